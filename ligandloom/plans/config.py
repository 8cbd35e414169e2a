"""Settings of a run."""

from __future__ import annotations

from dataclasses import dataclass

from ligandloom.functions import fingerprints as FP
from ligandloom.operators import matching


@dataclass(frozen=True)
class Config:
    kind: str = "circular"
    n_bits: int = FP.SIMILARITY_BITS
    radius: int = FP.RADIUS
    token_pattern: str = FP.SMILES_TOKEN
    test_share: float = 0.2
    seed: int = 42
    trees: int = 300
    depth: int = 10
    use_second_source: bool = False
    add_decoys: bool = False
    decoy_multiplier: float = 1.0
    search_models: bool = False
    search_trials: int | None = None
    search_budget_sec: float | None = None
    max_similarity: float = matching.MAX_SIMILARITY
