"""Fixed-width 0/1 features of a structure text.

A fingerprint is the sorted array of its set bits. All four kinds work on the
token sequence of the text; each pattern found sets the bit its hash names.
Tokenise once, then ask for several kinds in the same ``select``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, SparkSession, functions as F

from ligandloom.functions import pattern_bits

# ---- fixed values (patterns, sizes) ----
SMILES_TOKEN = r"\[[^\]]*\]|Br|Cl|%\d\d|[A-Za-z0-9]|[^\sA-Za-z0-9]"
WORD_TOKEN = r"[\p{L}\p{N}]+"
N_BITS = 1024
SIMILARITY_BITS = 2048
RADIUS = 2
PATH_LENGTH = 7
PAIR_DISTANCE = 30
KEY_PATTERNS = (
    "B", "Br", "Cl", "F", "I", "N", "O", "P", "S", "c", "n", "o", "s",
    "=", "#", "=O", "=N", "C#N", r"\(", r"\[", "@", r"\+", "-", "/",
    "CC", "CCC", "CO", "CN", "CS", "cc", "nc", "1", "2", "3", "4", r"\.",
)
KINDS = ("circular", "keys", "path", "pair")


def tokens(col: Column, pattern: str = SMILES_TOKEN) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(0))


def hash_bit(text: Column, n_bits: int) -> Column:
    """Bit of a pattern: first 28 bits of its md5, modulo the width."""
    number = F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("bigint")
    return (number % n_bits).cast("int")


def _pattern_bits(toks: Column, n_bits: int, *patterns) -> Column:
    @F.arrow_udf("array<int>")
    def run(lists: pa.Array) -> pa.Array:
        return pattern_bits.bits_of(lists, n_bits, *patterns)

    return run(toks)


def circular_bits(toks: Column, n_bits: int = N_BITS, radius: int = RADIUS) -> Column:
    """Every token with its surroundings of 0..radius tokens on both sides."""
    rings = [f"{r}|" for r in range(radius + 1)]
    return _pattern_bits(toks, n_bits, pattern_bits.circular, radius + 1, " ", rings)


def path_bits(toks: Column, n_bits: int = N_BITS, longest: int = PATH_LENGTH) -> Column:
    """Every run of 1..longest tokens."""
    return _pattern_bits(toks, n_bits, pattern_bits.path, longest, " ", ["p|"])


def pair_bits(toks: Column, n_bits: int = N_BITS, farthest: int = PAIR_DISTANCE) -> Column:
    """Every two tokens with their distance, up to ``farthest`` apart."""
    fixed = ["a|", *(str(d) for d in range(1, farthest + 1))]
    return _pattern_bits(toks, n_bits, pattern_bits.pair, farthest, "|", fixed)


def key_bits(col: Column, patterns: Sequence[str] = KEY_PATTERNS) -> Column:
    """Bit i is set when the text contains pattern i."""
    hits = [F.when(col.rlike(p), F.lit(i)) for i, p in enumerate(patterns)]
    return F.array_compact(F.array(*hits))


def fingerprint(
    key: Column,
    toks: Column,
    kind: str,
    n_bits: int = N_BITS,
    patterns: Sequence[str] = KEY_PATTERNS,
    radius: int = RADIUS,
    longest: int = PATH_LENGTH,
    farthest: int = PAIR_DISTANCE,
) -> Column:
    """Set bits of ``key``; ``toks`` is its token column."""
    if kind == "circular":
        return circular_bits(toks, n_bits, radius)
    if kind == "keys":
        return key_bits(key, patterns)
    if kind == "path":
        return path_bits(toks, n_bits, longest)
    if kind == "pair":
        return pair_bits(toks, n_bits, farthest)
    raise ValueError(f"unknown fingerprint kind {kind!r}, one of {KINDS}")


def width(kind: str, n_bits: int = N_BITS, patterns: Sequence[str] = KEY_PATTERNS) -> int:
    return len(patterns) if kind == "keys" else n_bits


def tanimoto(a: Column, b: Column) -> Column:
    """Shared over joint set bits; two empty fingerprints are alike."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    joint = F.size(a) + F.size(b) - shared
    return F.when(joint == 0, F.lit(1.0)).otherwise(shared / joint)


def bit_columns(on_bits: Column, n_bits: int, name: str = "X%d", first: int = 1) -> list[Column]:
    """0/1 columns, for export only."""
    return [
        F.array_contains(on_bits, F.lit(i)).cast("tinyint").alias(name % (i + first))
        for i in range(n_bits)
    ]


def vector_stage(
    spark: SparkSession, n_bits: int, in_col: str = "bit_names", out_col: str = "fp_vector"
) -> CountVectorizerModel:
    """Set bits -> sparse ML vector; the vocabulary is the bit numbers."""
    names = [str(i) for i in range(n_bits)]
    model = CountVectorizerModel.from_vocabulary(names, inputCol=in_col, outputCol=out_col)
    return model.setBinary(True)


def _sparse(lists: pa.Array, n_bits: int) -> pa.StructArray:
    """Lists of bits as sparse vectors in Spark's own layout; repeated bits count once, bits that are no feature do not."""
    if lists.null_count:
        raise ValueError("a row without bits has no vector")
    many = lists.value_lengths().to_numpy()
    bits = lists.flatten().fill_null(-1).to_numpy()
    inside, rising = (bits >= 0) & (bits < n_bits), np.r_[True, bits[1:] > bits[:-1], True]
    rising[np.cumsum(many)] = True  # where the next list begins
    if not (inside.all() and rising.all()):
        row = np.repeat(np.arange(len(lists)), many)
        place = np.unique(row[inside] * n_bits + bits[inside])
        row, bits = np.divmod(place, n_bits)
        many = np.bincount(row, minlength=len(lists))
    ends = pa.array(np.r_[0, np.cumsum(many)].astype(np.int32))
    indices = pa.ListArray.from_arrays(ends, pa.array(bits.astype(np.int32)))
    values = pa.ListArray.from_arrays(ends, pa.array(np.ones(len(bits))))
    kind, size = pa.array(np.zeros(len(lists), np.int8)), pa.array(np.full(len(lists), n_bits, np.int32))
    return pa.StructArray.from_arrays([kind, size, indices, values], ["type", "size", "indices", "values"])


def bit_vectors(on_bits: Column, n_bits: int, name: str) -> Column:
    """Set bits -> sparse ML vector, as ``vector_stage`` makes it; whole columns of integers, no text."""

    @F.arrow_udf(VectorUDT())
    def run(lists: pa.Array) -> pa.Array:
        return _sparse(lists, n_bits)

    return run(on_bits).alias(name, metadata={"ml_attr": {"num_attrs": n_bits, "attrs": {}}})


def bit_names(on_bits: Column) -> Column:
    return on_bits.cast("array<string>")
