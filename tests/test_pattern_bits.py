"""Bits of token patterns against plain hashing."""

import hashlib
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ligandloom.functions import fingerprints as FP


def plain(toks, kind, n_bits, size):
    if toks is None:
        return None
    n = len(toks)
    if kind == "circular":
        grams = [f"{r}|" + " ".join(toks[max(0, i - r) : i + r + 1]) for r in range(size + 1) for i in range(n)]
    elif kind == "path":
        grams = ["p|" + " ".join(toks[i : i + k]) for k in range(1, size + 1) for i in range(n - k + 1)]
    else:
        grams = [f"a|{toks[i]}|{toks[i + d]}|{d}" for d in range(1, size + 1) for i in range(n - d)]
    return sorted({int(hashlib.md5(g.encode()).hexdigest()[:7], 16) % n_bits for g in grams})


@pytest.mark.parametrize("kind, size", [("circular", 2), ("circular", 11), ("path", 7), ("pair", 30)])
def test_equals_plain_hashing(spark, kind, size):
    rng = random.Random(size)
    words = ["a", "é", "Wort", "x" * 24, "y" * 50, "z" * 53, "長" * 19, "w" * 117, "v" * 500, *(f"w{k}" for k in range(300))]
    rows = [[rng.choice(words) for _ in range(n)] for n in [0, 1, 2, 3, 7, 31, 32, 200, 3000, 0]] + [None, ["same"] * 5000]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "id long, toks array<string>").repartition(3)
    for n_bits in (64, 1024, 100_000):
        how = {"circular": FP.circular_bits, "path": FP.path_bits, "pair": FP.pair_bits}[kind]
        got = dict(df.select("id", how(F.col("toks"), n_bits, size)).collect())
        assert got == {k: plain(r, kind, n_bits, size) for k, r in enumerate(rows)}


def test_full_texts_end_early():
    """All bits of a long text are set by a small part of its patterns."""
    toks = [f"w{k * k % 9973}" for k in range(1_000_000)]
    at = time.monotonic()
    (bits,) = FP.pattern_bits.bits_of(pa.array([toks]), 1024, FP.pattern_bits.pair, 30, "|", ["a|", *map(str, range(1, 31))]).to_pylist()
    assert bits == list(range(1024)) and time.monotonic() - at < 5
