"""A bitmap of fixed size that tells what a distributed table cannot hold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2^27 bits: 16 MB, whatever the table.
BITS = 27
_CHUNK = 32_768  # bits that one row of Spark's bitmap functions holds


def sieve_of(table: DataFrame, column: str) -> np.ndarray:
    """The bitmap of an integer column of bit numbers from 0 to 2^``BITS`` - 1; only chunks with a bit travel."""
    bit = F.col(column) + 1
    maps = table.select(F.bitmap_bucket_number(bit).alias("b"), F.bitmap_bit_position(bit).alias("p"))
    out = np.zeros(1 << (BITS - 3), np.uint8)
    size = _CHUNK // 8
    for b, bits in maps.groupBy("b").agg(F.bitmap_construct_agg("p")).toLocalIterator():
        out[(b - 1) * size : b * size] = np.frombuffer(bits, np.uint8)
    return out


def has(sieve: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Which bit numbers are set?"""
    return (sieve[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
