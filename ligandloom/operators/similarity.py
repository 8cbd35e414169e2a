"""Tanimoto joins between a library and a set of reference fingerprints.

Finding the nearest of m references means comparing with all m, so the work is
rows x m by nature. The library is never shuffled or copied: the references are
walked in chunks of bounded size, sent to every task once, small ones together,
and a row carries its best so far from chunk to chunk. Any number of references, and any
repeated or missing keys, take the same way and give the same rows.

Bits are packed to 64-bit words and compared with numpy's population count. A
similarity cannot exceed min(n) / max(n) of the two numbers of set bits, so
whole bands of references of another size are passed over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ligandloom.functions.fingerprints import tanimoto
from ligandloom.operators import ranks
from ligandloom.session import settle, spread

#: Bytes of references that are sent at once, as one chunk or many small ones, and how often that is done before the rows
#: so far are written.
CHUNK_BYTES = 64 << 20
CHUNKS_AT_ONCE = 4
#: References and rows compared at once: few enough that their pairs stay in the cache of a core, and that the rows
#: of a part, which are put together by size, rule out nearly the same bands.
BAND = 256
ROWS_AT_ONCE = 256
WORDS_AT_ONCE = 3  # their common bits are counted in one byte
MEETING_WORDS = 256  # two sets that meet in a join cost about as much as so many packed words compared


def pack_bits(bits: pa.Array, n_bits: int) -> np.ndarray:
    """list<int> of set bits -> (rows, words) of uint64."""
    bits = bits.combine_chunks() if isinstance(bits, pa.ChunkedArray) else bits
    n_words = math.ceil(n_bits / 64)
    flat = np.zeros((len(bits), n_words * 64), dtype=np.uint8)
    sizes = np.asarray(bits.value_lengths().fill_null(0))
    rows = np.repeat(np.arange(len(bits)), sizes)
    flat[rows, np.asarray(bits.flatten())] = 1
    return np.packbits(flat, axis=1, bitorder="little").view(np.uint64)


def _ceiling(lo: int, hi: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Highest possible similarity of sets of lo ... hi bits and of those of each band, low ... high bits."""
    apart = np.where(hi < low, hi / np.maximum(low, 1), high / max(lo, 1))
    return np.where((hi >= low) & (high >= lo), 1.0, apart)


def _shared(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Numbers of common bits of all pairs of sets; both sides are (words, sets)."""
    out = np.zeros((one.shape[1], other.shape[1]), dtype=np.int32)
    both = np.empty(out.shape, dtype=np.uint64)
    few, more = np.empty(out.shape, dtype=np.uint8), np.empty(out.shape, dtype=np.uint8)
    for at in range(0, len(one), WORDS_AT_ONCE):
        for w in range(at, min(at + WORDS_AT_ONCE, len(one))):
            np.bitwise_and(one[w, :, None], other[w], out=both)
            np.bitwise_count(both, out=few if w == at else more)
            if w > at:
                few += more
        out += few
    return out


class References(NamedTuple):
    """Reference sets made ready to meet rows: bands of like size, with their columns of words."""

    n_ref: np.ndarray
    bands: list[np.ndarray]
    words: list[np.ndarray]
    low: np.ndarray
    high: np.ndarray


def references_of(ref: np.ndarray) -> References:
    n_ref = np.bitwise_count(ref).sum(axis=1, dtype=np.int32)
    by_size = np.argsort(n_ref, kind="stable")
    bands = [np.sort(by_size[at : at + BAND]) for at in range(0, len(ref), BAND)]
    low, high = (np.array([f(n_ref[b]) for b in bands]) for f in (np.min, np.max))
    return References(n_ref, bands, [np.ascontiguousarray(ref[b].T) for b in bands], low, high)


def best_match(
    lib: np.ndarray, ref: np.ndarray, best: np.ndarray | None = None, limit: float = np.inf
) -> tuple[np.ndarray, np.ndarray]:
    """Highest Tanimoto of each library row and the first reference that has it.

    With ``best``, the similarities so far, only higher ones count; the pick
    of a row that has none is -1. A row found above ``limit`` is not searched further.
    """
    return best_of_chunks(lib, [references_of(ref)], best, limit)


def best_of_chunks(
    lib: np.ndarray, chunks: Sequence[References], best: np.ndarray | None = None, limit: float = np.inf
) -> tuple[np.ndarray, np.ndarray]:
    """``best_match`` with the references of some chunks, which are numbered on from chunk to chunk."""
    sims = np.full(len(lib), -1.0) if best is None else best.copy()
    picks = np.full(len(lib), -1, dtype=np.int64)
    n_lib = np.bitwise_count(lib).sum(axis=1, dtype=np.int32)
    rows_by_size = np.argsort(n_lib, kind="stable")
    before = 0
    for chunk in chunks:
        found = np.full(len(lib), -1, dtype=np.int64)
        _meet(lib, n_lib, rows_by_size, chunk, sims, found, limit)
        better = found >= 0
        picks[better] = found[better] + before
        before += len(chunk.n_ref)
    return sims, picks


def _meet(
    lib: np.ndarray, n_lib: np.ndarray, rows_by_size: np.ndarray, chunk: References, sims: np.ndarray, picks: np.ndarray, limit: float
) -> None:
    """Raise ``sims`` of the rows that have a closer reference in the chunk, and set their ``picks``, -1 before."""
    n_ref, bands, words, low, high = chunk
    at_once = max(ROWS_AT_ONCE, ROWS_AT_ONCE * BAND // max(1, len(n_ref)))  # as many pairs with few references
    for at in range(0, len(lib), at_once):
        rows = rows_by_size[at : at + at_once]
        lo, hi = int(n_lib[rows[0]]), int(n_lib[rows[-1]])
        reach = _ceiling(lo, hi, low, high)
        for k in np.argsort(-reach, kind="stable").tolist():
            # an equal similarity may still have an earlier reference
            open_rows = rows[sims[rows] <= min(reach[k], limit)]
            if not len(open_rows):
                break  # the bands after this one reach no higher
            band, part = bands[k], np.ascontiguousarray(lib[open_rows].T)
            shared = _shared(part, words[k])
            joint = n_lib[open_rows, None] + n_ref[None, band] - shared
            sim = shared / np.maximum(joint, 1)
            if not lo and not low[k]:
                sim[joint == 0] = 1.0
            first = sim.argmax(axis=1)
            found, first = sim[np.arange(len(sim)), first], band[first]
            old = picks[open_rows]
            better = (found > sims[open_rows]) | ((found == sims[open_rows]) & (old >= 0) & (first < old))
            sims[open_rows[better]], picks[open_rows[better]] = found[better], first[better]


def _chunks(references: DataFrame, ref_key: str, ref_order: str, bits: str, n_bits: int, chunk_bytes: int):
    """The references in order, as lists of chunks (packed bits) of bounded size, each list with its keys.

    A list holds as many chunks as fit in ``CHUNK_BYTES``, one at least: sorting, collecting and sending cost a job each,
    which small chunks share.
    """
    refs = settle(
        references.select(
            F.col(ref_order).alias("_ord"), F.col(ref_key).cast("string").alias("_key"), F.col(bits).alias("_bits")
        )
    )
    size = refs.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce(F.length("_key"), F.lit(0)) + n_bits // 8 + F.coalesce(F.size("_bits"), F.lit(0)) * 4).alias("b"),
    ).first()
    n = math.ceil((size["b"] or 0) / chunk_bytes)
    step = math.ceil(size["n"] / n) if n else 1
    together = step * max(1, CHUNK_BYTES // chunk_bytes)
    if size["n"] > together:
        refs = settle(ranks.dense_number(refs, ["_ord", "_key"], "_no"))
        parts = [refs.where(F.col("_no").between(k + 1, k + together)) for k in range(0, size["n"], together)]
    else:
        parts = [refs] if n else []
    for part in parts:
        table = part.orderBy("_ord", "_key").toArrow()
        packed = pack_bits(table["_bits"], n_bits)
        yield [packed[at : at + step] for at in range(0, len(packed), step)], np.array(table["_key"].to_pylist(), dtype=object)


def nearest(
    library: DataFrame,
    references: DataFrame,
    ref_key: str,
    ref_order: str,
    bits: str = "on_bits",
    n_bits: int = 1024,
    chunk_bytes: int = CHUNK_BYTES,
    limit: float = math.inf,
) -> DataFrame:
    """Add ``max_sim`` and ``nearest`` (ties: lowest ``ref_order``) to each library row.

    Without references the similarity is 0. Repeated and missing keys on
    either side are rows like any other. Where only rows up to a ``limit`` are wanted, the search for a row ends with the
    first band of references that holds one above it; rows above the limit then have a similarity above it, not the highest.
    """
    schema = T.StructType(
        [
            *library.schema.fields,
            T.StructField("max_sim", T.DoubleType()),
            T.StructField("nearest", T.StringType()),
        ]
    )
    sc = library.sparkSession.sparkContext
    found = library
    walked = 0
    for chunks in _chunks(references, ref_key, ref_order, bits, n_bits, chunk_bytes):
        sent, start = sc.broadcast(chunks), walked == 0

        def scan(batches: Iterator[pa.RecordBatch], sent=sent, start=start) -> Iterator[pa.RecordBatch]:
            refs, keys = sent.value
            ready = [references_of(ref) for ref in refs]
            for batch in batches:
                columns = list(batch.columns) if start else batch.columns[:-2]
                best = None if start else batch.column("max_sim").to_numpy(zero_copy_only=False)
                sims, picks = best_of_chunks(pack_bits(batch.column(bits), n_bits), ready, best, limit)
                names = keys[np.maximum(picks, 0)]
                if not start:
                    old = np.array(batch.column("nearest").to_pylist(), dtype=object)
                    names = np.where(picks >= 0, names, old)
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(sims), pa.array(names, pa.string())], names=schema.names
                )

        found = found.mapInArrow(scan, schema)
        walked += 1
        if walked % CHUNKS_AT_ONCE == 0:
            found = settle(found)
    if not walked:
        return library.withColumn("max_sim", F.lit(0.0)).withColumn("nearest", F.lit(None).cast("string"))
    return found


def _rare_first(sets: DataFrame, n_bits: int) -> Column:
    """Place of each bit in ascending frequency: an array of ``n_bits`` numbers."""
    counted = dict(sets.select(F.explode("_set").alias("b")).groupBy("b").count().collect())  # at most n_bits rows
    order = sorted(range(n_bits), key=lambda b: (counted.get(b, 0), b))
    place = [0] * n_bits
    for k, b in enumerate(order):
        place[b] = k
    return F.lit(place)


def _sets(df: DataFrame, bits: str) -> DataFrame:
    """Distinct bit sets; a missing one is empty."""
    return df.select(F.coalesce(F.col(bits).cast("array<int>"), F.array().cast("array<int>")).alias("_set")).distinct()


def _prefixes(sets: DataFrame, place: Column, limit: float) -> DataFrame:
    """Each set once for each bit of its prefix: its rarest bits, so many that a set closer than the limit shares one.

    The empty set, which is like itself, has a bit of its own.
    """
    n = F.size("_set")
    least = F.ceil(n * F.lit(limit) - 1e-9)  # a closer set shares at least so many bits
    by_place = F.array_sort(F.transform("_set", lambda b: F.struct(F.get(place, b).alias("p"), b.alias("b"))))
    rare = F.slice(F.transform(by_place, lambda x: x["b"]), F.lit(1), F.greatest(n - least + 1, F.lit(1)).cast("int"))
    return sets.withColumn("_bit", F.explode(F.when(n == 0, F.array(F.lit(-1))).otherwise(rare)))


def _meetings(lib: DataFrame, ref: DataFrame, on: list[str]) -> float:
    """Pairs of rows that an equality join would make, from counts of its keys."""
    mine, theirs = (df.groupBy(*on).agg(F.count(F.lit(1)).cast("double").alias(n)) for df, n in ((lib, "_n"), (ref, "_m")))
    return mine.join(theirs, on).agg(F.sum(F.col("_n") * F.col("_m"))).first()[0] or 0.0


def close_sets(library: DataFrame, references: DataFrame, limit: float, bits: str = "on_bits", n_bits: int = 1024) -> DataFrame:
    """Distinct bit sets (``_set``) of the library that have a reference closer than ``limit``, for two large sides.

    Sets closer than the limit share one of their rarest bits and have sizes within a factor of it, so both sides can
    meet on (bit, band of sizes), the references in the bands next to theirs as well; the overlap of such candidates is
    counted exactly. Equal sets are one row on either side. Where bits are so dense that this join would meet pairs more
    often than a comparison of all packed sets costs, these are walked as in ``nearest``, each set up to its first close
    reference. Both ways find the same sets.
    """
    if not 0 <= limit < 1:
        raise ValueError("the limit has to be from 0 up to, but not including, 1")
    lib_sets, ref_sets = settle(_sets(library, bits)), settle(_sets(references, bits))
    place = _rare_first(lib_sets, n_bits)
    lib, ref, on = _prefixes(lib_sets, place, limit), _prefixes(ref_sets, place, limit).withColumnRenamed("_set", "_ref"), ["_bit"]
    if limit > 0:
        width = -math.log(limit) * 1.0001  # bands a little wider than the factor absorb rounding

        def band(column: str) -> Column:
            return F.floor(F.log(F.greatest(F.size(column), F.lit(1))) / F.lit(width))

        lib = lib.withColumn("_band", band("_set"))
        ref = ref.withColumn("_band", F.explode(F.array(*[band("_ref") + k for k in (-1, 0, 1)])))
        on = ["_bit", "_band"]
    words = float(lib_sets.count()) * ref_sets.count() * math.ceil(n_bits / 64)
    if words < _meetings(lib, ref, on) * MEETING_WORDS:
        refs = ref_sets.select("_set", F.xxhash64("_set").alias("_no"), F.lit("").alias("_name"))
        found = nearest(spread(lib_sets), refs, "_name", "_no", "_set", n_bits, limit=limit)
        return found.where(F.col("max_sim") > limit).select("_set")
    near = lib.join(ref, on)
    small, large = F.least(F.size("_set"), F.size("_ref")), F.greatest(F.size("_set"), F.size("_ref"))
    near = near.where((large == 0) | (small > F.lit(limit) * large))
    return near.where(tanimoto(F.col("_set"), F.col("_ref")) > limit).select("_set").distinct()


def far_rows(library: DataFrame, references: DataFrame, limit: float, bits: str = "on_bits", n_bits: int = 1024) -> DataFrame:
    """Library rows without a reference closer than ``limit``: those that ``dissimilar(nearest(...), limit)`` keeps."""
    close = close_sets(library, references, limit, bits, n_bits)
    own = F.coalesce(F.col(bits).cast("array<int>"), F.array().cast("array<int>"))
    return library.withColumn("_set", own).join(close, "_set", "left_anti").drop("_set")


def dissimilar(found: DataFrame, limit: float) -> DataFrame:
    """Rows of ``nearest`` whose closest reference is not closer than ``limit``."""
    return found.where(F.col("max_sim") <= limit)


def similarity_pairs(top: DataFrame, key: str, bits: str = "on_bits", k: int = 20) -> DataFrame:
    """All pairs of a short, already ranked list; more than ``k`` rows are refused, not cut."""
    short = top.select(F.col(key).alias("k"), F.col(bits).alias("b"))
    rows = short.limit(k + 1).agg(F.collect_list(F.struct("k", "b")).alias("l"))
    rows = rows.where(
        F.when(F.size("l") <= k, True).otherwise(F.raise_error(F.lit(f"more than {k} rows to pair")).cast("boolean"))
    )
    pairs = rows.withColumn("x", F.explode("l")).withColumn("y", F.explode("l"))
    return pairs.select(
        F.col("x.k").alias("a"), F.col("y.k").alias("b"), tanimoto(F.col("x.b"), F.col("y.b")).alias("sim")
    )


def similarity_matrix(pairs: DataFrame, names: list[str]) -> DataFrame:
    """Wide print form of ``similarity_pairs``; ``names`` are the short list."""
    return pairs.groupBy("a").pivot("b", names).agg(F.first("sim"))
