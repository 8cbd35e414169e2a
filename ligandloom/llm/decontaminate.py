"""Benchmark passages in documents.

An item of w words is looked for in every window of w words of a text (in the
whole text where that has fewer). A window and an item are alike by the
weighted Jaccard similarity of their five-word shingles, where a shingle's weight
is how often it occurs; an item of fewer words is one shingle.

1. A window can only be alike enough if eight ninths of its shingles occur in
   items of its size, so the windows for which this holds are fingerprinted, all
   of them: SimHash by majority over the window's shingle hashes.
2. Multi-index Hamming blocks find the items of that size: radius + 1 blocks, of
   which two fingerprints within the radius share at least one.
3. The exact similarity of the words themselves decides.

Windows as alike as 0.8 share eight ninths of their shingles; their fingerprints
differ in about 10 of 64 bits with a deviation of 3. The radius of 24 is five deviations away.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ligandloom.llm.common import arrow_rows, raw, words_of
from ligandloom.llm.tokens import Tokens, grouped, shingles, tokenise

WIDTH = 5
SIMILARITY = 0.8
RADIUS = 24
#: Bytes of item texts in one index; more items are searched in several passes.
INDEX_BYTES = 8 << 20
#: Window positions that are fingerprinted at once.
WINDOWS = 1 << 15


class Index(NamedTuple):
    ids: list[int]
    words: list[list[bytes]]
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # width -> sorted shingles, their sizes from/to
    sizes: dict[int, np.ndarray]  # width -> item sizes, as grams refers to them
    blocks: dict[int, list[dict[int, np.ndarray]]]  # item size -> for each block: value -> item places
    prints: np.ndarray


def majority(rows: np.ndarray) -> np.ndarray:
    """SimHash of each row of shingle hashes."""
    bits = np.unpackbits(np.ascontiguousarray(rows.astype(">u8")).view(np.uint8).reshape(*rows.shape, 8), axis=-1)
    counts = bits.reshape(rows.shape[0], rows.shape[1], 64).sum(axis=1, dtype=np.int32)
    return np.packbits(2 * counts > rows.shape[1], axis=1).view(">u8").ravel().astype(np.uint64)


def _cuts(radius: int) -> list[tuple[int, int]]:
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return list(zip(edges, edges[1:]))


def _block(prints: np.ndarray, cut: tuple[int, int]) -> np.ndarray:
    return (prints >> np.uint64(cut[0])) & np.uint64((1 << (cut[1] - cut[0])) - 1)


def build_index(items: list[tuple[int, bytes]], radius: int = RADIUS) -> Index:
    items = [(i, w) for i, w in ((i, words_of(t)) for i, t in items) if w]
    ids, words = [i for i, _ in items], [w for _, w in items]
    prints = np.zeros(len(items), np.uint64)
    found: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
    by_size: dict[int, list[int]] = defaultdict(list)
    for at, w in enumerate(words):
        width = min(WIDTH, len(w))
        grams = shingles(tokenise([b" ".join(w)]).hashes, width)
        prints[at] = majority(grams[None, :])[0]
        by_size[len(w)].append(at)
        for g in grams.tolist():
            found[width][g].add(len(w))
    grams, sizes = {}, {}
    for width, seen in found.items():
        keys = np.array(sorted(seen), np.uint64)
        runs = [sorted(seen[int(k)]) for k in keys]
        ends = np.cumsum([len(x) for x in runs])
        grams[width] = (keys, np.r_[0, ends[:-1]], ends)
        sizes[width] = np.array([s for x in runs for s in x])
    blocks = {}
    for size, places in by_size.items():
        places = np.array(places)
        blocks[size] = []
        for cut in _cuts(radius):
            values = _block(prints[places], cut)
            blocks[size].append({int(v): places[values == v] for v in np.unique(values)})
    return Index(ids, words, grams, sizes, blocks, prints)


def weighted_jaccard(a: list[bytes], b: list[bytes], width: int) -> float:
    x, y = (Counter(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) for w in (a, b))
    return sum((x & y).values()) / sum((x | y).values())


def _windows(index: Index, tokens: Tokens, similarity: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(item size, text, first word, fingerprint) of the windows that hold enough shingles of items of that size."""
    first, n = tokens.first, np.diff(tokens.first)
    for width, (keys, lo, hi) in index.grams.items():
        grams = shingles(tokens.hashes, width)
        if not len(grams):
            continue
        sieve = np.zeros(1 << 20, bool)
        sieve[(keys >> np.uint64(44)).astype(np.int64)] = True
        at = np.flatnonzero(sieve[(grams >> np.uint64(44)).astype(np.int64)])
        place = np.searchsorted(keys, grams[at])
        real = keys[np.minimum(place, len(keys) - 1)] == grams[at]
        at, place = at[real], place[real]
        doc = np.searchsorted(first, at, "right") - 1
        inside = at + width <= first[doc + 1]
        at, place, doc = at[inside], place[inside], doc[inside]
        if not len(at):
            continue
        run = hi[place] - lo[place]
        many = np.repeat(np.arange(len(at)), run)
        size = index.sizes[width][np.repeat(lo[place] - np.r_[0, np.cumsum(run)[:-1]], run) + np.arange(run.sum())]
        for w in np.unique(size):
            hit = many[size == w]
            p, d = at[hit], doc[hit]
            span = np.minimum(w, n[d])
            low = np.maximum(first[d], p - (span - width))
            high = np.minimum(p, first[d + 1] - span)
            # the ranges of a text overlap: keep what each adds to the one before
            low = np.maximum(low, np.r_[0, np.maximum.accumulate(high)[:-1] + 1])
            count = np.maximum(high - low + 1, 0)
            start = np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            d = np.repeat(d, count)
            for length in np.unique(np.minimum(w, n[d])):
                mine = np.minimum(w, n[d]) == length
                s, e = start[mine], d[mine]
                m = int(length) - width + 1
                # of two sums of weights x and y, the shared part must be similarity / (1 + similarity) of x + y
                need = similarity / (1 + similarity) * (m + int(w) - width + 1) - 1e-9
                enough = np.searchsorted(p, s + m) - np.searchsorted(p, s) >= need
                s, e = s[enough], e[enough]
                step = max(1, WINDOWS * 32 // m)
                for k in range(0, len(s), step):
                    rows = grams[s[k : k + step, None] + np.arange(m)]
                    yield int(w), e[k : k + step], s[k : k + step], majority(rows)


def find_leaks(
    index: Index, texts: list[bytes], radius: int = RADIUS, similarity: float = SIMILARITY
) -> list[tuple[int, int, int, int, int, float]]:
    """(text, item place, first word, words, Hamming distance, similarity) of the best window of each text and item."""
    tokens = tokenise(texts)
    best: dict[tuple[int, int], tuple] = {}
    for w, doc, start, prints in _windows(index, tokens, similarity):
        pairs = []
        for table, cut in zip(index.blocks[w], _cuts(radius)):
            values = _block(prints, cut)
            for v in np.unique(values).tolist():
                if v in table:
                    rows = np.flatnonzero(values == v)
                    pairs.append(np.repeat(rows, len(table[v])) * len(index.ids) + np.tile(table[v], len(rows)))
        if not pairs:
            continue
        row, item = np.divmod(np.unique(np.concatenate(pairs)), len(index.ids))
        apart = np.bitwise_count(prints[row] ^ index.prints[item])
        near = apart <= radius
        for k, i, h in zip(row[near].tolist(), item[near].tolist(), apart[near].tolist()):
            d, s = int(doc[k]), int(start[k])
            count = min(w, int(tokens.first[d + 1] - tokens.first[d]))
            window = [
                tokens.data[a:b].tobytes()
                for a, b in zip(tokens.starts[s : s + count], tokens.ends[s : s + count])
            ]
            alike = weighted_jaccard(window, index.words[i], min(WIDTH, w))
            if alike >= similarity:
                new = (-alike, s - int(tokens.first[d]), count, h)
                if (d, i) not in best or new < best[d, i]:
                    best[d, i] = new
    return [(d, i, s, count, h, -alike) for (d, i), (alike, s, count, h) in sorted(best.items())]


def _passes(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, bytes]]]:
    """The items in slices of bounded size, cut by a hash of the key."""
    some = items.where(F.col(key).isNotNull()).select(F.col(key).alias("i"), raw(text).alias("t"))
    size = some.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    cuts = -(-size // INDEX_BYTES)
    for k in range(cuts):
        part = some.where(F.pmod(F.xxhash64("i"), F.lit(cuts)) == k)
        yield [(r.i, bytes(r.t or b"")) for r in part.collect()]


def leaks(
    docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text",
    item_key: str = "item_id", radius: int = RADIUS, similarity: float = SIMILARITY,
) -> DataFrame:
    """One row for each document and item it holds: the window that is most alike, the first of several.

    Null and empty texts and items match nothing; ids may be of any type. Documents without leaks
    have no row; rows without an id are reported with a null id. A table of
    items beyond ``INDEX_BYTES`` is searched slice by slice.
    """
    schema = (
        f"doc_id {docs.schema[key].dataType.simpleString()}, item_id {items.schema[item_key].dataType.simpleString()}, first_word bigint, n_words bigint, "
        "hamming int, similarity double"
    )
    body = docs.select(F.col(key), raw(text).alias("body"))
    out = None
    for part in _passes(items, item_key, item_text):
        index = build_index(part, radius)

        def search(rows: Iterable[tuple], index: Index = index) -> Iterator[tuple]:
            for group in grouped(rows, 1):
                for d, i, *rest in find_leaks(index, [x[1] or b"" for x in group], radius, similarity):
                    yield (group[d][0], index.ids[i], *rest)

        found = arrow_rows(body, search, schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean_column(index: Index, text: str | Column) -> Column:
    """True where a text holds no item of the index."""

    @F.arrow_udf("boolean")
    def run(texts: pa.Array) -> pa.Array:
        out: list[bool] = []
        for group in grouped(((t.as_py(),) for t in texts), 0):
            bad = {d for d, *_ in find_leaks(index, [x[0] or b"" for x in group])}
            out += [k not in bad for k in range(len(group))]
        return pa.array(out, pa.bool_())

    return run(raw(text))


def without_leaks(
    docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id"
) -> DataFrame:
    """The rows of ``docs`` that hold no item; all columns stay whatever their names."""
    for part in _passes(items, item_key, item_text):
        docs = docs.where(clean_column(build_index(part), text))
    return docs
