"""Language-model scores: exact word counts for the base, a probabilistic suffix tree for the model.

Words. The training documents' words are counted exactly in a distributed table, which the base and the model share.

Model. A suffix tree over words, whose contexts are up to ``WORDS`` words; a text begins and ends with a word
of its own. Every run of words that the training documents hold ``LEAST`` times is counted, whatever their size. Tasks send each run's partition
and the next 32 bits of its hash; what comes twice makes a bitmap, and a second scan counts exactly what that lets through. A
context enters the tree if its next words diverge enough from what its longest suffix foretells. Distributions are
smoothed with that suffix's, down to the word counts. The logarithm of a probability is a sum over the runs that end at a
word. The ``HEAD`` most frequent words and runs are looked up inside the tasks; the others in their hash partitions. What
meets there are numbers packed many in a row, in the order of their hashes.
A bitmap of fixed size keeps at home what is not in the tables; where it is full, more travels, with the same result.

Spelling. What the words leave to unseen ones is shared out by a tree over the UTF-8 bytes of the lower-cased words with
one space between them, and one end. Its contexts have up to ``DEPTH`` symbols and make up at least 1 / ``RARE`` of
the corpus, so that it fits a task. It is run as an automaton whose state is the longest context that ends here;
thousands of stretches of text take a step at a time. A stretch starts ``DEPTH`` symbols early, which fixes its
state, as no context is longer.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ligandloom.llm.common import arrow_rows, fold, raw, words_of
from ligandloom.llm.phrases import bucket_of
from ligandloom.llm.sieve import BITS, has
from ligandloom.llm.tokens import grouped, mix, tokenise, unmix
from ligandloom.session import discard, shuffles_dropped, stored

#: Words of a context, and how often a run of words must occur.
WORDS, LEAST = 3, 2
DEPTH = 5
RARE = 131_072
#: Least divergence of a context: nats of likelihood it gains for each next symbol it has to store.
TEST = 1.0
HEAD = 1 << 20
CHUNKS = (1 << 24) + 1  # more than the chunks of texts in a task; odd, so that these go to all partitions
SHELF = 20  # bits of a hash that tell where the common rows begin which share them
START_WORD, END_WORD = (mix(np.array([k], np.uint64))[0] for k in (1, 2))
END = 0xFF  # no UTF-8 text has this byte; it also stands before a text
LANES = 2048
#: Bytes of text for each hash partition.
PART = 8 << 20
#: The runs are counted in so many steps, one after the other.
SHARES = 2
#: Numbers that a task holds before it sends, and numbers of a row it sends.
GRAMS_HELD, KEYS_HELD, RUNS_HELD, ASKED_HELD = 2_000_000, 2_000_000, 1_000_000, 250_000
ROW_KEYS, ROW_RUNS = 16_384, 4096
TAKEN = 256  # texts that a task has as Python objects at once


def stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of texts, each with ``DEPTH`` ends before it and one after; where each begins, and ends."""
    bodies = [b" ".join(words_of(t)) for t in texts]
    pad = bytes([END]) * DEPTH
    data = np.frombuffer(b"".join(pad + b + pad[:1] for b in bodies), np.uint8)
    sizes = np.array([len(b) + 1 for b in bodies], np.int64)
    stops = np.cumsum(sizes + DEPTH)
    return data, stops - sizes, stops


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of ``DEPTH`` symbols and the next one, oldest first in the high bits, and their counts."""
    data, _, stops = stream(texts)
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    n = len(data) - DEPTH
    pairs = data.astype(np.uint64)
    pairs = pairs[:-1] << np.uint64(8) | pairs[1:]
    key = pairs[:n].copy()
    for k in range(2, DEPTH, 2):  # DEPTH is odd
        key <<= np.uint64(16)
        key |= pairs[k : k + n]
    real = np.ones(len(data), bool)
    real[(stops[:, None] - 1 - np.arange(DEPTH)).ravel()] = False  # these reach into the next text
    return np.unique(key[real[:n]], return_counts=True)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


class Tree(NamedTuple):
    symbols: np.ndarray  # all that occur in it, sorted
    depth: np.ndarray  # of each context in the tree; the first is the empty one
    context: np.ndarray  # its symbols, the newest in the low byte
    start: np.ndarray  # where in next and count its part begins, and the end of all
    next: np.ndarray  # places in ``symbols`` of what was seen after it
    count: np.ndarray


def _suffix(depth: int, context: int, known: dict) -> int:
    """Place of the longest proper suffix that is known."""
    for d in range(depth - 1, -1, -1):
        at = known.get((d, context & ((1 << 8 * d) - 1)))
        if at is not None:
            return at
    raise KeyError(context)


def _smoothed(parent: np.ndarray, symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Probability of each symbol, and last that of any one symbol which never occurs."""
    total, kinds = counts.sum(), len(counts)
    out = parent * (kinds / (total + kinds))
    out[symbols] += counts / (total + kinds)
    return out


def grow_tree(depth: np.ndarray, context: np.ndarray, symbol: np.ndarray, count: np.ndarray) -> Tree:
    """The tree from the next-symbol counts of the frequent contexts."""
    if not (depth == 0).any():
        depth, context, symbol, count = (np.r_[a, b] for a, b in zip((depth, context, symbol, count), (0, 0, END, 1)))
    order = np.lexsort((symbol, context, depth))
    depth, context, symbol, count = (x[order].astype(np.int64) for x in (depth, context, symbol, count))
    symbols, place = np.unique(symbol, return_inverse=True)
    cut = np.flatnonzero(np.r_[True, (depth[1:] != depth[:-1]) | (context[1:] != context[:-1])])
    # shortest first: a context is held against the longest suffix kept so far
    keep: dict[tuple[int, int], int] = {}
    spread: list[np.ndarray] = []
    parts: list[tuple[int, int]] = []
    base = np.full(len(symbols) + 1, 1 / 256, np.float32)
    for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(depth)]):
        d, c = int(depth[lo]), int(context[lo])
        parent = spread[_suffix(d, c, keep)] if d else base
        part = count[lo:hi]
        if d and float((part * np.log(part / part.sum() / parent[place[lo:hi]])).sum()) < TEST * (hi - lo):
            continue
        keep[d, c] = len(spread)
        spread.append(_smoothed(parent, place[lo:hi], part))
        parts.append((lo, hi))
    picked = np.concatenate([np.arange(lo, hi) for lo, hi in parts])
    return Tree(
        symbols, np.array([d for d, _ in keep]), np.array([c for _, c in keep]),
        np.cumsum([0, *(hi - lo for lo, hi in parts)]), place[picked], count[picked],
    )


class Automaton:
    """Longest-suffix states of a tree: its contexts and all their prefixes."""

    def __init__(self, tree: Tree):
        kept = {(int(d), int(c)): k for k, (d, c) in enumerate(zip(tree.depth, tree.context))}
        column = {int(x): k for k, x in enumerate(tree.symbols)}
        order = sorted({(d - k, c >> 8 * k) for d, c in kept for k in range(d + 1)})  # suffixes come before
        at = {s: k for k, s in enumerate(order)}
        width = len(column) + 1
        self.column = np.full(256, len(column), np.int32)
        self.column[tree.symbols] = np.arange(len(column))
        children: dict[tuple, list] = {}
        for k, (d, c) in enumerate(order):
            if d and c & 255 in column:
                children.setdefault((d - 1, c >> 8), []).append((column[c & 255], k))
        spread = np.empty((len(order), width), np.float32)
        step = np.zeros((len(order), width), np.int32)
        base = np.full(width, 1 / 256, np.float32)
        for k, (d, c) in enumerate(order):
            back = _suffix(d, c, at) if d else 0
            spread[k], step[k] = (spread[back], step[back]) if d else (base, step[0])
            place = kept.get((d, c))
            if place is not None:
                lo, hi = tree.start[place], tree.start[place + 1]
                spread[k] = _smoothed(spread[k], tree.next[lo:hi], tree.count[lo:hi])
            for symbol, child in children.get((d, c), ()):
                step[k, symbol] = child
        step *= width
        self.step, self.spread = step.ravel(), np.log10(spread, out=spread).ravel()

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text."""
        data, starts, stops = stream(texts)
        sums = self.sums(data)
        return sums[stops] - sums[starts]

    def spelled(self, texts: list[bytes], chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each word with the symbol after it, or of the chosen ones, and of the end of each text without words."""
        data, starts, stops = stream(texts)
        full = stops - starts > 1
        last = data == 0x20
        last[stops[full] - 1] = True
        after = np.flatnonzero(last) + 1
        begins = np.sort(np.r_[starts[full], np.flatnonzero(data == 0x20) + 1])
        if chosen is not None:
            begins, after = begins[chosen], after[chosen]
        n = len(begins)
        begins, after = np.r_[begins, starts[~full]], np.r_[after, stops[~full]]
        # one stretch behind the other, each with the symbols before it
        sizes = after - begins + DEPTH
        ends = np.cumsum(sizes)
        sums = self.sums(data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(after - ends, sizes)])
        found = sums[ends] - sums[ends - sizes + DEPTH]
        empty = np.zeros(len(texts))
        empty[~full] = found[n:]
        return found[:n], empty

    def sums(self, data: np.ndarray) -> np.ndarray:
        """log10 probability of the symbols before each place of a stream."""
        if not len(data):
            return np.zeros(1)
        lanes = max(1, min(LANES, len(data) // 64))
        length = -(-len(data) // lanes)
        fill = np.full(DEPTH, END, np.uint8)
        padded = self.column[np.r_[fill, data, np.full(lanes * length - len(data), END, np.uint8)]]
        view = np.lib.stride_tricks.sliding_window_view(padded, length + DEPTH)[::length]
        symbols = np.ascontiguousarray(view.T)
        out = np.empty((length, lanes), np.float32)
        state = np.zeros(lanes, np.int32)
        for k in range(length + DEPTH):
            place = state + symbols[k]
            if k >= DEPTH:
                self.spread.take(place, out=out[k - DEPTH])
            state = self.step.take(place)
        return np.r_[0.0, np.cumsum(out.T.ravel()[: len(data)], dtype=np.float64)]


_AUTOMATA: dict[bytes, Automaton] = {}


def automaton_of(tree: Tree) -> Automaton:
    """Built once in a worker and used for all its tasks."""
    mark = xxhash.xxh64_digest(
        b"".join(x.tobytes() for x in (tree.symbols, tree.depth, tree.context, tree.start, tree.next, tree.count))
    )
    if mark not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[mark] = Automaton(tree)
    return _AUTOMATA[mark]


def word_runs(texts: list[bytes], longest: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Text of each word, its place among all words or -1 for a start and -2 for an end, and hashes of runs from it on.

    The hash of a run is made of those of the run without its last and without its first word.
    """
    tokens = tokenise(texts)
    sizes = np.diff(tokens.first)
    doc = np.repeat(np.arange(len(texts)), sizes + 2)
    ends = np.cumsum(sizes + 2) - 1
    place = np.zeros(len(doc), np.int64)
    place[ends - sizes - 1], place[ends] = -1, -2
    inner = place == 0
    place[inner] = np.arange(len(tokens.hashes))
    words = np.where(place == -1, START_WORD, END_WORD)
    words[inner] = tokens.hashes
    runs = [words]
    for _ in range(longest - 1):
        runs.append(joined(runs[-1][:-1], runs[-1][1:]))
    return doc, place, runs


SPREAD = np.uint64(0x9E3779B97F4A7C15)


def joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * SPREAD + second)


def second_of(run: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The hash that ``joined`` put behind ``first`` to make ``run``."""
    return unmix(run) - first * SPREAD


def planes(x: np.ndarray) -> bytes:
    """Numbers as their lowest bytes, then their next ones, and so on: equal bytes lie together and shrink when sent."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unplaned(packed: np.ndarray, width: int) -> list[np.ndarray]:
    """The ``width`` columns whose ``planes`` were put one behind the other."""
    return [np.ascontiguousarray(x.T).view("<u8").ravel() for x in packed.reshape(width, 8, -1)]


def packed_of(key: np.ndarray, *columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers in ascending order of the first, of which only the steps are kept."""
    return b"".join(map(planes, (np.diff(key, prepend=key.dtype.type(0)), *(c.view(np.uint64) for c in columns))))


def unpacked(rows: Iterable[bytes], width: int) -> list[np.ndarray]:
    """The columns of rows that ``packed_of`` made, one behind the other."""
    parts = [unplaned(np.frombuffer(r, np.uint8), width) for r in rows]
    if not parts:
        return [np.empty(0, np.uint64) for _ in range(width)]
    key, *columns = zip(*parts)
    return [np.concatenate([np.cumsum(k, dtype=np.uint64) for k in key]), *map(np.concatenate, columns)]


def dealt(kind: int, parts: int, key: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    """(bucket, kind, number, packed): numbers for the hash partition of their key, many in a row."""
    order = np.argsort(key)
    key, columns = key[order], [c[order] for c in columns]
    bucket = bucket_of(key, parts)
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)]):
        for k in range(a, b, ROW_RUNS):
            part = slice(k, min(b, k + ROW_RUNS))
            yield int(bucket[a]), kind, part.stop - k, packed_of(key[part], *(c[part] for c in columns))


DEALT = "bucket bigint, kind int, number bigint, packed binary"


def together(rows: DataFrame, tasks: int, key: str = "bucket", *order: str) -> DataFrame:
    """Rows of equal keys, one key after the other; the keys go to ``tasks`` tasks in turn."""
    return rows.repartitionById(max(1, tasks), (F.col(key) % max(1, tasks)).cast("int")).sortWithinPartitions(key, *order)


def met(rows: DataFrame, tasks: int, widths: dict[int, int], answer: Callable[..., Iterator[tuple]]) -> DataFrame:
    """Dealt rows that ``answer`` makes of the columns, by kind, that each hash partition was dealt."""

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for _, mine in groupby(rows, key=lambda r: r[0]):
            held: dict[int, list[bytes]] = {kind: [] for kind in widths}
            for _, kind, _, packed in mine:
                held[kind].append(packed)
            yield from answer(*(unpacked(held.pop(kind), width) for kind, width in widths.items()))

    return arrow_rows(together(rows, tasks), run, DEALT, batch=64)


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """Bit numbers of hashes in a bitmap; hashes of one partition have neighbouring bits."""
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def slice_of(bits: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The bytes of a bitmap from the first of some bits to the last, and where they begin."""
    if len(bits):
        at = int(bits.min()) >> 3
        out = np.zeros((int(bits.max()) >> 3) + 1 - at, np.uint8)
        np.bitwise_or.at(out, (bits >> 3) - at, np.left_shift(1, bits & 7).astype(np.uint8))
        yield at, out.tobytes()


def bitmap_of(slices: DataFrame) -> np.ndarray:
    """The bitmap of fixed size whose parts are the rows (at, bits)."""
    out, table = np.zeros(1 << (BITS - 3), np.uint8), slices.toArrow()
    for at, bits in zip(table["at"].to_pylist(), table["bits"]):
        out[at : at + len(bits.as_buffer())] |= np.frombuffer(bits.as_buffer(), np.uint8)
    return out


def whole_runs(texts: list[bytes], sizes: Iterable[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(size, where its runs begin, their hashes, hashes of all runs by size) of runs that stay in one text."""
    sizes = list(sizes)
    doc, _, runs = word_runs(texts, max(sizes))
    for size in sizes:
        at = np.flatnonzero(doc[: len(doc) - size + 1] == doc[size - 1 :]) if len(doc) >= size else np.zeros(0, np.int64)
        yield size, at, runs[size - 1][at], runs


def parts_of(keys: np.ndarray) -> np.ndarray:
    """Where equal neighbours begin."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])


def _sums(columns: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Rows (key, facts of the key, ..., number) with equal keys added up."""
    key, *facts, number = (np.concatenate(x) for x in columns)
    order = np.argsort(key)
    key = key[order]
    first = parts_of(key)
    number = np.add.reduceat(number[order], first) if len(key) else number
    return [key[first], *[f[order[first]] for f in facts], number]


def partitions(train: DataFrame) -> int:
    """Hash partitions for the runs of the column ``body``, by its bytes: a power of two."""
    size = train.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    return 1 << max(0, -(-size // PART) - 1).bit_length()


#: Spreads the two symbols by which runs of symbols are dealt; odd, so that it can be undone.
STIR = 0x9E37


def turned(g: np.ndarray) -> np.ndarray:
    """Runs of symbols as keys that begin with the two newest symbols of the context."""
    last = (g >> np.uint64(8) & np.uint64(0xFFFF)) * np.uint64(STIR) & np.uint64(0xFFFF)
    return last << np.uint64(48) | (g & np.uint64(0xFF)) << np.uint64(24) | g >> np.uint64(24)


def turned_back(key: np.ndarray) -> np.ndarray:
    last = (key >> np.uint64(48)) * np.uint64(pow(STIR, -1, 1 << 16)) & np.uint64(0xFFFF)
    return (key & np.uint64(0xFFFFFF)) << np.uint64(24) | last << np.uint64(8) | key >> np.uint64(24) & np.uint64(0xFF)


def count_grams(train: DataFrame, parts: int) -> DataFrame:
    """Dealt rows (key, n) of all runs of the column ``body``, and of kind 1 how many there are; tasks add up before they send."""

    def count(rows: Iterable[tuple]) -> Iterator[tuple]:
        def sent() -> Iterator[tuple]:
            g, n = held.pop()
            yield 0, 1, int(n.sum()), None
            yield from dealt(0, parts, turned(g), n)

        held: list[tuple] = []
        for group in grouped(rows, 0):
            part = grams([t or b"" for (t,) in group])
            if len(part[0]):
                held.append(part)
            if sum(len(k) for k, _ in held) >= GRAMS_HELD:
                held = [_added(held)]
                if len(held[0][0]) >= GRAMS_HELD // 2:
                    yield from sent()
        if held:
            held = [_added(held)]
            yield from sent()

    return arrow_rows(train, count, DEALT, batch=64, taken=TAKEN)


def learn_tree(train: DataFrame) -> Tree:
    """The suffix tree of the column ``body``.

    At each depth at most ``RARE`` contexts are frequent enough, so what reaches
    the driver is bounded by the parameters. Contexts of two symbols or more lie whole in a hash partition.
    """
    parts = partitions(train)
    level = stored(count_grams(train, parts), "grams")
    total = level.where("kind = 1").agg(F.sum("number")).first()[0] or 0
    least = max(2, -(-total // RARE))

    def frequent(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        for _, mine in groupby(rows, key=lambda r: r[0]):
            key, n = unpacked((packed for *_, packed in mine), 2)
            g = turned_back(key)
            for depth in range(DEPTH, 0, -1):
                g, n = _added([(g & np.uint64((1 << 8 * (depth + 1)) - 1), n)])
                real = np.ones(len(g), bool)
                if depth > 1:
                    first = parts_of(g >> np.uint64(8))
                    real = np.repeat(np.add.reduceat(n, first) >= least, np.diff(np.r_[first, len(g)]))
                columns = np.full(real.sum(), depth), g[real].view(np.int64), n[real].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["depth", "g", "n"])

    runs = together(level.where("kind = 0").select("bucket", "packed"), parts // 4)
    found = runs.mapInArrow(frequent, "depth bigint, g bigint, n bigint").groupBy("depth", "g").agg(F.sum("n").alias("n"))
    depth, g, n = (c.to_numpy() for c in found.toArrow().columns)
    discard(level)
    one = depth == 1
    last = np.bincount(g[one] & 255, n[one], 256).astype(np.int64)
    often = np.bincount(g[one] >> 8, n[one], 256) >= least
    keep = np.ones(len(g), bool)
    keep[one] = often[g[one] >> 8]
    none = np.flatnonzero(last) if total >= least else np.zeros(0, np.int64)
    return grow_tree(
        np.r_[depth[keep], np.zeros(len(none), np.int64)], np.r_[g[keep] >> 8, np.zeros(len(none), np.int64)],
        np.r_[g[keep] & 255, none], np.r_[n[keep], last[none]],
    )


def repeated(train: DataFrame, parts: int, least: int) -> np.ndarray:
    """The bitmap of all runs of 2 to ``WORDS`` + 1 words that may occur ``least`` times.

    A run is told by its partition and the 32 bits of its hash after that; a task sends it at most ``least`` times.
    """
    high = np.uint64(parts.bit_length() - 1)

    def sent(held: list[np.ndarray]) -> Iterator[tuple]:
        h = np.concatenate(held)
        held.clear()
        h.sort()
        h = h[np.r_[np.ones(min(least, len(h)), bool), h[least:] != h[:-least]]]  # no run more than ``least`` times
        bucket = bucket_of(h, parts)
        low = ((h << high) >> np.uint64(32)).astype(np.uint32)
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(h)]):
            for k in range(a, b, ROW_KEYS):
                steps = np.diff(low[k : min(b, k + ROW_KEYS)], prepend=np.uint32(0))
                yield int(bucket[a]), steps.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()

    def send(rows: Iterable[tuple]) -> Iterator[tuple]:
        held, fresh = [], 0
        for group in grouped(rows, 0):
            held += [g for _, _, g, _ in whole_runs([t or b"" for (t,) in group], range(2, WORDS + 2))]
            fresh += sum(len(g) for g in held[-WORDS:])
            if fresh >= KEYS_HELD:
                yield from sent(held)
                fresh = 0
        if fresh:
            yield from sent(held)

    def find(rows: Iterable[tuple]) -> Iterator[tuple]:
        for bucket, mine in groupby(rows, key=lambda r: r[0]):
            steps = (np.ascontiguousarray(np.frombuffer(r, np.uint8).reshape(4, -1).T).view("<u4").ravel() for _, r in mine)
            low = np.concatenate([np.cumsum(x, dtype=np.uint32) for x in steps])
            low.sort()
            often = low[least - 1 :]
            low = often[often == low[: len(often)]].astype(np.uint64)
            yield from slice_of(bits_of((low << np.uint64(32)) >> high | np.uint64((bucket << 64) // parts)))

    keys = arrow_rows(train, send, "bucket bigint, packed binary", batch=128, taken=TAKEN)
    return bitmap_of(arrow_rows(together(keys, parts // 2), find, "at bigint, bits binary", batch=16))


#: How many numbers dealt rows have, by kind: words (g, n), and from 2 on runs of so many words.
WIDTHS = {1: 2} | {size: 3 for size in range(2, WORDS + 2)}


def counted(train: DataFrame, parts: int, least: int = LEAST) -> DataFrame:
    """All that ``counted_share`` counts."""
    return counted_share(train, parts, repeated(train, parts, least), least)


def counted_share(train: DataFrame, parts: int, sieve: np.ndarray, least: int = LEAST, share: int = 0, shares: int = 1) -> DataFrame:
    """Dealt rows (g, n) of all words, and (s, c, n) of the runs of 2 to ``WORDS`` + 1 words that occur ``least`` times.

    ``c`` and ``s`` are hashes of the run without its last and without its first word; that of the run follows from them.
    Tasks add up before they send, to the hash partition of ``c``, which adds up again. One of several shares of the partitions
    is counted, so that what is sent need not lie on the disks all at once.
    """

    def sent(held: dict[int, list]) -> Iterator[tuple]:
        for size, rows in held.items():
            g, *c, n = _sums([list(x) for x in zip(*rows)])
            yield from dealt(size, parts, *c, second_of(g, *c), n) if c else dealt(size, parts, g, n)
            rows.clear()

    def count(rows: Iterable[tuple]) -> Iterator[tuple]:
        held: dict[int, list] = {size: [] for size in WIDTHS}
        fresh = 0
        for group in grouped(rows, 0):
            for size, at, g, runs in whole_runs([t or b"" for (t,) in group], WIDTHS):
                if size > 1:
                    if size > 2:  # both its parts occur so often as well
                        real = mark[at] & mark[at + 1]
                        at, g = at[real], g[real]
                    real = has(sieve, bits_of(g))
                    at, g = at[real], g[real]
                    mark = np.zeros(len(runs[0]), bool)
                    mark[at] = True
                    c = runs[size - 2][at]
                    if shares > 1:
                        mine = bucket_of(c, shares) == share
                        g, c = g[mine], c[mine]
                    held[size].append([g, c, np.ones(len(g), np.uint64)])
                else:
                    g, n = np.unique(g[bucket_of(g, shares) == share], return_counts=True)
                    held[size].append([g, n.astype(np.uint64)])
                fresh += len(g)
            if fresh >= RUNS_HELD:
                held = {size: [_sums([list(x) for x in zip(*rows)])] for size, rows in held.items()}
                fresh = sum(len(rows[0][0]) for rows in held.values())
                if fresh >= RUNS_HELD // 2:
                    yield from sent(held)
                    fresh = 0
        if fresh:
            yield from sent(held)

    def add(words: list[np.ndarray], *runs: list[np.ndarray]) -> Iterator[tuple]:
        yield from dealt(1, parts, *_sums([[x] for x in words]))
        for size, (c, s, n) in enumerate(runs, 2):
            _, c, s, n = _sums([[joined(c, s)], [c], [s], [n]])
            real = n >= least
            yield from dealt(size, parts, s[real], c[real], n[real])

    return met(arrow_rows(train, count, DEALT, batch=64, taken=TAKEN), parts // shares, WIDTHS, add)


def as_rows(packed: DataFrame, width: int, columns_of: Callable[..., list[np.ndarray]], schema: str) -> DataFrame:
    """Dealt rows as plain ones, of what ``columns_of`` makes of their columns."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns_of(*unpacked([row], width))], names)

    return packed.select("packed").mapInArrow(run, schema)


def count_runs(train: DataFrame, parts: int, least: int = LEAST) -> DataFrame:
    """(g, c, s, n) of all runs of 2 to ``WORDS`` + 1 words that occur ``least`` times."""
    return as_rows(
        counted(train, parts, least).where("kind > 1"), 3,
        lambda s, c, n: [x.view(np.int64) for x in (joined(c, s), c, s, n)], "g bigint, c bigint, s bigint, n bigint",
    )


def level_of(known: DataFrame, runs: DataFrame, parts: int, last: bool = False) -> DataFrame:
    """Dealt rows of the runs of one size: of kind 0, but for the last size, (g, n, p), and of kind 1 what they add to the tree, (g, x, c, n).

    ``known`` has the (g, n, p) of the runs that are a word shorter. The runs (s, c, n) meet those of their suffix,
    then those of their context, together with all other runs of that context.
    """

    def suffix(known: list[np.ndarray], runs: list[np.ndarray]) -> Iterator[tuple]:
        (g, n, p), (s, c, times) = known, runs
        order = np.argsort(g)
        yield from dealt(1, parts, c, s, times, p[order][np.searchsorted(g, s, sorter=order)])
        yield from dealt(0, parts, g, n)

    def context(known: list[np.ndarray], runs: list[np.ndarray]) -> Iterator[tuple]:
        (g, t), (c, s, n, q) = known, runs
        if not len(c):
            return
        order = np.argsort(c)
        c, s, n, q = c[order], s[order], n[order].astype(np.float64), q.view(np.float64)[order]
        first = parts_of(c)
        k = np.diff(np.r_[first, len(c)])
        order = np.argsort(g)
        t = t[order][np.searchsorted(g, c[first], sorter=order)]
        rest = t - np.add.reduceat(n, first)  # times that it goes on with runs which are not counted
        left = (rest + k) / (t + k)
        all_left = np.repeat(left, k)
        r = n / np.repeat(t + k, k) + all_left * q
        kept = np.add.reduceat(n * np.log(r / q), first) + rest * np.log(left) >= TEST * k
        mine = np.repeat(kept, k)
        g, n = joined(c, s), n.astype(np.uint64)
        if not last:
            yield from dealt(0, parts, g, n, np.where(mine, r, q))
        x = np.r_[np.log10(r[mine] / (all_left[mine] * q[mine])), np.log10(left[kept])]
        yield from dealt(1, parts, np.r_[g[mine], c[first][kept]], x, np.zeros(len(x), np.uint64), np.r_[n[mine], t[kept]])

    both = known.select("bucket", F.lit(0).alias("kind"), "number", "packed").union(
        runs.select("bucket", F.lit(1).alias("kind"), "number", "packed")
    )
    return met(met(both, parts // 4, {0: 3, 1: 3}, suffix), parts // 4, {0: 2, 1: 4}, context)


def learned(train: DataFrame) -> tuple[DataFrame, int, int, int, int]:
    """Dealt rows (g, x, c, n) of words and runs in the tree; occurrences and number of all words and ends; texts; partitions.

    The log10 probability of a text is the sum of ``x`` over its words and all their runs.
    ``x`` of a run has what its last word gains by being in the run, and what the run as a context leaves to its suffix.
    ``c`` is the count of a word or end, and 0 for runs; ``n`` the greatest count of a row, its doubling the kind.
    """
    parts = partitions(train)
    sieve = repeated(train, parts, LEAST)
    made = [stored(counted_share(train, parts, sieve, LEAST, k, SHARES), "counts") for k in range(SHARES)]
    counts = made[0]
    for more in made[1:]:
        counts = counts.union(more)

    def plain(packed: Iterable[tuple]) -> Iterator[tuple]:
        g, n = unpacked((p for (p,) in packed), 2)
        start = g == START_WORD
        yield int(n[~start].sum()), int((~start).sum()), int(n[start].sum())

    words = stored(counts.where("kind = 1"), "words")
    sizes = arrow_rows(words.select("packed"), plain, "total bigint, kinds bigint, texts bigint")
    total, kinds, texts = sizes.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in sizes.columns)).first()

    def shares(rows: Iterable[tuple]) -> Iterator[tuple]:
        for bucket, kind, number, packed in rows:
            g, n = unpacked([packed], 2)
            yield bucket, kind, number, packed_of(g, n, n / float(max(1, total + kinds)))

    level = arrow_rows(words, shares, DEALT, batch=64)
    levels: list[DataFrame] = []
    for size in range(2, WORDS + 2):
        levels.append(stored(level_of(level, counts.where(F.col("kind") == size), parts, size == WORDS + 1), "level"))
        level = levels[-1].where("kind = 0")
    for done in made:
        discard(done)

    def tree(words: list[np.ndarray], new: list[np.ndarray]) -> Iterator[tuple]:
        g, n = words
        c = np.where(g == START_WORD, np.uint64(0), n)
        x = np.where(g == START_WORD, 0.0, np.log10(n / float(max(1, total + kinds))))
        g, x, c, n = (np.r_[a, b] for a, b in zip((g, x, c, n), (new[0], new[1].view(np.float64), *new[2:])))
        order = np.argsort(g, kind="stable")
        g, x, c, n = g[order], x[order], c[order], n[order]
        first = parts_of(g)
        if len(first):
            g, x, c, n = g[first], np.add.reduceat(x, first), np.maximum.reduceat(c, first), np.maximum.reduceat(n, first)
        doubling = np.frexp(n.astype(np.float64))[1] - 1
        for d in np.unique(doubling).tolist():
            mine = doubling == d
            yield from dealt(d, parts, g[mine], x[mine], c[mine], n[mine])

    both = words.select("bucket", F.lit(0).alias("kind"), "number", "packed")
    for rows in levels:
        both = both.union(rows.where("kind = 1"))
    table = stored(met(both, parts // 2, {0: 2, 1: 4}, tree), "tree")
    for done in (words, *levels):
        discard(done)
    return table, total, kinds, texts, parts


def learn_words(train: DataFrame) -> tuple[DataFrame, int, int, int]:
    """(g, x, c, n) of words and runs in the tree, as ``learned`` tells them, and occurrences and number of words, and of texts."""
    table, total, kinds, texts, _ = learned(train)

    def plain(g: np.ndarray, x: np.ndarray, c: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        return [g.view(np.int64), x.view(np.float64), c.view(np.int64), n.view(np.int64)]

    return as_rows(table, 4, plain, "g bigint, x double, c bigint, n bigint"), total, kinds, texts


def head_of(table: DataFrame) -> tuple[int, list[np.ndarray]]:
    """(least, (g, x, c)): the rows whose doubling is ``least`` or more, at most ``HEAD`` of them."""
    sizes = dict(table.groupBy("kind").agg(F.sum("number")).collect())  # one row for each doubling
    held, least = 0, max(sizes, default=0) + 1
    for d in sorted(sizes, reverse=True):
        held += sizes[d]
        if held > HEAD:
            break
        least = d
    rows = table.where(F.col("kind") >= least).select("packed").toArrow()["packed"]
    g, x, c, _ = unpacked((r.as_buffer() for r in rows), 4)
    order = np.argsort(g)
    return least, [g[order], x.view(np.float64)[order], c[order].astype(np.float64)]


def bits_in(tail: DataFrame) -> np.ndarray:
    """The bitmap of the keys of dealt rows (g, x, c, n)."""

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for _, mine in groupby(rows, key=lambda r: r[0]):
            yield from slice_of(bits_of(unpacked((p for _, p in mine), 4)[0]))

    return bitmap_of(arrow_rows(tail.select("bucket", "packed"), run, "at bigint, bits binary", batch=16))


def score_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Null and empty texts are an end alone. Repeated rows count and are scored
    each time. Without training rows the base gives every token probability one.
    """
    whole = docs.select(
        F.col(key).alias("doc_id"), (fold(key, 7) == 2).alias("held_out"), raw(text).alias("body"),
    )
    train = whole.where(~F.col("held_out")).select("body")
    spark = docs.sparkSession
    with shuffles_dropped(spark):
        tree = learn_tree(train)
        table, n, v, _, parts = learned(train)  # ends are words here, starts are none
        unseen = math.log10(v / (n + v)) if n else 0.0
        low = math.log10(n + v + 1)
        least, (known_g, known_x, known_c) = head_of(table)
        known_g, known_x, known_c = np.r_[known_g, np.uint64((1 << 64) - 1)], np.r_[known_x, 0.0], np.r_[known_c, 0.0]
        shelf = np.searchsorted(known_g[:-1], np.arange(1 << SHELF, dtype=np.uint64) << np.uint64(64 - SHELF)).astype(np.int32)
        tail = table.where(F.col("kind") < least)
        rest = bits_in(tail)

    def asked(texts: list[bytes], machine: Automaton) -> tuple[np.ndarray, list[np.ndarray]]:
        """Tokens, known ones, base and score of each text from the common rows; the others: hash, text, twice how often, and 1 more
        for a word, and what they give if they are in no table."""
        doc, place, runs = word_runs(texts, WORDS + 1)
        miss = np.full(len(doc), unseen)
        miss[place == -1] = 0.0
        sums = np.zeros((4, len(texts)))
        sums[0] = np.bincount(doc[place != -1], minlength=len(texts))
        far = []
        for k, run in enumerate(runs):
            at = np.flatnonzero(doc[: len(run)] == doc[k:])
            g = run[at]
            known = shelf[g >> np.uint64(64 - SHELF)]
            late = np.flatnonzero(known_g[known] < g)
            while len(late):
                known[late] += 1
                late = late[known_g[known[late]] < g[late]]
            hit = known_g[known] == g
            known = known[hit]
            sums[3] += np.bincount(doc[at[hit]], known_x[known], len(texts))
            lost = at[~hit]
            if k == 0:  # only words that are not common need be spelled
                strange = place[lost] >= 0
                chosen = np.zeros(int(place.max(initial=-1)) + 1, bool)
                chosen[place[lost[strange]]] = True
                words, ends = machine.spelled(texts, chosen)
                miss[lost[strange]] += words
                miss[place == -2] += ends
            maybe = has(rest, bits_of(run[lost]))
            if k == 0:
                token = place[at[hit]] != -1
                mine, counts = doc[at[hit]][token], known_c[known][token]
                sums[1] += np.bincount(mine, counts > 0, len(texts))
                sums[2] += np.bincount(mine, np.log10(counts + 1) - low, len(texts))
                gone = lost[~maybe]  # in no table
                sums[2] -= np.bincount(doc[gone], place[gone] != -1, len(texts)) * low
                sums[3] += np.bincount(doc[gone], miss[gone], len(texts))
            lost = lost[maybe]
            far.append((doc[lost], run[lost], miss[lost] * (k == 0), (place[lost] != -1) & (k == 0)))
        at, g, gives, word = (np.concatenate(x) for x in zip(*far))
        order = np.lexsort((at, g))
        at, g, gives, word = at[order], g[order], gives[order], word[order]
        first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (g[1:] != g[:-1])][: len(g)])
        number = np.diff(np.r_[first, len(g)])
        gives = np.add.reduceat(gives, first) if len(first) else gives
        return sums, [g[first], at[first], 2 * number + word[first], gives]

    about = pa.schema([
        ("doc_id", to_arrow_schema(whole.schema).field("doc_id").type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
        ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
    ])

    def score(rows: Iterable[tuple]) -> Iterator[tuple]:
        """In chunks of many texts what these ask of the tail (kind 1), and what is known of them (2)."""
        machine = automaton_of(tree)
        chunk, texts, far, fresh = TaskContext.get().partitionId() * CHUNKS, [], [], 0

        def sent() -> Iterator[tuple]:
            for bucket, kind, _, packed in dealt(1, parts, *(np.concatenate(x) for x in zip(*far))):
                yield bucket, kind, chunk, packed
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*texts), about.types)], schema=about)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, about) as stream:
                stream.write_batch(batch)
            yield chunk % parts, 2, chunk, sink.getvalue().to_pybytes()

        for group in grouped(rows, 2):
            sums, (g, at, *more) = asked([r[2] or b"" for r in group], machine)
            far.append([g, at + len(texts), *more])
            fresh += len(g) + len(group)
            for (doc, held, _), (tokens, found, base, logp) in zip(group, sums.T.tolist()):
                texts.append((doc, held, int(tokens), int(found), base, logp))
            if fresh >= ASKED_HELD:
                yield from sent()
                chunk, texts, far, fresh = chunk + 1, [], [], 0
        if texts:
            yield from sent()

    def answer(rows: Iterable[tuple]) -> Iterator[tuple]:
        """What the tail of each hash partition gives the texts of a chunk; texts go through."""
        for _, mine in groupby(rows, key=lambda r: r[0]):
            known_g, known_x, known_c = np.array([(1 << 64) - 1], np.uint64), np.zeros(1), np.zeros(1)
            for (kind, chunk), some in groupby(mine, key=lambda r: r[1:3]):
                some = (packed for *_, packed in some)
                if kind == 2:
                    yield from ((chunk, kind, packed) for packed in some)
                    continue
                g, *columns = unpacked(some, 4)
                if kind == 0:
                    order = np.argsort(g)
                    known_g = np.r_[g[order], known_g]
                    known_x, known_c = (np.r_[c.view(t)[order], 0.0] for c, t in zip(columns, (np.float64, np.int64)))
                    continue
                at, number, gives = columns
                number, word = (number >> np.uint64(1)).astype(np.float64), (number & np.uint64(1)).astype(bool)
                place = np.searchsorted(known_g, g)
                real = known_g[place] == g
                count = np.where(real, known_c[place], 0.0)
                texts, at = np.unique(at, return_inverse=True)
                sums = (
                    number * (word & (count > 0)), np.where(word, number * (np.log10(count + 1) - low), 0.0),
                    np.where(real, number * known_x[place], gives.view(np.float64)),
                )
                yield chunk, kind, packed_of(texts, *(np.bincount(at, x, len(texts)) for x in sums))

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        for _, mine in groupby(rows, key=lambda r: r[0]):
            *answers, (_, _, texts) = mine
            columns = pa.ipc.open_stream(texts).read_all().combine_chunks()
            at, *more = unpacked((packed for *_, packed in answers), 4)
            more, part, far = (np.bincount(at.astype(np.int64), x.view(np.float64), len(columns)) for x in more)
            known, base, logp = (columns[c].to_numpy() for c in ("n_known", "base_score", "score"))
            yield pa.RecordBatch.from_arrays([
                *(columns[c].combine_chunks() for c in ("doc_id", "held_out", "n_tokens")),
                pa.array(known + more.astype(np.int64)), pa.array(np.full(len(columns), n)), pa.array(base + part), pa.array(logp + far),
            ], [f.name for f in result])

    result = StructType([
        whole.schema["doc_id"], whole.schema["held_out"], *(StructField(c, LongType()) for c in ("n_tokens", "n_known", "train_tokens")),
        StructField("base_score", DoubleType()), StructField("score", DoubleType()),
    ])
    asking = arrow_rows(whole, score, "bucket bigint, kind int, chunk bigint, packed binary", batch=64, taken=TAKEN)
    known = tail.select("bucket", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("chunk"), "packed")
    asking = together(known.union(asking), parts, "bucket", "kind", "chunk")
    answers = arrow_rows(asking, answer, "chunk bigint, kind int, packed binary", batch=64)
    return together(answers, parts // 2, "chunk", "kind").mapInArrow(add, result)
