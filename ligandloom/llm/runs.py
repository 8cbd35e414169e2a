"""Runs of words (stretches that repeat a period at least twice), caught online by dyadic blocks.

Words are appended. Each completed block of 2^k words, at a multiple of that, puts out a catcher for the
periods of its level: whenever the block comes back as the suffix of what has been appended, at a distance that is one of these
periods, the match is compared backwards at once and forwards with every word appended from then on. As soon as
it is as long as the period, a square is there; the squares of one period that follow each other merge into a run,
which is reported when a word breaks it, or at the end.

The first half of a square of period p has a whole block of each length up to (p + 1) / 2, so a period belongs to one
level only and each match is opened once, by its first whole block. Words come in batches, and all catchers of a level
take a batch in one comparison of window hashes. A level compares about two pairs for each word, whatever the text,
and keeps 8 bytes a word. A match of a multiple of the period has the same ends; the least period is the run's.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ligandloom.llm.common import arrow_rows, raw
from ligandloom.llm.tokens import grouped, mix, tokenise

#: Fewest words of a run.
LEAST = 12
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.empty((0, 3), np.int64)


def level_periods(least: int, longest: int) -> list[tuple[int, int, int]]:
    """(level, first, last period): blocks of 2^level words lie whole in the matches of these periods.

    A run of period p and of ``least`` words matches itself for max(p, least - p) words, and
    2 * block - 1 words hold a whole block.
    """
    found: dict[int, list[int]] = {}
    out: list[tuple[int, int, int]] = []
    for p in range(1, min(longest, least) + 1):
        found.setdefault(((max(p, least - p) + 1) // 2).bit_length() - 1, []).append(p)
    for level, periods in sorted(found.items()):
        begin = periods[0]
        for a, b in zip(periods, [*periods[1:], 0]):
            if b != a + 1:
                out.append((level, begin, a))
                begin = b
    p = least + 1
    while p <= longest:
        level = ((p + 1) // 2).bit_length() - 1
        last = min(longest, (4 << level) - 2)
        out.append((level, p, last))
        p = last + 1
    return out


class SquareCatcher:
    """Takes words, as 64-bit hashes, and gives the runs that they complete.

    ``reach`` bounds the words of a run, where it is known, and so the levels; words that occur once keep texts apart.
    """

    def __init__(self, least: int = LEAST, reach: int | None = None):
        self.least, self.reach = least, reach
        self.windows: list[np.ndarray] = [np.empty(0, np.uint64)]  # of 2^k words from each place on
        self.open = np.empty((0, 2), np.int64)  # first word and period of matches that go on

    def append(self, words: np.ndarray) -> np.ndarray:
        """(start, end, period) of the runs that these words have ended, in order."""
        before = len(self.windows[0])
        self._extend(words.astype(np.uint64))
        now = len(self.windows[0])
        if now == before:
            return _NONE
        starts, periods = self.open.T
        ends = self._forward(np.full(len(starts), before) - periods, periods)
        parts = [np.stack([starts, ends, periods], 1)]
        longest = now if self.reach is None else min(now, self.reach // 2)
        for level, first, last in level_periods(self.least, longest):
            if level < len(self.windows):
                parts.append(self._caught(level, first, last, before, now))
        found = np.concatenate(parts)
        going = found[:, 1] == now
        self.open = found[going][:, [0, 2]]
        return self._runs(found[~going])

    def finish(self) -> np.ndarray:
        """The runs that reach to the last word."""
        now = len(self.windows[0])
        starts, periods = self.open.T
        self.open = self.open[:0]
        return self._runs(np.stack([starts, np.full(len(starts), now), periods], 1))

    def _extend(self, words: np.ndarray) -> None:
        self.windows[0] = np.concatenate([self.windows[0], words])
        top = len(self.windows[0]) if self.reach is None else min(len(self.windows[0]), self.reach)
        level = 0
        while 2 << level <= top:
            if len(self.windows) == level + 1:
                self.windows.append(np.empty(0, np.uint64))
            below, old, half = self.windows[level], self.windows[level + 1], 1 << level
            fresh = below[len(old) :]
            made = mix(fresh[: len(fresh) - half] * _STEP + fresh[half:])
            self.windows[level + 1] = np.concatenate([old, made])
            level += 1

    def _caught(self, level: int, first: int, last: int, before: int, now: int) -> np.ndarray:
        """Matches that a block of this level opens when it comes back in the words from ``before`` on."""
        block, window = 1 << level, self.windows[level]
        row = max(0, -(-(before - block - last + 1) // block))  # the first block whose distances are not all done
        begin, width = row * block, last - first + 1
        if begin + first >= len(window):
            return _NONE
        there = window[begin + first :]
        rows = -(-len(there) // block)
        there = np.concatenate([there, np.zeros(rows * block + width - len(there), np.uint64)])
        view = np.lib.stride_tricks.sliding_window_view(there, width)[::block][:rows]
        own = window[begin::block][:rows]
        r, c = np.nonzero(view == own[:, None])
        s, p = begin + r * block, first + c
        real = (s + p < len(window)) & (s + p + block > before)
        s, p = s[real], p[real]
        follows = s >= block  # a match that the block before has opened
        at = s[follows] - block
        follows[follows] = window[at] == window[at + p[follows]]
        s, p = s[~follows], p[~follows]
        ends = self._forward(s + block, p)
        for k in range(level - 1, -1, -1):
            can = s >= 1 << k
            at = s[can] - (1 << k)
            can[can] = self.windows[k][at] == self.windows[k][at + p[can]]
            s = s - can * (1 << k)
        return np.stack([s, ends, p], 1)

    def _forward(self, at: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Where the match that covers the words before ``at`` ends in its later copy."""
        at = at.copy()
        for k in range(len(self.windows) - 1, -1, -1):
            window = self.windows[k]
            moving = np.ones(len(at), bool)
            while moving.any():  # once, but for the top level
                moving &= at + period < len(window)
                here = at[moving]
                moving[moving] = window[here] == window[here + period[moving]]
                at[moving] += 1 << k
                if k < len(self.windows) - 1:
                    break
        return at + period

    def _runs(self, found: np.ndarray) -> np.ndarray:
        start, end, period = found.T
        size = end - start
        found = found[size >= np.maximum(self.least, 2 * period)]
        found = found[np.lexsort(found.T[[2, 1, 0]])]
        same = (found[1:, :2] == found[:-1, :2]).all(1)
        return found[np.r_[True, ~same][: len(found)]]


def runs_of(texts: list[bytes], least: int = LEAST) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each text its runs as (start, length, period) by start and period, and which of its words are kept."""
    tokens = tokenise(texts, lower=False)
    sizes = np.diff(tokens.first)
    begins = np.r_[0, np.cumsum(sizes + 1)]
    words = mix(np.arange(begins[-1], dtype=np.uint64) + np.uint64(1 << 63))  # between texts: words of their own
    inner = np.ones(begins[-1], bool)
    inner[begins[1:] - 1] = False
    words[inner] = tokens.hashes
    catcher = SquareCatcher(least, int(sizes.max(initial=0)))
    found = np.concatenate([catcher.append(words), catcher.finish()])
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    start, end, period = found.T
    drops = np.zeros(begins[-1] + 1, np.int64)
    np.add.at(drops, start + period, 1)
    np.add.at(drops, end, -1)
    keep = np.cumsum(drops[:-1]) == 0
    cuts = np.searchsorted(start, begins)
    runs = [
        np.stack([start[a:b] - at, (end - start)[a:b], period[a:b]], 1)
        for a, b, at in zip(cuts, cuts[1:], begins.tolist())
    ]
    return runs, [keep[a : a + n] for a, n in zip(begins.tolist(), sizes.tolist())]


def find_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST) -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period) and collapsed of every row.

    ``collapsed`` has the words, joined by one space, that no run contains after its first period.
    Null texts are empty: no run, an empty text. Repeated rows stay repeated, other columns are not read.
    """

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for group in grouped(rows, 1):
            texts = [body or b"" for _, body in group]
            runs, keeps = runs_of(texts, least)
            for (doc, _), body, found, keep in zip(group, texts, runs, keeps):
                words = body.split()
                yield doc, list(map(tuple, found.tolist())), b" ".join(words if keep.all() else compress(words, keep.tolist()))

    kind = docs.schema[key].dataType.simpleString()
    found = arrow_rows(
        docs.select(F.col(key).alias("doc_id"), raw(text).alias("body")), run,
        f"doc_id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary", batch=256,
    )
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def with_planted_periods(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Texts whose words repeat from one place on, in the tenth of rows that the key's crc32 picks; a null key is empty."""
    h = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    words = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+"), "")
    picked = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), h.alias("h")).withColumn(
        "words", F.when(F.col("h") % 10 == 0, words)
    )
    g = F.floor(F.col("h") / 10)
    n = F.size("words")
    some = picked.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, (g % F.col("n"))).cast("int"))
    some = some.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    times = F.floor(rest / F.col("p")).cast("int")
    cycle = F.slice("words", F.col("a") + 1, F.col("p"))
    tail = F.flatten(F.array_repeat(cycle, times))
    part = F.slice("words", F.col("a") + 1, (rest - times * F.col("p")).cast("int"))
    repeated = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail, part), " ")
    return some.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def run_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: first start, then period) and digests of runs and collapsed text."""

    def line(r: Column) -> Column:
        return F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))

    best = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    )
    return found.withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("_best.s")).alias("start"),
        F.col("_best.n").alias("length"),
        (-F.col("_best.p")).alias("period"),
        F.expr("(1000 * _best.n) div (-_best.p)").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
