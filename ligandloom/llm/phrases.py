"""Phrases whose words keep together, found by Misra-Gries summaries and a second, exact count.

First pass. Every run of one to four words within a piece is hashed, with its language, into hash partitions of about ``PART``
bytes of text each. A task sums up what it reads into one summary for each partition and sends the summaries.
A partition merges them: counts are added, and where more than its capacity are left, the largest count
beyond the capacity is taken from all. The capacity is above mass / threshold, the mass being all occurrences that fell into
the partition, so all that is ever taken is less than the threshold, and every phrase that is frequent enough has
a count left. The masses are sorted before the summaries, so the capacity is known before the first merge.

Second pass. What survived becomes a bitmap of fixed size. Runs that it lets through go to the same partitions and are counted
exactly, by their words; the threshold then drops what only a hash, or the slack of a summary, had let in.

The other steps work on frequent phrases alone: each is cut into two parts, whose counts are joined to it, and it is dropped
if a longer phrase that has it is nearly as frequent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ligandloom.llm.common import arrow_rows, raw
from ligandloom.llm.sieve import BITS, has, sieve_of
from ligandloom.llm.tokens import grouped, mix, tokenise
from ligandloom.session import discard, stored

#: Words of the longest phrase, fewest occurrences, and phrases of a language in the report.
WORDS, LEAST, TOP = 4, 30, 2000
#: Per cent of a phrase's occurrences inside one longer phrase that make it a part of that.
INSIDE = 80
SCALE = 2_000_000
NO_LANGUAGE = "und"
#: Bytes of text for each hash partition; runs and phrases that a task holds before it sends, and keys of a row it sends.
PART = 16 << 20
RUNS_HELD, PHRASES_HELD, KEYS_HELD, ROW_KEYS = 2_000_000, 200_000, 1_000_000, 512
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BREAK = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
_LOW = np.uint64(0xFFFFFFFF)


class Runs:
    """Runs of 1 to ``longest`` words within the pieces of a group of texts, and their hashes."""

    def __init__(self, texts: list[bytes], langs: list[str], longest: int):
        self.langs = langs
        tokens = tokenise([t.translate(_BREAK) for t in texts])
        self.sizes = np.diff(tokens.first)
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        breaks = np.cumsum(tokens.data == 0x0A)
        piece = breaks[tokens.starts] + self.doc  # neither ever falls: equal sums are one piece of one text
        names, code = np.unique(np.array(langs, object), return_inverse=True) if langs else ([], np.zeros(0, int))
        salt = np.array([xxhash.xxh64_intdigest(x.encode(), 11) for x in names], np.uint64)[code[self.doc]] if len(self.doc) else np.zeros(0, np.uint64)
        run, self.hashes, self.at = tokens.hashes, [], []
        for size in range(1, longest + 1):
            if size > 1:
                run = mix(run[:-1] * _STEP + tokens.hashes[size - 1 :]) if len(run) > 1 else run[:0]
            n = len(run)
            whole = np.flatnonzero(piece[:n] == piece[size - 1 : size - 1 + n])
            self.at.append(whole)
            self.hashes.append(mix(run[whole] + salt[whole] * np.uint64(size)))
        lengths = tokens.ends - tokens.starts  # the words again, with one space after each
        self.ends = np.cumsum(lengths + 1)
        self.begins = self.ends - lengths - 1
        move = np.repeat(tokens.starts - self.begins, lengths + 1)
        place = np.arange(len(move)) + move
        clean = tokens.data[np.minimum(place, len(tokens.data) - 1)] if len(move) else np.zeros(0, np.uint8)
        clean = clean.copy()
        clean[self.ends - 1] = 0x20
        self.clean = clean.tobytes()

    def phrase(self, at: int, size: int) -> bytes:
        return self.clean[self.begins[at] : self.ends[at + size - 1] - 1]


def bucket_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Hash partition, by the high half of a hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def bit_of(bucket: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Bit number in the bitmap of a partition and the low half of a hash."""
    return (mix(bucket.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)


class Summary:
    """A Misra-Gries summary: ``count <= true count <= count + error`` for each key, and for absent ones with count 0."""

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.keys, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Merge another summary, of no error."""
        self.waiting.append((keys, counts))
        self.held += len(keys)
        if self.held > max(self.capacity, KEYS_HELD):
            self.settle()

    def settle(self) -> None:
        keys, counts = (np.concatenate(x) for x in zip((self.keys, self.counts), *self.waiting))
        self.waiting, self.held = [], 0
        self.keys, self.counts = summed(keys, counts)
        if len(self.keys) > self.capacity:
            most = len(self.counts) - 1 - self.capacity
            cut = np.partition(self.counts, most)[most]
            self.error += int(cut)
            self.counts -= cut
            left = self.counts > 0
            self.keys, self.counts = self.keys[left], self.counts[left]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def summaries(docs: DataFrame, parts: int, hashes_of: Callable[[list[tuple]], list[np.ndarray]]) -> DataFrame:
    """(bucket, kind, mass, keys, counts): of kind 0 the occurrences of a partition, of kind 1 a summary of them.

    ``hashes_of`` gives the hashes of all runs in a group of rows, of which the first column is the text.

    ``keys`` are little-endian 32-bit numbers; ``counts`` has a 32-bit number for the last so many of them, the others count once.
    """

    def sent(held: list[np.ndarray]) -> Iterator[tuple]:
        h = np.concatenate(held)
        held.clear()
        h.sort()
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        count = np.diff(np.r_[first, len(h)]).astype("<u4")
        h = h[first]
        bucket = bucket_of(h, parts)
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(h)]):
            yield int(bucket[a]), 0, int(count[a:b].sum(dtype=np.int64)), None, None
            for k in range(a, b, ROW_KEYS):
                part = slice(k, min(b, k + ROW_KEYS))
                low, n = (h[part] & _LOW).astype("<u4"), count[part]
                once = n == 1
                yield int(bucket[a]), 1, 0, np.r_[low[once], low[~once]].tobytes(), n[~once].tobytes()

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        held, fresh = [], 0
        for group in grouped(rows, 0):
            found = hashes_of(group)
            held += found
            fresh += sum(map(len, found))
            if fresh >= RUNS_HELD:
                yield from sent(held)
                fresh = 0
        if fresh:
            yield from sent(held)

    return arrow_rows(docs, run, "bucket bigint, kind int, mass bigint, keys binary, counts binary")


def survivors(summed_up: DataFrame, parts: int, least: int = LEAST) -> DataFrame:
    """(bit): bit numbers of all keys that may occur ``least`` times."""

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        now, mass, summary = None, 0, None

        def found() -> Iterator[tuple]:
            if summary is not None:
                summary.settle()
                keys = summary.keys[summary.counts + summary.error >= least]
                yield from ((b,) for b in bit_of(np.full(len(keys), now), keys).tolist())

        for bucket, kind, more, keys, counts in rows:
            if bucket != now:
                yield from found()
                now, mass, summary = bucket, 0, None
            if kind == 0:
                mass += more
                continue
            if summary is None:
                summary = Summary(mass // least + 1)
            keys, many = np.frombuffer(keys, "<u4"), np.frombuffer(counts, "<u4")
            summary.add(keys, np.r_[np.ones(len(keys) - len(many), np.int64), many.astype(np.int64)])
        yield from found()

    dealt = summed_up.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind")
    return arrow_rows(dealt, run, "bit bigint", batch=65_536)


def exact_counts(docs: DataFrame, sieve: np.ndarray, parts: int, least: int = LEAST, longest: int = WORDS) -> DataFrame:
    """(lang, phrase, words, f) of the runs that occur ``least`` times, and of each language its words as the empty phrase.

    Tasks send what the bitmap lets through to the hash partitions, many phrases in a row, and these add it up by the words.
    """

    def sent(held: dict[int, list], total: dict[str, int]) -> Iterator[tuple]:
        by_place: dict[tuple[int, str], list] = {}
        for key, (lang, phrase, n) in held.items():
            by_place.setdefault(((key >> 32) * parts >> 32, lang), []).append((phrase, n))
        for (bucket, lang), rows in by_place.items():
            for k in range(0, len(rows), ROW_KEYS):
                phrase, n = zip(*rows[k : k + ROW_KEYS])
                yield bucket, lang, b"\n".join(phrase), np.array(n, "<u8").tobytes()
        yield from ((0, lang, b"", np.array([n], "<u8").tobytes()) for lang, n in total.items())

    def count(rows: Iterable[tuple]) -> Iterator[tuple]:
        held: dict[int, list] = {}
        total: dict[str, int] = {}
        for group in grouped(rows, 0):
            langs = [r[1] for r in group]
            runs = Runs([r[0] or b"" for r in group], langs, longest)
            for lang, n in zip(langs, runs.sizes.tolist()):
                total[lang] = total.get(lang, 0) + n
            for size, (h, at) in enumerate(zip(runs.hashes, runs.at), 1):
                through = has(sieve, bit_of(bucket_of(h, parts), h & _LOW))
                h, at = h[through], at[through]
                h, first, n = np.unique(h, return_index=True, return_counts=True)
                for key, k, more in zip(h.tolist(), at[first].tolist(), n.tolist()):
                    row = held.get(key)
                    if row is None:
                        held[key] = [langs[runs.doc[k]], runs.phrase(k, size), more]
                    else:
                        row[2] += more
            if len(held) >= PHRASES_HELD:
                yield from sent(held, total)
                held, total = {}, {}
        yield from sent(held, total)

    def add(rows: Iterable[tuple]) -> Iterator[tuple]:
        now, sums = None, {}

        def found() -> Iterator[tuple]:
            for lang, counts in sums.items():
                for phrase, n in counts.items():
                    if n >= least or not phrase:
                        yield lang, phrase.decode("utf-8", "replace"), phrase.count(b" ") + bool(phrase), n

        for bucket, lang, phrases, counts in rows:
            if bucket != now:
                yield from found()
                now, sums = bucket, {}
            mine = sums.setdefault(lang, {})
            for phrase, n in zip(phrases.split(b"\n"), np.frombuffer(counts, "<u8").tolist()):
                mine[phrase] = mine.get(phrase, 0) + n
        yield from found()

    dealt = arrow_rows(docs, count, "bucket bigint, lang string, phrases binary, counts binary", batch=256)
    dealt = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return arrow_rows(dealt, add, "lang string, phrase string, words int, f bigint")


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = WORDS) -> DataFrame:
    """(lang, phrase, words, f) of all runs of up to ``longest`` words within pieces that occur ``least`` times in a language.

    The row of the empty phrase has the words of a language. Null texts are empty, a null language is ``und``; repeated rows count
    each time. Lower-cases A-Z. Words are between spaces and tabs, pieces between ``. , ; : ! ?`` and line ends.
    """
    picked = docs.select(
        raw(text).alias("body"), F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang")
    )
    size = picked.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    parts = max(1, -(-size // PART))

    def hashes_of(group: list[tuple]) -> list[np.ndarray]:
        return Runs([r[0] or b"" for r in group], [r[1] for r in group], longest).hashes

    kept = stored(survivors(summaries(picked, parts, hashes_of), parts, least), "survivors")
    sieve = sieve_of(kept, "bit")
    discard(kept)
    return exact_counts(picked, sieve, parts, least, longest)


def _between(phrase: Column, first: Column, size: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, size), " ")


def _wide(column: str) -> Column:
    return F.col(column).cast("decimal(20,0)")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = WORDS, top: int = TOP
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: the first ``top`` phrases of two words and more of each language.

    ``a`` are the occurrences of the phrase, ``l`` and ``r`` of its parts at the cut of the least score,
    floor(2000000 * a / (l + r)), of equal ones the first; ``n`` are the words of the language. A phrase is left out if a longer
    frequent one that has it makes up ``INSIDE`` per cent of it. Ordered by score and a, both descending, and by the bytes
    of the phrase. A language without frequent phrases, and an empty table, give no row.
    """
    table = stored(frequent_phrases(docs, text, lang, least, longest), "phrases")
    total = table.where("words = 0").select("lang", F.col("f").alias("n"))
    known = table.where("words > 0").select("lang", F.col("phrase").alias("part"), F.col("f").alias("c"))
    long = table.where("words > 1").withColumnRenamed("f", "a")
    one = F.lit(1)
    cut = long.withColumn("k", F.explode(F.sequence(one, F.col("words") - 1))).select(
        "lang", "phrase", "words", "a", "k",
        _between(F.col("phrase"), one, F.col("k")).alias("head"),
        _between(F.col("phrase"), F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"),
    )
    heads = known.withColumnsRenamed({"part": "head", "c": "l"})
    tails = known.withColumnsRenamed({"part": "tail", "c": "r"})
    score = F.expr(f"(cast({SCALE} as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + r)")
    scored = cut.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    inner = long.where("words > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.withColumn("i", F.explode(F.sequence(one, F.col("words") - F.col("m") + 1)))
    inner = inner.select("lang", _between(F.col("phrase"), F.col("i"), F.col("m")).alias("phrase"), "a")
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    free = best.join(inner, ["lang", "phrase"], "left").where(
        F.col("most").isNull() | (100 * _wide("most") < INSIDE * _wide("a"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = free.select("lang", "phrase", "a", "s.l", "s.r", "s.score").withColumn("rank", F.row_number().over(order))
    return first.where(F.col("rank") <= top).join(total, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex({_LOWER}, '[.,;:!?\\n\\x0B\\x0C\\r]')) AS piece
  FROM documents
), words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \\t]'), lambda x: x <> '') AS w FROM pieces
), sizes AS (
  SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words
), grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM starts, (VALUES (1), (2), (3), (4)) AS sizes_of(k)
  WHERE i + k - 1 <= len(w)
), counts AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}
), cuts AS (
  SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM counts WHERE k > 1
), scored AS (
  SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, c.cut,
         ({SCALE}::HUGEINT * c.f) // (x.f + y.f) AS score
  FROM cuts c
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.cut], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1 : c.k], ' ')
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM scored
), inside AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(f) AS most
  FROM (
    SELECT lang, k, f, string_split(phrase, ' ') AS w, m, unnest(range(1, k - m + 2)) AS i
    FROM counts, (VALUES (2), (3)) AS inner_of(m) WHERE m < k
  ) GROUP BY 1, 2
), ranked AS (
  SELECT b.lang, b.phrase, b.a, b.l, b.r, b.score,
         row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE b.o = 1 AND (i.most IS NULL OR 100 * i.most < {INSIDE} * b.a)
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, s.n::BIGINT AS n, r.score::BIGINT AS score
FROM ranked r JOIN sizes s ON s.lang = r.lang WHERE r.rank <= {TOP}
"""
