"""Token counts at every prefix of a text, by dynamic programming over a byte-pair vocabulary.

Byte-pair encoding is local: a row of tokens is the encoding of a text exactly when each two neighbours
are the encoding of their joint text. So of all tokens that end at a position just one can be the last token of the
prefix that ends there: the one that may stand behind the last token of what is left of it. ``count[end] =
count[begin] + 1`` then gives the exact number of tokens of every prefix in one pass, and questions about budgets and
truncation are looked up, not encoded again.

Two tokens may be neighbours if no merge ever crosses their border. That is followed on the parts that touch the
border, from single characters up to the whole tokens: the next merge is the one of least rank, the left one first.
Where a piece has no greater rank than a part of it (runs of spaces), the two are encoded together instead.

No piece spans the cut before a run of spaces or around a line end, so a text is cut there, and the
table of a word is kept for its next occurrences. A character without piece counts its UTF-8 bytes.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligandloom.llm.common import arrow_rows

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
LIMIT = 4096
#: Words whose tables or totals a worker keeps, the longest of them, and pairs of pieces.
MEMO, WORD, PAIRS = 300_000, 64, 400_000
NEVER = float("inf")


class Merges(NamedTuple):
    """Pieces that are the encoding of their own text; a rank says when a piece is merged, the least first."""

    rank: dict[str, float]
    left: dict[str, str]  # the part of a piece that its last merge had on the left
    loose: frozenset[str]  # pieces of no greater rank than a part of theirs
    prefix: bool  # a space is put before a text


def _encoded(text: str, rank: dict[str, float]) -> tuple[list[str], int]:
    """The merged parts of a short text, and how long the left part of the last merge was."""
    parts, cut = list(text), 0
    while len(parts) > 1:
        found = [(rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank]
        if not found:
            break
        k = min(found)[1]
        cut = len(parts[k])
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return parts, cut


def load(path: str = MODEL) -> Merges:
    """The merges of a model file. Read on the driver, they travel with the tasks (below 3 MB for 32,000 pieces)."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    spec = proto.normalizer_spec
    if not proto.trainer_spec.byte_fallback or proto.trainer_spec.model_type != 2:
        raise ValueError("a byte-pair model with byte fallback is needed")
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError("a model without normalisation is needed")
    if any(p.type in (4, 5) for p in proto.pieces):
        raise ValueError("pieces of one's own and unused pieces are not read")
    rank = {p.piece: -p.score for p in proto.pieces if p.type == 1}
    if any(re.search(f"[^{SPACE}]{SPACE}|.\n|\n.", p) for p in rank):
        raise ValueError("a piece reaches over a cut between words")
    return merges_of(rank, spec.add_dummy_prefix)


def merges_of(rank: dict[str, float], prefix: bool) -> Merges:
    if any(c not in rank for piece in rank for c in piece):
        raise ValueError("a character of a piece is no piece")
    whole: dict[str, float] = {}
    left: dict[str, str] = {}
    loose: set[str] = set()
    for piece, r in sorted(rank.items(), key=lambda x: len(x[0])):
        parts, cut = _encoded(piece, rank)
        if len(parts) > 1:
            continue  # other merges come first: no text holds this piece
        whole[piece], left[piece] = r, piece[:cut]
        if cut and any(len(x) > 1 and (rank[x] >= r or x in loose) for x in (piece[:cut], piece[cut:])):
            loose.add(piece)
    return Merges(whole, left, frozenset(loose), prefix)


class PrefixCounter:
    """Tables of words: entry k is the exact number of tokens of the first k characters."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.names = list(merges.rank)
        self.pieces = ahocorasick.Automaton()
        for k, piece in enumerate(self.names):
            self.pieces.add_word(piece, (k, len(piece)))
        self.pieces.make_automaton()
        self.ends: dict[str, list[tuple[str, float]]] = {}
        self.begins: dict[str, list[tuple[str, float]]] = {}
        self.pairs: dict[int, bool] = {}
        self.tables: dict[str, array] = {}
        self.spaced = Totals(self, SPACE)
        self.bare = Totals(self, "")

    def side(self, piece: str, right: bool) -> list[tuple[str, float]]:
        """Parts of a piece at its right or left border, shortest first, each with the rank of the merge that ends it."""
        known = self.ends if right else self.begins
        out = known.get(piece)
        if out is None:
            out, part, until = [], piece, NEVER
            while True:
                out.append((part, until))
                cut = len(self.merges.left[part])
                if not cut:
                    break
                until, part = self.merges.rank[part], part[cut:] if right else part[:cut]
            out.reverse()
            known[piece] = out
        return out

    def neighbours(self, a: str, b: str) -> bool:
        """Is (a, b) the encoding of a + b?"""
        rank = self.merges.rank
        if a in self.merges.loose or b in self.merges.loose:
            return _encoded(a + b, rank)[0] == [a, b]
        ends, begins = self.side(a, True), self.side(b, False)
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = ends[i], begins[j]
            joint = rank.get(x + y)
            if joint is not None and joint < x_until and joint <= y_until:
                return False
            if x_until is NEVER and y_until is NEVER:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def walk(self, word: str) -> list[int]:
        """The table of a word: each prefix ends in the one piece that may follow the last piece of the rest."""
        count, last, done = [0] * (len(word) + 1), [-1] * (len(word) + 1), 0
        pairs, width = self.pairs, len(self.names)
        for end, (piece, size) in self.pieces.iter(word):
            end += 1
            if end == done:
                continue
            begin = end - size
            if begin > done:  # characters without piece, up to where this one begins
                self._spell(word, count, done, begin)
                done = begin
            before = last[begin]
            if before >= 0:
                pair = before * width + piece
                fits = pairs.get(pair)
                if fits is None:
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    fits = pairs[pair] = self.neighbours(self.names[before], self.names[piece])
                if not fits:
                    continue
            count[end], last[end], done = count[begin] + 1, piece, end
        self._spell(word, count, done, len(word))
        return count

    def table(self, word: str) -> array:
        known = self.tables.get(word)
        if known is None:
            known = array("i", self.walk(word))
            if len(word) <= WORD:
                if len(self.tables) >= MEMO:
                    self.tables.clear()
                self.tables[word] = known
        return known

    @staticmethod
    def _spell(word: str, count: list[int], begin: int, end: int) -> None:
        for k in range(begin, end):
            count[k + 1] = count[k] + len(word[k].encode())

    def total(self, text: str) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        for totals in (self.spaced, self.bare):
            if len(totals) > MEMO:
                totals.clear()
        lines = text.split("\n")
        sum_ = (len(lines) - 1) * self.bare["\n"]
        for k, line in enumerate(lines):
            first = self.merges.prefix and k == 0
            if "  " in line or SPACE in line or line.startswith(" "):
                sum_ += sum(self.walk(w)[-1] for w in _cut((SPACE if first else "") + line.replace(" ", SPACE)))
                continue
            words = line.split(" ")
            head = words.pop(0)
            if first:
                sum_ += self.spaced[head]
            elif head:
                sum_ += self.bare[head]
            sum_ += sum(map(self.spaced.__getitem__, words))
        return sum_

    def prefixes(self, text: str) -> np.ndarray:
        """Entry k is the number of tokens of ``text[:k]``."""
        shift = int(self.merges.prefix)
        out = np.zeros(len(text) + 1 + shift, np.int32)
        at = base = 0
        for word in _cut(SPACE * shift + text.replace(" ", SPACE)) if text else ():
            table = np.frombuffer(self.table(word), np.int32)
            out[at + 1 : at + len(table)] = table[1:] + base
            at, base = at + len(word), base + int(table[-1])
        out = out[shift:]
        out[0] = 0
        return out


class Totals(dict):
    """Tokens of words that stand behind ``before``."""

    def __init__(self, counter: PrefixCounter, before: str):
        super().__init__()
        self.counter, self.before = counter, before

    def __missing__(self, word: str) -> int:
        n = self.counter.walk(self.before + word)[-1]
        if len(word) <= WORD:
            self[word] = n
        return n


_cut = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+").findall
_COUNTERS: dict[tuple, PrefixCounter] = {}


def counter_of(merges: Merges) -> PrefixCounter:
    """Built once in a worker and used for all its tasks."""
    mark = (len(merges.rank), hash(frozenset(merges.rank.items())), merges.prefix)
    if mark not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[mark] = PrefixCounter(merges)
    return _COUNTERS[mark]


def _mapped(docs: DataFrame, text: str, key: str, path: str, schema: str, fn) -> DataFrame:
    """Rows of the key and of what ``fn(counter, text)`` gives; a null text is empty."""
    merges = load(path)

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        counter = counter_of(merges)
        for doc, body in rows:
            yield doc, *fn(counter, body or "")

    kind = docs.schema[key].dataType.simpleString()
    picked = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return arrow_rows(picked, run, f"doc_id {kind}, {schema}", batch=256)


def token_counts(
    docs: DataFrame, limit: int = LIMIT, text: str = "text", key: str = "doc_id", path: str = MODEL
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row.

    Null and empty texts have no token; repeated rows stay repeated, other columns are not read.
    """
    counted = _mapped(
        docs, text, key, path, "n_bytes bigint, n_tokens bigint",
        lambda counter, body: (len(body.encode()), counter.total(body)),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def prefix_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str = MODEL) -> DataFrame:
    """doc_id and counts: entry k (from 0) is the number of tokens of the first k characters; [0] for null and empty texts."""
    return _mapped(
        docs, text, key, path, "counts array<int>", lambda counter, body: (counter.prefixes(body).tolist(),)
    )


def tokens_upto(counts: str, chars) -> F.Column:
    """Tokens of the first ``chars`` characters (a number or column), from a column of ``prefix_counts``."""
    place = F.least(F.greatest(chars if isinstance(chars, F.Column) else F.lit(chars), F.lit(0)), F.size(counts) - 1)
    return F.element_at(counts, place.cast("int") + 1)


def truncated(
    docs: DataFrame, budget: int = LIMIT, text: str = "text", key: str = "doc_id", path: str = MODEL
) -> DataFrame:
    """doc_id, text (its longest prefix of at most ``budget`` tokens), n_tokens of that, and cut (was it shortened).

    One more character can make fewer tokens, so the longest prefix is sought from the end.
    """

    def shorten(counter: PrefixCounter, body: str) -> tuple:
        counts = counter.prefixes(body)
        end = int(np.flatnonzero(counts <= max(0, budget))[-1])
        return body[:end], int(counts[end]), end < len(body)

    return _mapped(docs, text, key, path, "text string, n_tokens bigint, cut boolean", shorten)


def packed(docs: DataFrame, budget: int = LIMIT, text: str = "text", key: str = "doc_id", path: str = MODEL) -> DataFrame:
    """doc_id, part (from 0), begin, end and n_tokens: each text cut into parts of at most ``budget`` tokens.

    A part is as long as it can be without going over the budget on the way, counted by differences of the
    prefix counts at word cuts; a word of more tokens is a part of its own. Texts without a character have no part.
    """

    def parts(counter: PrefixCounter, body: str) -> tuple:
        out, begin, at, held = [], 0, 0, 0
        shift = int(counter.merges.prefix)
        for word in _cut(SPACE * shift + body.replace(" ", SPACE)) if body else ():
            n, size = counter.table(word)[-1], len(word) - (shift if at == 0 else 0)
            if held and held + n > budget:
                out.append((len(out), begin, at, held))
                begin, held = at, 0
            at, held = at + size, held + n
        return ([*out, (len(out), begin, at, held)] if at else [],)

    cut = _mapped(
        docs, text, key, path, "parts array<struct<part:bigint,begin:bigint,end:bigint,n_tokens:bigint>>", parts
    )
    return cut.select("doc_id", F.inline("parts"))
