"""Secrets in whole texts: fixed patterns, and strings that a tokenizer cannot shorten.

Ordinary words of any language come out of a byte-pair vocabulary at two or more
characters a token; random strings do not. A run of 20 or more key characters with too few
characters a token is taken for a secret, unless it is a digest of a known length,
a UUID or another identifier. What of a run lies outside the spans of the fixed patterns is judged by itself.
If the whole is none, its segments between ``= / _ -`` are, and chains of segments that are no words.
The limit is 1.7 characters a token, and 2.0 for segments of letters of one case, which fewer tokens spell.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ligandloom.llm.common import raw

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
RATIO, LEAST = 1.7, 20
ONE_CASE = 2.0
MASK = "[SECRET]"
KINDS = ("assign", "access", "hex", "random")

# fixed values: the patterns of the three base kinds, on lower-cased bytes for the first
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")

RUN = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
#: Hex digests of 128 to 512 bits, and UUIDs.
KNOWN = re.compile(
    rb"(?i:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"
    rb"|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"
)
SEGMENT = re.compile(rb"[A-Za-z0-9+]+")
LETTERS = re.compile(rb"[a-z]+|[A-Z]+")
#: A word with a short number at most.
WORD = re.compile(rb"[A-Za-z]{3,}[0-9]{0,4}")
#: Numbers, dates and rules; names and paths made of words with a short number at most.
NAME = re.compile(rb"[0-9_+/=-]+|(?:[A-Za-z]{3,}[0-9]{0,4}[_/=+-]+)+[A-Za-z]{3,}[0-9]{0,4}")


def read_ranks(path: str = RANKS) -> dict[bytes, int]:
    """The vocabulary, below 2 MB; it travels with the tasks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Scanner:
    def __init__(self, ranks: dict[bytes, int], ratio: float = RATIO):
        import tiktoken

        self.ratio = ratio
        self.encoding = tiktoken.Encoding("runs", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    def random(self, run: bytes) -> bool:
        """Is this run shortened too little? Long runs are encoded in parts of 256 characters."""
        if KNOWN.fullmatch(run) or NAME.fullmatch(run):
            return False
        return len(run) < self.ratio * self.tokens(run)

    def tokens(self, run: bytes) -> int:
        text = run.decode()
        return sum(len(self.encoding.encode_ordinary(text[k : k + 256])) for k in range(0, len(text), 256))

    def word(self, segment: bytes) -> bool:
        return bool(WORD.fullmatch(segment)) and len(segment) >= ONE_CASE * self.tokens(segment)

    def secrets(self, run: bytes) -> list[tuple[int, int]]:
        """Places of the random parts: the whole, or chains of segments that are no words, or single segments."""
        if len(run) < LEAST or KNOWN.fullmatch(run):
            return []
        if self.random(run):
            return [(0, len(run))]
        out, chain = [], []
        for m in [*SEGMENT.finditer(run), None]:
            if m and not self.word(m[0]):
                chain.append(m)
                continue
            if chain and chain[-1].end() - chain[0].start() >= LEAST:
                part = (chain[0].start(), chain[-1].end())
                if self.random(run[slice(*part)]):
                    out.append(part)
                elif not KNOWN.fullmatch(run[slice(*part)]):
                    out += [x.span() for x in chain if self.lone(x[0])]
            chain = []
        return out

    def lone(self, segment: bytes) -> bool:
        """Is this segment random, by the limit of its alphabet?"""
        if len(segment) < LEAST or KNOWN.fullmatch(segment):
            return False
        if LETTERS.fullmatch(segment):
            return len(segment) <= ONE_CASE * self.tokens(segment)
        return self.random(segment)

    def spans(self, text: bytes | None) -> list[tuple[int, int, int]]:
        """(start, kind, end) by start, in code points, end exclusive."""
        if not text:
            return []
        low, out = text.lower(), []
        if any(w in low for w in ASSIGN_WORDS):
            out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(low) if m.end(2) - m.start(2) >= 6]
        if b"AKIA" in text:
            out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        # parts of a word beside a base span are judged by themselves, so such texts are always searched
        if out or any(len(w) >= LEAST and self.holds_random(w) for w in text.split()):
            base = sorted(out)
            for m in RUN.finditer(text):
                at = m.start()
                for s, _, e in [*(x for x in base if x[0] < m.end() and m.start() < x[2]), (m.end(), 0, m.end())]:
                    out += [(at + a, 3, at + b) for a, b in self.secrets(text[at : max(at, s)])]
                    at = max(at, e)
        if not out:
            return []
        out.sort()
        if len(text) == len(text.decode("utf-8", "replace")):
            return out
        place, at, count = {}, 0, 0
        for b in sorted({x for s, _, e in out for x in (s, e)}):
            count += len(text[at:b].decode("utf-8", "replace"))
            place[b], at = count, b
        return [(place[s], k, place[e]) for s, k, e in out]

    def holds_random(self, word: bytes) -> bool:
        return any(self.secrets(m[0]) for m in RUN.finditer(word))


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def masked(text: str, spans: list[tuple[int, int, int]], mask: str = MASK) -> str:
    """The text with each span, or chain of overlapping spans, replaced."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]])


DIGEST = "struct<n_assign:bigint,n_access:bigint,n_hex:bigint,base_sha256:string,spans:string>"


def digest_column(ranks: dict[bytes, int], text: str | Column, ratio: float = RATIO) -> Column:
    """Counts of the base kinds, SHA-256 of the base spans, and all spans, of a text column."""

    @F.arrow_udf(DIGEST)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(ranks, ratio)
        for texts in batches:
            rows = []
            for t in texts:
                spans = scanner.spans(t.as_py())
                base = [x for x in spans if x[1] < 3]
                count = [sum(x[1] == k for x in base) for k in range(3)]
                rows.append((*count, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
            names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
            columns = [[r[k] for r in rows] for k in range(5)]
            yield pa.StructArray.from_arrays(
                [pa.array(c, pa.int64() if k < 3 else pa.string()) for k, c in enumerate(columns)], names
            )

    return run(raw(text))


def find_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str = RANKS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row; null texts are empty, repeated rows stay."""
    found = docs.select(F.col(key).alias("doc_id"), digest_column(read_ranks(path), text).alias("found"))
    return found.select("doc_id", "found.*")


def mask_column(ranks: dict[bytes, int], text: str | Column, ratio: float = RATIO) -> Column:
    """The text without its secrets; null stays null."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(ranks, ratio)
        for texts in batches:
            out = []
            for t in (x.as_py() for x in texts):
                spans = scanner.spans(t.encode("utf-8", "replace")) if t else []
                out.append(masked(t, spans) if spans else t)
            yield pa.array(out, pa.string())

    return run(F.col(text) if isinstance(text, str) else text)


def mask_documents(docs: DataFrame, text: str = "text", count: str = "n_chars", path: str = RANKS) -> DataFrame:
    """``docs`` with the secrets in ``text`` masked and ``count`` set anew; no row is dropped, other columns stay."""
    clean = docs.withColumn(text, mask_column(read_ranks(path), text))
    if count not in docs.columns:
        return clean
    return clean.withColumn(count, F.length(text).cast(docs.schema[count].dataType))
