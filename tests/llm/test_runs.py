"""Runs against the definition, word by word and in batches."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from ligandloom.llm import runs as R
from ligandloom.llm.queries import LLM


def plain(words, least=12):
    """(start, length, period): every maximal match of each period; of equal stretches the least period."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        k = 0
        while k + p < len(words):
            end = k
            while end + p < len(words) and words[end] == words[end + p]:
                end += 1
            if end > k and end + p - k >= max(least, 2 * p):
                found.setdefault((k, end + p - k), p)
            k = max(end, k + 1)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def some_words(rng):
    n, kinds = rng.choice([0, 1, 5, 11, 12, 13, 24, 30, 61, 130]), rng.choice([1, 2, 2, 3, 5])
    words = [bytes([97 + rng.randrange(kinds)]) for _ in range(n)]
    if n and rng.random() < 0.6:
        q = rng.randint(1, max(1, n // 2))
        words = [words[k % q] if rng.random() < 0.97 else b"x" for k in range(n)]
    return words + [b"z"] + words + words[: n // 2] if rng.random() < 0.3 else words


def test_many_texts_at_once():
    rng = random.Random(1)
    texts = [some_words(rng) for _ in range(1200)]
    for k in range(0, len(texts), 150):
        part = texts[k : k + 150]
        found, keeps = R.runs_of([b" ".join(w) for w in part])
        for words, got, keep in zip(part, found, keeps):
            want = plain(words)
            assert [tuple(r) for r in got.tolist()] == want
            dropped = {i for s, n, p in want for i in range(s + p, s + n)}
            assert keep.tolist() == [i not in dropped for i in range(len(words))]


def test_online_in_any_batches():
    rng = random.Random(2)
    for _ in range(500):
        words = some_words(rng)
        hashes = np.array([zlib.crc32(w) + 1 for w in words], np.uint64)
        for least in (2, 3, 12, 20):
            catcher, parts, at = R.SquareCatcher(least), [], 0
            while at < len(words):
                step = rng.choice([1, 1, 2, 7, 40])
                got = catcher.append(hashes[at : at + step])
                at += step
                assert all(end < min(at, len(words)) for end in got[:, 1])  # reported as soon as a word breaks it
                parts.append(got)
            parts.append(catcher.finish())
            got = sorted(((s, e - s, p) for s, e, p in np.concatenate(parts).tolist()), key=lambda r: (r[0], r[2]))
            assert got == plain(words, least)


def test_levels_cover_every_period():
    for least in (2, 3, 7, 12, 50):
        periods = [p for _, a, b in R.level_periods(least, 500) for p in range(a, b + 1)]
        assert sorted(periods) == list(range(1, 501))
        for level, a, b in R.level_periods(least, 500):
            assert all(2 * (1 << level) - 1 <= max(p, least - p) for p in range(a, b + 1))


def test_long_texts():
    words = [b"a"] * 300_000
    (found,), (keep,) = R.runs_of([b" ".join(words)])
    assert found.tolist() == [[0, 300_000, 1]] and keep.sum() == 1
    rng = random.Random(5)
    block = [b"%d" % rng.randrange(10**9) for _ in range(40_000)]
    (found,), _ = R.runs_of([b" ".join(block * 2 + block[:5] + [b"x"])])
    assert found.tolist() == [[0, 80_005, 40_000]]


def test_thue_morse_has_no_cubes():
    """A word in which weak polynomial hashes collide."""
    word = [b"a", b"b"]
    while len(word) < 4096:
        word += [b"b" if x == b"a" else b"a" for x in word]
    (found,), _ = R.runs_of([b" ".join(word)])
    assert [tuple(r) for r in found.tolist()] == plain(word)


def planted(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    return words


def digest(doc_id, text):
    words = planted(doc_id, text)
    found = plain(words)
    dropped = {i for s, n, p in found for i in range(s + p, s + n)}
    best = min(((-n, s, p) for s, n, p in found), default=None)
    longest = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    kept = b" ".join(w for k, w in enumerate(words) if k not in dropped)
    return (doc_id, len(found), *longest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_on_all_documents(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = LLM["op13_word_runs"].run(spark, sf)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for _, t in got.dtypes} == {"bigint", "string"}
    assert sorted(map(tuple, got.collect())) == sorted(digest(*r) for r in docs)


def test_defined_cases(spark):
    rows = [(None, None), (None, "a b " * 20), (1, ""), (30, " \t\n "), (7, "Aa aA\x1c " * 9), (7, "Aa aA\x1c " * 9)]
    rows += [(k, "u v w x " * (k % 9) + "é y " * k) for k in range(60)]
    docs = spark.createDataFrame([(*r, "runs", 0) for r in rows], "doc_id long, text string, runs string, collapsed int")
    got = R.run_digest(R.find_runs(R.with_planted_periods(docs)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((digest(*r) for r in rows), key=str)
    assert R.run_digest(R.find_runs(R.with_planted_periods(docs.limit(0)))).count() == 0
    found = R.find_runs(docs.where("doc_id = 30 and runs is not null").select("doc_id", F.col("text")))
    assert found.where("collapsed is null").count() == 0
