"""Phrases against plain counting, and the guarantee of the summaries."""

import random
from collections import Counter

import numpy as np
import pytest
from check_oracle import compare, connect

from ligandloom.llm import phrases


def frame(spark, rows, schema="doc_id long, text string, lang string"):
    return spark.createDataFrame(rows, schema)


def plain_counts(rows, least):
    counts, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in ",;:!?\n\x0b\x0c\r":
            text = text.replace(c, ".")
        total[lang] += 0
        for piece in text.split("."):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            total[lang] += len(words)
            for n in range(1, 5):
                counts.update((lang, tuple(words[k : k + n])) for k in range(len(words) - n + 1))
    return {k: n for k, n in counts.items() if n >= least}, total


def plain(rows, least, top):
    f, total = plain_counts(rows, least)
    found = {}
    for (lang, w), a in f.items():
        if len(w) < 2:
            continue
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        inside = any(
            x == lang and len(v) > len(w) and 100 * b >= 80 * a
            and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))
            for (x, v), b in f.items()
        )
        if not inside:
            found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted(
        (lang, rank, p.decode(), -a, x, y, total[lang], -s)
        for lang, rows in found.items()
        for rank, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)
    )


def texts(seed, n):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        words = [rng.choice(["The", "new", "york", "städt", "x", "a\x1cb", "of", "é"]) for _ in range(rng.randrange(40))]
        glue = [rng.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "\x0b"]) for _ in words]
        body = "".join(a + b for a, b in zip(words, glue))
        out.append((k, rng.choice([body, body, body, None, "", "New York City! new york city"]), rng.choice(["en", "de", None])))
    return out


def test_equals_plain_counting(spark):
    rows = texts(1, 150)
    got = phrases.collocations(frame(spark, rows), least=5, top=15)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, 5, 15)


def test_many_partitions_and_small_memory(spark, monkeypatch):
    rows = texts(2, 120)
    monkeypatch.setattr(phrases, "PART", 200)
    got = phrases.frequent_phrases(frame(spark, rows).repartition(5), least=4)
    want, total = plain_counts(rows, 4)
    want = {(lang, " ".join(w)): n for (lang, w), n in want.items()} | {(lang, ""): n for lang, n in total.items()}
    assert {(r.lang, r.phrase): r.f for r in got.collect()} == want


def test_summary_keeps_all_frequent_keys(monkeypatch):
    """Zipf-like masses merged in any order: what is taken stays below the threshold."""
    monkeypatch.setattr(phrases, "KEYS_HELD", 50)
    rng = np.random.default_rng(3)
    for least in (3, 10, 30):
        stream = (rng.zipf(1.3, 20_000) % 5_000).astype(np.uint32)
        true = Counter(stream.tolist())
        summary = phrases.Summary(len(stream) // least + 1)
        for part in np.array_split(stream, 37):
            keys, counts = np.unique(part, return_counts=True)
            summary.add(keys, counts.astype(np.int64))
        summary.settle()
        assert summary.error < least and len(summary.keys) <= summary.capacity
        held = dict(zip(summary.keys.tolist(), summary.counts.tolist()))
        assert summary.error > 0 or least == 3
        for key, n in true.items():
            assert held.get(key, 0) <= n <= held.get(key, 0) + summary.error


def test_exact_beyond_64_bits(spark):
    """Scores of counts whose products pass 64 bits."""
    table = spark.sql("SELECT cast(9000000000000000000 as bigint) a, cast(9000000000000000001 as bigint) l, cast(9223372036854775807 as bigint) r")
    score = "(cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + r)"
    a, x, y = 9000000000000000000, 9000000000000000001, 9223372036854775807
    assert table.selectExpr(f"{score} AS s").first().s == 2_000_000 * a // (x + y)


def test_defined_cases(spark):
    empty = frame(spark, [])
    assert phrases.collocations(empty).count() == 0
    odd = frame(spark, [(None, None, None), (1, "", "en"), (1, "...;;\n", None)])
    assert phrases.collocations(odd, least=1).count() == 0
    rows = [(1, "b a " * 3000, None), (1, "b a " * 3000, None)]  # repeated rows count each time; a very long piece
    got = phrases.collocations(frame(spark, rows), least=30)
    assert sorted(map(tuple, got.collect())) == plain(rows, 30, 2000)
    clash = frame(spark, [(1, "u v u v", "en", "x", 5)], "doc_id long, text string, lang string, phrase string, f long")
    assert {r.phrase for r in phrases.collocations(clash, least=2).collect()} == {"u v"}


def test_ties_go_by_bytes(spark):
    rows = [(k, "é z. z é. a b. B a", "en") for k in range(3)]
    got = phrases.collocations(frame(spark, rows), least=3)
    assert [r.phrase for r in got.orderBy("rank").collect()] == sorted(["é z", "z é", "a b", "b a"], key=str.encode)


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001"])
def test_query_equals_sql(spark, sf_dir):
    from ligandloom.llm.queries import LLM

    query = LLM["op11_phrases"]
    assert compare(query.run(spark, sf_dir), connect(sf_dir), query.sql) == ""
