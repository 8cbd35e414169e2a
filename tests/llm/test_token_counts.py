"""Prefix tables against the library, which encodes every prefix anew."""

import random

import numpy as np
import sentencepiece
from pyspark.sql import functions as F

from ligandloom.llm import token_counts as T
from ligandloom.llm.queries import LLM

PARTS = ["a", "b", "  ", " ", "\n", "▁", "é", "漢", "😀", "<s>", "</s>", "<0x0A>", "<unk>", "\t", "the", "ing", "ab", "\x00",
         "\r", "aaaa", "1", "00", "…", "ﷺ", " " * 17, "ould", "Ⅷ", "é"]


def library():
    return sentencepiece.SentencePieceProcessor(model_file=T.MODEL)


def odd_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(25))) for _ in range(n)]


def test_every_prefix():
    counter, sp = T.PrefixCounter(T.load()), library()
    for text in odd_texts(1, 400):
        want = [len(x) for x in sp.encode([text[:k] for k in range(len(text) + 1)])]
        assert counter.prefixes(text).tolist() == want
        assert counter.total(text) == want[-1]


def test_small_memory(monkeypatch):
    for name in ("MEMO", "WORD", "PAIRS"):
        monkeypatch.setattr(T, name, 3)
    counter, sp = T.PrefixCounter(T.load()), library()
    for text in odd_texts(2, 150):
        assert counter.total(text) == len(sp.encode(text)) == counter.prefixes(text)[-1]


def test_random_vocabularies():
    """Ranks that grow with the merges, and ranks without any order: greedy merging is the reference."""
    rng = random.Random(4)
    for grown in (True, False) * 15:
        pieces = list("abc")
        while len(pieces) < 25:
            joint = rng.choice(pieces) + rng.choice(pieces)
            if joint not in pieces and len(joint) < 9:
                pieces.append(joint)
        ranks = list(range(len(pieces)))
        if not grown:
            ranks[3:] = [rng.randrange(3, 9) for _ in pieces[3:]]  # ties as well
        rank = {p: float(r) for p, r in zip(pieces, ranks)}
        counter = T.PrefixCounter(T.merges_of(rank, False))
        for _ in range(60):
            text = "".join(rng.choice("abcd") for _ in range(rng.randrange(30)))
            want = [len(T._encoded(text[:k], rank)[0]) for k in range(len(text) + 1)]
            assert counter.walk(text) == want


def test_query_on_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    sp = library()
    want = {(d, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for d, t in docs}
    got = LLM["op12_token_counts"].run(spark, sf)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(docs)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}


def test_budgets_without_encoding_again(spark):
    sp, texts = library(), [*odd_texts(5, 60), None, "", "word " * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    counts = {r.doc_id: r.counts for r in T.prefix_counts(docs).collect()}
    cuts = {r.doc_id: r for r in T.truncated(docs, 7).collect()}
    for k, text in enumerate(texts):
        text = text or ""
        want = [len(x) for x in sp.encode([text[:i] for i in range(len(text) + 1)])]
        assert counts[k] == want
        end = max(i for i, n in enumerate(want) if n <= 7)
        assert (cuts[k].text, cuts[k].n_tokens, cuts[k].cut) == (text[:end], want[end], end < len(text))
    asked = T.prefix_counts(docs).select("doc_id", "counts", T.tokens_upto("counts", 3).alias("n"), T.tokens_upto("counts", F.col("doc_id")).alias("m"))
    for r in asked.collect():
        assert r.n == r.counts[min(3, len(r.counts) - 1)] and r.m == r.counts[min(r.doc_id, len(r.counts) - 1)]


def test_parts_stay_in_the_budget(spark):
    texts = {0: "one two  three\nfour " * 40, 1: "", 2: None, 3: "x" * 300}
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    rows = sorted(T.packed(docs, 16).collect())
    sp = library()
    for k, text in texts.items():
        mine = [r for r in rows if r.doc_id == k]
        assert "".join((text or "")[r.begin : r.end] for r in mine) == (text or "")
        assert sum(r.n_tokens for r in mine) == len(sp.encode(text or ""))
    assert all(r.n_tokens <= 16 for r in rows if r.doc_id == 0)
    assert len([r for r in rows if r.doc_id == 3]) == 1


def test_defined_cases(spark):
    rows = [(None, None, 1), (1, "", 2), (1, "a b", 3), (1, "a b", 3), (2, "long " * 200_000, 4), (3, "y" * 200_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_tokens int")
    got = T.token_counts(docs, limit=2).collect()
    sp = library()
    assert sorted(got, key=str) == sorted(
        [(d, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 2) for d, t, _ in rows], key=str
    )
    assert T.token_counts(docs.limit(0)).count() == 0
    named = docs.select(F.col("doc_id").alias("text"), F.col("text").alias("doc_id"))
    assert T.token_counts(named, text="doc_id", key="text").count() == len(rows)


def test_totals_are_ends_of_tables():
    counter = T.PrefixCounter(T.load())
    assert np.array_equal(counter.prefixes("abc abc"), np.array([0, *[counter.total("abc abc"[:k]) for k in range(1, 8)]]))
