"""The packed rows of op5."""

import numpy as np

from ligandloom.llm import suffix_lm
from ligandloom.llm.phrases import bucket_of


def test_numbers_are_packed_and_unpacked():
    rng = np.random.default_rng(6)
    key, value = rng.integers(0, 1 << 64, 10_000, np.uint64), rng.random(10_000)
    rows = list(suffix_lm.dealt(3, 8, key, value))
    assert sum(number for _, _, number, _ in rows) == len(key)
    back, values = suffix_lm.unpacked([packed for *_, packed in rows], 2)
    order = np.argsort(key)
    assert (back == key[order]).all() and (values.view(float) == value[order]).all()
    assert all((bucket_of(suffix_lm.unpacked([packed], 2)[0], 8) == bucket).all() for bucket, _, _, packed in rows)
    grams = rng.integers(0, 1 << 48, 1000).astype(np.uint64)
    assert (suffix_lm.turned_back(suffix_lm.turned(grams)) == grams).all()


def test_chosen_words_are_spelled_as_all():
    texts = [b"one two three one two", b"", b"  ", "über two\nthree".encode(), b"x"]
    keys, counts = suffix_lm.grams(texts)
    tree = suffix_lm.grow_tree(np.full(len(keys), suffix_lm.DEPTH), (keys >> np.uint64(8)).astype(np.int64), (keys & np.uint64(255)).astype(np.int64), counts)
    machine = suffix_lm.Automaton(tree)
    words, ends = machine.spelled(texts)
    assert np.allclose(np.bincount([0] * 5 + [3] * 3 + [4], words, 5) + ends, machine.scores(texts))
    chosen = np.arange(9) % 2 == 0
    assert np.allclose(machine.spelled(texts, chosen)[0], words[chosen])


def test_shares_make_up_the_whole(spark):
    texts = [b"a b c d a b c d", b"", b"b c d a b", b"x"] * 2
    train = spark.createDataFrame([(t,) for t in texts], "body binary")
    sieve = suffix_lm.repeated(train, 4, 2)

    def numbers(*frames):
        rows = [r for f in frames for r in f.collect()]
        return sorted((r.kind, *x) for r in rows for x in zip(*suffix_lm.unpacked([r.packed], suffix_lm.WIDTHS[r.kind])))

    assert numbers(*(suffix_lm.counted_share(train, 4, sieve, 2, k, 2) for k in range(2))) == numbers(suffix_lm.counted(train, 4, 2))


def test_words_asked_for_are_not_sent_one_by_one(spark):
    docs = spark.createDataFrame([(k, f"a b c{k} d") for k in range(20)], "doc_id bigint, text string")
    plan = suffix_lm.score_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "SortMergeJoin" not in plan
