"""Curation of long lists: texts are brought to their normal form once, and rows are held only against sets of like size."""

import numpy as np
from pyspark.sql import functions as F

from ligandloom.operators import matching
from ligandloom.operators import similarity as S


def test_blank_texts_are_told_without_their_keys(spark):
    texts = ["a b", " a\t\nb ", "A-b", None, "", " \r\n\t ", "!", " "]
    raw = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = matching.distinct_structures(raw, "text", "id")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "regexp_replace" in x]
    # the signs and the no-break space have keys, whose coarse keys are empty
    assert sorted(tuple(r)[1:] for r in found.collect()) == [(0, 3, 3, 2), (6, 2, 2, 2)]


def test_keys_of_known_rows_are_made_before_they_are_joined(spark):
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def key(text):
        asked.add(1)
        return text

    texts = [(k, f"word {k}") for k in range(20)]
    raw = spark.createDataFrame(texts, "ord long, text string")
    known = spark.createDataFrame(texts[:4], "ord long, text string")
    known = known.select(key("text").alias("coarse"), "ord", F.array(F.lit(1)).alias("on_bits"))
    kept, _ = matching.curate_decoys(raw, "text", "ord", known, known.select("coarse"), lambda c: F.array(F.length(c)), 64)
    assert kept.count() == 20
    assert asked.value == 8  # once for the actives, once for the inactives


def test_rows_are_held_against_sets_of_like_size(monkeypatch):
    """Sets nested in each other: the similarity is the ratio of sizes, so few bands can hold the closest."""
    n_bits, met = 4096, [0]
    flat = np.zeros((n_bits, n_bits), np.uint8)
    flat[np.tril_indices(n_bits)] = 1
    sets = np.packbits(flat, axis=1, bitorder="little").view(np.uint64)
    whole = S._shared

    def counted(one, other):
        met[0] += one.shape[1] * other.shape[1]
        return whole(one, other)

    monkeypatch.setattr(S, "_shared", counted)
    sims, picks = S.best_match(sets[1::2], sets[::2])
    size = np.arange(2, n_bits + 1, 2)
    assert np.allclose(sims, np.maximum((size - 1) / size, np.where(size < n_bits, size / (size + 1), 0)))
    assert (picks * 2 + 1 >= size - 1).all()
    assert met[0] < len(sims) ** 2 / 2
