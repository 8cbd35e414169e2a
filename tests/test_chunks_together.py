"""Small chunks of references go to the tasks together; before, each chunk took a sorted job, a broadcast and a walk of its own."""

import random

import pytest

from ligandloom.operators import similarity as S


def rows(spark):
    rng = random.Random(8)
    lib = [(None if i % 5 == 0 else "same" if i % 5 == 1 else f"l{i}", sorted(rng.sample(range(90), rng.randint(0, 9)))) for i in range(70)]
    ref = [(f"r{i:02d}", sorted(rng.sample(range(90), rng.randint(0, 9))), i) for i in range(57)]
    ref += [("twin", ref[3][1], 100), (None, ref[4][1], 101), ("r05", ref[5][1], 5)]
    want = []
    for key, b in lib:
        sims = [(len(set(b) & set(c)) / len(set(b) | set(c)) if b or c else 1.0, -o, name) for name, c, o in ref]
        best = max(sims, key=lambda s: s[:2])
        want.append((key, best[0], best[2]))
    left = spark.createDataFrame(lib, "k string, on_bits array<int>")
    return left, spark.createDataFrame(ref, "k string, on_bits array<int>, o int").repartition(5), sorted(want, key=str)


@pytest.mark.parametrize("together", [1, 900, 64 << 20])
def test_chunks_in_any_lists_give_the_same_rows(spark, monkeypatch, together):
    left, right, want = rows(spark)
    monkeypatch.setattr(S, "CHUNK_BYTES", together)  # a chunk a list, three of them, or all
    sent = []
    monkeypatch.setattr(S, "_chunks", lambda *a, real=S._chunks: (sent.append(len(c[0])) or c for c in real(*a)))
    got = S.nearest(left, right, "k", "o", n_bits=90, chunk_bytes=300).drop("on_bits")
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert sum(sent) >= 5 and (len(sent) == 1) == (together > 900) and (max(sent) == 1) == (together == 1)


def test_many_small_chunks_are_walked_in_one_pass(spark):
    left, right, want = rows(spark)
    out = S.nearest(left, right, "k", "o", n_bits=90, chunk_bytes=40)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "LogicalRDD" in plan
    assert sorted(map(tuple, out.drop("on_bits").collect()), key=str) == want


def test_no_references(spark):
    left, right, _ = rows(spark)
    got = S.nearest(left, right.where("o < 0"), "k", "o", n_bits=90, chunk_bytes=40).collect()
    assert len(got) == 70 and {(r["max_sim"], r["nearest"]) for r in got} == {(0.0, None)}
