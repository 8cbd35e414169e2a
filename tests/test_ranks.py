import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ligandloom.operators import curation, dedup, ranks


def test_hash_rank_matches_plain_order(spark):
    import hashlib

    df = spark.range(500).withColumn("c", F.col("id") % 2)
    got = {r["id"]: r["rank"] for r in ranks.hash_rank(df, "id", 7, ("c",), digits=2).collect()}
    for c in (0, 1):
        order = sorted((i for i in range(500) if i % 2 == c), key=lambda i: hashlib.md5(f"7|{i}".encode()).hexdigest())
        assert [got[i] for i in order] == list(range(1, 251))
    top = ranks.hash_rank(df, "id", 7, upto=13)
    assert sorted(r["rank"] for r in top.collect()) == list(range(1, 14))


def test_dense_number(spark):
    words = [f"w{random.Random(1).random()}{i}" for i in range(300)]
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(5)
    got = {r["w"]: r["n"] for r in ranks.dense_number(df, ["w"], "n").collect()}
    assert got == {w: i + 1 for i, w in enumerate(sorted(words))}


def test_running_totals_have_no_single_task_window(spark):
    rng = random.Random(2)
    rows = [(g, float(i), rng.randint(1, 9)) for g in "ab" for i in range(200)]
    df = spark.createDataFrame(rows, "g string, v double, n long")
    out = ranks.running_totals(df, [F.col("v").desc()], {"cum": "n"}, ["g"])
    for g in "ab":
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: -r[1])
        want = np.cumsum([r[2] for r in mine]).tolist()
        got = [r["cum"] for r in sorted(out.where(F.col("g") == g).collect(), key=lambda r: -r["v"])]
        assert got == want


@pytest.mark.parametrize("slices", [1, 50, ranks.SLICES])
def test_percentiles_with_a_hot_key(spark, slices):
    """A third of the rows share one key; any slices give the same exact values."""
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.34 else f"k{rng.randint(0, 40)}", round(rng.gauss(0, 3), 1)) for _ in range(900)]
    df = spark.createDataFrame(rows, "k string, v double")
    out = ranks.group_with_percentiles(
        df, ["k"], [F.count(F.lit(1)).alias("n")], {"med": ("v", 0.5), "p95": ("v", 0.95)}, slices
    )
    got = {r["k"]: (r["n"], r["med"], r["p95"]) for r in out.collect()}
    for k in {r[0] for r in rows}:
        vals = [v for key, v in rows if key == k]
        assert got[k][0] == len(vals)
        assert got[k][1:] == pytest.approx(tuple(np.percentile(vals, [50, 95])))


def test_percentiles_of_extreme_values(spark):
    rng = random.Random(8)
    some = [0.0, 1e-320, -1e-320, 1e308, -1e308, float("inf"), 1.0, 1.0000000001, 0.9999999, -3.5, 7.25]
    rows = [(k % 3 or None, rng.choice([*some, None])) for k in range(300)] + [(9, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    probs = {"a": 0.0, "b": 0.31, "c": 0.5, "d": 0.9, "e": 1.0}
    want = df.where("v is not null").groupBy("k").agg(*[F.percentile("v", F.lit(p)).alias(o) for o, p in probs.items()])
    got = ranks.percentiles(df, ["k"], "v", probs, 3)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_slices_never_fall(spark):
    values = sorted({x * 10.0**e for x in (-9.99, -1.0, 0.0, 1.0, 1.5, 9.99) for e in range(-300, 300, 7)})
    df = spark.createDataFrame([(v,) for v in [*values, float("inf"), float("nan")]], "v double")
    found = [r.s for r in df.select(ranks.value_slice(F.col("v"), 64).alias("s"), "v").orderBy("v").collect()]
    assert found == sorted(found)


def test_robust_dedup_grades(spark):
    rows = [
        ("a", "i1", "s", "=", 100.0), ("a", "i2", "t", "=", 100.0),  # high
        ("b", None, "s", "=", 1.0), ("b", "i3", "s", "=", 9.0),  # good
        ("c", "i4", "s", "=", 1.0), ("c", "i4", "s", "=", 90.0),  # moderate
        ("d", "i5", "s", "=", 1.0), ("d", "i5", "s", "=", 1e4),  # conflict
        ("e", "i6", "s", ">", 1.0),  # qualified only
        ("f", "i7", "s", None, 5.0), ("f", "i7", "s", "<", 6.0),  # single
        ("g", None, "s", "=", 0.0), (None, "i8", "s", "=", 1.0), ("h", "i9", "s", "=", None),
    ]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "key string, id string, source string, relation string, v double, ord int")
    got = {r["key"]: r for r in dedup.robust_dedup(df, "key", "v", "ord").collect()}
    assert {k: r["confidence"] for k, r in got.items()} == {
        "a": dedup.HIGH, "b": dedup.GOOD, "c": dedup.MODERATE, "d": dedup.CONFLICT, "e": dedup.QUALIFIED_ONLY,
        "f": dedup.SINGLE, "g": dedup.SINGLE,
    }
    assert [k for k, r in sorted(got.items()) if r["recommend_keep"]] == ["a", "b", "c", "f", "g"]
    assert got["a"]["sources"] == "s, t" and got["b"]["id"] == "i3" and got["g"]["id"] == ""
    assert got["d"]["fold_change"] == 10000.0 and got["d"]["range_log"] == 4.0
    assert got["e"]["value_median"] is None and got["f"]["n_qualified"] == 1


def test_mark_duplicates(spark):
    rows = [(0, "x", "A"), (1, "x", "A"), (2, "b", "A"), (3, "b", "B"), (4, None, "A"), (5, None, "B"), (6, "z", "A")]
    df = spark.createDataFrame(rows, "ord int, key string, source string")
    got = {r["ord"]: tuple(r)[3:] for r in curation.mark_duplicates(df, "key").collect()}
    assert got == {
        0: (2, True, 2, False), 1: (2, True, 2, False), 2: (2, True, 1, True), 3: (2, True, 1, True),
        4: (1, False, None, False), 5: (1, False, None, False), 6: (1, False, None, False),
    }


def test_require_target_names_others(spark):
    df = spark.createDataFrame([(" T1 ",), ("T2",), ("T2",)], "t string")
    assert curation.select_target(df, "t", "T1").count() == 1
    with pytest.raises(ValueError, match=r"T2 \(2\), T1 \(1\)"):
        curation.select_target(df, "t", "T9")
