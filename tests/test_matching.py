import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ligandloom.operators import matching as M
from ligandloom.operators import similarity as S

COLS = ("p1", "p2", "p3")
TOL = (25.0, 1.0, 0.0)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def frames(spark, pool, actives):
    schema = "id long, p1 double, p2 double, p3 double"
    return spark.createDataFrame(pool, schema), spark.createDataFrame(actives, schema)


def close(a, c):
    return all(abs(x - y) <= t for x, y, t in zip(a, c, TOL))


def make(seed, n_pool, n_act, hot):
    """Coarse values give ties and boundary hits; ``hot`` of the pool is one vector."""
    rng = random.Random(seed)

    def vector():
        return (rng.choice([0.0, 25.0, 50.0, 60.5, -25.0]), rng.choice([0.0, 1.0, 2.0, 0.3]), float(rng.randint(0, 1)))

    pool = [(i, *((0.0, 0.0, 0.0) if rng.random() < hot else vector())) for i in range(n_pool)]
    return pool, [(1000 + i, *vector()) for i in range(n_act)]


def test_tolerance_pairs_equal_brute_force(spark):
    pool, act = make(1, 120, 40, 0.3)
    p, a = frames(spark, pool, act)
    out = M.tolerance_pairs(p, a.withColumnRenamed("id", "aid"), COLS, TOL)
    assert "CartesianProduct" not in plan(out) and "NestedLoop" not in plan(out)
    got = {(r["id"], r["aid"]) for r in out.collect()}
    assert got == {(x[0], y[0]) for x in pool for y in act if close(x[1:], y[1:])}


def loop(pool, act, arrival, n_need=None):
    free, out = {y[0]: y[1:] for y in act}, {}
    for x in sorted(pool, key=lambda x: (arrival[x[0]], x[0])):
        fits = [(sum(abs(u - v) / (t or 1) for u, v, t in zip(free[k], x[1:], TOL)), k) for k in free if close(free[k], x[1:])]
        if fits and (n_need is None or len(out) < n_need):
            out[x[0]] = min(fits)[1]
            del free[out[x[0]]]
    return out


ALL = M.PART_PAIRS


@pytest.mark.parametrize("seed, n_pool, n_act, hot, need, part_pairs", [
    (1, 60, 25, 0.34, None, ALL), (2, 30, 60, 0.0, 9, ALL), (3, 150, 30, 0.8, None, ALL), (4, 40, 40, 0.1, 3, ALL),
    (1, 60, 25, 0.34, None, 15), (2, 30, 60, 0.0, 9, 0),
])
def test_exclusive_assignment_equals_the_loop(spark, seed, n_pool, n_act, hot, need, part_pairs):
    """All parts walked, small ones walked and large ones in rounds, and all in rounds."""
    pool, act = make(seed, n_pool, n_act, hot)
    p, a = frames(spark, pool, act)
    p = p.withColumn("arrival", F.md5(F.col("id").cast("string")))
    arrival = {r["id"]: r["arrival"] for r in p.collect()}
    won = M.exclusive_assignment(p, a, "id", "id", "id", COLS, TOL, "arrival", need, part_pairs)
    got = {r["pool"]: r["active"] for r in won.collect()}
    assert got == loop(pool, act, arrival, need)
    assert len(set(got.values())) == len(got)


def test_no_pairs(spark):
    p, a = frames(spark, [(1, 0.0, 0.0, 0.0)], [(2, 900.0, 0.0, 0.0)])
    p = p.withColumn("arrival", F.md5(F.col("id").cast("string")))
    assert M.exclusive_assignment(p, a, "id", "id", "id", COLS, TOL, "arrival").count() == 0


def count_rounds(monkeypatch):
    made = []
    keep = M.stored
    monkeypatch.setattr(M, "stored", lambda df, name: made.append(name) or keep(df, name))
    return lambda: made.count("rows")


def test_a_long_chain_settles_in_few_rounds(spark, monkeypatch):
    """Different actives in one narrow region, each wanted most by one pool row and next by its neighbour."""
    rounds = count_rounds(monkeypatch)
    act = [(1000 + i, float(i), 0.0, 0.0) for i in range(200)]
    pool = [(i, i + 0.4, 0.0, 0.0) for i in range(200)]
    p, a = frames(spark, pool, act)
    p = p.withColumn("arrival", F.md5(F.col("id").cast("string")))
    arrival = {r["id"]: r["arrival"] for r in p.collect()}
    won = M.exclusive_assignment(p, a, "id", "id", "id", COLS, TOL, "arrival", part_pairs=0)
    assert {r["pool"]: r["active"] for r in won.collect()} == loop(pool, act, arrival)
    assert rounds() <= 40


def test_equal_rows_settle_in_few_rounds(spark, monkeypatch):
    """Hundreds of equal actives and pool rows: about one round per choice does, not one per row."""
    rounds = count_rounds(monkeypatch)
    rng = random.Random(9)
    act = [(1000 + i, 0.0, 0.0, 0.0) for i in range(300)] + [(2000 + i, rng.uniform(5, 25), 0.3, 0.0) for i in range(20)]
    pool = [(i, 1.0 if i % 3 else 2.5, 0.1, 0.0) for i in range(700)]
    p, a = frames(spark, pool, act)
    p = p.withColumn("arrival", F.md5(F.col("id").cast("string")))
    arrival = {r["id"]: r["arrival"] for r in p.collect()}
    won = M.exclusive_assignment(p, a, "id", "id", "id", COLS, TOL, "arrival", part_pairs=0)
    assert {r["pool"]: r["active"] for r in won.collect()} == loop(pool, act, arrival)
    assert rounds() <= 25


def brute(lib, ref):
    out = {}
    for k, b in lib:
        best = max(
            ((len(set(b) & set(c)) / len(set(b) | set(c)) if set(b) | set(c) else 1.0), -i) for i, (_, c) in enumerate(ref)
        )
        out[k] = (best[0], ref[-best[1]][0])
    return out


@pytest.mark.parametrize("ways", [{}, {"chunk_bytes": 100}, {"chunk_bytes": 400}])
def test_nearest_equals_brute_force(spark, ways):
    rng = random.Random(5)
    bits = lambda: sorted(rng.sample(range(130), rng.randint(0, 12)))
    copies = bits()
    lib = [(f"l{i}", copies if i % 3 == 0 else bits()) for i in range(60)]
    ref = [(f"r{i:02d}", copies if i in (4, 9) else bits()) for i in range(31)]
    left = spark.createDataFrame(lib, "k string, on_bits array<int>")
    right = spark.createDataFrame([(k, b, i) for i, (k, b) in enumerate(ref)], "k string, on_bits array<int>, o int")
    out = S.nearest(left, right, "k", "o", n_bits=130, **ways)
    assert "CartesianProduct" not in plan(out) and "NestedLoop" not in plan(out)
    assert {r["k"]: (r["max_sim"], r["nearest"]) for r in out.collect()} == brute(lib, ref)


def test_matrix(spark):
    df = spark.createDataFrame([("a", [1, 2]), ("b", [2]), ("c", [])], "k string, on_bits array<int>")
    wide = S.similarity_matrix(S.similarity_pairs(df, "k"), ["a", "b", "c"]).orderBy("a").collect()
    assert [tuple(r) for r in wide] == [("a", 1.0, 0.5, 0.0), ("b", 0.5, 1.0, 0.0), ("c", 0.0, 0.0, 1.0)]


def test_more_rows_than_the_matrix_takes_are_refused(spark):
    df = spark.createDataFrame([(str(i), [i]) for i in range(4)], "k string, on_bits array<int>")
    assert S.similarity_pairs(df, "k", k=4).count() == 16
    with pytest.raises(Exception, match="more than 3 rows"):
        S.similarity_pairs(df, "k", k=3).collect()


@pytest.mark.parametrize("ways", [{}, {"chunk_bytes": 1}])
def test_nearest_with_missing_and_repeated_keys(spark, ways):
    lib = spark.createDataFrame([("a", [1]), ("a", [9]), (None, [2]), ("b", None)], "k string, on_bits array<int>")
    ref = spark.createDataFrame([(None, [1], 1), ("x", [2], 2), ("x", [1], 3)], "k string, on_bits array<int>, o int")
    got = sorted(map(tuple, S.nearest(lib, ref, "k", "o", n_bits=64, **ways).select("k", "max_sim", "nearest").collect()), key=str)
    assert got == sorted([("a", 1.0, None), ("a", 0.0, None), (None, 1.0, "x"), ("b", 0.0, None)], key=str)


def test_nearest_without_references(spark):
    lib = spark.createDataFrame([("a", [1])], "k string, on_bits array<int>")
    none = spark.createDataFrame([], "k string, on_bits array<int>, o int")
    row = S.nearest(lib, none, "k", "o").first()
    assert (row["max_sim"], row["nearest"]) == (0.0, None)


def test_window_decoys(spark):
    rng = np.random.default_rng(6)
    rows = [(f"p{i % 90}", i, float(rng.normal()), sorted(set(rng.integers(0, 64, 9).tolist()))) for i in range(120)]
    schema = "key string, ord int, p1 double, on_bits array<int>"
    pool = spark.createDataFrame(rows, schema)
    act = spark.createDataFrame([(f"a{i}", i, float(rng.normal()), sorted(set(rng.integers(0, 64, 9).tolist()))) for i in range(30)], schema)
    known = spark.createDataFrame([("p1",), ("p2",)], "key string")
    out = M.window_matched_decoys(pool, act, known, "key", "ord", ["p1"], 20, 64, 0.3).collect()
    keys = [r["key"] for r in out]
    lo, hi = np.percentile([r["p1"] for r in act.collect()], [5, 95])
    assert len(keys) == len(set(keys)) <= 20 and not {"p1", "p2"} & set(keys)
    assert all(lo <= r["p1"] <= hi and r["max_sim"] <= 0.3 for r in out)


def test_missing_property_is_outside(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None)], "id int, p double")
    assert [r["id"] for r in df.where(M.in_window({"p": (0.0, 2.0)})).collect()] == [1]


def test_empty_actives(spark):
    p, a = frames(spark, [(1, 0.0, 0.0, 0.0)], [(2, 0.0, 0.0, 0.0)])
    assert M.prune_to_envelope(p, a.where("id < 0"), COLS, TOL).count() == 0
    window = M.property_window(a.where("id < 0"), ["p1"])
    assert M.window_bounds(window, ["p1"], {"p1": (1.0, 2.0)}) == {"p1": (1.0, 2.0)}
    with pytest.raises(ValueError, match="no values"):
        M.window_bounds(window, ["p1"])
