"""The join on shared rare bits against all pairs."""

import random

import pytest

from ligandloom.operators import similarity as S

ROWS = "id long, on_bits array<int>"


def sets(seed, n, width):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        size = rng.choice([0, 1, 2, width // 8, width // 2, width])
        out.append((k if k % 7 else None, rng.choice([None, *[sorted(rng.sample(range(width), size))] * 5])))
    return out + out[: n // 4] + [(900 + k, list(range(width // 4))) for k in range(n // 3)]


def alike(a, b):
    a, b = set(a or ()), set(b or ())
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("limit", [0.0, 0.2, 0.35, 0.5, 0.8, 0.95])
@pytest.mark.parametrize("width", [8, 64])
def test_equals_all_pairs(spark, limit, width):
    lib, ref = sets(int(limit * 100) + width, 60, width), sets(7 + width, 25, width)
    got = S.far_rows(spark.createDataFrame(lib, ROWS), spark.createDataFrame(ref, ROWS), limit, n_bits=width)
    want = [r for r in lib if all(alike(r[1], x[1]) <= limit for x in ref)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_empty_sides_and_limits(spark):
    some = spark.createDataFrame([(1, [1, 2]), (2, None)], ROWS)
    assert S.far_rows(some, some.limit(0), 0.5).count() == 2
    assert S.far_rows(some.limit(0), some, 0.5).count() == 0
    with pytest.raises(ValueError):
        S.far_rows(some, some, 1.0)


def test_search_with_a_limit_keeps_the_same_rows(spark):
    lib, ref = sets(3, 80, 64), sets(4, 40, 64)
    a, b = (spark.createDataFrame(x, ROWS) for x in (lib, ref))
    for limit in (0.2, 0.5):
        full = S.dissimilar(S.nearest(a, b, "id", "id", n_bits=64), limit).collect()
        short = S.dissimilar(S.nearest(a, b, "id", "id", n_bits=64, chunk_bytes=2000, limit=limit), limit).collect()
        assert sorted(map(repr, full)) == sorted(map(repr, short))


def test_plan_sends_no_side_to_all_tasks(spark):
    a = spark.createDataFrame(sets(5, 50, 64), ROWS)
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = S.far_rows(a, a, 0.5, n_bits=64)._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    assert "Broadcast" not in plan and "Cartesian" not in plan and "SortMergeJoin" in plan


def test_dense_bits_are_not_joined(spark, monkeypatch):
    """Sets of half of all bits share rare bits with nearly all others: they are compared packed, and both ways agree."""
    rng = random.Random(9)
    lib, ref = ([(k, sorted(rng.sample(range(64), rng.randint(20, 40)))) for k in range(n)] for n in (400, 150))
    a, b = spark.createDataFrame(lib, ROWS), spark.createDataFrame(ref, ROWS)
    got = S.close_sets(a, b, 0.5, n_bits=64)
    assert "Join" not in got._jdf.queryExecution().toString()
    monkeypatch.setattr(S, "MEETING_WORDS", 0)
    joined = S.close_sets(a, b, 0.5, n_bits=64)
    assert "Join" in joined._jdf.queryExecution().toString()
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in joined.collect())
