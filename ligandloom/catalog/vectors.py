"""Queries over fingerprints with properties: windows, tolerance and similarity joins, decoys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ligandloom.catalog.registry import query, r
from ligandloom.catalog.views import PROPERTIES, VEC_BITS, vec
from ligandloom.functions import fingerprints as FP
from ligandloom.functions import values as V
from ligandloom.operators import assemble, features, learn, matching, ranks
from ligandloom.operators import similarity as S
from ligandloom.operators.ranks import hash_order
from ligandloom.sources.writers import expand_bits
from pyspark.ml.functions import vector_to_array

TOL = matching.TOLERANCE
SIM = 0.5
#: How many negatives are missing: actives minus measured inactives, the documents of label 3.
NEED = "(SELECT greatest(0, count(*) FILTER (active = 1) - count(*) FILTER (active = 0 AND label = 3)) FROM vec)"


def _sides(spark, sf):
    v = vec(spark, sf)
    return v.where("active = 0"), v.where("active = 1")


def _need(spark, sf) -> int:
    measured = vec(spark, sf).where("active = 1 OR label = 3")
    return assemble.n_needed(*assemble.class_sizes(measured, "active"))


_WINDOW = "\nUNION ALL ".join(
    f"SELECT '{p}' AS feature, count({p}) AS n, {r(f'quantile_cont({p}, 0.05)', 9)} AS lo, {r(f'quantile_cont({p}, 0.95)', 9)} AS hi"
    " FROM vec WHERE active = 1"
    for p in PROPERTIES
)
_BOUNDS = "SELECT " + ", ".join(
    f"quantile_cont({p}, 0.05) AS {p}_lo, quantile_cont({p}, 0.95) AS {p}_hi" for p in PROPERTIES
) + " FROM vec WHERE active = 1"
_INSIDE = " AND ".join(f"vec.{p} BETWEEN {p}_lo AND {p}_hi" for p in PROPERTIES)


def _window(spark, sf, slices):
    w = matching.property_window(_sides(spark, sf)[1], PROPERTIES, slices=slices)
    return w.select("feature", "n", *[V.half_even(F.col(c), 9).alias(c) for c in ("lo", "hi")])


@query("a11_property_window", "vec", _WINDOW)
def a11(spark, sf):
    return _window(spark, sf, ranks.SLICES)


@query("a11_property_window_split_hot", "vec", _WINDOW)
def a11_hot(spark, sf):
    """Same result with one slice for each doubling of the values."""
    return _window(spark, sf, 1)


@query("a12_property_envelope", "vec", "SELECT " + ", ".join(
    f"min({p}) - {t}::DOUBLE AS {p}_lo, max({p}) + {t}::DOUBLE AS {p}_hi" for p, t in zip(PROPERTIES, TOL)
) + " FROM vec WHERE active = 1")
def a12(spark, sf):
    return matching.property_envelope(_sides(spark, sf)[1], PROPERTIES, TOL)


@query("p17_in_window", "vec", f"WITH b AS ({_BOUNDS}) SELECT vec_id FROM vec, b WHERE active = 0 AND {_INSIDE}")
def p17(spark, sf):
    pool, actives = _sides(spark, sf)
    bounds = matching.window_bounds(matching.property_window(actives, PROPERTIES), PROPERTIES)
    return pool.where(matching.in_window(bounds)).select("vec_id")


_PAIRS = "SELECT p.vec_id AS pool, a.vec_id AS active FROM vec p JOIN vec a ON p.active = 0 AND a.active = 1 AND p.charge = 0" + "".join(
    f" AND abs(a.{c} - p.{c}) <= {t}" for c, t in zip(PROPERTIES, TOL)
)


@query("j6_tolerance_pairs", "vec", _PAIRS)
def j6(spark, sf):
    pool, actives = _sides(spark, sf)
    left, right = _pair_sides(pool, actives)
    return matching.tolerance_pairs(left, right, PROPERTIES, TOL).select("pool", "active")


def _pair_sides(pool, actives):
    fit = matching.prune_to_envelope(pool.where("charge = 0"), actives, PROPERTIES, TOL)
    return fit.select(F.col("vec_id").alias("pool"), *PROPERTIES), actives.select(F.col("vec_id").alias("active"), *PROPERTIES)


_ONE = ", ".join(f"CASE WHEN vec_id % 3 = 0 THEN (SELECT min_by({p}, vec_id) FROM vec WHERE active = 1) ELSE {p} END AS {p}" for p in PROPERTIES[:5])


@query("j6_row_pairs", "vec", f"WITH c AS (SELECT vec_id, active, {_ONE}, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE charge END AS charge FROM vec WHERE active = 0 UNION ALL SELECT vec_id, active, {', '.join(PROPERTIES)} FROM vec WHERE active = 1)"
 + _PAIRS.replace("FROM vec p JOIN vec a", " FROM c p JOIN c a"))
def j6_crowded(spark, sf):
    """A third of the pool shares the properties of one active."""
    pool, actives = _sides(spark, sf)
    one = actives.agg(*[F.min_by(p, "vec_id").alias(p) for p in PROPERTIES[:5]]).first()
    third = F.col("vec_id") % 3 == 0
    crowded = pool.withColumns(
        {**{p: F.when(third, F.lit(one[p])).otherwise(F.col(p)) for p in PROPERTIES[:5]},
         "charge": F.when(third, 0).otherwise(F.col("charge"))}
    )
    left, right = _pair_sides(crowded, actives)
    return matching.row_pairs(left, right, PROPERTIES, TOL).select("pool", "active")


_DIST = " + ".join(f"abs(a.{c} - p.{c}) / {t or 1}::DOUBLE" for c, t in zip(PROPERTIES, TOL))


def _assigned(pool_filter: str) -> str:
    """The row-by-row loop: each pool row in turn takes its nearest free active."""
    return f"""
WITH RECURSIVE pr AS (SELECT p.vec_id AS pool, a.vec_id AS aid, {_DIST} AS dist
  FROM vec p JOIN vec a ON p.active = 0 AND a.active = 1 AND p.charge = 0 {pool_filter}{"".join(
    f" AND abs(a.{c} - p.{c}) <= {t}" for c, t in zip(PROPERTIES, TOL))}),
o AS (SELECT pool, row_number() OVER (ORDER BY md5(concat('42|', pool)), pool) AS i FROM (SELECT DISTINCT pool FROM pr)),
q AS (SELECT o.i, pr.* FROM pr JOIN o USING (pool)),
walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS taken, NULL::BIGINT AS pick
 UNION ALL
 SELECT n.i, CASE WHEN n.pick IS NULL THEN n.taken ELSE list_append(n.taken, n.pick) END, n.pick FROM (
  SELECT w.i + 1 AS i, any_value(w.taken) AS taken,
   arg_min(q.aid, (q.dist, q.aid)) FILTER (NOT list_contains(w.taken, q.aid)) AS pick
  FROM walk w JOIN q ON q.i = w.i + 1 GROUP BY w.i) n)
SELECT o.pool, walk.pick AS active FROM walk JOIN o ON o.i = walk.i WHERE pick IS NOT NULL"""


@query("j7_exclusive_assignment", "vec", _assigned(""))
def j7(spark, sf):
    pool, actives = _sides(spark, sf)
    fit = pool.where("charge = 0").withColumn("arrival", hash_order(F.col("vec_id"), 42))
    won = matching.exclusive_assignment(
        fit, actives, "vec_id", "vec_id", "vec_id", PROPERTIES, TOL, "arrival"
    )
    return won.select("pool", "active")


_FAR = "AND p.vec_id IN (SELECT vec_id FROM vnear WHERE max_sim <= 0.5)"


@query("u6_per_active_decoys", "vec vnear", f"""
WITH x AS ({_assigned(_FAR).strip()}),
k AS (SELECT pool FROM x ORDER BY md5(concat('42|', pool)), pool LIMIT {NEED})
SELECT vec_id, 1 AS label, 'real' AS source FROM vec WHERE active = 1
UNION ALL SELECT vec_id, 0, 'real' FROM vec WHERE active = 0 AND label = 3
UNION ALL SELECT pool, 0, 'decoy' FROM k WHERE pool NOT IN (SELECT vec_id FROM vec WHERE label = 3)""".replace(
    "AND p.vec_id IN", "AND p.label <> 3 AND p.vec_id IN"))
def u6(spark, sf):
    """Matched decoys (J6, J9, J7) joined to the measured rows."""
    pool, actives = _sides(spark, sf)
    measured = pool.where("label = 3")
    known = actives.select("vec_id").union(measured.select("vec_id"))
    decoys = matching.per_active_decoys(
        pool.withColumn("ord", F.col("vec_id")), actives.withColumn("ord", F.col("vec_id")), known,
        "vec_id", "ord", PROPERTIES, _need(spark, sf), VEC_BITS, TOL, SIM, neutral="charge",
    )
    return assemble.with_provenance(actives, measured, decoys, "vec_id")


_NEAR = "SELECT vec_id, max_sim, aid::VARCHAR AS nearest FROM vnear"


@query("j8_nearest_active", "vnear", _NEAR)
def j8(spark, sf):
    pool, actives = _sides(spark, sf)
    return S.nearest(pool.select("vec_id", "on_bits"), actives, "vec_id", "vec_id", n_bits=VEC_BITS).drop("on_bits")


@query("j8_nearest_active_blocks", "vnear", """
SELECT CASE vec_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'same' ELSE vec_id::VARCHAR END AS row_key, max_sim, aid::VARCHAR AS nearest FROM vnear""")
def j8_blocks(spark, sf):
    """Same result for references in many chunks, on a library with missing and repeated keys."""
    pool, actives = _sides(spark, sf)
    key = F.when(F.col("vec_id") % 4 == 0, F.lit(None)).when(F.col("vec_id") % 4 == 1, "same").otherwise(F.col("vec_id").cast("string"))
    return S.nearest(
        pool.select(key.alias("row_key"), "on_bits"), actives, "vec_id", "vec_id", n_bits=VEC_BITS, chunk_bytes=8000
    ).drop("on_bits")


@query("j9_dissimilar", "vnear", f"SELECT vec_id, {r('max_sim', 3)} AS max_sim FROM vnear WHERE max_sim <= {SIM}")
def j9(spark, sf):
    pool, actives = _sides(spark, sf)
    found = S.nearest(pool.select("vec_id", "on_bits"), actives, "vec_id", "vec_id", n_bits=VEC_BITS, limit=SIM)
    return S.dissimilar(found, SIM).select("vec_id", V.half_even(F.col("max_sim"), 3).alias("max_sim"))


@query("j9_far_rows", "vnear", f"SELECT vec_id FROM vnear WHERE max_sim <= {SIM}")
def j9_far(spark, sf):
    """The same rows through shared rare bits, without a copy of either side in every task."""
    pool, actives = _sides(spark, sf)
    return S.far_rows(pool.select("vec_id", "on_bits"), actives, SIM, n_bits=VEC_BITS).select("vec_id")


@query("j10_similarity_pairs", "vec vbits", """
WITH top AS (SELECT vec_id FROM vec ORDER BY p1 DESC, vec_id LIMIT 20), n AS (SELECT vec_id, count(*) AS n FROM vbits GROUP BY vec_id),
o AS (SELECT x.vec_id AS a, y.vec_id AS b, count(*) AS c FROM vbits x JOIN vbits y USING (b)
 WHERE x.vec_id IN (SELECT vec_id FROM top) AND y.vec_id IN (SELECT vec_id FROM top) GROUP BY ALL)
SELECT x.vec_id AS a, y.vec_id AS b, coalesce(c, 0)::DOUBLE / (nx.n + ny.n - coalesce(c, 0)) AS sim FROM top x CROSS JOIN top y
JOIN n nx ON nx.vec_id = x.vec_id JOIN n ny ON ny.vec_id = y.vec_id LEFT JOIN o ON o.a = x.vec_id AND o.b = y.vec_id""")
def j10(spark, sf):
    top = ranks.top_rows(vec(spark, sf), [F.desc("p1"), F.asc("vec_id")], 20)
    return S.similarity_pairs(top, "vec_id")


@query("j11_bind_features", "vec vbits", """
SELECT vec_id, p1, p2, n::INT AS n_on FROM vec LEFT JOIN (SELECT vec_id, count(*) AS n FROM vbits GROUP BY vec_id) USING (vec_id)""")
def j11(spark, sf):
    v = vec(spark, sf)
    return assemble.bind_features(
        v.select("vec_id", "p1", "p2"), v.select("vec_id", F.size("on_bits").alias("n_on")), "vec_id"
    )


_SUPPLY = f"""
WITH w AS ({_BOUNDS}), f AS (SELECT vec.vec_id, max_sim FROM w, vec JOIN vnear ON vnear.vec_id = vec.vec_id
 WHERE vec.active = 0 AND vec.label <> 3 AND {_INSIDE} AND max_sim <= {SIM})"""


@query("u8_window_matched_decoys", "vec vnear", f"""{_SUPPLY}
SELECT vec_id, {r("max_sim", 3)} AS max_sim, row_number() OVER (ORDER BY md5(concat('42|', vec_id)), vec_id) AS rank FROM f
ORDER BY rank LIMIT {NEED}""")
def u8(spark, sf):
    pool, actives = _sides(spark, sf)
    known = actives.select("vec_id").union(pool.where("label = 3").select("vec_id"))
    decoys = matching.window_matched_decoys(
        pool.withColumn("ord", F.col("vec_id")), actives.withColumn("ord", F.col("vec_id")), known,
        "vec_id", "ord", PROPERTIES, _need(spark, sf), VEC_BITS, SIM,
    )
    return decoys.select("vec_id", V.half_even(F.col("max_sim"), 3).alias("max_sim"), "rank")


@query("u9_size_matched_decoys", "vec", f"""
WITH w AS ({_BOUNDS}) SELECT vec_id FROM vec, w WHERE active = 0 AND p1 BETWEEN p1_lo AND p1_hi
ORDER BY md5(concat('42|', vec_id)), vec_id LIMIT {NEED}""")
def u9(spark, sf):
    pool, actives = _sides(spark, sf)
    out = matching.size_matched_decoys(
        pool.withColumn("ord", F.col("vec_id")), actives, "vec_id", "ord", "p1", _need(spark, sf)
    )
    return out.select("vec_id")


@query("a26_similarity_summary", "vnear", "SELECT count(*) AS n, quantile_cont(max_sim, 0.5) AS median, max(max_sim) AS highest FROM vnear")
def a26(spark, sf):
    return matching.similarity_summary(j8(spark, sf))


_FEATS = PROPERTIES[:5]


_HOLED = "SELECT active, " + ", ".join(f"CASE WHEN vec_id % {7 + k} <> 0 THEN {p} END AS {p}" for k, p in enumerate(_FEATS)) + " FROM vec"


@query("a21_effect_size", "vec", f"WITH h AS ({_HOLED}) SELECT feature, " + ", ".join(
    f"{r(c, 6)} AS {c}" for c in ("active_mean", "inactive_mean", "std_all", "std_effect")
) + " FROM (" + " UNION ALL ".join(
    f"""SELECT '{p}' AS feature, avg(v) FILTER (active = 1) AS active_mean, avg(v) FILTER (active = 0) AS inactive_mean,
 stddev_samp(v) AS std_all, (avg(v) FILTER (active = 1) - avg(v) FILTER (active = 0)) / nullif(stddev_samp(v), 0) AS std_effect
 FROM (SELECT active, coalesce({p}, (SELECT quantile_cont({p}, 0.5) FROM h)) AS v FROM h)""" for p in _FEATS) + ")")
def a21(spark, sf):
    """Missing cells count as the median."""
    v = vec(spark, sf)
    holed = v.withColumns({p: F.when(F.col("vec_id") % (7 + k) != 0, F.col(p)) for k, p in enumerate(_FEATS)})
    out = features.effect_size(holed, _FEATS, "active")
    cols = ("active_mean", "inactive_mean", "std_all", "std_effect")
    return out.select("feature", *[V.half_even(F.col(c), 6).alias(c) for c in cols])


@query("t5_ranked_effects", "vec", f"""
WITH e AS ({" UNION ALL ".join(f"SELECT '{p}' AS feature, (avg({p}) FILTER (active = 1) - avg({p}) FILTER (active = 0)) / nullif(stddev_samp({p}), 0) AS e FROM vec" for p in _FEATS)})
SELECT feature, CASE WHEN e > 0 THEN '↑active' ELSE '↓active' END AS direction, row_number() OVER (ORDER BY abs(e) DESC, feature)::INT AS position FROM e""")
def t5(spark, sf):
    """Rank by strength with an arrow; the learned gains are ranked in m7."""
    eff = features.effect_size(vec(spark, sf), _FEATS, "active")
    order = F.row_number().over(
        ranks.Window.orderBy(F.abs("std_effect").desc(), "feature")  # one row per feature
    )
    arrow = F.when(F.col("std_effect") > 0, "↑active").otherwise("↓active")
    return eff.select("feature", arrow.alias("direction"), order.alias("position"))


@query("p29_combine_features", "vec vbits", f"""
SELECT vec_id, {VEC_BITS + 5} AS n_features, {r("n + p1 + p2 + p3 + p4 + p5", 6)} AS total FROM vec
JOIN (SELECT vec_id, count(*)::DOUBLE AS n FROM vbits GROUP BY vec_id) USING (vec_id)""")
def p29(spark, sf):
    v = learn.fingerprint_features(vec(spark, sf), "on_bits", VEC_BITS, "fp")
    both = learn.combined_features(v, "fp", _FEATS)
    arr = vector_to_array("features")
    total = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
    return both.select("vec_id", F.size(arr).alias("n_features"), V.half_even(total, 6).alias("total"))


@query("p33_expand_bits", "vec", "SELECT vec_id, " + ", ".join(
    f"CASE WHEN embedding[{i}] > 0 THEN 1 ELSE 0 END::TINYINT AS x{i}" for i in range(1, VEC_BITS + 1)
) + " FROM vec")
def p33(spark, sf):
    return expand_bits(vec(spark, sf).select("vec_id", "on_bits"), "on_bits", VEC_BITS, "x%d")


@query("w6_batch_numbers", "vec", """
WITH n AS (SELECT vec_id, row_number() OVER (ORDER BY md5(concat('42|', vec_id)), vec_id) AS r FROM vec WHERE active = 1)
SELECT vec_id, (r - 1) // 45 + 1 AS batch, (r - 1) % 45 + 1 AS place, printf('b%02d_act_%02d', (r - 1) // 45 + 1, (r - 1) % 45 + 1) AS batch_id FROM n""")
def w6(spark, sf):
    return assemble.number_batches(_sides(spark, sf)[1].select("vec_id"), "vec_id")


@query("tanimoto_bits", "vec vbits", "SELECT vec_id, count(*)::INT AS n_on, string_agg(b::VARCHAR, ',' ORDER BY b) AS bits FROM vbits GROUP BY vec_id")
def bits_text(spark, sf):
    text = F.array_join(FP.bit_names(F.col("on_bits")), ",")
    return vec(spark, sf).where(F.size("on_bits") > 0).select("vec_id", F.size("on_bits").alias("n_on"), text.alias("bits"))
