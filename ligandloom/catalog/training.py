"""Queries over labelled compounds: folds, splits, ratios, weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ligandloom.catalog.registry import query
from ligandloom.catalog.views import docs, lab
from ligandloom.operators import assemble

_ORDER = "ORDER BY md5(concat('42|', id)), id"


@query("w7_stratified_folds", "lab", f"""
SELECT id, y, ((row_number() OVER (PARTITION BY y {_ORDER}) - 1) % 5)::INT AS fold FROM lab""")
def w7(spark, sf):
    return assemble.stratified_folds(lab(spark, sf).select("id", "y"), "id", "y")


@query("w8_stratified_split", "lab", f"""
SELECT id, y, row_number() OVER (PARTITION BY y {_ORDER}) <= ceil(count(*) OVER (PARTITION BY y) * 0.2::DOUBLE) AS is_test FROM lab""")
def w8(spark, sf):
    return assemble.stratified_split(lab(spark, sf).select("id", "y"), "id", "y")


@query("p32_cohort", "lab", "SELECT id FROM lab WHERE y = 1 AND source = 'real'")
def p32(spark, sf):
    return assemble.cohort(lab(spark, sf), y=1, source="real").select("id")


@query("u4_set_union", "lab docs", """
SELECT id FROM lab WHERE y = 1 UNION SELECT id FROM docs WHERE source IN ('src1', 'src2', 'src3')""")
def u4(spark, sf):
    more = docs(spark, sf).where(F.col("source").isin("src1", "src2", "src3"))
    return assemble.known_keys(lab(spark, sf).where("y = 1"), more, key="id")


@query("a24_balanced_weights", "lab", """
SELECT id, (SELECT count(*) FROM lab)::DOUBLE / (2 * count(*) OVER (PARTITION BY y)) AS weight FROM lab""")
def a24(spark, sf):
    return assemble.balanced_weights(lab(spark, sf), "y").select("id", "weight")


_RATIOS = (1, 3, 5)


@query("u7_ratio_sets", "lab docs", f"""
WITH a AS (SELECT id FROM lab WHERE y = 0 AND source = 'real'), i AS (SELECT id FROM lab WHERE y = 0 AND source = 'decoy'),
d AS (SELECT id, row_number() OVER ({_ORDER}) AS rn FROM docs WHERE id NOT IN (SELECT id FROM lab)),
r AS (SELECT unnest({list(_RATIOS)}) AS ratio), n AS (SELECT ratio, greatest(0, (SELECT count(*) FROM a) * ratio - (SELECT count(*) FROM i)) AS need FROM r)
SELECT ratio, id, 1 AS label, 'active' AS source FROM n, a UNION ALL SELECT ratio, id, 0, 'real_inactive' FROM n, i
UNION ALL SELECT ratio, id, 0, 'decoy' FROM n, d WHERE rn <= need""")
def u7(spark, sf):
    known = lab(spark, sf)
    decoys = docs(spark, sf).select("id").join(known.select("id"), "id", "left_anti")
    actives = known.where("y = 0 and source = 'real'")
    inactives = known.where("y = 0 and source = 'decoy'")
    return assemble.ratio_sets(actives, inactives, decoys, "id", _RATIOS)


@query("t4_need", "lab", """
SELECT greatest(0, count(*) FILTER (y = 1) - count(*) FILTER (y = 0)) AS n_need FROM lab""")
def t4(spark, sf):
    need = assemble.n_needed(*assemble.class_sizes(lab(spark, sf), "y"))
    return spark.range(1).select(F.lit(need).cast("bigint").alias("n_need"))


_SETS = {"both": "y IN (0, 1)", "one": "y = 1", "none": "y > 1", "other": "y IN (0, 1)"}


def _guard(case: str, where: str) -> str:
    y = "y + 1" if case == "other" else "y"
    return f"""SELECT '{case}' AS labels, count(*) FILTER ({y} = 1) AS a, count(*) FILTER ({y} = 0) AS i,
 count(*) FILTER ({y} NOT IN (0, 1)) AS o FROM lab WHERE {where}"""


@query("v6_class_guards", "lab", """
SELECT labels, CASE WHEN o > 0 THEN 'labels other than 0 and 1' WHEN a + i = 0 THEN 'no labelled rows'
 WHEN a = 0 OR i = 0 THEN concat('one class only: ', a, ' active, ', i, ' inactive') ELSE concat(a, ' and ', i) END AS outcome
FROM (""" + " UNION ALL ".join(_guard(k, w) for k, w in _SETS.items()) + ")")
def v6(spark, sf):
    """What training would say to four label columns before it starts."""
    rows = []
    for case, where in _SETS.items():
        df = lab(spark, sf).where(where).select((F.col("y") + 1 if case == "other" else F.col("y")).alias("y"))
        try:
            rows.append((case, "{} and {}".format(*assemble.require_classes(df, "y"))))
        except ValueError as e:
            rows.append((case, str(e)))
    return spark.createDataFrame(rows, "labels string, outcome string")
