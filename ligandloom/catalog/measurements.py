"""Queries over measurement rows: values, labels, unions, dedup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ligandloom.catalog.registry import query, r
from ligandloom.catalog.views import lib, meas
from ligandloom.functions import values as V
from ligandloom.operators import assemble, curation, dedup, ranks
from ligandloom.sources import readers

_LABEL = """CASE WHEN v IS NULL THEN NULL WHEN relation IN ('>','>=') THEN 0
 WHEN v <= 10000 THEN 1 ELSE 0 END"""
_CLASS = """CASE WHEN relation IN ('>','>=') THEN
   CASE WHEN v >= 20000 THEN 'inactive' WHEN v > 10000 THEN 'gray' ELSE 'amb' END
 ELSE CASE WHEN v <= 10000 THEN 'active' WHEN v < 20000 THEN 'gray' ELSE 'inactive' END END"""
_EXACT = "relation NOT IN ('>','<','>=','<=')"
_PIC = "(9::DOUBLE - log10(greatest(v, 1e-6::DOUBLE)))"
_QUALIFIED = r"'^\s*([<>=~]+)?\s*([0-9.eE+-]+)'"
_NUMBER = r"'^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI]nf(inity)?)\s*$'"


def labelled(spark, sf):
    return meas(spark, sf).withColumn("label", V.label_binary(F.col("v"), F.col("relation")))


@query("p1_parse_qualified", "meas", f"""
SELECT ord, CASE WHEN coalesce(regexp_matches(raw, {_QUALIFIED}), false) THEN
   CASE WHEN regexp_extract(raw, {_QUALIFIED}, 1) = '' THEN '=' ELSE regexp_extract(raw, {_QUALIFIED}, 1) END
 ELSE '' END AS relation,
 CASE WHEN regexp_matches(raw, {_QUALIFIED}) THEN try_cast(regexp_extract(raw, {_QUALIFIED}, 2) AS DOUBLE) END AS value
FROM meas""")
def p1(spark, sf):
    relation, value = V.parse_qualified(F.col("raw"))
    return meas(spark, sf, heavy=True).select("ord", relation.alias("relation"), value.alias("value"))


@query("p2_to_number", "meas", f"""
SELECT ord, CASE WHEN regexp_matches(text, {_NUMBER}) THEN try_cast(trim(text) AS DOUBLE) END AS number FROM meas""")
def p2(spark, sf):
    return meas(spark, sf).select("ord", V.to_number(F.col("text")).alias("number"))


@query("p3_to_nanomolar", "meas", """
SELECT ord, CASE trim(any_unit) WHEN 'nM' THEN v WHEN 'uM' THEN v * 1000::DOUBLE WHEN 'M' THEN v * 1e9::DOUBLE END AS nm
FROM meas""")
def p3(spark, sf):
    return meas(spark, sf).select("ord", V.to_nanomolar(F.col("v"), F.col("any_unit")).alias("nm"))


@query("p4_coalesce_id", "meas", "SELECT ord, coalesce(registry, name) AS compound_id FROM meas")
def p4(spark, sf):
    return meas(spark, sf).select("ord", F.coalesce("registry", "name").alias("compound_id"))


@query("p5_filter_type", "meas", "SELECT ord, type FROM meas WHERE upper(type) = 'IC50'")
def p5(spark, sf):
    return meas(spark, sf).where(V.is_type(F.col("type"))).select("ord", "type")


@query("p6_clean_relation", "meas", "SELECT ord, replace(quoted, '''', '') AS relation FROM meas")
def p6(spark, sf):
    return meas(spark, sf).select("ord", V.clean_relation(F.col("quoted")).alias("relation"))


@query("p10_pic50", "meas", f"""
SELECT ord, {r("-log10(v * 1e-9::DOUBLE)", 9)} AS pic50, {r(_PIC, 9)} AS pic50_floored FROM meas""")
def p10(spark, sf):
    v = F.col("v")
    return meas(spark, sf).select(
        "ord",
        V.half_even(V.pic50(v), 9).alias("pic50"),
        V.half_even(V.pic50_floored(v), 9).alias("pic50_floored"),
    )


@query("p11_label_binary", "meas", f"SELECT ord, {_LABEL} AS label FROM meas")
def p11(spark, sf):
    return labelled(spark, sf).select("ord", "label")


@query("p12_label_potency", "meas", f"SELECT ord, cast({_PIC} >= 6 AS int) AS active FROM meas")
def p12(spark, sf):
    return meas(spark, sf).select("ord", V.label_potency(V.pic50_floored(F.col("v"))).alias("active"))


@query("p13_classify4", "meas", f"SELECT ord, {_CLASS} AS class FROM meas")
def p13(spark, sf):
    return meas(spark, sf).select("ord", V.activity_class(F.col("v"), F.col("relation")).alias("class"))


@query("p14_gray_zone", "meas", """
SELECT count(*) AS n FROM meas WHERE relation = '=' AND v > 10000 AND v < 20000""")
def p14(spark, sf):
    gray = meas(spark, sf).where(V.in_gray_zone(F.col("v"), F.col("relation")))
    return gray.agg(F.count(F.lit(1)).alias("n"))


@query("p15_potency_or_value", "meas", f"""
SELECT ord, potency FROM (SELECT ord, {r("coalesce(pchembl, CASE WHEN trim(any_unit) = 'nM' THEN -log10(v * 1e-9::DOUBLE) END)", 9)} AS potency
 FROM meas) WHERE potency IS NOT NULL""")
def p15(spark, sf):
    pot = V.potency(F.col("pchembl"), F.col("v"), F.col("any_unit"))
    return (
        meas(spark, sf, heavy=True)
        .select("ord", V.half_even(pot, 9).alias("potency"))
        .where(F.col("potency").isNotNull())
    )


@query("p16_require_target", "meas", "SELECT ord, target FROM meas WHERE target = 'T3'")
def p16(spark, sf):
    return curation.select_target(meas(spark, sf), "target", "T3").select("ord", "target")


@query("p18_usable_measurement", "meas", "SELECT ord, v FROM meas WHERE key IS NOT NULL AND unit = 'nM' AND v > 0")
def p18(spark, sf):
    m = meas(spark, sf)
    return m.where(V.usable_measurement(F.col("key"), F.col("v"), F.col("unit"))).select("ord", "v")


@query("p27_activity_name", "meas", f"""
SELECT activity, count(*) AS n FROM (SELECT CASE {_LABEL} WHEN 1 THEN 'active' WHEN 0 THEN 'inactive'
 ELSE 'unlabeled' END AS activity FROM meas) GROUP BY activity""")
def p27(spark, sf):
    named = labelled(spark, sf).withColumn("activity", V.activity_name(F.col("label")))
    return dedup.value_counts(named, "activity")


def _typed(m):
    return curation.from_typed_columns(
        m.where("source = 'A'"), "key", "id", "type", "quoted", "text", "any_unit", "pchembl", "ord", "A"
    )


def _qualified(m):
    return curation.from_qualified_text(
        m.where("source = 'B'"), "key", "raw", "registry", "name", "ord", "B"
    )


_UNION = f"""
SELECT 'B' AS source, coalesce(registry, name) AS compound_id, key AS smiles,
 CASE WHEN regexp_matches(raw, {_QUALIFIED}) THEN try_cast(regexp_extract(raw, {_QUALIFIED}, 2) AS DOUBLE) END AS ic50_nm,
 CASE WHEN regexp_matches(raw, {_QUALIFIED}) THEN CASE WHEN regexp_extract(raw, {_QUALIFIED}, 1) = '' THEN '='
  ELSE regexp_extract(raw, {_QUALIFIED}, 1) END ELSE '' END AS relation,
 NULL::DOUBLE AS pchembl, 'IC50' AS std_type, ord FROM meas WHERE source = 'B' AND raw IS NOT NULL
UNION ALL
SELECT 'A', id, key, CASE trim(any_unit) WHEN 'nM' THEN n WHEN 'uM' THEN n * 1000::DOUBLE WHEN 'M' THEN n * 1e9::DOUBLE END,
 replace(quoted, '''', ''), pchembl, 'IC50', ord FROM (SELECT *, CASE WHEN regexp_matches(text, {_NUMBER})
 THEN try_cast(trim(text) AS DOUBLE) END AS n FROM meas) WHERE source = 'A' AND upper(type) = 'IC50'"""


@query("u1_harmonised_union", "meas", _UNION)
def u1(spark, sf):
    m = meas(spark, sf, heavy=True)
    merged = _qualified(m).unionByName(_typed(m))
    return merged.withColumnsRenamed({"ic50_nM": "ic50_nm", "pChEMBL": "pchembl"})


@query("b1_merge_chain", "meas", f"""
WITH u AS ({_UNION}), s AS (SELECT smiles, count(*) AS n, min(source) <> max(source) AS x FROM u GROUP BY smiles),
g AS (SELECT smiles, row_number() OVER (ORDER BY smiles) AS dup_group FROM s WHERE n > 1)
SELECT u.ord, u.source, u.compound_id, u.smiles AS canonical_smiles, u.ic50_nm, u.relation,
 true AS valid_structure, s.n AS dup_count, s.n > 1 AS is_duplicate, g.dup_group, (s.n > 1 AND s.x) AS cross_source_dup
FROM u JOIN s USING (smiles) LEFT JOIN g USING (smiles)""")
def b1(spark, sf):
    m = meas(spark, sf, heavy=True)
    merged = curation.merge_sources([_qualified(m), _typed(m)])
    return merged.select(
        "ord", "source", "compound_id", "canonical_smiles", F.col("ic50_nM").alias("ic50_nm"), "relation",
        "valid_structure", "dup_count", "is_duplicate", "dup_group", "cross_source_dup",
    )


@query("j1_left_join_flag", "meas", """
SELECT m.ord, m.key, q.has_qualifier FROM meas m LEFT JOIN
 (SELECT key, bool_or(relation IN ('>','<','>=','<=')) AS has_qualifier FROM meas GROUP BY key) q USING (key)""")
def j1(spark, sf):
    m = meas(spark, sf)
    flags = m.groupBy("key").agg(dedup.any_qualified("relation").alias("has_qualifier"))
    return m.select("ord", "key").join(flags, "key", "left").select("ord", "key", "has_qualifier")


@query("j13_assay_compounds", "meas", f"""
SELECT key AS id, max(CASE WHEN {_LABEL} = 1 THEN 1 ELSE 0 END) AS active FROM meas WHERE source = 'A' GROUP BY key""")
def j13(spark, sf):
    links = labelled(spark, sf).select(
        F.col("source").alias("target"),
        F.col("id").alias("assay"),
        F.col("key").alias("id"),
        F.when(F.col("label") == 1, "active").otherwise("inactive").alias("outcome"),
    )
    return curation.assay_compounds(links, "A")


@query("a1_value_counts", "meas", f"""
SELECT source, label, count(*) AS n FROM (SELECT source, {_LABEL} AS label FROM meas) GROUP BY ALL""")
def a1(spark, sf):
    return dedup.value_counts(labelled(spark, sf), "source", "label")


_VALUE = r("v", 3)
_SOURCES = "string_agg(DISTINCT source, ', ' ORDER BY source)"


@query("a2_distinct_values", "meas", f"""
WITH g AS (SELECT key, {_VALUE} AS k, min_by(v, ord) AS v, min_by(id, ord) AS id, min_by(relation, ord) AS relation,
 min_by(pchembl, ord) FILTER (pchembl IS NOT NULL) AS pchembl, {_SOURCES} AS sources, count(*) AS n_records
 FROM meas GROUP BY 1, 2)
SELECT key, v, id, relation, pchembl, sources, n_records, count(*) OVER (PARTITION BY key) AS n_values FROM g""")
def a2(spark, sf):
    return dedup.distinct_values(meas(spark, sf, heavy=True), "key", "v", "ord", ("id", "relation", "pchembl"))


@query("w4_n_values", "meas", f"""
SELECT key, v, count(*) OVER (PARTITION BY key) AS n_values FROM
 (SELECT key, min_by(v, ord) AS v FROM meas GROUP BY key, {_VALUE})""")
def w4(spark, sf):
    return dedup.distinct_values(meas(spark, sf), "key", "v", "ord").select("key", "v", "n_values")


_MEDIAN = f"""
SELECT key, min_by(id, ord) AS id, quantile_cont(v, 0.5) AS value_median, min(v) AS value_min, max(v) AS value_max,
 count(*) AS n_measurements, bool_or(relation IN ('>','<','>=','<=')) AS has_qualifier, {_SOURCES} AS sources
FROM meas GROUP BY key"""


def _median(spark, sf, slices=ranks.SLICES):
    return dedup.median_per_key(meas(spark, sf, heavy=True), "key", "v", "ord", first=("id",), slices=slices)


@query("a3_median_per_key", "meas", _MEDIAN)
def a3(spark, sf):
    return _median(spark, sf)


@query("a3_median_per_key_split_hot", "meas", _MEDIAN)
def a3_hot(spark, sf):
    """Same result with one slice for each doubling of the values."""
    return _median(spark, sf, 1)


@query("a4_median_per_pair", "meas", """
SELECT id, key, count(*) AS n, quantile_cont(v, 0.5) AS value_median FROM meas
WHERE key IS NOT NULL AND unit = 'nM' AND v > 0 GROUP BY id, key""")
def a4(spark, sf):
    m = meas(spark, sf).where(V.usable_measurement(F.col("key"), F.col("v"), F.col("unit")))
    return dedup.median_per_pair(m, ["id", "key"], "v")


_ROBUST = f"""
WITH g AS (SELECT key, min_by(id, ord) AS id, count(*) FILTER ({_EXACT}) AS n_exact,
 count(*) FILTER (NOT ({_EXACT})) AS n_qualified, quantile_cont({_PIC}, 0.5) FILTER ({_EXACT}) AS med,
 max({_PIC}) FILTER ({_EXACT}) - min({_PIC}) FILTER ({_EXACT}) AS rng, {_SOURCES} AS sources FROM meas GROUP BY key),
c AS (SELECT *, CASE WHEN n_exact = 0 THEN 'qualified_only' WHEN n_exact = 1 THEN 'single' WHEN rng <= 0.5 THEN 'high (<=3x)'
 WHEN rng <= 1 THEN 'good (<=10x)' WHEN rng <= 2 THEN 'moderate (10-100x)' ELSE 'CONFLICT (>100x)' END AS confidence FROM g)
SELECT key, id, {r("pow(10::DOUBLE, 9 - med)", 3)} AS value_median, {r("med", 3)} AS pic50_median, n_exact, n_qualified,
 {r("pow(10::DOUBLE, rng)", 1)} AS fold_change, {r("rng", 2)} AS range_log, confidence,
 confidence NOT IN ('CONFLICT (>100x)', 'qualified_only') AS recommend_keep, sources FROM c"""


def _robust(spark, sf, slices=ranks.SLICES):
    return dedup.robust_dedup(meas(spark, sf, heavy=True), "key", "v", "ord", slices=slices)


@query("a5_robust_dedup", "meas", _ROBUST)
def a5(spark, sf):
    return _robust(spark, sf)


@query("a5_robust_dedup_split_hot", "meas", _ROBUST)
def a5_hot(spark, sf):
    """Same result with every key of more than four rows treated as hot."""
    return _robust(spark, sf, 1)


@query("a6_label_per_key", "meas", f"""
SELECT key, max(l) AS label, count(*) AS n_rows, min(l) <> max(l) AS contradictory
FROM (SELECT key, {_LABEL} AS l FROM meas) WHERE l IS NOT NULL GROUP BY key""")
def a6(spark, sf):
    return dedup.label_per_key(labelled(spark, sf), "key", "label")


@query("a8_any_qualified", "meas", """
SELECT key, bool_or(relation IN ('>','<','>=','<=')) AS has_qualifier FROM meas GROUP BY key""")
def a8(spark, sf):
    return meas(spark, sf).groupBy("key").agg(dedup.any_qualified("relation").alias("has_qualifier"))


@query("a9_join_sources", "meas", f"SELECT key, {_SOURCES} AS sources FROM meas GROUP BY key")
def a9(spark, sf):
    return meas(spark, sf).groupBy("key").agg(dedup.join_sources("source").alias("sources"))


@query("a10_first_valid", "meas", """
SELECT key, min_by(registry, ord) FILTER (registry IS NOT NULL) AS registry,
 min_by(pchembl, ord) FILTER (pchembl IS NOT NULL) AS pchembl FROM meas GROUP BY key""")
def a10(spark, sf):
    cols = [dedup.first_valid(c, "ord").alias(c) for c in ("registry", "pchembl")]
    return meas(spark, sf, heavy=True).groupBy("key").agg(*cols)


@query("a29_best_class_per_key", "meas", f"""
WITH c AS (SELECT key, ord, v, {_CLASS} AS class FROM meas),
b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE class WHEN 'active' THEN 0 WHEN 'gray' THEN 1
 WHEN 'inactive' THEN 2 ELSE 3 END, ord) AS rn FROM c)
SELECT key, class, v FROM b WHERE rn = 1 AND class IN ('active', 'inactive')""")
def a29(spark, sf):
    m = meas(spark, sf, heavy=True).withColumn("class", V.activity_class(F.col("v"), F.col("relation")))
    return dedup.best_class_per_key(m, "key", "class", "ord", ("v",))


@query("a30_label_conflicts", "meas", f"""
SELECT key, min(l) AS lowest, max(l) AS highest FROM (SELECT key, {_LABEL} AS l FROM meas)
GROUP BY key HAVING min(l) <> max(l)""")
def a30(spark, sf):
    return dedup.label_conflicts(labelled(spark, sf), "key", "label")


@query("t1_sorted_grades", "meas", f"""
WITH res AS ({_ROBUST.strip()}) SELECT key, confidence, fold_change, row_number() OVER (ORDER BY
 CASE confidence WHEN 'CONFLICT (>100x)' THEN 0 WHEN 'moderate (10-100x)' THEN 1 WHEN 'good (<=10x)' THEN 2
 WHEN 'high (<=3x)' THEN 3 WHEN 'single' THEN 4 ELSE 5 END, fold_change DESC NULLS LAST, key) AS position FROM res""")
def t1(spark, sf):
    graded = _robust(spark, sf).select("key", "confidence", "fold_change")
    order = [dedup.grade_order(), F.col("fold_change").desc_nulls_last(), F.col("key").asc()]
    return ranks.dense_number(graded, order, "position")


@query("t2_worst_conflicts", "meas", f"""
WITH res AS ({_ROBUST.strip()}) SELECT key, fold_change, n_exact FROM res WHERE confidence = 'CONFLICT (>100x)'
ORDER BY fold_change DESC, key LIMIT 5""")
def t2(spark, sf):
    bad = _robust(spark, sf).where(F.col("confidence") == dedup.CONFLICT)
    return ranks.top_rows(bad, [F.desc("fold_change"), F.asc("key")], 5).select("key", "fold_change", "n_exact")


@query("u3_set_difference", "meas", f"""
SELECT DISTINCT key FROM (SELECT key, {_LABEL} AS l FROM meas) WHERE l = 0
EXCEPT SELECT key FROM (SELECT key, {_LABEL} AS l FROM meas) WHERE l = 1""")
def u3(spark, sf):
    rows = labelled(spark, sf)
    return assemble.subtract_keys(rows.where("label = 0"), rows.where("label = 1"), "key")


@query("potency_training_rows", "meas", """
WITH p AS (SELECT key, ord, coalesce(CASE WHEN pchembl IS NOT NULL THEN pchembl END,
 CASE WHEN trim(any_unit) = 'nM' THEN -log10(v * 1e-9::DOUBLE) END) AS potency FROM meas WHERE target = 'T6'),
f AS (SELECT key, min_by(potency, ord) AS potency FROM p WHERE potency IS NOT NULL GROUP BY key)
SELECT key, cast(potency >= 6 AS int) AS active FROM f""")
def potency_training_rows(spark, sf):
    mine = curation.select_target(meas(spark, sf), "target", "T6")
    return curation.potency_rows(mine, "key", "ord", "pchembl", "v", "any_unit").select("key", "active")


@query("s4_last_name_wins", "lib", """
SELECT concat('PART:', name) AS name, max_by(smiles, ord) AS smiles, 'PART' AS source FROM lib GROUP BY name""")
def s4(spark, sf):
    return readers.last_per_name(lib(spark, sf), "PART")
