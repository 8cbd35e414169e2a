"""Queries for wide feature cleaning and the data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ligandloom.catalog.measurements import _LABEL, labelled
from ligandloom.catalog.registry import query
from ligandloom.catalog.views import WIDE, WIDE_NUMERIC, meas, vec, wide
from ligandloom.functions import values as V
from ligandloom.operators import assemble, checks, dedup, features
from ligandloom.operators.ranks import SLICES
from ligandloom.session import scratch_path
from ligandloom.sources import readers, writers

_FIN = "CASE WHEN NOT isinf(ratio) AND NOT isnan(ratio) THEN ratio END"


@query("p21_clean_nonfinite", "wide", f"SELECT ord, quantity, price, tax, {_FIN} AS ratio, gap FROM wide")
def p21(spark, sf):
    return features.clean_nonfinite(wide(spark, sf), WIDE_NUMERIC).select("ord", *WIDE_NUMERIC)


@query("p21_count_nonfinite", "wide", "\nUNION ALL ".join(
    f"""SELECT '{c}' AS feature, count(*) FILTER (isinf({c})) AS n_inf,
 count(*) FILTER ({c} IS NULL OR isinf({c}) OR isnan({c})) AS n_missing FROM wide""" for c in WIDE_NUMERIC))
def p21_counts(spark, sf):
    return features.count_nonfinite(wide(spark, sf), WIDE_NUMERIC)


@query("p22_drop_non_numeric", "wide", "SELECT ord, quantity, price, tax, ratio, gap FROM wide")
def p22(spark, sf):
    return features.drop_non_numeric(wide(spark, sf).select("ord", *WIDE), WIDE)


_COMPLETE = f"""SELECT * FROM (SELECT ord, quantity, price, tax, {_FIN} AS ratio, gap, potency FROM wide)
WHERE ratio IS NOT NULL AND gap IS NOT NULL"""


def _export(spark, sf):
    w = features.drop_non_numeric(wide(spark, sf).select("ord", "potency", *WIDE), WIDE)
    return features.drop_incomplete(features.clean_nonfinite(w, WIDE_NUMERIC), WIDE_NUMERIC)


@query("p23_drop_incomplete", "wide", _COMPLETE)
def p23(spark, sf):
    return _export(spark, sf)


@query("p24_arrange_columns", "wide", f"SELECT ord AS row_id, quantity, price, tax, ratio, gap, potency AS class FROM ({_COMPLETE})")
def p24(spark, sf):
    return assemble.arrange(_export(spark, sf), ["row_id"], "class", {"ord": "row_id", "potency": "class"})


@query("p25_select_by_header", "wide", "SELECT tax, price, potency FROM wide")
def p25(spark, sf):
    """The selection is the header of another file."""
    path = scratch_path(spark, "selected") + ".csv"
    writers.write_csv(wide(spark, sf).select("tax", "price", "potency").limit(1), path)
    return features.select_by_header(wide(spark, sf), readers.read_header(spark, path, ","), "potency")


@query("a7_dedup_features", "wide", """
SELECT key, min_by(quantity, ord) AS quantity, min_by(price, ord) AS price, min_by(gap, ord) FILTER (gap IS NOT NULL) AS gap,
 max(potency) AS potency FROM wide GROUP BY key""")
def a7(spark, sf):
    return dedup.dedup_features(wide(spark, sf), "key", "ord", ("quantity", "price", "gap"), "potency")


_MED = """WITH t AS (SELECT * FROM wide WHERE potency = 1), m AS (SELECT quantile_cont(gap, 0.5) AS g,
 quantile_cont(CASE WHEN NOT isinf(ratio) THEN ratio END, 0.5) AS r FROM t)
SELECT ord, coalesce(gap, g) AS gap, coalesce(CASE WHEN NOT isinf(ratio) THEN ratio END, r) AS ratio FROM wide, m"""


def _imputed(spark, sf, slices):
    w = features.clean_nonfinite(wide(spark, sf), WIDE_NUMERIC)
    filled = features.impute_medians(w, ["gap", "ratio"], w.where("potency = 1"), slices)
    return filled.select("ord", "gap", "ratio")


@query("a25_impute_median", "wide", _MED)
def a25(spark, sf):
    return _imputed(spark, sf, SLICES)


@query("a25_impute_median_split_hot", "wide", _MED)
def a25_hot(spark, sf):
    return _imputed(spark, sf, 1)


# ---- checks ----


def _features_check(spark, sf, drift: bool = False):
    """Stored bits against bits recomputed from the numbers they came from."""
    again = F.expr(
        "array_compact(transform(sequence(0, size(embedding) - 1), i -> CASE WHEN embedding[i] > 0 THEN i END))"
    )
    raw = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    kept = F.col("on_bits")
    if drift:
        kept = F.when(F.col("vec_id") % 11 == 0, F.filter("on_bits", lambda b, i: i > 0)).otherwise(kept)
    joined = vec(spark, sf).select("vec_id", kept.alias("on_bits")).join(raw, "vec_id")
    return checks.stored_equals_recomputed(joined, "on_bits", again)


@query("v1_features_match", "", """
SELECT count(*) AS n_rows, count(*) FILTER (vec_id % 11 = 0 AND list_max(embedding) > 0) AS n_mismatch FROM embeddings""")
def v1(spark, sf):
    """Every eleventh stored fingerprint has lost its first bit."""
    return _features_check(spark, sf, drift=True)


def _drifted(spark, sf):
    """Stored labels that disagree with the rule for one target."""
    return labelled(spark, sf).withColumn(
        "stored", F.when(F.col("target") == "T2", F.lit(1)).otherwise(F.col("label"))
    )


@query("v2_labels_follow_rule", "meas", f"""
SELECT count(*) AS n_rows, count(*) FILTER (target = 'T2' AND ({_LABEL}) IS DISTINCT FROM 1) AS n_mismatch FROM meas""")
def v2(spark, sf):
    return checks.labels_follow_rule(_drifted(spark, sf), "stored", "v", "relation")


@query("v3_labels_agree", "meas", f"""
SELECT count(*) AS n_rows, count(*) FILTER (target <> 'T2' OR ({_LABEL}) = 1) AS n_consistent FROM meas""")
def v3(spark, sf):
    d = _drifted(spark, sf)
    good = d.select("ord", "label")
    bad = d.select("ord", F.col("stored").alias("label"))
    return checks.labels_agree({"a": good, "b": good, "c": good, "d": bad}, "ord", "label")


_V4 = """WITH x AS (SELECT key, CASE WHEN target = 'T4' THEN v + 0.5::DOUBLE ELSE v END AS v FROM meas),
k AS (SELECT DISTINCT key, v FROM meas)
SELECT count(*) AS n_rows, count(k.key) AS n_present FROM x LEFT JOIN k ON x.key = k.key AND x.v = k.v"""


@query("v4_pairs_present", "meas", _V4)
def v4(spark, sf):
    m = meas(spark, sf)
    shifted = m.withColumn("v", F.when(F.col("target") == "T4", F.col("v") + 0.5).otherwise(F.col("v")))
    return checks.pairs_present(shifted, m, "key", "v")


@query("v5_verdict", "meas", f"""
WITH l AS (SELECT count(*) FILTER (target = 'T2' AND ({_LABEL}) IS DISTINCT FROM 1) = 0 AS ok FROM meas),
p AS (SELECT n_rows = n_present AS ok FROM ({_V4}))
SELECT 'features' AS check, true AS passed UNION ALL SELECT 'labels', ok FROM l
UNION ALL SELECT 'tables', ok FROM l UNION ALL SELECT 'source', ok FROM p
UNION ALL SELECT 'all', (SELECT ok FROM l) AND (SELECT ok FROM p)""")
def v5(spark, sf):
    return checks.verdict(_features_check(spark, sf), v2(spark, sf), v3(spark, sf), v4(spark, sf))


@query("w11_examples_per_rule", "meas", """
WITH t AS (SELECT ord, v, relation, CASE WHEN relation = '=' AND v <= 10000 THEN 'exact_low'
 WHEN relation = '=' AND v > 10000 THEN 'exact_high' WHEN relation IN ('>','>=') THEN 'lower_bound'
 WHEN relation IN ('<','<=') AND v <= 10000 THEN 'upper_bound_low' END AS rule FROM meas),
n AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY ord)::INT AS place FROM t WHERE rule IS NOT NULL)
SELECT rule, place, ord, v, relation FROM n WHERE place <= 2""")
def w11(spark, sf):
    return checks.examples_per_rule(meas(spark, sf), "v", "relation", "ord").select("rule", "place", "ord", "v", "relation")
