"""Queries over scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ligandloom.catalog.registry import query, r
from ligandloom.catalog.views import scored
from ligandloom.functions import values as V
from ligandloom.operators import evaluate as E

_CM = """cm AS (SELECT count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p < 0.5 AND y = 0) AS tn,
 count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn FROM scored)"""
_RATES = """tp, tn, fp, fn, coalesce((tp + tn)::DOUBLE / nullif(tp + tn + fp + fn, 0), 0) AS accuracy,
 coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision,
 coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc"""
_CURVE = """sc AS (SELECT p, count(*) FILTER (y = 1) AS tp, count(*) FILTER (y <> 1) AS fp FROM scored GROUP BY p),
cv AS (SELECT p, tp, fp, sum(tp) OVER (ORDER BY p DESC)::BIGINT AS cum_tp, sum(fp) OVER (ORDER BY p DESC)::BIGINT AS cum_fp FROM sc)"""
_RANK = """rm AS (SELECT sum(fp::DOUBLE * (cum_tp - tp / 2::DOUBLE)) / (sum(tp) * sum(fp))::DOUBLE AS roc_auc,
 sum(tp::DOUBLE * cum_tp / (cum_tp + cum_fp)) / sum(tp)::DOUBLE AS average_precision FROM cv)"""


@query("a15_confusion_matrix", "scored", f"WITH {_CM} SELECT * FROM cm")
def a15(spark, sf):
    return E.confusion(scored(spark, sf), "y", "p")


@query("a16_rates", "scored", f"WITH {_CM} SELECT {_RATES} FROM cm")
def a16(spark, sf):
    return E.rates(E.confusion(scored(spark, sf), "y", "p"))


@query("a17_classification_report", "scored", f"""
WITH {_CM}, b AS (SELECT tn::DOUBLE / (tn + fn) AS pi, tn::DOUBLE / (tn + fp) AS ri, tn + fp AS si,
 tp::DOUBLE / (tp + fp) AS pa, tp::DOUBLE / (tp + fn) AS ra, tp + fn AS sa FROM cm),
f AS (SELECT *, 2 * pi * ri / (pi + ri) AS fi, 2 * pa * ra / (pa + ra) AS fa, (ri * si + ra * sa) / (si + sa) AS acc FROM b),
o AS (SELECT 'inactive' AS class, pi AS precision, ri AS recall, fi AS f1, si AS support FROM f
UNION ALL SELECT 'active', pa, ra, fa, sa FROM f UNION ALL SELECT 'accuracy', acc, acc, acc, si + sa FROM f
UNION ALL SELECT 'macro avg', (pi + pa) / 2, (ri + ra) / 2, (fi + fa) / 2, si + sa FROM f
UNION ALL SELECT 'weighted avg', (pi * si + pa * sa) / (si + sa), (ri * si + ra * sa) / (si + sa), (fi * si + fa * sa) / (si + sa), si + sa FROM f)
SELECT class, {r("precision", 9)} AS precision, {r("recall", 9)} AS recall, {r("f1", 9)} AS f1, support FROM o""")
def a17(spark, sf):
    rep = E.classification_report(scored(spark, sf), "y", "p")
    nums = [V.half_even(F.col(c), 9).alias(c) for c in ("precision", "recall", "f1")]
    return rep.select("class", *nums, "support")


def _rank(spark, sf):
    return E.ranking_metrics(E.score_curve(scored(spark, sf), "y", "p"))


@query("a18_roc_auc", "scored", f"WITH {_CURVE}, {_RANK} SELECT {r('roc_auc', 9)} AS roc_auc FROM rm")
def a18(spark, sf):
    return _rank(spark, sf).select(V.half_even(F.col("roc_auc"), 9).alias("roc_auc"))


@query("a19_average_precision", "scored", f"WITH {_CURVE}, {_RANK} SELECT {r('average_precision', 9)} AS average_precision FROM rm")
def a19(spark, sf):
    return _rank(spark, sf).select(V.half_even(F.col("average_precision"), 9).alias("average_precision"))


@query("a20_subset_specificity", "scored", f"""
SELECT {r("avg(CASE WHEN p < 0.5 THEN 1::DOUBLE ELSE 0 END) FILTER (source = 'real' AND y = 0)", 9)} AS specificity FROM scored""")
def a20(spark, sf):
    s = E.subset_specificity(scored(spark, sf), "y", "p", "source", "real")
    return s.select(V.half_even(F.col("specificity"), 9).alias("specificity"))


@query("w9_roc_curve", "scored", f"""
WITH {_CURVE} SELECT p AS threshold, cum_fp / (SELECT sum(fp) FROM sc)::DOUBLE AS fpr, cum_tp / (SELECT sum(tp) FROM sc)::DOUBLE AS tpr FROM cv""")
def w9(spark, sf):
    s = scored(spark, sf)
    return E.roc_points(E.score_curve(s, "y", "p"), "p", E.class_totals(s, "y"))


@query("w9_pr_curve", "scored", f"""
WITH {_CURVE} SELECT p AS threshold, cum_tp / (cum_tp + cum_fp)::DOUBLE AS precision, cum_tp / (SELECT sum(tp) FROM sc)::DOUBLE AS recall FROM cv""")
def w9_pr(spark, sf):
    s = scored(spark, sf)
    return E.pr_points(E.score_curve(s, "y", "p"), "p", E.class_totals(s, "y"))


def _variants(spark, sf):
    """Three scorings of the same rows."""
    s = scored(spark, sf)
    names = F.array(F.lit("plain"), F.lit("blunt"), F.lit("reversed"))
    every = s.select("*", F.explode(names).alias("variant"))
    p = F.when(F.col("variant") == "blunt", F.floor(F.col("p") * 10) / 10).when(
        F.col("variant") == "reversed", 1 - F.col("p")
    )
    return every.withColumn("p", F.coalesce(p.cast("double"), "p"))


_VAR = """v AS (SELECT y, 'plain' AS variant, p FROM scored UNION ALL SELECT y, 'blunt', floor(p * 10) / 10 FROM scored
 UNION ALL SELECT y, 'reversed', 1 - p FROM scored),
sc AS (SELECT variant, p, count(*) FILTER (y = 1) AS tp, count(*) FILTER (y <> 1) AS fp FROM v GROUP BY variant, p),
cv AS (SELECT *, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp FROM sc WINDOW w AS (PARTITION BY variant ORDER BY p DESC)),
rm AS (SELECT variant, sum(fp::DOUBLE * (ctp - tp / 2::DOUBLE)) / (sum(tp) * sum(fp))::DOUBLE AS roc_auc,
 sum(tp::DOUBLE * ctp / (ctp + cfp)) / sum(tp)::DOUBLE AS average_precision FROM cv GROUP BY variant)"""


@query("m4_metrics_per_variant", "scored", f"""
WITH {_VAR}, cm AS (SELECT variant, count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p < 0.5 AND y = 0) AS tn,
 count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn FROM v GROUP BY variant)
SELECT variant, tp, tn, fp, fn, {r('roc_auc', 9)} AS roc_auc, {r('average_precision', 9)} AS average_precision FROM cm JOIN rm USING (variant)""")
def m4_metrics(spark, sf):
    t = E.metrics_table(_variants(spark, sf), "y", "p", ["variant"])
    nums = [V.half_even(F.col(c), 9).alias(c) for c in ("roc_auc", "average_precision")]
    return t.select("variant", "tp", "tn", "fp", "fn", *nums)


@query("a31_pick_best", "scored", f"""
WITH {_VAR} SELECT variant, {r('roc_auc', 9)} AS roc_auc FROM rm ORDER BY roc_auc DESC, variant LIMIT 1""")
def a31(spark, sf):
    best = E.pick_best(E.metrics_table(_variants(spark, sf), "y", "p", ["variant"]), "variant")
    return best.select("variant", V.half_even(F.col("roc_auc"), 9).alias("roc_auc"))


@query("a31_combined_gain", "scored", f"""
WITH {_VAR}, g AS (SELECT max(roc_auc) FILTER (variant = 'plain') - max(roc_auc) FILTER (variant <> 'plain') AS gain FROM rm)
SELECT {r('gain', 9)} AS gain, gain > 0.002 AS improved FROM g""")
def a31_gain(spark, sf):
    g = E.combined_gain(E.metrics_table(_variants(spark, sf), "y", "p", ["variant"]), "variant", "plain")
    return g.select(V.half_even(F.col("gain"), 9).alias("gain"), "improved")
