"""Exact classifier metrics as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ligandloom.operators.ranks import running_totals

THRESHOLD = 0.5


def confusion(
    df: DataFrame, label: str, score: str, by: Sequence[str] = (), threshold: float = THRESHOLD
) -> DataFrame:
    said, real = F.col(score) >= threshold, F.col(label) == 1
    return df.groupBy(*by).agg(
        F.count_if(said & real).alias("tp"),
        F.count_if(~said & ~real).alias("tn"),
        F.count_if(said & ~real).alias("fp"),
        F.count_if(~said & real).alias("fn"),
    )


def _share(part: Column, whole: Column) -> Column:
    """part/whole, 0 for an empty whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def rates(counts: DataFrame) -> DataFrame:
    """accuracy, recall, precision and mcc of confusion counts."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return counts.select(
        "*",
        _share(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _share(tp, tp + fn).alias("recall"),
        _share(tp, tp + fp).alias("precision"),
        _share(tp * tn - fp * fn, root).alias("mcc"),
    )


def classification_report(
    df: DataFrame, label: str, score: str, threshold: float = THRESHOLD
) -> DataFrame:
    """precision, recall, f1 and support per class, with accuracy and the two averages."""
    one = confusion(df, label, score, (), threshold)

    def line(name: str, hit: str, wrong: str, lost: str) -> Column:
        p, r = _share(F.col(hit), F.col(hit) + F.col(wrong)), _share(F.col(hit), F.col(hit) + F.col(lost))
        return F.struct(
            F.lit(name).alias("class"),
            p.alias("precision"),
            r.alias("recall"),
            _share(F.lit(2.0) * p * r, p + r).alias("f1"),
            (F.col(hit) + F.col(lost)).alias("support"),
        )

    both = one.select(line("inactive", "tn", "fn", "fp").alias("i"), line("active", "tp", "fp", "fn").alias("a"))
    n = F.col("i.support") + F.col("a.support")
    names = ("precision", "recall", "f1")

    def mean(m: str, weighted: bool) -> Column:
        if not weighted:
            return ((F.col(f"i.{m}") + F.col(f"a.{m}")) / 2).alias(m)
        return _share(
            F.col(f"i.{m}") * F.col("i.support") + F.col(f"a.{m}") * F.col("a.support"), n
        ).alias(m)

    right = _share(F.col("i.recall") * F.col("i.support") + F.col("a.recall") * F.col("a.support"), n)
    rows = F.array(
        F.col("i"),
        F.col("a"),
        F.struct(F.lit("accuracy").alias("class"), *[right.alias(m) for m in names], n.alias("support")),
        F.struct(F.lit("macro avg").alias("class"), *[mean(m, False) for m in names], n.alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), *[mean(m, True) for m in names], n.alias("support")),
    )
    return both.select(F.inline(rows))


def score_curve(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score, from high to low: own and running class counts."""
    counts = df.groupBy(*by, score).agg(
        F.count_if(F.col(label) == 1).alias("tp"), F.count_if(F.col(label) != 1).alias("fp")
    )
    return running_totals(counts, [F.col(score).desc()], {"cum_tp": "tp", "cum_fp": "fp"}, by)


def ranking_metrics(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """roc_auc (ties averaged) and average_precision (step sum) of a score curve."""
    tp, fp, ctp, cfp = (F.col(c).cast("double") for c in ("tp", "fp", "cum_tp", "cum_fp"))
    sums = curve.groupBy(*by).agg(
        F.sum(fp * (ctp - tp / 2)).alias("_area"),
        F.sum(tp * ctp / (ctp + cfp)).alias("_steps"),
        F.sum(tp).alias("_p"),
        F.sum(fp).alias("_n"),
    )
    return sums.select(
        *by,
        F.try_divide(F.col("_area"), F.col("_p") * F.col("_n")).alias("roc_auc"),
        F.try_divide(F.col("_steps"), F.col("_p")).alias("average_precision"),
    )


def roc_points(curve: DataFrame, score: str, totals: DataFrame) -> DataFrame:
    """(threshold, fpr, tpr); ``totals`` is one row n_pos, n_neg."""
    row = totals.first()
    pos, neg = F.lit(float(row["n_pos"])), F.lit(float(row["n_neg"]))
    return curve.select(
        F.col(score).alias("threshold"),
        F.try_divide(F.col("cum_fp"), neg).alias("fpr"),
        F.try_divide(F.col("cum_tp"), pos).alias("tpr"),
    )


def pr_points(curve: DataFrame, score: str, totals: DataFrame) -> DataFrame:
    """(threshold, precision, recall)."""
    pos = F.lit(float(totals.first()["n_pos"]))
    return curve.select(
        F.col(score).alias("threshold"),
        (F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))).alias("precision"),
        F.try_divide(F.col("cum_tp"), pos).alias("recall"),
    )


def class_totals(df: DataFrame, label: str) -> DataFrame:
    return df.agg(
        F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) != 1).alias("n_neg")
    )


def subset_specificity(
    df: DataFrame,
    label: str,
    score: str,
    source: str,
    real: str,
    by: Sequence[str] = (),
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Share of measured inactives told inactive; decoys left out, null if there are none."""
    mine = (F.col(label) == 0) & (F.col(source) == real)
    right = F.when(F.col(score) < threshold, 1.0).otherwise(0.0)
    return df.groupBy(*by).agg(F.avg(F.when(mine, right)).alias("specificity"))


def metrics_table(
    df: DataFrame, label: str, score: str, by: Sequence[str] = (), threshold: float = THRESHOLD
) -> DataFrame:
    """All metrics, one row per variant."""
    left = rates(confusion(df, label, score, by, threshold))
    right = ranking_metrics(score_curve(df, label, score, by), by)
    if by:
        return left.join(right, list(by))
    return left.withColumn("_one", F.lit(1)).join(right.withColumn("_one", F.lit(1)), "_one").drop("_one")


def pick_best(metrics: DataFrame, name: str, metric: str = "roc_auc") -> DataFrame:
    """The variant with the highest metric, the first by name on ties."""
    return metrics.agg(
        F.min_by(F.struct(name, metric), F.struct((-F.col(metric)).alias("m"), name)).alias("b")
    ).select("b.*")


def combined_gain(metrics: DataFrame, name: str, combined: str, least: float = 0.002) -> DataFrame:
    """How much the combined variant beats the best single one."""
    both = metrics.agg(
        F.max(F.when(F.col(name) == combined, F.col("roc_auc"))).alias("c"),
        F.max(F.when(F.col(name) != combined, F.col("roc_auc"))).alias("s"),
    )
    gain = F.col("c") - F.col("s")
    return both.select(gain.alias("gain"), (gain > least).alias("improved"))
