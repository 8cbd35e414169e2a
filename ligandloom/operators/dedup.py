"""One row per key: distinct values, medians, confidence grades, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ligandloom.functions import values as V
from ligandloom.operators.ranks import SLICES, group_with_percentiles

# ---- fixed values (confidence grades in report order, limits in log10 units) ----
CONFLICT = "CONFLICT (>100x)"
MODERATE = "moderate (10-100x)"
GOOD = "good (<=10x)"
HIGH = "high (<=3x)"
SINGLE = "single"
QUALIFIED_ONLY = "qualified_only"
GRADES = (CONFLICT, MODERATE, GOOD, HIGH, SINGLE, QUALIFIED_ONLY)
HIGH_RANGE, GOOD_RANGE, MODERATE_RANGE = 0.5, 1.0, 2.0
CLASS_RANK = {"active": 0, "gray": 1, "inactive": 2, "amb": 3}


def first_valid(column: str, ord: str) -> Column:
    """First non-null value in the given order."""
    value = F.col(column)
    return F.min_by(value, F.when(value.isNotNull(), F.col(ord)))


def join_sources(column: str) -> Column:
    """Sorted distinct values as one text."""
    return F.array_join(F.sort_array(F.collect_set(column)), ", ")


def any_qualified(relation: str) -> Column:
    return F.bool_or(V.is_qualified(F.col(relation)))


def measured(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.where(F.col(key).isNotNull() & F.col(value).isNotNull())


def distinct_values(
    df: DataFrame,
    key: str,
    value: str,
    ord: str,
    first: Sequence[str] = (),
    source: str = "source",
) -> DataFrame:
    """One row per key and value (to 3 decimals), with the number of values per key.

    The count per key is an aggregate joined back, not a window: a key with
    very many values stays spread over the tasks.
    """
    rows = measured(df, key, value).withColumn("_value", V.half_even(F.col(value), 3))
    # every row of a group has an order, so the first value is its minimum by order
    merged = rows.groupBy(key, "_value").agg(
        F.min_by(value, ord).alias(value),
        *[first_valid(c, ord).alias(c) for c in first],
        join_sources(source).alias("sources"),
        F.count(F.lit(1)).alias("n_records"),
    )
    per_key = rows.select(key, "_value").distinct().groupBy(key).agg(
        F.count(F.lit(1)).alias("n_values")
    )
    return merged.join(per_key, key).drop("_value")


def median_per_key(
    df: DataFrame,
    key: str,
    value: str,
    ord: str,
    relation: str = "relation",
    first: Sequence[str] = (),
    source: str = "source",
    slices: int = SLICES,
) -> DataFrame:
    """Median, spread and sources per key."""
    aggs = [
        *[first_valid(c, ord).alias(c) for c in first],
        F.min(value).alias("value_min"),
        F.max(value).alias("value_max"),
        F.count(F.lit(1)).alias("n_measurements"),
        any_qualified(relation).alias("has_qualifier"),
        join_sources(source).alias("sources"),
    ]
    return group_with_percentiles(
        measured(df, key, value), [key], aggs, {"value_median": (value, 0.5)}, slices
    )


def median_per_pair(
    df: DataFrame, keys: Sequence[str], value: str, slices: int = SLICES
) -> DataFrame:
    """Median value per (id, structure)."""
    return group_with_percentiles(
        df, keys, [F.count(F.lit(1)).alias("n")], {"value_median": (value, 0.5)}, slices
    )


def confidence(n_exact: Column, spread: Column) -> Column:
    """Grade from the number of exact values and their log10 range."""
    return (
        F.when(n_exact == 0, QUALIFIED_ONLY)
        .when(n_exact == 1, SINGLE)
        .when(spread <= HIGH_RANGE, HIGH)
        .when(spread <= GOOD_RANGE, GOOD)
        .when(spread <= MODERATE_RANGE, MODERATE)
        .otherwise(CONFLICT)
    )


def robust_dedup(
    df: DataFrame,
    key: str,
    value: str,
    ord: str,
    relation: str = "relation",
    first: Sequence[str] = ("id",),
    source: str = "source",
    slices: int = SLICES,
) -> DataFrame:
    """Grade each key by how far its exact measurements spread."""
    exact = ~V.is_qualified(F.col(relation))
    rows = measured(df, key, value).withColumn(
        "_p", F.when(exact, V.pic50_floored(F.col(value)))
    )
    aggs = [
        *[F.coalesce(first_valid(c, ord), F.lit("")).alias(c) for c in first],
        F.count("_p").alias("n_exact"),
        F.count_if(F.col("_p").isNull()).alias("n_qualified"),
        (F.max("_p") - F.min("_p")).alias("_range"),
        join_sources(source).alias("sources"),
    ]
    grouped = group_with_percentiles(rows, [key], aggs, {"_median": ("_p", 0.5)}, slices)
    grade = confidence(F.col("n_exact"), F.col("_range"))
    return grouped.select(
        key,
        *first,
        V.half_even(F.pow(F.lit(10.0), F.lit(9.0) - F.col("_median")), 3).alias("value_median"),
        V.half_even(F.col("_median"), 3).alias("pic50_median"),
        "n_exact",
        "n_qualified",
        V.half_even(F.pow(F.lit(10.0), F.col("_range")), 1).alias("fold_change"),
        V.half_even(F.col("_range"), 2).alias("range_log"),
        grade.alias("confidence"),
        (~grade.isin(CONFLICT, QUALIFIED_ONLY)).alias("recommend_keep"),
        "sources",
    )


def grade_order() -> Column:
    """Sort position of a confidence grade, worst first."""
    col = F.lit(len(GRADES))
    for i, grade in enumerate(GRADES):
        col = F.when(F.col("confidence") == grade, i).otherwise(col)
    return col


def label_per_key(df: DataFrame, key: str, label: str) -> DataFrame:
    """Any active row makes the key active; mixed labels are reported."""
    return (
        df.where(F.col(label).isNotNull())
        .groupBy(key)
        .agg(
            F.max(label).alias("label"),
            F.count(F.lit(1)).alias("n_rows"),
            (F.min(label) != F.max(label)).alias("contradictory"),
        )
    )


def label_conflicts(df: DataFrame, key: str, label: str) -> DataFrame:
    """Keys with more than one label."""
    return (
        df.groupBy(key)
        .agg(F.min(label).alias("lowest"), F.max(label).alias("highest"))
        .where(F.col("lowest") != F.col("highest"))
    )


def keep_first(df: DataFrame, keys: Sequence[str], ord: str) -> DataFrame:
    """The first row of each key; each map task sends one row per key."""
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.col(ord)).alias("_row")
    )
    return packed.select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def dedup_features(
    df: DataFrame, key: str, ord: str, features: Sequence[str], label: str
) -> DataFrame:
    """First non-null of each feature and the highest label per key."""
    return (
        df.where(F.col(label).isNotNull())
        .groupBy(key)
        .agg(*[first_valid(c, ord).alias(c) for c in features], F.max(label).alias(label))
    )


def best_class_per_key(
    df: DataFrame, key: str, cls: str, ord: str, keep: Sequence[str] = ()
) -> DataFrame:
    """Strongest class per key (first row on ties), then only active and inactive keys."""
    rank = F.lit(len(CLASS_RANK))
    for name, r in CLASS_RANK.items():
        rank = F.when(F.col(cls) == name, r).otherwise(rank)
    best = df.groupBy(key).agg(
        F.min_by(F.struct(cls, *keep), F.struct(rank.alias("r"), F.col(ord).alias("o"))).alias("_b")
    )
    return best.select(key, *[F.col(f"_b.{c}").alias(c) for c in (cls, *keep)]).where(
        F.col(cls).isin("active", "inactive")
    )


def value_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
