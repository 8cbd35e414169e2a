"""Data-quality checks; every result is a table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from ligandloom.functions import values as V


def stored_equals_recomputed(df: DataFrame, stored: str, again: Column) -> DataFrame:
    """(n_rows, n_mismatch) of stored features against recomputed ones."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~F.col(stored).eqNullSafe(again)).alias("n_mismatch"),
    )


def labels_follow_rule(df: DataFrame, label: str, value: str, relation: str) -> DataFrame:
    again = V.label_binary(F.col(value), F.col(relation))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~F.col(label).eqNullSafe(again)).alias("n_mismatch"),
    )


def labels_agree(tables: Mapping[str, DataFrame], row_id: str, label: str) -> DataFrame:
    """(n_rows, n_consistent): rows that have one and the same label in all tables.

    The tables are stacked and grouped by row id, one shuffle for any number
    of them; a missing label counts as a value of its own.
    """
    stacked = None
    for name, df in tables.items():
        value = F.struct(F.col(label).isNull().alias("none"), F.col(label).alias("l"))
        part = df.select(row_id, value.alias("_l"), F.lit(name).alias("_t"))
        stacked = part if stacked is None else stacked.unionByName(part)
    rows = stacked.groupBy(row_id).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_l").alias("_lo"), F.max("_l").alias("_hi")
    )
    same = (F.col("_n") == len(tables)) & F.col("_lo").eqNullSafe(F.col("_hi"))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(same).alias("n_consistent"))


def pairs_present(df: DataFrame, source: DataFrame, key: str, value: str) -> DataFrame:
    """(n_rows, n_present): rows whose (key, value) the source has; missing equals missing."""
    known = source.select(F.col(key).alias("_k"), F.col(value).alias("_v")).distinct()
    on = F.col(key).eqNullSafe(F.col("_k")) & F.col(value).eqNullSafe(F.col("_v"))
    marked = df.select(key, value).join(known.withColumn("_hit", F.lit(True)), on, "left")
    return marked.agg(F.count(F.lit(1)).alias("n_rows"), F.count("_hit").alias("n_present"))


def verdict(features: DataFrame, labels: DataFrame, agree: DataFrame, present: DataFrame) -> DataFrame:
    """One row per check with its outcome, and all of them together."""
    parts = [
        features.select(F.lit("features").alias("check"), (F.col("n_mismatch") == 0).alias("passed")),
        labels.select(F.lit("labels").alias("check"), (F.col("n_mismatch") == 0).alias("passed")),
        agree.select(F.lit("tables").alias("check"), (F.col("n_rows") == F.col("n_consistent")).alias("passed")),
        present.select(F.lit("source").alias("check"), (F.col("n_rows") == F.col("n_present")).alias("passed")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("check").agg(F.bool_and("passed").alias("passed")).unionByName(
        rows.agg(F.bool_and("passed").alias("passed")).select(F.lit("all").alias("check"), "passed")
    )


def rule_of(value: Column, relation: Column) -> Column:
    """Name of the label rule a row falls under."""
    rel = F.trim(relation)
    low = value <= V.ACTIVE_MAX_NM
    return (
        F.when((rel == "=") & low, "exact_low")
        .when((rel == "=") & (value > V.ACTIVE_MAX_NM), "exact_high")
        .when(rel.isin(*V.LOWER_BOUND), "lower_bound")
        .when(rel.isin(*V.UPPER_BOUND) & low, "upper_bound_low")
    )


def examples_per_rule(df: DataFrame, value: str, relation: str, ord: str, n: int = 2) -> DataFrame:
    """The first n rows of every rule.

    Each rule keeps its n first rows per partial group before the final
    window sees them (the window group limit Spark plans for row_number <= n).
    """
    tagged = df.withColumn("rule", rule_of(F.col(value), F.col(relation))).where("rule is not null")
    place = F.row_number().over(Window.partitionBy("rule").orderBy(ord))
    return tagged.withColumn("place", place).where(F.col("place") <= n)
