"""Clean and describe wide numeric feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ligandloom.functions import values as V
from ligandloom.operators.ranks import SLICES, column_percentiles


def clean_nonfinite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: V.finite(F.col(c)) for c in columns})


def count_nonfinite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, n_inf, n_missing) in one pass; missing includes infinite."""
    aggs = []
    for c in columns:
        aggs.append(F.count_if(F.abs(F.col(c)) == F.lit(float("inf"))).alias(f"inf_{c}"))
        aggs.append(F.count_if(V.finite(F.col(c)).isNull()).alias(f"missing_{c}"))
    one = df.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.col(f"inf_{c}").alias("n_inf"),
                F.col(f"missing_{c}").alias("n_missing"),
            )
            for c in columns
        ]
    )
    return one.select(F.inline(rows))


def _holds_numbers(df: DataFrame, column: str) -> bool:
    """Is the column of a type whose values, cast to double, are what their texts convert to?"""
    return isinstance(df.schema[column].dataType, (T.IntegralType, T.DoubleType))


def as_number(df: DataFrame, column: str) -> Column:
    """``to_number`` of a column, without the way through text where its type allows; NaN is null."""
    if not _holds_numbers(df, column):
        return V.to_number(F.col(column))
    number = F.col(column).cast("double")
    return F.when(~F.isnan(number), number)


def numeric_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns all of whose values convert to a number; only those of other types than numbers are read."""
    texts = [c for c in columns if not _holds_numbers(df, c)]
    if not texts:
        return list(columns)
    row = df.agg(
        *[
            F.count_if(F.col(c).isNotNull() & V.to_number(F.col(c)).isNull()
                       & (F.lower(F.col(c).cast("string")) != "nan")).alias(c)
            for c in texts
        ]
    ).first()
    return [c for c in columns if c not in texts or row[c] == 0]


def drop_non_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop the columns with a value that does not convert, the others as double."""
    good = numeric_columns(df, columns)
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, *[as_number(df, c).alias(c) for c in good])


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop("any", subset=list(columns))


def impute_medians(
    df: DataFrame,
    columns: Sequence[str],
    train: DataFrame | None = None,
    slices: int = SLICES,
) -> DataFrame:
    """Fill missing cells with the medians of the training rows, one number per feature."""
    medians = column_percentiles(df if train is None else train, columns, {"m": 0.5}, slices)
    fill = {r["feature"]: r["m"] for r in medians.collect()}
    return df.withColumns({c: F.coalesce(c, F.lit(fill.get(c))) for c in columns})


def effect_size(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Class means and standardised difference per feature, after median fill."""
    filled = impute_medians(df, columns)
    long = filled.select(label, *columns).unpivot([label], list(columns), "feature", "value")
    active = F.avg(F.when(F.col(label) == 1, F.col("value")))
    inactive = F.avg(F.when(F.col(label) == 0, F.col("value")))
    grouped = long.groupBy("feature").agg(
        active.alias("active_mean"), inactive.alias("inactive_mean"), F.stddev_samp("value").alias("std_all")
    )
    diff = F.col("active_mean") - F.col("inactive_mean")
    return grouped.withColumn("std_effect", diff / F.nullif(F.col("std_all"), F.lit(0.0)))


def select_by_header(df: DataFrame, header: Sequence[str], label: str) -> DataFrame:
    """The features another file names; fails when one is not there."""
    wanted = [c for c in header if c.lower() != label.lower()]
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"features not found: {', '.join(missing)}")
    return df.select(*wanted, label)
