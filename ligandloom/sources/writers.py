"""Write tables, delimited files and batches."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from ligandloom.functions.fingerprints import bit_columns
from ligandloom.operators.assemble import BATCH_ROWS, SEED, number_batches
from ligandloom.sources.readers import path_exists


def write_tables(tables: Mapping[str, DataFrame], folder: str) -> None:
    """One parquet table per name, replaced if there."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    (
        df.write.mode("overwrite").option("header", True).option("sep", sep)
        .option("quote", '"').option("escape", '"').csv(path)
    )


def write_batches(
    df: DataFrame, key: str, folder: str, rows: int = BATCH_ROWS, seed: int = SEED
) -> None:
    """Shuffled batches of ``rows`` lines 'key id', one folder with one file per batch."""
    lines = number_batches(df, key, rows, seed).select(
        "batch", "place", F.concat_ws(" ", key, "batch_id").alias("value")
    )
    (
        lines.repartition("batch").sortWithinPartitions("batch", "place")
        .select("batch", "value")
        .write.mode("overwrite").partitionBy("batch").text(folder)
    )


def materialize_once(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored result if there is one, else compute and store it."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def expand_bits(
    df: DataFrame, bits: str, n_bits: int, name: str = "X%d", first: int = 1
) -> DataFrame:
    """0/1 columns in place of the set bits, for export."""
    rest = [c for c in df.columns if c != bits]
    return df.select(*rest, *bit_columns(F.col(bits), n_bits, name, first))
