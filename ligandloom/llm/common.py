"""Reading tables, folds and byte-level text helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts


def raw(text: str | Column) -> Column:
    """The UTF-8 bytes of a text column, so that Python workers need not decode."""
    col = F.col(text) if isinstance(text, str) else text
    return col.cast("binary")


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) words; ``bytes.split`` cuts at exactly x20 and x09-x0D."""
    return text.lower().split() if text else []


def arrow_rows(
    df: DataFrame, fn: Callable[[Iterable[tuple]], Iterator[tuple]], schema: str, batch: int = 4096, taken: int | None = None
) -> DataFrame:
    """``mapInArrow`` over plain tuples: ``fn`` turns a partition's rows into rows of ``schema``.

    Rows leave in batches of ``batch``, so a partition is never held as a whole.
    ``taken`` is how many come in as Python objects at once: all that Spark sends together if None.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for k in range(0, b.num_rows, taken or max(1, b.num_rows)):
                    yield from zip(*(c.to_pylist() for c in b.slice(k, taken).columns), strict=True)

        held: list[tuple] = []
        for row in fn(rows()):
            held.append(row)
            if len(held) >= batch:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), out, strict=True)], schema=out
                )
                held = []
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), out, strict=True)], schema=out
            )

    return df.mapInArrow(run, schema)
