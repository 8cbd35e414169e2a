"""Number columns are not read as text; their values come out as their texts would."""

import math

from pyspark.sql import functions as F

from ligandloom.functions import values as V
from ligandloom.operators import features


def test_same_values_as_through_text(spark):
    doubles = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, 1e-300, 5e-324, 1.7976931348623157e308, 0.1, 123456789.125, -2.5e10]
    rows = [(k, x, k * 10**15 if k % 2 else None, k, "n.d." if k == 3 else str(k), f" {k}.5") for k, x in enumerate(doubles)]
    df = spark.createDataFrame(rows, "id int, d double, l long, i int, word string, text string").withColumn("f", F.col("d").cast("float"))
    columns = ["d", "l", "i", "word", "text", "f"]
    got = features.drop_non_numeric(df, columns)
    want = df.select("id", *[V.to_number(F.col(c)).alias(c) for c in columns if c != "word"])
    assert got.schema == want.schema
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_number_columns_have_no_pattern(spark):
    df = spark.createDataFrame([(1, 2.0, 3)], "id int, d double, l long")
    out = features.drop_non_numeric(df, ["d", "l"])
    assert "rlike" not in out._jdf.queryExecution().toString().lower()
