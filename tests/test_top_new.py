"""The best new rows of a screen, with the nearest active of these alone."""

from pyspark.sql import functions as F

from ligandloom.operators import learn, ranking, ranks


def test_same_rows_as_the_whole_screen(spark, monkeypatch):
    rows = [(k, str(k % 55) if k % 9 else None, [b for b in range(16) if (k * 7 + b * b) % 3], k % 4 == 0) for k in range(60)]
    rows.append((60, "x", None, False))
    df = spark.createDataFrame(rows, "id long, key string, on_bits array<int>, active boolean")
    known = df.where("active").select("key", F.col("id").alias("ord"), "on_bits")
    library = df.select("id", "key", "on_bits")
    monkeypatch.setattr(learn, "scores", lambda model, rows, out: rows.withColumn(out, F.col("id") % 5 / 5))
    compared = []
    real = learn.nearest
    monkeypatch.setattr(learn, "nearest", lambda lib, *rest: compared.append(lib.count()) or real(lib, *rest))
    got = learn.top_new(None, library, "id", "key", known, "key", "ord", 16, k=12)
    assert compared == [12]
    whole = learn.screen(None, library, "id", "key", known, "key", "ord", 16)
    want = ranks.top_rows(whole.where(~F.col("is_known")), ranking.hit_order("id"), 12)
    assert got.schema == want.schema and got.collect() == want.collect()
