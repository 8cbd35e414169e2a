"""p30d and u10 run at the library's default distance and radius, by plain counting."""

import hashlib

from pyspark.sql import functions as F

from ligandloom.catalog import documents
from ligandloom.catalog.views import DOC_BITS, docs
from ligandloom.functions import fingerprints as FP


def bit(gram):
    return int(hashlib.md5(gram.encode()).hexdigest()[:7], 16) % DOC_BITS


def token_rows(spark, sf):
    rows = docs(spark, sf).where("key is not null").orderBy("id").limit(40)
    return rows.select("id", "key", FP.tokens(F.col("key"), FP.WORD_TOKEN).alias("t")).collect()


def test_pairs_reach_the_default_distance(spark, sf):
    rows = token_rows(spark, sf)
    assert FP.PAIR_DISTANCE == 30 and max(len(r.t) for r in rows) > 30
    got = {r.id: r.bits for r in documents.p30d(spark, sf).collect()}
    for r in rows:
        want = {bit(f"a|{a}|{b}|{d}") for d in range(1, 31) for a, b in zip(r.t, r.t[d:])}
        assert got[r.id] == ",".join(map(str, sorted(want)))


def test_decoy_fingerprints_have_the_default_radius(spark, sf):
    rows = token_rows(spark, sf)
    assert FP.RADIUS == 2
    frame = spark.createDataFrame([(r.id, r.key) for r in rows], "id string, key string")
    for r, got in zip(rows, frame.select(documents._doc_bits(F.col("key")).alias("b")).collect()):
        want = {bit(f"{d}|" + " ".join(r.t[max(0, i - d) : i + d + 1])) for d in range(3) for i in range(len(r.t))}
        assert got.b == sorted(want)
