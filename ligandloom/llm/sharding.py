"""A uniform shuffle of any size into equal shards, in two passes.

Pass one scatters the records into buckets that fit in memory, by a seeded hash of
their key. Pass two takes one bucket at a time, puts it in a fixed order and shuffles it by
Fisher-Yates with a generator seeded by the bucket. A record's place in the whole
shuffle is the number of records in the buckets before plus its place in its own; the
places are dealt to the shards in turn. So shards differ by one record at most, and a
record's shard and slot depend on the seed and the data, never on the partitioning.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ligandloom.session import stored

SHARDS, SEED = 40, 17
#: Bytes of a bucket, by the size law: UTF-8 bytes of the text plus 16 for each record.
BUCKET_BYTES = 32 << 20


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniform order of n records: each place swaps with one not yet passed."""
    draws = np.random.Generator(np.random.PCG64([seed, bucket])).random(n)
    order = list(range(n))
    for i, j in zip(range(n - 1, 0, -1), (draws[1:][::-1] * np.arange(n, 1, -1)).astype(np.int64).tolist()):
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def shuffled_shards(
    docs: DataFrame, shards: int = SHARDS, seed: int = SEED, text: str = "text", key: str = "doc_id",
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """(row, size, text_crc32, shard, slot) of every record; ``row`` holds all its columns.

    Null texts have no bytes. A null key is a key of its own. Keys that repeat
    so often that they would fill a bucket are spread over several; only then does it depend on
    the reading order which of the equal keys goes where.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.struct("*").alias("row"), F.col(key).alias("key"),
        (F.octet_length(body) + 16).cast("bigint").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    total, n = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    buckets = max(1, -(-(total or 0) // bucket_bytes))
    full = max(1, -(-n // buckets))
    hot = stored(rows.groupBy("key").count().where(F.col("count") > full), "hot")  # fewer than there are buckets
    place = F.xxhash64(F.lit(seed), "key")
    if hot.isEmpty():
        rows = rows.withColumn("bucket", F.pmod(place, F.lit(buckets)).cast("bigint"))
    else:
        parts = F.coalesce(F.ceil(F.col("count") / full), F.lit(1))
        spread = hot.select(F.col("key").alias("k"), "count")
        rows = stored(
            rows.join(F.broadcast(spread), F.col("key").eqNullSafe(F.col("k")), "left").withColumn(
                "bucket",
                F.pmod(place + F.pmod(F.monotonically_increasing_id(), parts), F.lit(buckets)).cast("bigint"),
            ).drop("k", "count"),
            "scattered",
        )
    sizes = rows.groupBy("bucket").count()
    before = F.coalesce(
        F.sum("count").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    starts = stored(sizes.select("bucket", before.alias("start")), "starts")
    filled = rows.join(starts, "bucket").select("row", "size", "text_crc32", "key", "bucket", "start")
    out = filled.select("row", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))

    def shuffle(bucket: pa.Table) -> pa.Table:
        b, start = bucket.column("bucket")[0].as_py(), bucket.column("start")[0].as_py()
        fixed = bucket.sort_by([("key", "ascending"), ("text_crc32", "ascending"), ("size", "ascending")])
        mixed = fixed.take(pa.array(fisher_yates(len(bucket), seed, b)))
        at = np.arange(start, start + len(bucket))
        return mixed.select(["row", "size", "text_crc32"]).append_column(
            "shard", pa.array((at % shards).astype(np.int32))
        ).append_column("slot", pa.array(at // shards))

    return filled.groupBy("bucket").applyInArrow(shuffle, out.schema)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, **columns: str) -> None:
    """Write the shards as Parquet folders ``_shard=0`` ... under ``path``, each in the order of its slots."""
    dealt = shuffled_shards(docs, shards, seed, **columns)
    (
        dealt.repartitionByRange(shards, "shard", "slot").sortWithinPartitions("shard", "slot")
        .select("row.*", F.col("shard").alias("_shard")).write.partitionBy("_shard").parquet(path)
    )


def shard_table(docs: DataFrame, shards: int = SHARDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: the law is ``rows``)."""
    dealt = shuffled_shards(docs, shards, text=text, key=key)
    return dealt.select(
        F.col("row")[key].alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
