"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of this session.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master, as
    in tests, may fall back to a temporary folder of the machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="ligandloom-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir() or folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, per_core: int = 1) -> DataFrame:
    """Use all cores for dear per-row work on a scan of few splits.

    A scan with at least ``per_core`` times as many splits as the cluster has cores is left as
    it is, so large inputs are never shuffled for this.
    """
    parts = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df if df.rdd.getNumPartitions() >= parts else df.repartition(parts)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from the written rows.

    Cuts the lineage of iterative jobs and fixes values that a recomputation
    could change (partition numbers), so lost executors do no harm.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back.

    For loops: a checkpoint still hands the known constraints of its plan on,
    and they multiply from round to round; a table starts afresh.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame that ``stored`` gave, once nothing reads it any more."""
    spark = df.sparkSession
    folder = shared_folder(spark).rstrip("/")
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        name = path.rsplit("/", 1)[1]
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if path.endswith(f"{folder.rsplit('/', 1)[1]}/{name}"):
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What a query shuffled is deleted from the disks as soon as it has ended.

    For chains of tables: without it the shuffles of all steps lie there until the driver happens to collect its garbage.
    A frame made inside should be run once; frames for the caller are made outside.
    """
    before = spark.conf.get(DROP_SHUFFLES)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
