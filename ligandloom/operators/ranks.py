"""Ranks, running sums and exact percentiles that no single task has to hold.

A window without a partition key, or with one dominant key, runs in one task.
Here the rows are first cut into ordered slices of even size, the slices are
totalled (a table as small as the number of slices), and each slice is then
finished on its own with the total of the slices before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ligandloom.session import settle

SLICES = 4096  # of the values between a number and its double, for percentiles
HEX_DIGITS = 4  # 16**4 slices of a hash order

_BEFORE = (Window.unboundedPreceding, -1)
_UPTO = (Window.unboundedPreceding, Window.currentRow)


def hash_order(key: Column, seed: int) -> Column:
    """Seeded order key, the same on every cluster."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def slice_rank(
    df: DataFrame,
    order: str,
    by: Sequence[str] = (),
    tie: Sequence[str] = (),
    out: str = "rank",
    upto: int | str | None = None,
    digits: int = HEX_DIGITS,
) -> DataFrame:
    """1-based rank by a hash text column within ``by``.

    The leading hex digits of a hash are evenly spread and keep its order, so
    they are the slices. With ``upto``, a number or a column that is constant
    within ``by``, slices that start behind it are dropped before anything is
    sorted.
    """
    cut = df.withColumn("_slice", F.substring(order, 1, digits))
    keys = [*by, "_slice"]
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(*_BEFORE)
    starts = (
        cut.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    last = F.col(upto) if isinstance(upto, str) else F.lit(upto)
    if isinstance(upto, int):
        starts = starts.where(F.col("_start") < last)
    placed = cut.join(starts, keys)
    if isinstance(upto, str):
        placed = placed.where(F.col("_start") < last)
    inside = Window.partitionBy(*keys).orderBy(order, *tie)
    ranked = placed.withColumn(out, F.col("_start") + F.row_number().over(inside))
    if upto is not None:
        ranked = ranked.where(F.col(out) <= last)
    return ranked.drop("_slice", "_start")


def hash_rank(
    df: DataFrame,
    key: str,
    seed: int,
    by: Sequence[str] = (),
    out: str = "rank",
    upto: int | None = None,
    digits: int = HEX_DIGITS,
) -> DataFrame:
    """Rank of every row in the seeded order of its (unique) key."""
    hashed = df.withColumn("_hash", hash_order(F.col(key), seed))
    return slice_rank(hashed, "_hash", by, (key,), out, upto, digits).drop("_hash")


def dense_number(df: DataFrame, order: Sequence[Column | str], out: str) -> DataFrame:
    """1-based number of each row in sort order; rows must differ in ``order``.

    Range partitions are sorted on their own; ``monotonically_increasing_id``
    then holds (partition, position), and the partition sizes give the rest.
    """
    ranged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    fixed = settle(ranged).withColumn("_pid", F.shiftright("_pos", 33))
    before = Window.orderBy("_pid").rowsBetween(*_BEFORE)
    starts = (
        fixed.groupBy("_pid")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    place = F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        fixed.join(F.broadcast(starts), "_pid")  # one row per shuffle partition
        .withColumn(out, F.col("_start") + place + 1)
        .drop("_pos", "_pid", "_start")
    )


def running_totals(
    df: DataFrame,
    order: Sequence[Column | str],
    sums: Mapping[str, str],
    by: Sequence[str] = (),
) -> DataFrame:
    """Running sums ``{out: column}`` in sort order within ``by``.

    Rows must differ in (by, order), which callers get by aggregating first;
    then range partitions are even whatever the distribution of the values.
    """
    ranged = settle(
        df.repartitionByRange(*by, *order).withColumn("_pid", F.spark_partition_id())
    )
    keys = [*by, "_pid"]
    before = Window.partitionBy(*by).orderBy("_pid").rowsBetween(*_BEFORE)
    totals = ranged.groupBy(*keys).agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    starts = totals.select(
        *keys,
        *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_s_{o}") for o in sums],
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*_UPTO)
    return join_null_safe(ranged, starts, keys, "inner").select(
        *df.columns,
        *[(F.col(f"_s_{o}") + F.sum(c).over(inside)).alias(o) for o, c in sums.items()],
    )


def value_slice(value: Column, slices: int) -> Column:
    """A whole number that never falls as the value grows: ``slices`` steps for each doubling; NaN comes last."""
    top = 1100 * slices  # above the logarithm of any double
    size = F.abs(value.cast("double"))
    step = F.when(F.isnan(size), 2 * top).otherwise(F.least(F.floor(F.log2(size) * slices), F.lit(top)))
    return F.when(value == 0, 0).when(value < 0, -(step + top)).otherwise(step + top).cast("long")


def percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], slices: int = SLICES
) -> DataFrame:
    """(keys, *probs) exact interpolated percentiles per key, from frequencies; keys without a value have no row.

    Equal values of a key are counted on the map side first. Counts per slice of the values then
    tell in which slice a percentile lies, and only the values of such slices are put in order. So no task
    holds all values of a key, however many there are.
    """
    keys = list(keys)
    counted = (
        df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_slice", value_slice(F.col(value), slices))
    )
    whole = Window.partitionBy(*keys)
    sums = counted.groupBy(*keys, "_slice").agg(F.sum("_c").alias("_n"))
    sums = sums.withColumns({"_end": F.sum("_n").over(whole.orderBy("_slice").rowsBetween(*_UPTO)), "_all": F.sum("_n").over(whole)})
    wanted = F.lit(False)
    for p in probs.values():
        at = (F.col("_all") - 1) * F.lit(float(p))
        for rank in (F.floor(at), F.ceil(at)):
            wanted = wanted | ((rank < F.col("_end")) & (rank >= F.col("_end") - F.col("_n")))
    sums = sums.where(wanted).select(*keys, "_slice", (F.col("_end") - F.col("_n")).alias("_start"), "_all")
    inside = Window.partitionBy(*keys, "_slice").orderBy(value).rowsBetween(*_UPTO)
    near = join_null_safe(counted, sums, [*keys, "_slice"], "inner").withColumn("_cum", F.col("_start") + F.sum("_c").over(inside))
    aggs = []
    for out, p in probs.items():
        pos = (F.col("_all") - 1) * F.lit(float(p))
        for end, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            aggs.append(F.min(F.when(F.col("_cum") > rank, F.col(value))).alias(f"_{end}_{out}"))
        aggs.append(F.first(pos).alias(f"_p_{out}"))
    found = near.groupBy(*keys).agg(*aggs)
    cols = []
    for out in probs:
        lo, hi, pos = (F.col(f"_{x}_{out}") for x in ("lo", "hi", "p"))
        mixed = (F.ceil(pos) - pos) * lo + (pos - F.floor(pos)) * hi
        cols.append(F.when(F.floor(pos) == F.ceil(pos), lo).otherwise(mixed).cast("double").alias(out))
    return found.select(*keys, *cols)


def group_with_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    aggs: Sequence[Column],
    percentiles_of: Mapping[str, tuple[str, float]],
    slices: int = SLICES,
) -> DataFrame:
    """``groupBy(keys).agg(...)`` with exact percentiles ``{out: (column, p)}``.

    All other aggregates combine on the map side and are joined with the percentiles.
    """
    keys = list(keys)
    out = df.groupBy(*keys).agg(*aggs, F.lit(1).alias("_one"))
    for column in dict.fromkeys(c for c, _ in percentiles_of.values()):
        probs = {o: p for o, (c, p) in percentiles_of.items() if c == column}
        out = join_null_safe(out, percentiles(df, keys, column, probs, slices), keys, "left")
    return out.drop("_one")


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on the keys where a null equals a null."""
    right = right.withColumnsRenamed({k: f"_r_{i}" for i, k in enumerate(keys)})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{i}")) for i, k in enumerate(keys)]
    return left.join(right, on, how).drop(*[f"_r_{i}" for i in range(len(keys))])


def column_percentiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Mapping[str, float],
    slices: int = SLICES,
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per (by, feature) with exact percentiles of each column."""
    long = df.select(*by, *columns).unpivot(list(by), list(columns), "feature", "value")
    long = long.where(F.col("value").isNotNull())
    return group_with_percentiles(
        long, [*by, "feature"], [F.count(F.lit(1)).alias("n")],
        {o: ("value", p) for o, p in probs.items()}, slices,
    )


def top_rows(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The k first rows, k being a small report size (top-k per task, then merged)."""
    return df.orderBy(*order).limit(k)
