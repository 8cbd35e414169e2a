"""Put training sets together: priorities, ratios, folds, splits, batches."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ligandloom.operators import dedup
from ligandloom.operators.ranks import hash_rank
from ligandloom.session import settle

# ---- fixed values ----
BATCH_ROWS = 45
FOLDS = 5
TEST_SHARE = 0.2
RATIOS = (1, 5, 10)
SEED = 42


def union_earlier_wins(frames: Sequence[DataFrame], key: str, ord: str) -> DataFrame:
    """Union in which a key keeps the row of the earliest frame that has it."""
    tagged = [f.withColumn("_prio", F.lit(i)) for i, f in enumerate(frames)]
    merged = tagged[0]
    for t in tagged[1:]:
        merged = merged.unionByName(t)
    placed = merged.withColumn("_at", F.struct("_prio", ord))
    return dedup.keep_first(placed, [key], "_at").drop("_prio", "_at")


def known_keys(*frames: DataFrame, key: str) -> DataFrame:
    """Set union of the keys."""
    merged = frames[0].select(key)
    for f in frames[1:]:
        merged = merged.union(f.select(key))
    return merged.distinct()


def subtract_keys(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``df`` that ``other`` does not have."""
    return df.select(key).distinct().join(other.select(key).distinct(), key, "left_anti")


def n_needed(actives: int, inactives: int, multiplier: float = 1.0) -> int:
    return max(0, int(actives * multiplier) - inactives)


def class_sizes(df: DataFrame, label: str) -> tuple[int, int]:
    """(actives, inactives)."""
    row = df.agg(F.count_if(F.col(label) == 1).alias("a"), F.count_if(F.col(label) == 0).alias("i"))
    found = row.first()
    return found["a"], found["i"]


def require_classes(df: DataFrame, label: str) -> tuple[int, int]:
    """Both classes must occur before anything costly starts."""
    n_act, n_ina = class_sizes(df, label)
    if not df.where(F.col(label).isNotNull() & ~F.col(label).isin(0, 1)).isEmpty():
        raise ValueError("labels other than 0 and 1")
    if n_act + n_ina == 0:
        raise ValueError("no labelled rows")
    if n_act == 0 or n_ina == 0:
        raise ValueError(f"one class only: {n_act} active, {n_ina} inactive")
    return n_act, n_ina


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def assemble_training(
    sources: Sequence[DataFrame | None],
    key: str,
    label: str,
    ord: str,
    negatives: DataFrame | None = None,
    multiplier: float = 1.0,
    seed: int = SEED,
) -> DataFrame:
    """Sources by priority, filled up with negatives to actives x multiplier."""
    present = [s.select(key, label, ord) for s in sources if s is not None]
    if not present:
        raise ValueError("no source of training rows")
    base = union_earlier_wins(present, key, ord)
    if negatives is None:
        return base
    need = n_needed(*class_sizes(base, label), multiplier)
    if need == 0:
        return base
    fresh = negatives.select(key, ord).join(base.select(key), key, "left_anti")
    fresh = dedup.keep_first(fresh, [key], ord).withColumn(label, F.lit(0))
    fill = hash_rank(fresh, key, seed, upto=need).drop("rank")
    return base.unionByName(fill.select(base.columns))


def load_available(
    spark: SparkSession, loaders: Mapping[str, Callable[[], DataFrame]], columns: Sequence[str]
) -> tuple[list[DataFrame], DataFrame]:
    """(tables, report): every source that can be read, in order, and (place, source, loaded, n_rows, reason) of each.

    A source is read once and written to the shared folder, so one that breaks in the middle is left out as a whole and
    the others go on. The reason is the kind of the error. Fails only when no source is left.
    """
    tables, rows = [], []
    for place, (name, load) in enumerate(loaders.items(), 1):
        try:
            df = load()
            require_columns(df, columns)
            table = settle(df.select(*columns))
            rows.append((place, name, True, table.count(), None))
            tables.append(table)
        except Exception as e:  # whatever a source raises is its reason
            rows.append((place, name, False, None, type(e).__name__))
    if not tables:
        raise ValueError("no source could be read: " + ", ".join(f"{r[1]} ({r[4]})" for r in rows))
    return tables, spark.createDataFrame(rows, "place int, source string, loaded boolean, n_rows bigint, reason string")


def with_provenance(
    actives: DataFrame,
    inactives: DataFrame,
    decoys: DataFrame,
    key: str,
    names: Sequence[str] = ("real", "real", "decoy"),
) -> DataFrame:
    """(key, label, source) of the three parts."""
    parts = [
        f.select(key, F.lit(lab).alias("label"), F.lit(name).alias("source"))
        for f, lab, name in zip((actives, inactives, decoys), (1, 0, 0), names)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def ratio_sets(
    actives: DataFrame,
    inactives: DataFrame,
    decoys: DataFrame,
    key: str,
    ratios: Sequence[int] = RATIOS,
    seed: int = SEED,
) -> DataFrame:
    """Training sets of several active:inactive ratios, told apart by ``ratio``.

    All measured inactives are in every set; decoys fill up to
    actives x ratio. The decoys are ranked once for all ratios.
    """
    n_act, n_ina, n_dec = actives.count(), inactives.count(), decoys.count()
    need = {r: n_needed(n_act, n_ina, r) for r in ratios}
    for r, n in need.items():
        if n > n_dec:
            warnings.warn(f"1:{r} needs {n} decoys, {n_dec} available, all taken", stacklevel=2)
    ranked = hash_rank(decoys.select(key), key, seed, upto=max(max(need.values()), 1))
    wanted = F.array_compact(
        F.array(*[F.when(F.col("rank") <= n, F.lit(r)) for r, n in need.items()])
    )
    every = F.array(*[F.lit(r) for r in ratios])
    names = ("active", "real_inactive", "decoy")
    parts = []
    for f, lab, name, which in zip(
        (actives, inactives, ranked), (1, 0, 0), names, (every, every, wanted)
    ):
        parts.append(
            f.select(
                F.explode(which).alias("ratio"),
                key,
                F.lit(lab).alias("label"),
                F.lit(name).alias("source"),
            )
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def stratified_folds(
    df: DataFrame, key: str, label: str, k: int = FOLDS, seed: int = SEED
) -> DataFrame:
    """Class-balanced fold number 0..k-1."""
    ranked = hash_rank(df, key, seed, (label,), "_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def stratified_split(
    df: DataFrame, key: str, label: str, test_share: float = TEST_SHARE, seed: int = SEED
) -> DataFrame:
    """Add ``is_test``: the first share of each class in seeded order."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    ranked = hash_rank(df, key, seed, (label,), "_rank").join(sizes, label)
    test = F.col("_rank") <= F.ceil(F.col("_n") * F.lit(test_share))
    return ranked.withColumn("is_test", test).drop("_rank", "_n")


def sample_n(df: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    """Exactly n rows (or all), the same ones on every cluster."""
    return hash_rank(df, key, seed, upto=n).drop("rank")


def shuffled(df: DataFrame, key: str, seed: int = SEED, out: str = "position") -> DataFrame:
    """Seeded order as an explicit position."""
    return hash_rank(df, key, seed, out=out)


def number_batches(
    df: DataFrame, key: str, rows: int = BATCH_ROWS, seed: int = SEED
) -> DataFrame:
    """Shuffled batches with ids bNN_act_NN."""
    ranked = hash_rank(df, key, seed, out="_rank")
    batch = F.floor((F.col("_rank") - 1) / rows) + 1
    place = (F.col("_rank") - 1) % rows + 1
    return ranked.select(
        *df.columns,
        batch.alias("batch"),
        place.alias("place"),
        F.format_string("b%02d_act_%02d", batch, place).alias("batch_id"),
    )


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """n / (2 n_class) as row weight, of the labels 0 and 1; other labels get no weight."""
    n_act, n_ina = class_sizes(df, label)
    n = float(n_act + n_ina)
    weight = F.when(F.col(label) == 1, F.lit(n / max(2.0 * n_act, 1.0))).when(
        F.col(label) == 0, F.lit(n / max(2.0 * n_ina, 1.0))
    )
    return df.withColumn(out, weight)


def cohort(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows with the given column values, such as label=1, source='real'."""
    for column, value in wanted.items():
        df = df.where(F.col(column) == value)
    return df


def bind_features(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Features side by side, matched on the key and never by position."""
    return left.join(right, key)


def arrange(
    df: DataFrame, meta: Sequence[str], last: str, rename: Mapping[str, str] | None = None
) -> DataFrame:
    """Rename, then meta columns first and the class column last."""
    df = df.withColumnsRenamed(dict(rename or {}))
    middle = [c for c in df.columns if c not in meta and c != last]
    return df.select(*meta, *middle, last)
