"""Candidate lists, docking scores and fixed-width record groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ligandloom.functions import values as V

# ---- fixed values ----
MIN_PROBABILITY = 0.7
MAX_ROTATABLE = 10
TOP_NEW, TOP_ALL, TOP_SIMILAR = 300, 50, 20


def select_candidates(hits: DataFrame, p: float = MIN_PROBABILITY) -> DataFrame:
    return hits.where((F.col("active_prob") >= p) & ~F.col("is_known"))


def manifest(candidates: DataFrame) -> DataFrame:
    """Rounded candidate sheet; mw, logp, n_rotatable and status are inputs."""
    return candidates.select(
        "id",
        V.half_even(F.col("active_prob"), 4).alias("active_prob"),
        V.half_even(F.col("max_sim_known"), 4).alias("max_sim_known"),
        V.half_even(F.col("mw"), 1).alias("mw"),
        V.half_even(F.col("logp"), 2).alias("logp"),
        "n_rotatable",
        F.coalesce(F.col("n_rotatable") > MAX_ROTATABLE, F.lit(False)).alias("flexible_warn"),
        "status",
    )


def known_flag(df: DataFrame, known: DataFrame, key: str, out: str = "is_known") -> DataFrame:
    """Add whether the key is in the known set."""
    marks = known.select(key).distinct().withColumn("_hit", F.lit(True))
    return df.join(marks, key, "left").withColumn(out, F.col("_hit").isNotNull()).drop("_hit")


def resume(todo: DataFrame, done: DataFrame, id: str, score: str) -> tuple[DataFrame, DataFrame]:
    """(rows still to compute, finished rows to reuse)."""
    finished = done.where(F.col(score).isNotNull())
    return todo.join(finished.select(id), id, "left_anti"), finished


def control_thresholds(scores: DataFrame) -> DataFrame:
    """One row: the weakest control's affinity and efficiency."""
    control = F.col("type") == "control"
    le = V.ligand_efficiency(F.col("affinity"), F.col("n_heavy"))
    return scores.agg(
        F.max(F.when(control, F.col("affinity"))).alias("affinity_max"),
        F.min(F.when(control, le)).alias("le_min"),
    )


def efficiency_flags(scores: DataFrame) -> DataFrame:
    """Candidates with efficiency and their standing against the controls."""
    row = control_thresholds(scores).first()  # two numbers
    aff_max, le_min = (F.lit(row[c]).cast("double") for c in ("affinity_max", "le_min"))
    le = V.ligand_efficiency(F.col("affinity"), F.col("n_heavy"))
    out = scores.where(F.col("type") == "candidate").withColumn("le", le)

    def flag(test: Column) -> Column:
        return F.coalesce(test, F.lit(False))

    out = out.withColumn("beats_affinity", flag(F.col("affinity") <= aff_max)).withColumn(
        "beats_le", flag(F.col("le") >= le_min)
    )
    return out.withColumn("both", F.col("beats_affinity") & F.col("beats_le")).withColumn(
        "size_inflated", F.col("beats_affinity") & ~F.col("beats_le")
    )


def rank_by_affinity(id: str = "id") -> list[Column]:
    return [F.col("affinity").asc_nulls_last(), F.col(id).asc()]


def rank_by_efficiency(id: str = "id") -> list[Column]:
    return [F.col("le").desc_nulls_last(), F.col(id).asc()]


def hit_order(id: str = "id", score: str = "active_prob") -> list[Column]:
    return [F.col(score).desc(), F.col(id).asc()]


def group_sizes(lines: DataFrame, *keys: str) -> DataFrame:
    return lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_lines"), F.min("line_no").alias("first_line"))


def largest_group(lines: DataFrame, file: str, *keys: str) -> DataFrame:
    """Per file the group with the most lines, the earliest on ties."""
    sizes = group_sizes(lines, file, *keys)
    best = F.max_by(
        F.struct(*keys, "n_lines"), F.struct("n_lines", (-F.col("first_line")).alias("f"))
    )
    return sizes.groupBy(file).agg(best.alias("_b")).select(file, "_b.*")


def split_largest(lines: DataFrame, file: str, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(lines of the largest group, all other lines)."""
    best = largest_group(lines, file, *keys).drop("n_lines")
    on = [file, *keys]
    return lines.join(best, on, "left_semi"), lines.join(best, on, "left_anti")
