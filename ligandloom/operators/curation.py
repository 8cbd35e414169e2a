"""Harmonise two measurement sources and flag their duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ligandloom.functions import values as V
from ligandloom.operators.ranks import dense_number

MEASUREMENT = ("source", "compound_id", "smiles", "ic50_nM", "relation", "pChEMBL", "std_type", "ord")


def from_qualified_text(
    raw: DataFrame, smiles: str, text: str, registry_id: str, name: str, ord: str, source: str
) -> DataFrame:
    """Rows whose value is text such as ``>10000``, already in nM."""
    relation, number = V.parse_qualified(F.col(text))
    return raw.where(F.col(text).isNotNull()).select(
        F.lit(source).alias("source"),
        F.coalesce(registry_id, name).alias("compound_id"),
        F.col(smiles).alias("smiles"),
        number.alias("ic50_nM"),
        relation.alias("relation"),
        F.lit(None).cast("double").alias("pChEMBL"),
        F.lit("IC50").alias("std_type"),
        F.col(ord).alias("ord"),
    )


def from_typed_columns(
    raw: DataFrame,
    smiles: str,
    compound_id: str,
    type_: str,
    relation: str,
    value: str,
    unit: str,
    pchembl: str,
    ord: str,
    source: str,
) -> DataFrame:
    """Rows with separate value, unit, relation and type columns; IC50 only."""
    return raw.where(V.is_type(F.col(type_))).select(
        F.lit(source).alias("source"),
        F.col(compound_id).alias("compound_id"),
        F.col(smiles).alias("smiles"),
        V.to_nanomolar(V.to_number(F.col(value)), F.col(unit)).alias("ic50_nM"),
        V.clean_relation(F.col(relation)).alias("relation"),
        V.to_number(F.col(pchembl)).alias("pChEMBL"),
        F.lit("IC50").alias("std_type"),
        F.col(ord).alias("ord"),
    )


def require_key(df: DataFrame, key: str) -> DataFrame:
    return df.where(V.has_key(F.col(key)))


def mark_duplicates(df: DataFrame, key: str, source: str = "source") -> DataFrame:
    """Add dup_count, is_duplicate, dup_group and cross_source_dup.

    Rows without a key are each their own group. Only keys that occur more
    than once are numbered and joined back; a hot key is one aggregated row
    on that side, and its many rows are split by the adaptive skew join.
    """
    repeated = (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("dup_count"),
            (F.min(source) != F.max(source)).alias("cross_source_dup"),
        )
        .where(F.col("dup_count") > 1)
    )
    numbered = dense_number(repeated, [key], "dup_group")
    joined = df.join(numbered, key, "left")
    return joined.select(
        *df.columns,
        F.coalesce("dup_count", F.lit(1)).alias("dup_count"),
        F.col("dup_count").isNotNull().alias("is_duplicate"),
        "dup_group",
        F.coalesce("cross_source_dup", F.lit(False)).alias("cross_source_dup"),
    )


def merge_sources(parts: Sequence[DataFrame], valid: str | None = None) -> DataFrame:
    """Union, drop rows without structure, add the canonical key and duplicate flags."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    keyed = require_key(merged, "smiles").withColumn(
        "canonical_smiles", V.canonical_key(F.col("smiles"), valid=valid)
    )
    flagged = keyed.withColumn("valid_structure", F.col("canonical_smiles").isNotNull())
    return mark_duplicates(flagged, "canonical_smiles")


def report_order() -> list[Column]:
    """Duplicate groups first, their rows together."""
    return [
        F.col("is_duplicate").desc(),
        F.col("dup_group").asc_nulls_last(),
        F.col("canonical_smiles").asc_nulls_last(),
        F.col("source").asc(),
        F.col("ord").asc(),
    ]


def merge_summary(df: DataFrame, key: str = "canonical_smiles", source: str = "source") -> DataFrame:
    """Row counts of the merged table, one row per source.

    The numbers of duplicate groups and distinct keys come from ``key_counts``.
    """
    return df.groupBy(source).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(key).isNull()).alias("n_invalid"),
        F.count_if("is_duplicate").alias("n_duplicate"),
        F.count_if("cross_source_dup").alias("n_cross_source"),
    )


def key_counts(df: DataFrame, key: str, approximate: bool = False) -> DataFrame:
    """Distinct keys and keys with several rows; per-key counts combine map-side."""
    if approximate:
        return df.agg(F.approx_count_distinct(key).alias("n_keys"))
    per_key = df.where(F.col(key).isNotNull()).groupBy(key).count()
    return per_key.agg(
        F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("count") > 1).alias("n_dup_groups")
    )


def key_sketches(df: DataFrame, key: str, by: Sequence[str], precision: int = 14) -> DataFrame:
    """(by, n_rows, sketch): HyperLogLog sketches of the distinct keys, to be stored and merged; null keys count as rows only."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.hll_sketch_agg(F.col(key), F.lit(precision)).alias("sketch"))


def merged_key_counts(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n_rows, n_keys): about how many distinct keys stored sketches hold together, without their rows."""
    return sketches.groupBy(*by).agg(
        F.sum("n_rows").alias("n_rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_keys")
    )


def select_target(df: DataFrame, column: str, target: str) -> DataFrame:
    """Rows of one target; names the most frequent others when there are none."""
    trimmed = V.strip(F.col(column))
    kept = df.where(trimmed == target)
    if kept.isEmpty():
        others = (
            df.groupBy(trimmed.alias("t")).count().orderBy(F.desc("count"), "t").limit(5).collect()
        )
        found = ", ".join(f"{r['t']} ({r['count']})" for r in others)
        raise ValueError(f"no rows for target {target}; most frequent: {found}")
    return kept


def potency_rows(
    df: DataFrame,
    key: str,
    ord: str,
    pchembl: str | None,
    value: str | None,
    unit: str | None,
    threshold: float = V.POTENT_PIC50,
) -> DataFrame:
    """(key, potency, active) from the reported potency or the value, first row per key."""
    reported = V.to_number(F.col(pchembl)) if pchembl else F.lit(None).cast("double")
    number = V.to_number(F.col(value)) if value else F.lit(None).cast("double")
    pot = V.potency(reported, number, F.col(unit) if unit else None)
    rows = df.where(F.col(key).isNotNull()).select(key, ord, pot.alias("potency"))
    rows = rows.where(F.col("potency").isNotNull())
    first = rows.groupBy(key).agg(F.min_by("potency", ord).alias("potency"))
    return first.withColumn("active", V.label_potency(F.col("potency"), threshold))


def assay_compounds(links: DataFrame, target: str) -> DataFrame:
    """(id, active) of all of a target's assays; an id active anywhere is active.

    ``links`` has target, assay, id, outcome.
    """
    active = F.max(F.when(F.col("outcome") == "active", 1).otherwise(0))
    return links.where(F.col("target") == target).groupBy("id").agg(active.alias("active"))


def attach_structures(ids: DataFrame, structures: DataFrame, id: str = "id") -> DataFrame:
    """Look the structure of each id up; ids without one are dropped."""
    return ids.join(structures, id)
