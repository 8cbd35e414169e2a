"""The chains users run: curation, training sets, screening, re-ranking.

Each function takes and returns DataFrames and only counts where the flow
depends on a number.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Model, PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ligandloom.functions import fingerprints as FP
from ligandloom.functions import values as V
from ligandloom.operators import assemble, checks, curation, dedup, evaluate, learn, matching, ranking, ranks
from ligandloom.operators import similarity as S
from ligandloom.plans.config import Config
from ligandloom.session import settle
from ligandloom.sources import readers

KEY = "canonical_smiles"


def curate_measurements(parts: Sequence[DataFrame], valid: str | None = None) -> dict[str, DataFrame]:
    """Harmonised sources -> merged table, its duplicates and the three deduplicated tables."""
    merged = settle(curation.merge_sources(parts, valid))
    first = ("compound_id", "smiles")
    return {
        "all_data": merged,
        "duplicates_only": merged.where("is_duplicate"),
        "same_dedup_keepdiff": dedup.distinct_values(
            merged, KEY, "ic50_nM", "ord", (*first, "relation", "pChEMBL")
        ).withColumnRenamed("n_values", "n_ic50_values"),
        "median_per_compound": dedup.median_per_key(merged, KEY, "ic50_nM", "ord", first=first),
        "robust_dedup": dedup.robust_dedup(merged, KEY, "ic50_nM", "ord", first=first),
    }


def label_compounds(distinct: DataFrame, active_max: float = V.ACTIVE_MAX_NM) -> DataFrame:
    """(key, label, n_rows, contradictory): one label per compound."""
    label = V.label_binary(F.col("ic50_nM"), F.col("relation"), active_max)
    return dedup.label_per_key(distinct.withColumn("label", label), KEY, "label")


# fixed values: what the headers of an activity download contain, foremost first
ACTIVITY_HEADERS = {
    "structure": ("smiles",), "potency": ("pchembl",), "value": ("standard value", "standard_value"),
    "unit": ("standard units", "standard_units"), "target": ("target chembl",),
}


def read_activity_file(
    spark: SparkSession, path: str, target: str | None = None, threshold: float = V.POTENT_PIC50, sep: str | None = None
) -> DataFrame:
    """(key, potency, active) of a downloaded activity table, whatever its separator and exact headers.

    Rows of other targets go where the file names the target; the first row
    with a potency counts for its structure.
    """
    rows = readers.read_delimited(spark, path, sep, order="ord")
    header = [c for c in rows.columns if c != "ord"]
    named = {role: readers.find_column(header, *parts) for role, parts in ACTIVITY_HEADERS.items()}
    if named["structure"] is None:
        raise ValueError(f"no structure column in header {header}")
    picked = rows.select("ord", *[F.col(f"`{c}`").alias(role) for role, c in named.items() if c])
    if target and named["target"]:
        picked = curation.select_target(picked, "target", target)
    have = {role: role if named[role] else None for role in named}
    found = curation.potency_rows(
        picked, "structure", "ord", have["potency"], have["value"], have["unit"], threshold
    )
    return found.withColumnRenamed("structure", KEY)


def train_descriptors(
    rows: DataFrame, columns: Sequence[str], cfg: Config, vector: str = ""
) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """(model, out-of-fold metrics, importance) of a model over numeric columns, and over bits too with ``vector``.

    The metrics come from folds that fill from their own training rows; the
    model carries the medians of all rows.
    """
    make = lambda: learn.boosted_trees(cfg.trees, cfg.depth, cfg.seed)
    scored = settle(learn.out_of_fold(rows, KEY, make, learn.fold_median_fill(columns, vector), seed=cfg.seed))
    model = learn.fit_filling(rows, columns, make(), vector)
    numeric = learn.fit_filling(rows, columns, make()) if vector else model
    return model, evaluate.metrics_table(scored, "label", "score"), learn.importance(numeric, rows, columns)


def audit_labels(
    tables: Mapping[str, DataFrame], source: DataFrame, key: str, label: str, value: str, relation: str,
    stored_bits: str, again: Column,
) -> DataFrame:
    """One row per check of a labelled set: features recomputed, labels by rule, labels across tables, pairs in the source."""
    first = next(iter(tables.values()))
    return checks.verdict(
        checks.stored_equals_recomputed(first, stored_bits, again),
        checks.labels_follow_rule(first, label, value, relation),
        checks.labels_agree(tables, key, label),
        checks.pairs_present(first, source, key, value),
    )


def with_fingerprint(df: DataFrame, key: str, cfg: Config, out: str = "on_bits") -> DataFrame:
    """Set bits of the key; rows without a key have none and are dropped."""
    toks = FP.tokens(F.col(key), cfg.token_pattern)
    rows = df.where(V.has_key(F.col(key))).withColumn("_toks", toks)
    bits = FP.fingerprint(F.col(key), F.col("_toks"), cfg.kind, cfg.n_bits, radius=cfg.radius)
    return rows.withColumn(out, bits).drop("_toks")


def decoy_training_set(
    compounds: DataFrame, pool: DataFrame, properties: Sequence[str], cfg: Config, per_active: bool
) -> DataFrame:
    """(key, label, source) with as many decoys as it takes to balance the classes.

    ``compounds`` has key, label, ``ord`` and the property columns, ``pool``
    key, ``ord`` and the same properties.
    """
    printed = settle(with_fingerprint(compounds, KEY, cfg))
    actives, inactives = (printed.where(F.col("label") == c) for c in (1, 0))
    need = assemble.n_needed(*assemble.require_classes(printed, "label"))
    width = FP.width(cfg.kind, cfg.n_bits)
    make = matching.per_active_decoys if per_active else matching.window_matched_decoys
    extra = {"neutral": properties[-1]} if per_active else {}
    decoys = make(
        pool, actives, printed, KEY, "ord", properties, need, width, limit=cfg.max_similarity,
        seed=cfg.seed, fingerprint=lambda df: with_fingerprint(df, KEY, cfg), **extra,
    )
    return assemble.with_provenance(actives, inactives, decoys, KEY)


def training_rows(
    sources: Sequence[DataFrame | None], cfg: Config, negatives: DataFrame | None = None
) -> DataFrame:
    """Sources by priority, with decoys when the settings ask for them."""
    used = sources if cfg.use_second_source else sources[:1]
    return assemble.assemble_training(
        used, KEY, "active", "ord", negatives if cfg.add_decoys else None,
        cfg.decoy_multiplier, cfg.seed,
    )


def train(rows: DataFrame, cfg: Config) -> tuple[Model, DataFrame, DataFrame]:
    """(model, report, ranking metrics) of a hold-out evaluation."""
    assemble.require_classes(rows, "active")
    printed = with_fingerprint(rows.withColumnRenamed("active", "label"), KEY, cfg)
    df = settle(
        learn.fingerprint_features(printed, "on_bits", FP.width(cfg.kind, cfg.n_bits)).select(
            KEY, "label", "features"
        )
    )
    model, test = learn.hold_out(df, KEY, lambda: learn.random_forest(cfg.trees, cfg.depth, cfg.seed), cfg.seed)
    if cfg.search_models:
        split = assemble.stratified_split(df, KEY, "label", cfg.test_share, cfg.seed)
        model, _ = learn.search(split.where(~F.col("is_test")).drop("is_test"), KEY, cfg.search_trials, cfg.search_budget_sec, cfg.seed)
        test = learn.scores(model, test.drop("score"))
    test = settle(test)
    report = evaluate.classification_report(test, "label", "score")
    return model, report, evaluate.ranking_metrics(evaluate.score_curve(test, "label", "score"))


def screen_library(model: Model, library: DataFrame, known: DataFrame, cfg: Config) -> dict[str, DataFrame]:
    """Library (name, smiles) -> all hits in rank order, the best new ones, and their similarity.

    ``known`` has the key and ``ord`` of the known actives.
    """
    width = FP.width(cfg.kind, cfg.n_bits)
    keyed = library.withColumn(KEY, V.canonical_key(F.col("smiles")))
    printed = with_fingerprint(keyed, KEY, cfg)
    rows = learn.fingerprint_features(printed, "on_bits", width)
    actives = with_fingerprint(known, KEY, cfg)
    hits = settle(learn.screen(model, rows, "name", KEY, actives, KEY, "ord", width))
    order = ranking.hit_order("name")
    top = ranks.top_rows(hits, order, ranking.TOP_SIMILAR).select("name", KEY)
    pairs = S.similarity_pairs(with_fingerprint(top, KEY, cfg), "name", k=ranking.TOP_SIMILAR)
    return {
        "ranked": hits.orderBy(*order),
        "top_new": ranks.top_rows(hits.where(~F.col("is_known")), order, ranking.TOP_NEW),
        "top_all": ranks.top_rows(hits, order, ranking.TOP_ALL),
        "similarity": pairs,
    }


def curate_ligands(distinct: DataFrame) -> DataFrame:
    """(coarse, key, size, label, ord): largest fragment per structure, best class per identity."""
    frag = V.largest_fragment(F.col(KEY))
    rows = dedup.measured(distinct, KEY, "ic50_nM").select(
        V.coarse_key(frag).alias("coarse"),
        frag.alias("key"),
        F.length(frag).alias("size"),
        V.activity_class(F.col("ic50_nM"), F.col("relation")).alias("label"),
        F.struct(KEY, "ic50_nM").alias("ord"),
    )
    return dedup.best_class_per_key(rows, "coarse", "label", "ord", ("key", "size", "ord"))


def rerank_docking(scores: DataFrame) -> dict[str, DataFrame]:
    """Scores with heavy atom counts -> size-corrected ranking and the promising candidates."""
    le = V.ligand_efficiency(F.col("affinity"), F.col("n_heavy"))
    flagged = ranking.efficiency_flags(scores)
    return {
        "ranked": scores.withColumn("le", le).orderBy(*ranking.rank_by_efficiency()),
        "promising": flagged.where("both").orderBy(*ranking.rank_by_efficiency()),
        "size_inflated": flagged.where("size_inflated"),
    }
