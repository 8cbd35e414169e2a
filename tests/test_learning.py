import numpy as np
import pytest
from pyspark.sql import functions as F

from ligandloom.catalog.views import PROPERTIES, VEC_BITS, vec
from ligandloom.operators import assemble, checks, evaluate, features, learn, matching, ranks
from ligandloom.plans import chains
from ligandloom.plans.config import Config

NUM = PROPERTIES[:5]
SMALL = Config(trees=10, depth=4, n_bits=128)


@pytest.fixture(scope="module")
def rows(spark, sf):
    v = learn.fingerprint_features(vec(spark, sf), "on_bits", VEC_BITS)
    return v.withColumn("label", F.col("active")).select("vec_id", "label", "on_bits", "features", *NUM).cache()


def test_out_of_fold_scores_each_key_once(rows):
    out = learn.out_of_fold(rows, "vec_id", lambda: learn.random_forest(5, 3)).collect()
    assert len(out) == rows.count() and len({r["vec_id"] for r in out}) == len(out)
    assert all(0 <= r["score"] <= 1 for r in out)
    share = {f: np.mean([r["label"] for r in out if r["fold"] == f]) for f in range(5)}
    assert max(share.values()) - min(share.values()) < 0.02


def test_fold_fill_uses_training_rows_only(spark):
    train = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 100.0)], "label int, x double")
    new = spark.createDataFrame([(1, None), (1, 7.0)], "label int, x double")
    filled = learn.fold_median_fill(["x"])(new, train).orderBy("x").collect()
    assert [r["features"][0] for r in filled] == [3.0, 7.0]


def test_model_refuses_other_features(rows, tmp_path):
    model = learn.fit(rows, learn.random_forest(5, 3))
    path = str(tmp_path / "m")
    learn.save_model(model, path, "circular", VEC_BITS, *assemble.class_sizes(rows, "label"))
    with pytest.raises(ValueError, match="trained on circular"):
        learn.load_model(path, "keys")
    again, about = learn.load_model(path, "circular")
    assert about["n_bits"] == VEC_BITS
    a = {r["vec_id"]: r["score"] for r in learn.scores(model, rows).collect()}
    b = {r["vec_id"]: r["score"] for r in learn.scores(again, rows).collect()}
    assert a == b


def test_auc_on_rows_the_model_saw(rows):
    scored = learn.scores(learn.fit(rows, learn.random_forest(50, 8)), rows)
    m = evaluate.metrics_table(scored, "label", "score").first()
    assert m["roc_auc"] > 0.9 and m["average_precision"] > 0.8


def test_metrics_edge_cases(spark):
    one = spark.createDataFrame([(0, 0.1), (0, 0.2)], "y int, p double")
    m = evaluate.metrics_table(one, "y", "p").first()
    assert m["recall"] == 0 and m["precision"] == 0 and m["mcc"] == 0 and m["roc_auc"] is None
    tie = spark.createDataFrame([(0, 0.5), (1, 0.5)], "y int, p double")
    assert evaluate.metrics_table(tie, "y", "p").first()["roc_auc"] == 0.5
    s = evaluate.subset_specificity(tie.withColumn("s", F.lit("decoy")), "y", "p", "s", "real").first()
    assert s["specificity"] is None


def test_guards(spark):
    df = spark.createDataFrame([(1,), (1,)], "label int")
    with pytest.raises(ValueError, match="one class"):
        assemble.require_classes(df, "label")
    with pytest.raises(ValueError, match="no labelled rows"):
        assemble.require_classes(df.where("label = 0"), "label")
    with pytest.raises(ValueError, match="missing columns: x"):
        assemble.require_columns(df, ["label", "x"])
    with pytest.raises(ValueError, match="no source"):
        assemble.assemble_training([None], "k", "label", "ord")
    with pytest.raises(ValueError, match="features not found: z"):
        features.select_by_header(df, ["z"], "label")


def test_short_supply_warns_and_takes_all(spark):
    a, i, d = spark.range(4), spark.range(10, 11), spark.range(20, 25)
    with pytest.warns(UserWarning, match="1:5 needs 19 decoys, 5 available"):
        out = assemble.ratio_sets(a, i, d, "id", (1, 5))
    got = {(r["ratio"], r["source"]): r["n"] for r in out.groupBy("ratio", "source").agg(F.count("*").alias("n")).collect()}
    assert got[(1, "decoy")] == 3 and got[(5, "decoy")] == 5 and got[(5, "real_inactive")] == 1


def test_verdict_fails_on_one_bad_check(spark):
    ok = spark.createDataFrame([(5, 0)], "n_rows long, n_mismatch long")
    same = spark.createDataFrame([(5, 5)], "n_rows long, n_consistent long")
    gone = spark.createDataFrame([(5, 4)], "n_rows long, n_present long")
    got = {r["check"]: r["passed"] for r in checks.verdict(ok, ok, same, gone).collect()}
    assert got == {"features": True, "labels": True, "tables": True, "source": False, "all": False}


def test_search_reports_the_best(rows):
    model, table = learn.search(rows, "vec_id", budget_sec=0.0)
    assert table.where("roc_auc IS NOT NULL").count() == 1 and table.count() == 7
    assert learn.scores(model, rows).count() == rows.count()
    assert learn.search(rows, "vec_id", trials=1)[1].count() == 1


def test_a_saved_model_fills_holes(spark, tmp_path):
    df = spark.createDataFrame(
        [(i, int(i % 4 == 0), float(i % 4), None if i % 3 else float(i % 9)) for i in range(80)],
        "vec_id int, label int, a double, b double",
    )
    model = learn.fit_filling(df, ["a", "b"], learn.boosted_trees(2, 2))
    learn.save_model(model, str(tmp_path / "m"), "descriptor", 16, 20, 60)
    again, about = learn.load_model(str(tmp_path / "m"), "descriptor", 16)
    assert about["n_active"] == 20
    new = spark.createDataFrame([(1, 0.0, None), (2, None, 5.0)], "vec_id int, a double, b double")
    got = learn.scores(again.copy(), new)
    assert got.where("score > 0.5").count() == 1 and got.count() == 2
    with pytest.raises(ValueError, match="16 bits"):
        learn.load_model(str(tmp_path / "m"), "descriptor", 32)


def test_effect_size_counts_holes_as_the_median(spark):
    rows = [(1, 1.0), (1, None), (0, 4.0), (0, 5.0), (0, 5.0)]
    got = features.effect_size(spark.createDataFrame(rows, "y int, x double"), ["x"], "y").first()
    assert round(got["std_effect"], 2) == -1.15


def test_labels_agree_tells_minus_nine_from_missing(spark):
    a = spark.createDataFrame([(1, -9), (2, None)], "id int, l int")
    b = spark.createDataFrame([(1, None), (2, None)], "id int, l int")
    assert tuple(checks.labels_agree({"a": a, "b": b}, "id", "l").first()) == (2, 1)


def test_a_null_key_may_be_hot(spark):
    rows = [(None, float(i)) for i in range(50)] + [("k", float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = ranks.group_with_percentiles(df, ["k"], [F.count(F.lit(1)).alias("n")], {"m": ("v", 0.5)}, slices=2)
    assert {tuple(r) for r in got.collect()} == {(None, 50, 24.5), ("k", 5, 2.0)}


def test_other_labels_are_refused(spark):
    df = spark.createDataFrame([(0,), (1,), (2,)], "label int")
    with pytest.raises(ValueError, match="other than"):
        learn.require_classes(df, "label")


SMI = ["C" * (i % 9 + 1) + "O" * (i % 4) + "N" * (i % 3) + ("c1ccccc1" if i % 2 else "=S") for i in range(160)]


def measured(spark):
    rows = [
        (SMI[i], f"id{i}", "A" if i % 3 else "B", float(10 ** (i % 7)), "=" if i % 5 else ">", i)
        for i in range(len(SMI))
    ]
    df = spark.createDataFrame(rows, "smiles string, compound_id string, source string, ic50_nM double, relation string, ord int")
    return df.withColumn("pChEMBL", F.lit(None).cast("double")).withColumn("std_type", F.lit("IC50"))


def test_curation_chain(spark):
    tables = chains.curate_measurements([measured(spark)])
    assert tables["all_data"].count() == 160
    n_keys = len({s for s in SMI})
    assert tables["robust_dedup"].count() == tables["median_per_compound"].count() == n_keys
    assert tables["duplicates_only"].where("not is_duplicate").count() == 0
    comp = chains.label_compounds(tables["same_dedup_keepdiff"])
    assert comp.count() == n_keys
    lig = chains.curate_ligands(tables["same_dedup_keepdiff"])
    assert set(r["label"] for r in lig.collect()) <= {"active", "inactive"}


def test_train_and_screen_chain(spark):
    rows = measured(spark).select(
        F.col("smiles").alias("canonical_smiles"), (F.col("ic50_nM") <= 1000).cast("int").alias("active"), "ord"
    )
    train = chains.training_rows([rows], SMALL)
    model, report, ranking = chains.train(train, SMALL)
    assert report.count() == 5 and ranking.count() == 1
    lib = spark.createDataFrame([(f"n{i}", s) for i, s in enumerate(SMI[:40])] + [("bad", "  ")], "name string, smiles string")
    known = train.where("active = 1").select("canonical_smiles", "ord")
    out = chains.screen_library(model, lib, known, SMALL)
    hits = out["ranked"].collect()
    assert len(hits) == 40 and [h["active_prob"] for h in hits] == sorted((h["active_prob"] for h in hits), reverse=True)
    assert all(h["max_sim_known"] == 1.0 for h in hits if h["is_known"])
    assert out["similarity"].count() == 400 and out["similarity"].where("a = b and sim <> 1").count() == 0
    assert out["top_new"].where("is_known").count() == 0
    empty = chains.screen_library(model, lib.where("name = 'bad'"), known, SMALL)
    assert empty["ranked"].count() == 0 and "active_prob" in empty["ranked"].columns


@pytest.mark.parametrize("per_active", [True, False])
def test_decoy_chain(spark, sf, per_active):
    v = vec(spark, sf).withColumn("ord", F.col("vec_id"))
    text = F.concat_ws("", F.transform("on_bits", lambda b: F.concat(F.chr(b % 26 + 65), F.lit("="))))
    v = v.withColumn("canonical_smiles", text)
    comp = v.where("label < 4").withColumn("label", (F.col("label") < 3).cast("int"))
    cfg = Config(n_bits=256, max_similarity=0.6)
    out = chains.decoy_training_set(comp, v.where("label >= 4"), PROPERTIES, cfg, per_active)
    n = {(r["label"], r["source"]): r["n"] for r in out.groupBy("label", "source").agg(F.count("*").alias("n")).collect()}
    assert n[(1, "real")] == comp.where("label = 1").count()
    assert 0 < n.get((0, "decoy"), 0) <= n[(1, "real")] - n[(0, "real")]
    assert out.count() == out.select("canonical_smiles").distinct().count()


def test_rerank_chain(spark):
    rows = [("c1", "control", -8.0, 20), ("c2", "control", -7.0, 14), ("m1", "candidate", -9.0, 20), ("m2", "candidate", -9.0, 60), ("m3", "candidate", None, 10)]
    out = chains.rerank_docking(spark.createDataFrame(rows, "id string, type string, affinity double, n_heavy int"))
    assert [r["id"] for r in out["promising"].collect()] == ["m1"]
    assert [r["id"] for r in out["size_inflated"].collect()] == ["m2"]
    assert out["ranked"].collect()[-1]["id"] == "m3"


def test_screening_runs_on_a_stream(spark, sf, tmp_path):
    """The library side is stateless, so a stream frame works unchanged."""
    from ligandloom.operators.similarity import nearest

    v = vec(spark, sf).select("vec_id", "on_bits", "active")
    path = str(tmp_path / "in")
    v.where("active = 0").write.parquet(path)
    stream = spark.readStream.schema("vec_id long, on_bits array<int>, active int").parquet(path)
    near = nearest(stream, v.where("active = 1"), "vec_id", "vec_id", n_bits=VEC_BITS)
    q = near.writeStream.format("memory").queryName("near").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("near").count() == v.where("active = 0").count()


def test_matching_constants():
    assert matching.TOLERANCE == (25.0, 1.0, 1.0, 2.0, 2.0, 0.0) and matching.MAX_SIMILARITY == 0.35


def test_descriptor_chain_and_audit(spark, rows):
    df = rows.withColumn("canonical_smiles", F.col("vec_id").cast("string")).withColumn(
        "label", (F.col("p1") > 0).cast("int")
    )
    cfg = Config(trees=3, depth=2)
    model, metrics, gains = chains.train_descriptors(df.drop("features"), NUM, cfg)
    assert gains.first()["feature"] == "p1" and metrics.first()["roc_auc"] > 0.99
    assert learn.scores(model, df.drop("features")).where("score > 0.5").count() == df.where("label = 1").count()
    _, combined, _ = chains.train_descriptors(df.withColumnRenamed("features", "fp"), NUM, cfg, "fp")
    assert combined.count() == 1
    made = spark.createDataFrame([("a", 50.0, "=", 1, 7), ("b", 90000.0, "=", 0, 8)], "k string, v double, r string, y int, b int")
    good = chains.audit_labels({"x": made, "y": made}, made, "k", "y", "v", "r", "b", F.col("b"))
    assert all(r["passed"] for r in good.collect())
    bad = chains.audit_labels({"x": made, "y": made.withColumn("y", F.lit(1))}, made, "k", "y", "v", "r", "b", F.lit(7))
    assert {r["check"] for r in bad.collect() if not r["passed"]} == {"features", "tables", "all"}
