"""The stages on the given tables and on awkward rows, and the driver's entry."""

import sys

import corpus_pipeline as pipeline
from check_oracle import compare, connect

import __spark_entry__
from ligandloom.llm import decontaminate, toxicity
from ligandloom.llm.queries import LLM


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in pipeline.STAGES:
        after = stage(spark, docs, sf)
        sizes.append(after.count())
        if name != "sentencepiece":
            assert after.columns == docs.columns
            assert after.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
            docs = after.cache()
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4] == sizes[5] > 0.6 * sizes[0]
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontaminate.leaks(docs, bench).count() == 0
    got = pipeline.run(spark, sf)
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in docs.collect()}


def test_rejected_documents_are_the_toxic_ones(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    flagged = {r.doc_id for r in toxicity.score_documents(docs, labels).where("predicted = 1").collect()}
    kept = {r.doc_id for r in pipeline.drop_toxic(spark, docs, sf).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - flagged


def test_empty_documents_pass_all_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_every_operator_has_a_query():
    names = {n.split("_")[0] for n in LLM}
    assert names == {f"op{k}" for k in range(1, 14)}
    assert set(LLM) | {"pipeline"} <= set(__spark_entry__.queries())


def test_rules_equal_sql(spark, sf):
    assert compare(LLM["op3_adaptive_rules"].run(spark, sf), connect(sf), LLM["op3_adaptive_rules"].sql) == ""


def test_library_does_not_import_llm():
    import subprocess

    code = "import sys, ligandloom.catalog, ligandloom.plans.chains; sys.exit(any('llm' in m for m in sys.modules if m.startswith('ligandloom')))"
    assert subprocess.run([sys.executable, "-c", code]).returncode == 0
