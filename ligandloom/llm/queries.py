"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from ligandloom.llm import (
    adaptive_rules, decontaminate, html_text, line_crf, phrases, pieces, runs, secret_scan, sharding, simhash, suffix_lm,
    token_counts, toxicity,
)
from ligandloom.llm.common import read


class LlmQuery(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


LLM: dict[str, LlmQuery] = {}


def register(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        LLM[name] = LlmQuery(fn, sql)
        return fn

    return add


@register("op10_simhash_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@register("op8_benchmark_leaks")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@register("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@register("op4_secret_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(read(spark, sf_dir, "documents"))


@register("op9_sentencepiece")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoding_digest(read(spark, sf_dir, "documents"))


@register("op3_adaptive_rules", adaptive_rules.SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_rules.judge(read(spark, sf_dir, "documents"))


@register("op6_sharding")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(read(spark, sf_dir, "documents"))


@register("op1_html_text")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(read(spark, sf_dir, "pages"))


@register("op5_suffix_lm")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_lm.score_documents(read(spark, sf_dir, "documents"))


@register("op2_line_crf")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@register("op11_phrases", phrases.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


@register("op12_token_counts")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


@register("op13_word_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digest(runs.find_runs(runs.with_planted_periods(read(spark, sf_dir, "documents"))))
