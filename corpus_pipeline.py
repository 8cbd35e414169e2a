"""The corpus pipeline: documents pass its stages one after the other.

Every stage is a function of (spark, docs, sf_dir); its rows are written as Parquet
in the shared folder and read again as the next one's documents. All but
the last return the columns of documents, whatever these are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ligandloom.llm import decontaminate, pieces, secret_scan, simhash, toxicity
from ligandloom.llm.common import read
from ligandloom.llm.queries import LLM, LlmQuery
from ligandloom.session import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold stay."""
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the document with the least id stays."""
    return simhash.one_per_group(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays."""
    return secret_scan.mask_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the text decoded again from its pieces, and the piece ids."""
    return pieces.encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("sentencepiece", encode_pieces),
]

#: The learned lexicon, the components and the Viterbi search have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {**LLM, "pipeline": LlmQuery(run, ORACLE_SQL)}
