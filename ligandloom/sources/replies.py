"""Stored replies of compound services: JSON text to tables.

A reply table has one row per request, with the body as text and any columns that tell the requests apart.
Nothing is dropped silently: a body that gives no answer is a row of ``rejected`` with its reason.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

# ---- fixed values (names in replies) ----
STRUCTURE_NAMES = ("SMILES", "ConnectivitySMILES", "CanonicalSMILES", "IsomericSMILES")
NUMERIC_NAMES = (
    "MolecularWeight", "XLogP", "HBondDonorCount", "HBondAcceptorCount", "RotatableBondCount", "Charge",
)
ACTIVE, INACTIVE = "active", "inactive"

_ID_SCHEMA = "InformationList struct<Information:array<struct<AID:bigint,CID:array<bigint>>>>, _broken string"
_PROPERTY_SCHEMA = "PropertyTable struct<Properties:array<map<string,string>>>, _broken string"
EMPTY, BROKEN, NO_ANSWER = "empty", "broken", "no answer"


def _parsed(replies: DataFrame, body: str, schema: str, answer: str) -> DataFrame:
    """``replies`` without the body, with the answer as ``_answer`` and the reason why there is none as ``reason``."""
    json = F.from_json(F.col(body), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rest = [c for c in replies.columns if c != body]
    found = replies.withColumn("_json", json)
    reason = (
        F.when(F.coalesce(F.trim(body), F.lit("")) == "", EMPTY)
        .when(F.col("_json").isNull() | F.col("_json._broken").isNotNull(), BROKEN)
        .when(F.col(f"_json.{answer}").isNull(), NO_ANSWER)
    )
    return found.select(*rest, F.when(reason.isNull(), F.col(f"_json.{answer}")).alias("_answer"), reason.alias("reason"))


def rejected(replies: DataFrame, body: str, kind: str) -> DataFrame:
    """Requests whose reply gives nothing, with the reason: empty, broken JSON, or no answer of this ``kind`` (ids, properties)."""
    schema, answer = {
        "ids": (_ID_SCHEMA, "InformationList.Information"),
        "properties": (_PROPERTY_SCHEMA, "PropertyTable.Properties"),
    }[kind]
    return _parsed(replies, body, schema, answer).where("reason is not null").drop("_answer")


def outcome_rows(replies: DataFrame, body: str, outcome: str = "outcome") -> DataFrame:
    """(assay, id, outcome) of replies with the ids of an assay; repeated ids of a reply are one row."""
    lists = _parsed(replies, body, _ID_SCHEMA, "InformationList.Information").select(outcome, F.explode("_answer").alias("i"))
    ids = lists.select(F.col("i.AID").alias("assay"), F.explode("i.CID").alias("id"), outcome)
    return ids.where("id is not null").distinct()


def outcome_labels(rows: DataFrame, outcome: str = "outcome") -> DataFrame:
    """(id, label) of all ids: 1 where any assay calls it active, else 0 where one calls it inactive."""
    called = rows.where(F.col(outcome).isin(ACTIVE, INACTIVE))
    return called.groupBy("id").agg(F.max((F.col(outcome) == ACTIVE).cast("int")).alias("label"))


def property_rows(
    replies: DataFrame, body: str, names: Sequence[str] = STRUCTURE_NAMES, numbers: Sequence[str] = NUMERIC_NAMES
) -> DataFrame:
    """(id, structure, *numbers) of replies with properties; the structure is the first spelling of its name that has a value.

    Numbers may be JSON numbers or texts; other texts are missing values.
    """
    rows = _parsed(replies, body, _PROPERTY_SCHEMA, "PropertyTable.Properties").select(F.explode("_answer").alias("_p"))
    structure = F.coalesce(*[F.nullif(F.trim(F.col("_p")[n]), F.lit("")) for n in names])
    picked = rows.select(
        F.expr("try_cast(_p['CID'] AS bigint)").alias("id"), structure.alias("structure"),
        *[F.expr(f"try_cast(_p['{n}'] AS double)").alias(n) for n in numbers],
    )
    return picked.where("id is not null")


def unknown_names(
    replies: DataFrame, body: str, names: Sequence[str] = STRUCTURE_NAMES, numbers: Sequence[str] = NUMERIC_NAMES
) -> DataFrame:
    """(name, n): properties of the replies that nothing reads, such as a new spelling."""
    rows = _parsed(replies, body, _PROPERTY_SCHEMA, "PropertyTable.Properties").select(F.explode("_answer").alias("_p"))
    found = rows.select(F.explode(F.map_keys("_p")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return found.where(~F.col("name").isin("CID", *names, *numbers))
