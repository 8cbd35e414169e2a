"""Queries over stored replies, sources that may fail, sketches and word histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ligandloom.catalog.registry import query, r
from ligandloom.catalog.views import docs, meas, table
from ligandloom.functions import descriptors as D, values as V
from ligandloom.operators import assemble, curation
from ligandloom.session import stored
from ligandloom.sources import replies as R


def _id_replies(spark, sf):
    """One reply per supplier and return flag with its parts; some are cut off, empty, missing or a fault."""
    lines = table(spark, sf, "lineitem").where("l_returnflag <> 'N'")
    each = lines.groupBy(F.col("l_suppkey").alias("AID"), "l_returnflag").agg(F.collect_set("l_partkey").alias("CID"))
    info = F.array(F.struct("AID", "CID"))
    body = F.to_json(F.struct(F.struct(info.alias("Information")).alias("InformationList")))
    spoiled = (
        F.when(F.col("AID") % 7 == 0, F.expr("substr(body, 1, length(body) - 2)")).when(F.col("AID") % 11 == 0, None)
        .when(F.col("AID") % 13 == 0, " ").when(F.col("AID") % 17 == 0, '{"Fault": {"Code": "Busy"}}').otherwise(F.col("body"))
    )
    outcome = F.when(F.col("l_returnflag") == "R", R.ACTIVE).otherwise(R.INACTIVE).alias("outcome")
    return each.withColumn("body", body).select(F.col("AID").alias("request"), outcome, spoiled.alias("body"))


_GOOD = "l_suppkey % 7 <> 0 AND l_suppkey % 11 <> 0 AND l_suppkey % 13 <> 0 AND l_suppkey % 17 <> 0"
_OUTCOME = "CASE l_returnflag WHEN 'R' THEN 'active' ELSE 'inactive' END"


@query("s4_outcome_replies", "", f"""
SELECT DISTINCT l_suppkey AS assay, l_partkey AS id, {_OUTCOME} AS outcome FROM lineitem WHERE l_returnflag <> 'N' AND {_GOOD}""")
def outcome_replies(spark, sf):
    return R.outcome_rows(_id_replies(spark, sf), "body")


@query("s4_outcome_labels", "", f"""
SELECT l_partkey AS id, max((l_returnflag = 'R')::INT) AS label FROM lineitem WHERE l_returnflag <> 'N' AND {_GOOD} GROUP BY l_partkey""")
def outcome_labels(spark, sf):
    """An id that any assay calls active is active."""
    return R.outcome_labels(R.outcome_rows(_id_replies(spark, sf), "body"))


@query("s4_rejected_replies", "", f"""
SELECT request, outcome, CASE WHEN request % 7 = 0 THEN 'broken' WHEN request % 11 = 0 OR request % 13 = 0 THEN 'empty' ELSE 'no answer' END AS reason
FROM (SELECT DISTINCT l_suppkey AS request, {_OUTCOME} AS outcome FROM lineitem WHERE l_returnflag <> 'N' AND NOT ({_GOOD}))""")
def rejected_replies(spark, sf):
    return R.rejected(_id_replies(spark, sf), "body", "ids")


def _property_replies(spark, sf):
    """Ten parts a reply; the structure under several names, weights as text, a name that nobody knows."""
    part = table(spark, sf, "part")
    key, name = F.col("p_partkey"), F.col("p_name")
    fields = F.map_filter(
        F.create_map(
            F.lit("CID"), key.cast("string"),
            F.lit("SMILES"), F.when(key % 3 == 0, name), F.lit("CanonicalSMILES"), F.when(key % 3 < 2, F.concat(name, F.lit("!"))),
            F.lit("IsomericSMILES"), F.when(key % 3 == 2, F.lit(" ")),
            F.lit("MolecularWeight"), F.when(key % 5 == 0, "n/a").otherwise(F.col("p_retailprice").cast("string")),
            F.lit("Charge"), (F.col("p_size") % 5 - 2).cast("string"), F.lit("Sm1les"), F.when(key % 4 == 0, "?"),
        ),
        lambda k, v: v.isNotNull(),
    )
    packed = part.groupBy(F.floor(key / 10).alias("request")).agg(F.collect_list(fields).alias("Properties"))
    body = F.to_json(F.struct(F.struct("Properties").alias("PropertyTable")))
    return packed.select("request", F.when(F.col("request") % 9 == 4, F.concat(body, F.lit("}]"))).otherwise(body).alias("body"))


_STRUCTURE = "CASE p_partkey % 3 WHEN 0 THEN trim(p_name) WHEN 1 THEN concat(trim(p_name), '!') END"


@query("s4_property_replies", "", f"""
SELECT p_partkey AS id, {_STRUCTURE} AS structure, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice::DOUBLE END AS weight,
 (p_size % 5 - 2)::DOUBLE AS charge, NULL::DOUBLE AS logp FROM part""")
def property_replies(spark, sf):
    rows = R.property_rows(_property_replies(spark, sf).where("request % 9 <> 4 OR body is null").unionByName(_mended(spark, sf)), "body")
    return rows.select(
        "id", "structure", F.col("MolecularWeight").alias("weight"), F.col("Charge").alias("charge"), F.col("XLogP").alias("logp")
    )


def _mended(spark, sf):
    """The spoiled replies, asked for again."""
    again = _property_replies(spark, sf).where("request % 9 = 4")
    return again.withColumn("body", F.expr("substr(body, 1, length(body) - 2)"))


@query("s4_unknown_names", "", "SELECT 'Sm1les' AS name, count(*) AS n FROM part WHERE p_partkey % 4 = 0 HAVING count(*) > 0")
def unknown_names(spark, sf):
    good = _property_replies(spark, sf).where("request % 9 <> 4").unionByName(_mended(spark, sf))
    return R.unknown_names(good, "body")


@query("u5_sources_that_fail", "docs", """
WITH a AS (SELECT key, quality AS label, docs.id AS ord FROM labels JOIN docs ON docs.id = doc_id),
b AS (SELECT key, toxic AS label, docs.id AS ord FROM labels JOIN docs ON docs.id = doc_id WHERE key IS NOT NULL),
m AS (SELECT key, min_by(label, ord) AS label FROM a WHERE key IS NOT NULL GROUP BY key)
SELECT source, n FROM (SELECT 'missing folder: not loaded' AS source, 0::BIGINT AS n UNION ALL SELECT 'no label: not loaded', 0
 UNION ALL SELECT 'breaks while read: not loaded', 0 UNION ALL SELECT 'quality: loaded', (SELECT count(*) FROM a)
 UNION ALL SELECT 'assembled', (SELECT count(*) FROM m) UNION ALL SELECT 'assembled of label 1', (SELECT count(*) FROM m WHERE label = 1))""")
def sources_that_fail(spark, sf):
    """Four loaders, of which one works; the training rows come from it and the others are reported."""
    d = docs(spark, sf)
    rows = table(spark, sf, "labels").join(d, F.col("doc_id") == F.col("id")).select(
        "key", F.col("quality").alias("label"), F.col("id").alias("ord")
    )
    loaders = {
        "missing folder": lambda: spark.read.parquet(f"{sf}/not_there.parquet"),
        "no label": lambda: rows.drop("label"),
        "breaks while read": lambda: rows.withColumn("label", F.raise_error(F.lit("broken row")).cast("int")),
        "quality": lambda: rows,
    }
    tables, report = assemble.load_available(spark, loaders, ["key", "label", "ord"])
    made = assemble.assemble_training(tables, "key", "label", "ord")
    said = F.concat("source", F.when(F.col("loaded"), ": loaded").otherwise(": not loaded"))
    count = F.count(F.lit(1)).alias("n")
    return (
        report.select(said.alias("source"), F.coalesce("n_rows", F.lit(0)).alias("n"))
        .unionByName(made.agg(count).select(F.lit("assembled").alias("source"), "n"))
        .unionByName(made.where("label = 1").agg(count).select(F.lit("assembled of label 1").alias("source"), "n"))
    )


@query("a13_merged_sketches", "meas", """
SELECT coalesce(source, 'all') AS source, count(*) AS n_rows, count(DISTINCT key) AS exact, TRUE AS within_3_percent FROM meas
GROUP BY GROUPING SETS ((source), ())""")
def merged_sketches(spark, sf):
    """Sketches of the keys by source and unit, stored, then merged by source and for all, next to the exact counts."""
    m = meas(spark, sf)
    sketches = stored(curation.key_sketches(m, "key", ["source", "unit"]), "sketches")
    about = curation.merged_key_counts(sketches, ["source"]).unionByName(
        curation.merged_key_counts(sketches).withColumn("source", F.lit("all"))
    )
    exact = m.groupBy("source").agg(F.countDistinct("key").alias("exact")).unionByName(
        m.agg(F.countDistinct("key").alias("exact")).withColumn("source", F.lit("all"))
    )
    close = F.abs(F.col("n_keys") - F.col("exact")) <= 0.03 * F.col("exact")
    return about.join(exact, "source").select("source", "n_rows", "exact", close.alias("within_3_percent"))


_WORDS = r"regexp_extract_all(key, '\S+')"
_COUNTS = {
    c: f"len(list_filter(w, lambda x: {cond}))"
    for c, cond in {
        "number": "regexp_matches(x, '^[0-9]+$')",
        "lower": "regexp_matches(x, '^[a-z]+$')",
        "upper": "regexp_matches(x, '^[A-Z]+$')",
        "capital": "regexp_matches(x, '^[A-Z][a-z]+$')",
        "mixed": "regexp_matches(x, '^[A-Za-z0-9]+$') AND NOT regexp_matches(x, '^([0-9]+|[a-z]+|[A-Z]+|[A-Z][a-z]+)$')",
        "other": "NOT regexp_matches(x, '^[A-Za-z0-9]+$')",
    }.items()
}


@query("p31_word_histogram", "docs", f"""
WITH w AS (SELECT id, {_WORDS} AS w FROM docs WHERE key IS NOT NULL),
c AS (SELECT id, nullif(len(w), 0)::DOUBLE AS total, {", ".join(f"{e}::DOUBLE AS {c}" for c, e in _COUNTS.items())} FROM w)
SELECT id, {", ".join(f"{r(f'{c} / total', 9)} AS {c}_words" for c in _COUNTS)},
 {r(" + ".join(f"CASE WHEN {c} > 0 THEN -({c} / total) * ln({c} / total) WHEN total > 0 THEN 0 END" for c in _COUNTS), 9)} AS word_entropy,
 {r(f"greatest({', '.join(f'{c} / total' for c in _COUNTS)})", 9)} AS top_share FROM c""")
def word_histogram(spark, sf):
    d = docs(spark, sf).where("key is not null").withColumn("words", F.regexp_extract_all("key", F.lit(r"\S+"), F.lit(0)))
    counted = d.select("id", D.class_histogram(F.col("words")).alias("histogram"))
    return counted.select("id", *[V.half_even(c, 9).alias(n) for n, c in D.histogram_descriptors("histogram").items()])
