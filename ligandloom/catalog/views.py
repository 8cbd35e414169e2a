"""The given tables seen as this engine's inputs, for Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ligandloom.functions import fingerprints as FP, values as V
from ligandloom.session import spread

PROPERTIES = ("p1", "p2", "p3", "p4", "p5", "charge")
DOC_BITS = 1024
VEC_BITS = 64
DOC_RADIUS = FP.RADIUS


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_REL = "CASE l_returnflag WHEN 'A' THEN '>' WHEN 'R' THEN '<' ELSE '=' END"


def meas(spark: SparkSession, sf: str, heavy: bool = False) -> DataFrame:
    """Measurements, from lineitem; ``heavy`` spreads a table of few splits."""
    rows = table(spark, sf, "lineitem")
    return (spread(rows) if heavy else rows).selectExpr(
        "concat(l_orderkey,'-',l_linenumber,'-',l_partkey,'-',l_suppkey,'-',l_extendedprice) AS ord",
        "concat('P',l_partkey,'-S',l_suppkey % 10) AS key",
        "concat('L',l_suppkey) AS id",
        "CASE l_linestatus WHEN 'O' THEN 'A' ELSE 'B' END AS source",
        f"{_REL} AS relation",
        "CASE cast(l_quantity AS int) % 3 WHEN 0 THEN 'uM' ELSE 'nM' END AS unit",
        "l_extendedprice * l_extendedprice / 10000D AS v",
        f"""CASE l_linenumber WHEN 1 THEN concat('  ', {_REL}, ' ', l_extendedprice)
             WHEN 2 THEN cast(l_extendedprice AS string)
             WHEN 3 THEN concat(l_extendedprice, '-', l_extendedprice)
             WHEN 4 THEN 'n.d.' WHEN 5 THEN NULL
             ELSE concat({_REL}, l_extendedprice, ' nM') END AS raw""",
        """CASE l_linenumber WHEN 1 THEN '1d' WHEN 2 THEN concat(' ', l_extendedprice)
             WHEN 3 THEN 'abc' WHEN 4 THEN NULL ELSE cast(l_extendedprice AS string) END AS text""",
        """CASE l_linenumber WHEN 1 THEN 'uM' WHEN 2 THEN ' nM ' WHEN 3 THEN 'M'
             WHEN 4 THEN 'mM' WHEN 5 THEN NULL ELSE 'nM' END AS any_unit""",
        "CASE WHEN l_linenumber = 1 THEN 4D + l_quantity / 10D END AS pchembl",
        "CASE WHEN l_discount > 0.07D THEN 'Ki' WHEN l_discount < 0.02D THEN 'ic50' ELSE 'IC50' END AS type",
        "concat('T', l_linenumber) AS target",
        "CASE WHEN l_returnflag = 'N' THEN NULL ELSE concat('L', l_suppkey) END AS registry",
        "concat('N', l_partkey) AS name",
        f"CASE WHEN l_linenumber = 1 THEN NULL ELSE concat('''', {_REL}, '''') END AS quoted",
    )


_MEAS_SQL = f"""SELECT concat(l_orderkey,'-',l_linenumber,'-',l_partkey,'-',l_suppkey,'-',l_extendedprice) AS ord,
  concat('P',l_partkey,'-S',l_suppkey % 10) AS key, concat('L',l_suppkey) AS id,
  CASE l_linestatus WHEN 'O' THEN 'A' ELSE 'B' END AS source, {_REL} AS relation,
  CASE cast(l_quantity AS int) % 3 WHEN 0 THEN 'uM' ELSE 'nM' END AS unit,
  l_extendedprice * l_extendedprice / 10000::DOUBLE AS v,
  CASE l_linenumber WHEN 1 THEN concat('  ', {_REL}, ' ', l_extendedprice)
    WHEN 2 THEN cast(l_extendedprice AS VARCHAR)
    WHEN 3 THEN concat(l_extendedprice, '-', l_extendedprice)
    WHEN 4 THEN 'n.d.' WHEN 5 THEN NULL
    ELSE concat({_REL}, l_extendedprice, ' nM') END AS raw,
  CASE l_linenumber WHEN 1 THEN '1d' WHEN 2 THEN concat(' ', l_extendedprice)
    WHEN 3 THEN 'abc' WHEN 4 THEN NULL ELSE cast(l_extendedprice AS VARCHAR) END AS text,
  CASE l_linenumber WHEN 1 THEN 'uM' WHEN 2 THEN ' nM ' WHEN 3 THEN 'M'
    WHEN 4 THEN 'mM' WHEN 5 THEN NULL ELSE 'nM' END AS any_unit,
  CASE WHEN l_linenumber = 1 THEN 4::DOUBLE + l_quantity / 10::DOUBLE END AS pchembl,
  CASE WHEN l_discount > 0.07::DOUBLE THEN 'Ki' WHEN l_discount < 0.02::DOUBLE THEN 'ic50' ELSE 'IC50' END AS type,
  concat('T', l_linenumber) AS target,
  CASE WHEN l_returnflag = 'N' THEN NULL ELSE concat('L', l_suppkey) END AS registry,
  concat('N', l_partkey) AS name,
  CASE WHEN l_linenumber = 1 THEN NULL ELSE concat('''', {_REL}, '''') END AS quoted
FROM lineitem"""


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """Structures with copies, from documents; one language plays the invalid ones."""
    return spread(table(spark, sf, "documents")).select(
        F.col("doc_id").alias("id"),
        "source",
        "lang",
        V.canonical_key(F.col("text")).alias("key"),
    )


_KEY_SQL = r"trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'))"


def docs_raw(spark: SparkSession, sf: str) -> DataFrame:
    """All documents three times: as they are, padded, and with other punctuation."""
    d = spread(table(spark, sf, "documents")).select("doc_id", "source", "text")
    n = F.col("doc_id") * 3
    return (
        d.select(n.alias("id"), "source", "text")
        .union(d.select(n + 1, "source", F.concat(F.lit("  "), "text", F.lit(" "))))
        .union(d.select(n + 2, F.lit("srcX"), F.replace("text", F.lit("."), F.lit("!"))))
    )


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed-width records, from the lines of documents."""
    return (
        table(spark, sf, "documents")
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "value"))
        .withColumn("line_no", F.col("line_no").cast("bigint"))
    )


def vec(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints, properties and labels, from embeddings."""
    return table(spark, sf, "embeddings").selectExpr(
        "vec_id",
        "label",
        "cast(label < 3 AS int) AS active",
        "array_compact(transform(embedding, (x, i) -> CASE WHEN x > 0 THEN i END)) AS on_bits",
        "cast(embedding[0] AS double) * 200D AS p1",
        "cast(embedding[1] AS double) * 4D AS p2",
        "cast(embedding[2] AS double) * 8D AS p3",
        "cast(embedding[3] AS double) * 8D AS p4",
        "cast(embedding[4] AS double) * 8D AS p5",
        "cast(vec_id % 3 - 1 AS double) AS charge",
    )


def lab(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled compounds, from labels."""
    return table(spark, sf, "labels").selectExpr(
        "doc_id AS id",
        "quality AS y",
        "CASE WHEN toxic = 1 THEN 'decoy' ELSE 'real' END AS source",
    )


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions with ties, from labels."""
    return table(spark, sf, "labels").selectExpr(
        "doc_id AS id",
        "quality AS y",
        "toxic",
        "CASE WHEN toxic = 1 THEN 'decoy' ELSE 'real' END AS source",
        """cast(conv(substr(md5(cast(doc_id AS string)), 1, 4), 16, 10) AS bigint) % 71 / 100D
           + 0.29D * quality AS p""",
    )


def dock(spark: SparkSession, sf: str) -> DataFrame:
    """Docking scores, from part; one size has no score."""
    return table(spark, sf, "part").selectExpr(
        "concat('M', p_partkey) AS id",
        "CASE WHEN p_brand = 'Brand#1' THEN 'control' ELSE 'candidate' END AS type",
        "CASE WHEN p_size = 17 THEN NULL ELSE -(p_retailprice / 100D) END AS affinity",
        "p_size + 10 AS n_heavy",
        "p_type",
    )


def lib(spark: SparkSession, sf: str) -> DataFrame:
    """Screening library with repeated names, from part."""
    return table(spark, sf, "part").selectExpr(
        "p_name AS name", "concat('C', p_brand, p_type) AS smiles", "p_partkey AS ord", "p_brand AS source"
    )


def hits(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked hits with properties: scored rows joined to their document."""
    s = scored(spark, sf)
    d = table(spark, sf, "documents").selectExpr("doc_id AS id", "n_chars", "length(lang) AS lang_len")
    return s.join(d, "id").selectExpr(
        "id",
        "p AS active_prob",
        "n_chars % 1000 / 997D AS max_sim_known",
        "toxic = 1 AS is_known",
        "n_chars / 7D AS mw",
        "n_chars / 1013D AS logp",
        "cast(n_chars % 23 AS int) AS n_rotatable",
        "CASE WHEN n_chars > 1000 THEN 'MMFF' ELSE 'UFF' END AS status",
    )


WIDE = ("quantity", "price", "tax", "ratio", "gap", "flag")
WIDE_NUMERIC = ("quantity", "price", "tax", "ratio", "gap")


def wide(spark: SparkSession, sf: str) -> DataFrame:
    """Wide features with infinite, missing and text cells, from lineitem."""
    return table(spark, sf, "lineitem").selectExpr(
        "concat(l_orderkey,'-',l_linenumber,'-',l_partkey,'-',l_suppkey,'-',l_extendedprice) AS ord",
        "concat('P',l_partkey,'-S',l_suppkey % 10) AS key",
        "l_quantity AS quantity",
        "l_extendedprice AS price",
        "l_tax AS tax",
        "CASE WHEN l_discount = 0 THEN double('inf') ELSE 1D / l_discount END AS ratio",
        "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity * l_tax END AS gap",
        "l_returnflag AS flag",
        "cast(l_returnflag = 'R' AS int) AS potency",
    )


VIEW_USES = {
    "vbits": ("vec",),
    "vsim": ("vec", "vbits"),
    "vnear": ("vsim",),
    "hits": ("scored",),
    "doctok": ("docs",),
    "dbits": ("doctok",),
}

_HEX = "('0x' || substr(md5({}), 1, {}))::BIGINT"

VIEW_SQL = {
    "meas": _MEAS_SQL,
    "docs": f"SELECT doc_id AS id, source, lang, nullif({_KEY_SQL}, '') AS key FROM documents",
    "docs_raw": """SELECT doc_id * 3 AS id, source, text FROM documents
UNION ALL SELECT doc_id * 3 + 1, source, concat('  ', text, ' ') FROM documents
UNION ALL SELECT doc_id * 3 + 2, 'srcX', replace(text, '.', '!') FROM documents""",
    "lines": """SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line_no,
 unnest(string_split(text, chr(10))) AS value FROM documents""",
    "vec": """SELECT vec_id, label, cast(label < 3 AS int) AS active, embedding,
 embedding[1]::DOUBLE * 200 AS p1, embedding[2]::DOUBLE * 4 AS p2, embedding[3]::DOUBLE * 8 AS p3,
 embedding[4]::DOUBLE * 8 AS p4, embedding[5]::DOUBLE * 8 AS p5, (vec_id % 3 - 1)::DOUBLE AS charge
FROM embeddings""",
    "vbits": """SELECT vec_id, active, b FROM (SELECT vec_id, active, unnest(range(0, len(embedding))) AS b,
 unnest(embedding) AS x FROM vec) WHERE x > 0""",
    "vsim": """SELECT p.vec_id, a.vec_id AS aid,
 count(*)::DOUBLE / (any_value(pn.n) + any_value(an.n) - count(*)) AS sim
FROM vbits p JOIN vbits a ON p.b = a.b AND a.active = 1 AND p.active = 0
JOIN (SELECT vec_id, count(*) AS n FROM vbits GROUP BY vec_id) pn ON pn.vec_id = p.vec_id
JOIN (SELECT vec_id, count(*) AS n FROM vbits GROUP BY vec_id) an ON an.vec_id = a.vec_id
GROUP BY p.vec_id, a.vec_id""",
    "vnear": """SELECT vec_id, sim AS max_sim, aid FROM (SELECT *, row_number() OVER
 (PARTITION BY vec_id ORDER BY sim DESC, aid) AS rn FROM vsim) WHERE rn = 1""",
    "lab": """SELECT doc_id AS id, quality AS y, CASE WHEN toxic = 1 THEN 'decoy' ELSE 'real' END AS source
FROM labels""",
    "scored": f"""SELECT doc_id AS id, quality AS y, toxic,
 CASE WHEN toxic = 1 THEN 'decoy' ELSE 'real' END AS source,
 {_HEX.format("doc_id::VARCHAR", 4)} % 71 / 100::DOUBLE + 0.29::DOUBLE * quality AS p FROM labels""",
    "dock": """SELECT concat('M', p_partkey) AS id,
 CASE WHEN p_brand = 'Brand#1' THEN 'control' ELSE 'candidate' END AS type,
 CASE WHEN p_size = 17 THEN NULL ELSE -(p_retailprice / 100::DOUBLE) END AS affinity,
 p_size + 10 AS n_heavy, p_type FROM part""",
    "lib": """SELECT p_name AS name, concat('C', p_brand, p_type) AS smiles, p_partkey AS ord,
 p_brand AS source FROM part""",
    "hits": """SELECT s.id, s.p AS active_prob, n_chars % 1000 / 997::DOUBLE AS max_sim_known,
 s.toxic = 1 AS is_known, n_chars / 7::DOUBLE AS mw, n_chars / 1013::DOUBLE AS logp,
 cast(n_chars % 23 AS int) AS n_rotatable, CASE WHEN n_chars > 1000 THEN 'MMFF' ELSE 'UFF' END AS status
FROM scored s JOIN documents d ON d.doc_id = s.id""",
    "wide": """SELECT concat(l_orderkey,'-',l_linenumber,'-',l_partkey,'-',l_suppkey,'-',l_extendedprice) AS ord,
 concat('P',l_partkey,'-S',l_suppkey % 10) AS key, l_quantity AS quantity, l_extendedprice AS price,
 l_tax AS tax, CASE WHEN l_discount = 0 THEN 'inf'::DOUBLE ELSE 1::DOUBLE / l_discount END AS ratio,
 CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity * l_tax END AS gap, l_returnflag AS flag,
 cast(l_returnflag = 'R' AS int) AS potency FROM lineitem""",
    "doctok": r"SELECT id, key, source, regexp_extract_all(key, '[\p{L}\p{N}]+') AS t FROM docs",
    "dbits": f"""SELECT DISTINCT id, {_HEX.format("g", 7)} % {DOC_BITS} AS b FROM (
 SELECT id, concat(r, '|', array_to_string(list_slice(t, greatest(i - r, 1), least(i + r, len(t))), ' ')) AS g
 FROM (SELECT id, t, unnest(range(1, len(t) + 1)) AS i FROM doctok) CROSS JOIN range(0, {DOC_RADIUS + 1}) x(r))""",
}
