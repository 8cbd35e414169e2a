"""Queries that write the given tables as files in the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ligandloom.catalog.registry import query
from ligandloom.catalog.views import docs_raw, lib, table, vec
from ligandloom.functions import values as V
from ligandloom.operators import assemble
from ligandloom.plans import chains
from ligandloom.session import scratch_path
from ligandloom.sources import readers, writers


@query("s1_read_delimited", "", """
SELECT p_partkey::VARCHAR AS p_partkey, CASE WHEN p_size = 10 THEN NULL ELSE concat(p_name, ' "', p_brand, '", x') END AS name,
 CASE WHEN p_size = 20 THEN NULL ELSE p_type END AS p_type FROM part WHERE p_size <> 30""")
def s1(spark, sf):
    """Quotes, missing texts, short rows (size 20) and rows with a field too many (size 30)."""
    q = F.replace(F.concat("p_name", F.lit(' "'), "p_brand", F.lit('", x')), F.lit('"'), F.lit('""'))
    name = F.when(F.col("p_size") == 10, F.lit("NA")).otherwise(F.concat(F.lit('"'), q, F.lit('"')))
    line = F.concat_ws(
        ",",
        F.col("p_partkey").cast("string"),
        name,
        F.when(F.col("p_size") != 20, F.col("p_type")),
        F.when(F.col("p_size") == 30, F.lit("too,many")),
    )
    path = scratch_path(spark, "delimited")
    lines = table(spark, sf, "part").select(line.alias("value"))
    header = spark.createDataFrame([("p_partkey,name,p_type",)], "value string")
    # every file of the folder starts with the header
    with_header = lines.mapInPandas(_with_header(header.first()[0]), "value string")
    with_header.write.text(path)
    return readers.read_delimited(spark, path, ",", ["p_partkey", "name", "p_type"])


def _with_header(header: str):
    def add(frames):
        import pandas as pd

        yield pd.DataFrame({"value": [header]})
        yield from frames

    return add


@query("s2_sniff_delimiter", "", "SELECT p_partkey::VARCHAR AS p_partkey, p_name FROM part")
def s2(spark, sf):
    path = scratch_path(spark, "sniffed")
    writers.write_csv(table(spark, sf, "part").select("p_partkey", "p_name", "p_type"), path, ";")
    return readers.read_delimited(spark, path, None, ["p_partkey", "p_name"])


@query("s4_load_library", "lib", """
SELECT concat('PART:', ord, ' ', name) AS name, smiles, 'PART' AS source FROM lib""")
def s4(spark, sf):
    """Columns found by their headings."""
    path = scratch_path(spark, "library") + ".tsv"
    rows = lib(spark, sf).select(
        F.concat_ws(" ", "ord", "name").alias("Pref_Name"), F.col("smiles").alias("Canonical_SMILES"), "source"
    )
    writers.write_csv(rows, path, "\t")
    return readers.load_library(spark, path, "PART")


@query("s3b_activity_file", "", """
WITH a AS (SELECT concat('P', p_partkey) AS k, CASE WHEN p_size % 3 = 0 THEN p_retailprice / 300 END AS reported,
 CASE WHEN p_size % 5 <> 0 THEN p_retailprice * 10 END AS nm FROM part WHERE p_size % 2 = 0)
SELECT k AS canonical_smiles, round_even(coalesce(reported, -log10(nm * 1e-9)) * 1e6, 0) / 1e6 AS potency,
 (coalesce(reported, -log10(nm * 1e-9)) >= 6)::INT AS active FROM a WHERE coalesce(reported, nm) IS NOT NULL""")
def s3b(spark, sf):
    """Separator and headers are found; other targets, other units and repeated rows go."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    part = table(spark, sf, "part").select(
        F.concat(F.lit("P"), "p_partkey").alias("Smiles"),
        F.when(size % 3 == 0, price / 300).alias("pChEMBL Value"),
        (price * 10).alias("Standard Value"),
        F.when(size % 5 != 0, "nM").otherwise("ug.mL-1").alias("Standard Units"),
        F.when(size % 2 == 0, " T1 ").otherwise("T2").alias("Target ChEMBL ID"),
    )
    path = scratch_path(spark, "activities") + ".csv"
    writers.write_csv(part.unionByName(part.where("`Standard Units` = 'nM'")), path, ";")
    rows = chains.read_activity_file(spark, path, "T1", 6.0)
    return rows.select(chains.KEY, V.half_even(F.col("potency"), 6).alias("potency"), "active")


@query("s5_build_library", "lib", """
SELECT concat('A:', ord) AS name, smiles, 'A' AS source FROM lib UNION ALL SELECT concat('B:', ord), smiles, 'B' FROM lib WHERE source = 'Brand#2'""")
def s5(spark, sf):
    rows = lib(spark, sf).select(F.col("ord").alias("id"), "smiles", "source")
    a, b = scratch_path(spark, "lib-a") + ".csv", scratch_path(spark, "lib-b") + ".tsv"
    writers.write_csv(rows.drop("source"), a)
    writers.write_csv(rows.where("source = 'Brand#2'").drop("source"), b, "\t")
    return readers.build_library(spark, {"A": a, "B": b, "C": a + ".missing"})


@query("s6_read_token_files", "docs_raw", r"""
SELECT token, count(*) AS n FROM (SELECT regexp_extract(unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))), '^\s*(\S+)', 1) AS token FROM docs_raw)
WHERE token <> '' AND token <> 'ligand' AND lower(token) NOT IN ('smiles', 'canonical_smiles', 'smi') GROUP BY token""")
def s6(spark, sf):
    path = scratch_path(spark, "tokens")
    docs_raw(spark, sf).select("source", F.col("text").alias("value")).write.partitionBy("source").text(path)
    return readers.read_token_files(spark, path).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("s7_read_fixed_width", "", """
SELECT residue, chain, class, count(*) AS n FROM (SELECT CASE WHEN p_size % 7 = 0 THEN 'HOH' WHEN p_size % 5 = 0 THEN 'NAD' WHEN p_size % 3 = 0 THEN 'YXW' ELSE 'ALA' END AS residue,
 CASE WHEN p_size > 25 THEN 'A' ELSE 'B' END AS chain, CASE WHEN p_size % 7 = 0 THEN 'drop' WHEN p_size % 5 = 0 THEN 'cofactor' WHEN p_size % 3 = 0 THEN 'other'
 ELSE 'protein' END AS class FROM part) GROUP BY ALL""")
def s7(spark, sf):
    size = F.col("p_size")
    residue = F.when(size % 7 == 0, "HOH").when(size % 5 == 0, "NAD").when(size % 3 == 0, "YXW").otherwise("ALA")
    line = F.concat(
        F.rpad(F.lit("HETATM"), 6, " "), F.lpad(F.col("p_partkey").cast("string"), 5, " "), F.lit("  C   "), residue,
        F.lit(" "), F.when(size > 25, "A").otherwise("B"), F.lpad(size.cast("string"), 4, " "),
    )
    path = scratch_path(spark, "records")
    atoms = table(spark, sf, "part").select(line.alias("value"))
    atoms.union(atoms.select(F.lit("REMARK not an atom").alias("value"))).write.text(path)
    return readers.read_fixed_width(spark, path).groupBy("residue", "chain", "class").agg(F.count(F.lit(1)).alias("n"))


@query("s8_write_tables", "", "SELECT 'part' AS sheet, p_partkey AS id FROM part UNION ALL SELECT 'labels', doc_id FROM labels")
def s8(spark, sf):
    folder = scratch_path(spark, "tables")
    sheets = {
        "part": table(spark, sf, "part").select(F.col("p_partkey").alias("id")),
        "labels": table(spark, sf, "labels").select(F.col("doc_id").alias("id")),
    }
    writers.write_tables(sheets, folder)
    writers.write_tables(sheets, folder)  # replaced, not doubled
    parts = [spark.read.parquet(f"{folder}/{n}").select(F.lit(n).alias("sheet"), "id") for n in sheets]
    return parts[0].unionByName(parts[1])


@query("s9_write_csv", "", "SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_retailprice::VARCHAR AS price FROM part")
def s9(spark, sf):
    path = scratch_path(spark, "csv")
    writers.write_csv(table(spark, sf, "part").select("p_partkey", "p_name", F.col("p_retailprice").cast("string").alias("price")), path)
    return spark.read.option("header", True).csv(path)


@query("s10_write_batches", "vec", """
WITH n AS (SELECT vec_id, row_number() OVER (ORDER BY md5(concat('42|', vec_id)), vec_id) AS r FROM vec WHERE active = 1)
SELECT ((r - 1) // 45 + 1)::INT AS batch, concat(vec_id, ' ', printf('b%02d_act_%02d', (r - 1) // 45 + 1, (r - 1) % 45 + 1)) AS value FROM n""")
def s10(spark, sf):
    path = scratch_path(spark, "batches")
    writers.write_batches(assemble.cohort(vec(spark, sf), active=1).select("vec_id"), "vec_id", path)
    return spark.read.text(path).select("batch", "value")


@query("s11_materialize_once", "", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def s11(spark, sf):
    path = scratch_path(spark, "once")
    part = table(spark, sf, "part")
    writers.materialize_once(spark, path, lambda: part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")))

    def never():
        raise AssertionError("computed twice")

    return writers.materialize_once(spark, path, never)
