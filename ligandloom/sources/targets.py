"""Protein targets by short name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---- fixed values ----
TARGETS = {
    "HSD17B13": ("CHEMBL5305042", 345275, "17-beta-hydroxysteroid dehydrogenase 13"),
    "THRB": ("CHEMBL1947", None, "Thyroid hormone receptor beta"),
    "FASN": ("CHEMBL4158", None, "Fatty acid synthase"),
    "ACACA": ("CHEMBL3616", None, "Acetyl-CoA carboxylase 1"),
    "SCD1": ("CHEMBL5555", None, "Stearoyl-CoA desaturase"),
    "DGAT2": ("CHEMBL5504", None, "Diacylglycerol O-acyltransferase 2"),
    "KHK": ("CHEMBL4979", None, "Ketohexokinase"),
    "PPARA": ("CHEMBL239", None, "PPAR-alpha"),
}


def targets(spark: SparkSession) -> DataFrame:
    rows = [(t, *v) for t, v in TARGETS.items()]
    return spark.createDataFrame(rows, "target string, target_id string, gene_id long, name string")
