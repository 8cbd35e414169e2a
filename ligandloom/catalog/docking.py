"""Queries over hits and docking scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ligandloom.catalog.registry import query, r
from ligandloom.catalog.views import dock, hits, table
from ligandloom.functions import values as V
from ligandloom.operators import ranking, ranks


@query("p19_select_candidates", "hits", "SELECT id, active_prob FROM hits WHERE active_prob >= 0.7 AND NOT is_known")
def p19(spark, sf):
    return ranking.select_candidates(hits(spark, sf)).select("id", "active_prob")


@query("p20_manifest", "hits", f"""
SELECT id, {r("active_prob", 4)} AS active_prob, {r("max_sim_known", 4)} AS max_sim_known, {r("mw", 1)} AS mw,
 {r("logp", 2)} AS logp, n_rotatable, coalesce(n_rotatable > 10, false) AS flexible_warn, status
FROM hits WHERE active_prob >= 0.7 AND NOT is_known""")
def p20(spark, sf):
    return ranking.manifest(ranking.select_candidates(hits(spark, sf)))


@query("a14_screen_summary", "hits", """
SELECT count(*) FILTER (active_prob >= 0.9) AS n_strong, count(*) FILTER (active_prob >= 0.9 AND NOT is_known) AS n_strong_new,
 count(*) FILTER (is_known) AS n_known FROM hits""")
def a14_screen(spark, sf):
    strong = F.col("active_prob") >= 0.9
    return hits(spark, sf).agg(
        F.count_if(strong).alias("n_strong"),
        F.count_if(strong & ~F.col("is_known")).alias("n_strong_new"),
        F.count_if("is_known").alias("n_known"),
    )


@query("t2_top_hits", "hits", "SELECT id, active_prob FROM hits WHERE NOT is_known ORDER BY active_prob DESC, id LIMIT 300")
def t2(spark, sf):
    new = hits(spark, sf).where(~F.col("is_known"))
    return ranks.top_rows(new, ranking.hit_order(), ranking.TOP_NEW).select("id", "active_prob")


@query("j3_known_flag", "", """
SELECT doc_id AS id, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS is_known FROM documents""")
def j3(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    known = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return ranking.known_flag(d, known, "id")


@query("j2_lookup_join", "dock", """
SELECT dock.id, dock.affinity, part.p_size AS size FROM dock LEFT JOIN part
 ON concat('M', part.p_partkey) = dock.id AND part.p_size > 10""")
def j2(spark, sf):
    sizes = table(spark, sf, "part").where("p_size > 10")
    sizes = sizes.select(F.concat(F.lit("M"), "p_partkey").alias("id"), F.col("p_size").alias("size"))
    return dock(spark, sf).select("id", "affinity").join(sizes, "id", "left")


_DONE = "p_type IN ('ECONOMY', 'PROMO')"


@query("j5_resume", "dock", f"""
SELECT id, affinity, true AS reused FROM dock WHERE {_DONE} AND affinity IS NOT NULL
UNION ALL SELECT id, coalesce(affinity, 0), false FROM dock WHERE NOT ({_DONE} AND affinity IS NOT NULL)""")
def j5(spark, sf):
    """Finished rows are reused; the rest is 'computed' (here: missing becomes 0)."""
    d = dock(spark, sf)
    todo, done = ranking.resume(d.drop("affinity"), d.where(_DONE), "id", "affinity")
    fresh = todo.join(d.select("id", "affinity"), "id").withColumn("affinity", F.coalesce("affinity", F.lit(0.0)))
    return done.select("id", "affinity", F.lit(True).alias("reused")).unionByName(
        fresh.select("id", "affinity", F.lit(False).alias("reused"))
    )


_THR = """t AS (SELECT max(affinity) FILTER (type = 'control') AS affinity_max,
 min(-affinity / n_heavy) FILTER (type = 'control') AS le_min FROM dock)"""


@query("a22_control_thresholds", "dock", f"WITH {_THR} SELECT * FROM t")
def a22(spark, sf):
    return ranking.control_thresholds(dock(spark, sf))


@query("p26_efficiency_flags", "dock", f"""
WITH {_THR}, c AS (SELECT id, affinity, n_heavy, -affinity / n_heavy AS le, affinity_max, le_min FROM dock, t WHERE type = 'candidate'),
f AS (SELECT *, coalesce(affinity <= affinity_max, false) AS beats_affinity, coalesce(le >= le_min, false) AS beats_le FROM c)
SELECT id, affinity, n_heavy, le, beats_affinity, beats_le, beats_affinity AND beats_le AS both,
 beats_affinity AND NOT beats_le AS size_inflated FROM f""")
def p26(spark, sf):
    return ranking.efficiency_flags(dock(spark, sf)).drop("type", "p_type")


@query("t3_rank_by_affinity", "dock", "SELECT id, affinity, row_number() OVER (ORDER BY affinity ASC NULLS LAST, id) AS position FROM dock")
def t3(spark, sf):
    return ranks.dense_number(dock(spark, sf).select("id", "affinity"), ranking.rank_by_affinity(), "position")


@query("t3_rank_by_efficiency", "dock", """
SELECT id, -affinity / n_heavy AS le, row_number() OVER (ORDER BY -affinity / n_heavy DESC NULLS LAST, id) AS position FROM dock""")
def t3_le(spark, sf):
    le = V.ligand_efficiency(F.col("affinity"), F.col("n_heavy"))
    return ranks.dense_number(dock(spark, sf).select("id", le.alias("le")), ranking.rank_by_efficiency(), "position")
