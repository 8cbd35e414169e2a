"""Queries over structures with copies: keys, duplicates, fingerprints, funnel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ligandloom.catalog.registry import query, r
from ligandloom.catalog.views import DOC_BITS, DOC_RADIUS, docs, docs_raw, lab, lines, table
from ligandloom.functions import descriptors as D
from ligandloom.functions import fingerprints as FP
from ligandloom.functions import values as V
from ligandloom.operators import assemble, curation, dedup, matching, ranking
from ligandloom.sources import readers

_COARSE = r"md5(regexp_replace(lower(key), '[^\p{L}\p{N}]', '', 'g'))"
VALID = r"\p{L}{3}"
SIM_LIMIT = 0.35


@query("p7_require_key", "", "SELECT doc_id AS id FROM documents WHERE text IS NOT NULL AND length(text) > 0")
def p7(spark, sf):
    return curation.require_key(table(spark, sf, "documents"), "text").select(F.col("doc_id").alias("id"))


@query("p8_canonical_key", "docs", rf"""
SELECT id, md5(key) AS key_md5, key IS NOT NULL AS valid_structure FROM
 (SELECT id, CASE WHEN regexp_matches(lower(key), '{VALID}') THEN lower(key) END AS key FROM docs)""")
def p8(spark, sf):
    key = V.canonical_key(F.col("text"), lower=True, valid=VALID)
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), key.alias("key"))
    return d.select("id", F.md5("key").alias("key_md5"), F.col("key").isNotNull().alias("valid_structure"))


@query("p9_clean_key", "docs", f"""
WITH f AS (SELECT id, unnest(string_split(key, '.')) AS frag, unnest(range(0, len(string_split(key, '.')))) AS i FROM docs),
b AS (SELECT id, arg_min(frag, (-length(frag), i)) AS key FROM f GROUP BY id)
SELECT id, md5(key) AS fragment_md5, {_COARSE} AS coarse, len(string_split(key, ' '))::INT AS size FROM b""")
def p9(spark, sf):
    d = docs(spark, sf).select("id", V.largest_fragment(F.col("key")).alias("frag"))
    return d.select(
        "id",
        F.md5("frag").alias("fragment_md5"),
        V.coarse_key(F.col("frag")).alias("coarse"),
        F.size(F.split("frag", " ")).alias("size"),
    )


# every fourth source plays the structures that could not be parsed
_INVALID = "source IN ('src0', 'src4', 'src8', 'src12', 'src16')"
_KEYED = f"SELECT id, source, CASE WHEN {_INVALID} THEN NULL ELSE key END AS key FROM docs"
_DUPS = f"""
WITH k AS ({_KEYED}), s AS (SELECT key, count(*) AS n, min(source) <> max(source) AS x FROM k WHERE key IS NOT NULL GROUP BY key),
g AS (SELECT key, row_number() OVER (ORDER BY key) AS dup_group FROM s WHERE n > 1)"""


def _keyed(spark, sf):
    bad = F.col("source").isin("src0", "src4", "src8", "src12", "src16")
    return docs(spark, sf).withColumn("key", F.when(~bad, F.col("key")))


@query("w1_dup_count", "docs", f"""{_DUPS}
SELECT k.id, coalesce(s.n, 1) AS dup_count, coalesce(s.n, 1) > 1 AS is_duplicate, g.dup_group,
 coalesce(s.n > 1 AND s.x, false) AS cross_source_dup FROM k LEFT JOIN s USING (key) LEFT JOIN g USING (key)""")
def w1(spark, sf):
    """Also W2 (dup_group) and W3 (cross_source_dup)."""
    return curation.mark_duplicates(_keyed(spark, sf), "key").select(
        "id", "dup_count", "is_duplicate", "dup_group", "cross_source_dup"
    )


@query("w2_dup_group", "docs", f"{_DUPS} SELECT md5(key) AS key_md5, dup_group FROM g")
def w2(spark, sf):
    marked = curation.mark_duplicates(_keyed(spark, sf), "key").where("is_duplicate")
    return marked.groupBy(F.md5("key").alias("key_md5")).agg(F.min("dup_group").alias("dup_group"))


@query("w3_cross_source_dup", "docs", f"""{_DUPS}
SELECT k.id FROM k JOIN s USING (key) WHERE s.n > 1 AND s.x""")
def w3(spark, sf):
    return curation.mark_duplicates(_keyed(spark, sf), "key").where("cross_source_dup").select("id")


@query("a13_distinct_counts", "docs", """
SELECT count(*) AS n_keys, count(*) FILTER (n > 1) AS n_dup_groups FROM
 (SELECT key, count(*) AS n FROM docs WHERE key IS NOT NULL GROUP BY key)""")
def a13(spark, sf):
    return curation.key_counts(docs(spark, sf), "key")


@query("a14_run_summary", "docs", f"""{_DUPS}
SELECT source, count(*) AS n_rows, count(*) FILTER (key IS NULL) AS n_invalid, count(*) FILTER (n > 1) AS n_duplicate,
 count(*) FILTER (n > 1 AND x) AS n_cross_source FROM k LEFT JOIN s USING (key) GROUP BY source""")
def a14(spark, sf):
    return curation.merge_summary(curation.mark_duplicates(_keyed(spark, sf), "key"), "key")


@query("a28_keep_first", "docs", "SELECT md5(key) AS key_md5, min(id) AS id, min_by(source, id) AS source FROM docs GROUP BY key")
def a28(spark, sf):
    d = docs(spark, sf).select("key", "id", F.col("id").alias("ord"), "source")
    return dedup.keep_first(d, ["key"], "ord").select(F.md5("key").alias("key_md5"), "id", "source")


@query("j4_anti_join", "docs", f"""
SELECT id FROM docs WHERE key NOT IN (SELECT key FROM docs WHERE {_INVALID} AND key IS NOT NULL)""")
def j4(spark, sf):
    d = docs(spark, sf)
    known = d.where(F.col("source").isin("src0", "src4", "src8", "src12", "src16"))
    return matching.exclude_keys(d, known, "key").select("id")


@query("j12_attach_structures", "docs lab", """
SELECT lab.id, y AS label, md5(key) AS key_md5 FROM lab JOIN docs ON docs.id = lab.id""")
def j12(spark, sf):
    ids = lab(spark, sf).select("id", F.col("y").alias("label"))
    found = curation.attach_structures(ids, docs(spark, sf).select("id", "key"))
    return found.select("id", "label", F.md5("key").alias("key_md5"))


@query("u2_union_earlier_wins", "docs", """
WITH t AS (SELECT key, id, 1 AS label, 0 AS prio FROM docs WHERE lang = 'fr'
 UNION ALL SELECT key, id, 0, 1 FROM docs WHERE lang <> 'fr')
SELECT md5(key) AS key_md5, arg_min(id, (prio, id)) AS id, arg_min(label, (prio, id)) AS label FROM t GROUP BY key""")
def u2(spark, sf):
    d = docs(spark, sf)
    parts = [
        d.where("lang = 'fr'").select("key", F.col("id").alias("ord"), "id", F.lit(1).alias("label")),
        d.where("lang <> 'fr'").select("key", F.col("id").alias("ord"), "id", F.lit(0).alias("label")),
    ]
    return assemble.union_earlier_wins(parts, "key", "ord").select(F.md5("key").alias("key_md5"), "id", "label")


@query("u5_assemble_training", "docs", """
WITH l AS (SELECT docs.key, docs.id AS ord, quality AS y FROM labels JOIN docs ON docs.id = labels.doc_id),
b AS (SELECT key, min(ord) AS ord, min_by(y, ord) AS y FROM l GROUP BY key),
c AS (SELECT greatest(0, count(*) FILTER (y = 1) - count(*) FILTER (y = 0)) AS need FROM b),
n AS (SELECT key, min(id) AS ord FROM docs WHERE key NOT IN (SELECT key FROM b) GROUP BY key),
k AS (SELECT *, row_number() OVER (ORDER BY md5(concat('42|', key)), key) AS rn FROM n)
SELECT md5(key) AS key_md5, y AS label FROM b UNION ALL SELECT md5(key), 0 FROM k, c WHERE rn <= need""")
def u5(spark, sf):
    d = docs(spark, sf).select("key", F.col("id").alias("ord"))
    known = lab(spark, sf).join(d, F.col("id") == F.col("ord")).select("key", F.col("y").alias("label"), "ord")
    out = assemble.assemble_training([known, None], "key", "label", "ord", negatives=d)
    return out.select(F.md5("key").alias("key_md5"), "label")


@query("w10_sample_n", "docs", """
SELECT id FROM docs ORDER BY md5(concat('42|', id)), id LIMIT 300""")
def w10(spark, sf):
    return assemble.sample_n(docs(spark, sf).select("id"), "id", 300)


@query("w10_shuffle", "docs", "SELECT id, row_number() OVER (ORDER BY md5(concat('42|', id)), id) AS position FROM docs")
def w10_shuffle(spark, sf):
    return assemble.shuffled(docs(spark, sf).select("id"), "id")


# ---- fingerprints and descriptors ----

_HASH = "('0x' || substr(md5(g), 1, 7))::BIGINT"


def _bits_sql(grams: str) -> str:
    return f"""
WITH g AS ({grams}), b AS (SELECT DISTINCT id, {_HASH} % {DOC_BITS} AS b FROM g)
SELECT docs.id, count(b)::INT AS n_on, coalesce(string_agg(b::VARCHAR, ',' ORDER BY b), '') AS bits
FROM docs LEFT JOIN b ON b.id = docs.id WHERE docs.key IS NOT NULL GROUP BY docs.id"""


def _bits_out(df):
    text = F.array_join(F.col("on_bits").cast("array<string>"), ",")
    return df.where("key is not null").select("id", F.size("on_bits").alias("n_on"), text.alias("bits"))


@query("p30a_circular_bits", "doctok", _bits_sql("""
SELECT id, concat(r, '|', array_to_string(list_slice(t, greatest(i - r, 1), least(i + r, len(t))), ' ')) AS g
FROM (SELECT id, t, unnest(range(1, len(t) + 1)) AS i FROM doctok) CROSS JOIN range(0, 3) x(r)"""))
def p30a(spark, sf):
    d = docs(spark, sf).withColumn("toks", FP.tokens(F.col("key"), FP.WORD_TOKEN))
    return _bits_out(d.withColumn("on_bits", FP.circular_bits(F.col("toks"), DOC_BITS)))


WORD_KEYS = tuple(r"(?i)(^| )%s" % c for c in "abcdefghijklmnopqrstuvwxyz") + (r"\d", "@", "http", r"\(", ":", "é")


@query("p30b_key_bits", "docs", "SELECT id, ({0})::INT AS n_on, concat_ws(',', {1}) AS bits FROM docs WHERE key IS NOT NULL".format(
    " + ".join(f"regexp_matches(key, '{p}')::INT" for p in WORD_KEYS),
    ", ".join(f"CASE WHEN regexp_matches(key, '{p}') THEN '{i}' END" for i, p in enumerate(WORD_KEYS)),
))
def p30b(spark, sf):
    d = docs(spark, sf)
    return _bits_out(d.withColumn("on_bits", FP.key_bits(F.col("key"), WORD_KEYS)))


@query("p30c_path_bits", "doctok", _bits_sql("""
SELECT id, concat('p|', array_to_string(list_slice(t, i, i + k - 1), ' ')) AS g
FROM (SELECT id, t, unnest(range(1, len(t) + 1)) AS i FROM doctok) CROSS JOIN range(1, 8) x(k) WHERE i + k - 1 <= len(t)"""))
def p30c(spark, sf):
    d = docs(spark, sf).withColumn("toks", FP.tokens(F.col("key"), FP.WORD_TOKEN))
    return _bits_out(d.withColumn("on_bits", FP.path_bits(F.col("toks"), DOC_BITS)))


@query("p30d_pair_bits", "doctok", _bits_sql("""
SELECT id, concat('a|', t[i], '|', t[i + d], '|', d) AS g
FROM (SELECT id, t, unnest(range(1, len(t) + 1)) AS i FROM doctok) CROSS JOIN range(1, %d) x(d) WHERE i + d <= len(t)""" % (FP.PAIR_DISTANCE + 1)))
def p30d(spark, sf):
    d = docs(spark, sf).withColumn("toks", FP.tokens(F.col("key"), FP.WORD_TOKEN))
    return _bits_out(d.withColumn("on_bits", FP.pair_bits(F.col("toks"), DOC_BITS)))


def _count_sql(pattern: str) -> str:
    return f"len(regexp_extract_all(key, '{pattern}'))::DOUBLE"


@query("p31_descriptors", "docs", rf"""
WITH c AS (SELECT id, length(key)::DOUBLE AS n_chars, {_count_sql("[A-Z]")} AS n_upper, {_count_sql("[a-z]")} AS n_lower,
 {_count_sql("[0-9]")} AS n_digits, {_count_sql(r"\s")} AS n_blanks, {_count_sql("[=#]")} AS n_bonds,
 {_count_sql(r"\(")} AS n_branches, {_count_sql(r"\[")} AS n_brackets, {_count_sql(r"\+")} AS n_plus,
 {_count_sql("-")} AS n_minus, {_count_sql(r"\.")} + 1 AS n_fragments, {_count_sql(r"\S+")} AS n_words,
 len(list_distinct(regexp_extract_all(key, '\S+')))::DOUBLE AS n_distinct_words FROM docs)
SELECT *, n_lower / nullif(n_upper + n_lower, 0) AS lower_share, n_digits / nullif(n_chars, 0) AS digit_share,
 n_chars / nullif(n_words, 0) AS word_length FROM c""")
def p31(spark, sf):
    d = docs(spark, sf)
    out = D.with_descriptors(d, D.text_descriptors(F.col("key")))
    return out.drop("key", "source", "lang")


# ---- funnel and curation of returned lists ----

# known actives: labelled good; known inactives: labelled bad
_KNOWN = f"""ka AS (SELECT docs.id, docs.key, {_COARSE} AS coarse FROM labels JOIN docs ON docs.id = doc_id WHERE toxic = 1),
ki AS (SELECT {_COARSE} AS coarse FROM labels JOIN docs ON docs.id = doc_id WHERE quality = 0 AND toxic = 0)"""
_FUNNEL = rf"""
WITH {_KNOWN},
raw AS (SELECT id, text, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) AS key FROM docs_raw),
c AS (SELECT min(id) AS ord, count(*) AS n_rows, count(DISTINCT text) AS n_texts, count(DISTINCT key) AS n_keys, {_COARSE} AS coarse
 FROM raw WHERE key <> '' GROUP BY {_COARSE}),
t AS (SELECT c.*, CASE WHEN coarse IN (SELECT coarse FROM ka) THEN 'overlap_active'
 WHEN coarse IN (SELECT coarse FROM ki) THEN 'overlap_inactive' END AS stage FROM c)"""


def _known(spark, sf):
    # only the few known texts get keys: keys made before the join would be made of all texts, for each use
    labels = table(spark, sf, "labels").where("toxic = 1 or quality = 0").withColumnRenamed("doc_id", "id")
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    both = labels.join(texts, "id").withColumn("key", V.canonical_key(F.col("text")))
    both = both.withColumn("coarse", V.coarse_key(F.col("key")))
    actives = both.where("toxic = 1").withColumn("on_bits", _doc_bits(F.col("key")))
    actives = actives.select("coarse", F.col("id").alias("ord"), "on_bits")
    inactives = both.where("quality = 0 and toxic = 0").select("coarse")
    return actives, inactives


def _doc_bits(col):
    return FP.circular_bits(FP.tokens(col, FP.WORD_TOKEN), DOC_BITS)


@query("a27_overlap_funnel", "docs docs_raw", f"""{_FUNNEL}
SELECT stage, sum(n)::BIGINT AS n FROM (SELECT 'text' AS stage, n_rows - n_texts AS n FROM t
 UNION ALL SELECT 'key', n_texts - n_keys FROM t UNION ALL SELECT 'coarse', n_keys - 1 FROM t
 UNION ALL SELECT coalesce(stage, 'kept'), 1 FROM t) GROUP BY stage""")
def a27(spark, sf):
    """The exact rules of the funnel; u10 adds the similarity stage."""
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "id")
    coarse = docs(spark, sf).select("id", V.coarse_key(F.col("key")).alias("coarse"))
    both = labels.join(coarse, "id")
    distinct = matching.distinct_structures(docs_raw(spark, sf), "text", "id")
    tagged = matching.tag_overlaps(
        distinct, both.where("toxic = 1"), both.where("quality = 0 and toxic = 0")
    )
    return matching.dedup_funnel(tagged)


_SIMS = f"""{_FUNNEL},
s AS (SELECT ord, raw.key, coarse FROM t JOIN raw ON raw.id = t.ord WHERE stage IS NULL),
sg AS (SELECT ord, regexp_extract_all(key, '[\\p{{L}}\\p{{N}}]+') AS t FROM s),
sb AS (SELECT DISTINCT ord, {_HASH} % {DOC_BITS} AS b FROM (SELECT ord, concat(r, '|',
 array_to_string(list_slice(t, greatest(i - r, 1), least(i + r, len(t))), ' ')) AS g
 FROM (SELECT ord, t, unnest(range(1, len(t) + 1)) AS i FROM sg) CROSS JOIN range(0, {DOC_RADIUS + 1}) x(r))),
ab AS (SELECT dbits.id, b FROM dbits JOIN ka ON ka.id = dbits.id),
sn AS (SELECT ord, count(*) AS n FROM sb GROUP BY ord), an AS (SELECT id, count(*) AS n FROM ab GROUP BY id),
o AS (SELECT sb.ord, ab.id, count(*) AS c FROM sb JOIN ab USING (b) GROUP BY ALL),
m AS (SELECT ord, max(c::DOUBLE / (sn.n + an.n - c)) AS max_sim FROM o JOIN sn USING (ord) JOIN an ON an.id = o.id GROUP BY ord),
f AS (SELECT s.*, coalesce(max_sim, 0) AS max_sim FROM s LEFT JOIN m USING (ord))"""


def _curated(spark, sf):
    actives, inactives = _known(spark, sf)
    return matching.curate_decoys(
        docs_raw(spark, sf), "text", "id", actives, inactives, _doc_bits, DOC_BITS, SIM_LIMIT
    )


@query("u10_curate_decoys", "docs docs_raw dbits", f"""{_SIMS}
SELECT ord, md5(key) AS key_md5, coarse, len(string_split(key, ' '))::INT AS size, {r("max_sim", 3)} AS max_sim
FROM f WHERE max_sim <= {SIM_LIMIT}""")
def u10(spark, sf):
    kept, _ = _curated(spark, sf)
    return kept.select("ord", F.md5("key").alias("key_md5"), "coarse", "size", "max_sim")


@query("u10_funnel", "docs docs_raw dbits", f"""{_SIMS}
SELECT stage, sum(n)::BIGINT AS n FROM (SELECT 'text' AS stage, n_rows - n_texts AS n FROM t
 UNION ALL SELECT 'key', n_texts - n_keys FROM t UNION ALL SELECT 'coarse', n_keys - 1 FROM t
 UNION ALL SELECT stage, 1 FROM t WHERE stage IS NOT NULL
 UNION ALL SELECT CASE WHEN max_sim > {SIM_LIMIT} THEN 'similar' ELSE 'kept' END, 1 FROM f) GROUP BY stage""")
def u10_funnel(spark, sf):
    return _curated(spark, sf)[1]


# ---- fixed-width records ----

_FIELDS = {"record": (1, 2), "residue": (3, 3), "chain": (6, 1), "number": (7, 4), "atom": (1, 1), "element": (8, 2)}
# short words of the texts play the record codes
_CODES = {"protein": ("En", "La", "Le", "Is", "An"), "cofactor": ("Ou", "On"), "drop": ("Th", "Er", "De")}


@query("s7_fixed_width", "lines", """
SELECT doc_id, line_no, trim(substr(value, 1, 2)) AS record, trim(substr(value, 3, 3)) AS residue, trim(substr(value, 6, 1)) AS chain,
 trim(substr(value, 7, 4)) AS number, CASE WHEN trim(substr(value, 1, 2)) IN ('En','La','Le','Is','An') THEN 'protein'
 WHEN trim(substr(value, 1, 2)) IN ('Ou','On') THEN 'cofactor' WHEN trim(substr(value, 1, 2)) IN ('Th','Er','De') THEN 'drop'
 ELSE 'other' END AS class FROM lines""")
def s7(spark, sf):
    rows = readers.fixed_fields(lines(spark, sf), _FIELDS)
    cls = F.lit("other")
    for name in ("drop", "cofactor", "protein"):
        cls = F.when(F.col("record").isin(*_CODES[name]), name).otherwise(cls)
    return rows.select("doc_id", "line_no", "record", "residue", "chain", "number", cls.alias("class"))


@query("a23_largest_group", "lines", """
WITH g AS (SELECT doc_id, substr(value, 1, 2) AS grp, count(*) AS n_lines, min(line_no) AS f FROM lines GROUP BY 1, 2)
SELECT doc_id, arg_min(grp, (-n_lines, f)) AS grp, max(n_lines) AS n_lines FROM g GROUP BY doc_id""")
def a23(spark, sf):
    rows = lines(spark, sf).withColumn("grp", F.substring("value", 1, 2))
    return ranking.largest_group(rows, "doc_id", "grp")


@query("a23_split_largest", "lines", """
WITH g AS (SELECT doc_id, substr(value, 1, 2) AS grp, count(*) AS n_lines, min(line_no) AS f FROM lines GROUP BY 1, 2),
b AS (SELECT doc_id, arg_min(grp, (-n_lines, f)) AS grp FROM g GROUP BY doc_id)
SELECT l.doc_id, l.line_no, b.grp IS NOT NULL AS reference FROM lines l
LEFT JOIN b ON b.doc_id = l.doc_id AND b.grp = substr(l.value, 1, 2)""")
def a23_split(spark, sf):
    rows = lines(spark, sf).withColumn("grp", F.substring("value", 1, 2))
    mine, rest = ranking.split_largest(rows, "doc_id", "grp")
    return mine.select("doc_id", "line_no", F.lit(True).alias("reference")).unionByName(
        rest.select("doc_id", "line_no", F.lit(False).alias("reference"))
    )


@query("p28_heavy_atoms", "docs", r"""
SELECT id, (len(regexp_extract_all(key, '\[[^\]]*\]|Br|Cl|[BCNOPSFIbcnops]')) - len(regexp_extract_all(key, '\[\d*H[+-]?\d*\]')))::INT AS n_heavy
FROM docs""")
def p28(spark, sf):
    return docs(spark, sf).select("id", V.heavy_atoms(F.col("key")).alias("n_heavy"))


@query("p28_heavy_lines", "lines", """
SELECT doc_id, count(*) FILTER (upper(CASE WHEN length(trim(substr(value, 8, 2))) > 0 THEN trim(substr(value, 8, 2))
 ELSE trim(substr(value, 1, 1)) END) <> 'H') AS n_heavy FROM lines GROUP BY doc_id""")
def p28_lines(spark, sf):
    return readers.heavy_lines(readers.fixed_fields(lines(spark, sf), _FIELDS), "doc_id")


@query("s6_first_tokens", "lines", r"""
WITH t AS (SELECT doc_id, line_no, regexp_extract(value, '^\s*(\S+)', 1) AS token FROM lines)
SELECT doc_id, line_no, token FROM t WHERE token <> '' AND token <> 'ligand'
 AND lower(token) NOT IN ('smiles', 'canonical_smiles', 'smi')""")
def s6(spark, sf):
    return readers.first_tokens(lines(spark, sf)).select("doc_id", "line_no", "token")
