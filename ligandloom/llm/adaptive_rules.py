"""Quality rules whose thresholds follow each language and source; DataFrame functions only.

The counts of a text are made inside its row, so nothing but one small row per document is ever
shuffled. Each share (symbols, repeated lines, repeated words, exclamation marks) goes into a
histogram sketch per language and source: integer buckets of at most 1/32 relative width, whose
counts add up, so sketches of parts, sources and languages merge without loss. A threshold is the
upper fence q75 + 3 * max(q75 - q25, slack) of the sketch of the row's language and source; where that holds few rows
the merged sketch of the language, then of everything, stands in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ligandloom.session import stored

WINDOW = 5
#: Rows a sketch needs to be used by itself.
ENOUGH = 50
#: Fence width, in spreads, and the least spread of each share in parts per million.
FENCE = 3
SLACK = {"symbols": 15_000, "lines": 100_000, "repeats": 60_000, "bangs": 20_000}
SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = "[#*$%&|<>]"


def with_counts(docs: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """The ``keep`` columns and the counts of each text; null texts have none. Each step uses the one before once per row."""
    at = lambda a, i: F.get(a, i)
    body = F.coalesce(F.col(text), F.lit(""))
    step = docs.select(*keep, body.alias("body"))
    kept = step.columns[:-1]
    step = step.select(
        *kept, "body",
        F.array_remove(F.split("body", SPACE), "").alias("words"),
        F.filter(F.split("body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        (F.size(F.split("body", SYMBOL)) - 1).cast("bigint").alias("n_symbols"),
        (F.size(F.split("body", "!")) - 1).cast("bigint").alias("n_bangs"),
    )
    step = step.select(
        *kept, "n_symbols", "n_bangs",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    starts = F.when(F.size("h") >= WINDOW, F.sequence(F.lit(0), F.size("h") - WINDOW)).otherwise(
        F.array().cast("array<int>")
    )
    step = step.withColumn(
        "windows", F.transform(starts, lambda i: F.xxhash64(*[at(F.col("h"), i + k) for k in range(WINDOW)]))
    ).drop("h")
    # only texts with a repeated window are sorted
    step = step.withColumn(
        "sorted",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i")))),
        ),
    ).drop("windows")
    step = step.withColumn(
        "places",
        F.sort_array(
            F.transform(
                F.filter(
                    "sorted",
                    lambda e, j: F.coalesce(at(F.col("sorted"), j - 1).x == e.x, F.lit(False))
                    | F.coalesce(at(F.col("sorted"), j + 1).x == e.x, F.lit(False)),
                ),
                lambda e: e.i,
            )
        ),
    ).drop("sorted")
    covered = F.aggregate(
        "places",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda a, p: F.struct(
            (p + WINDOW).alias("end"), (a.n + (p + WINDOW - F.greatest(a.end, p))).cast("bigint").alias("n")
        ),
        lambda a: a.n,
    )
    return step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint"))).drop("places")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def shares() -> Column:
    """The shares of a row as (name, parts per million)."""

    def ppm(n: str, of: str) -> Column:
        return F.expr(f"{n} * 1000000 div greatest({of}, 1)")

    parts = {
        "symbols": ppm("n_symbols", "word_chars"), "lines": ppm("n_dup_lines", "n_lines"),
        "repeats": ppm("n_repeat_words", "n_words"), "bangs": ppm("n_bangs", "n_words"),
    }
    return F.array(*[F.struct(F.lit(k).alias("share"), v.alias("v")) for k, v in parts.items()])


def bucket(v: str) -> Column:
    """Exact below 64; above, the leading bit and the five after it."""
    return F.expr(
        f"CASE WHEN {v} < 64 THEN {v} ELSE 32 * (length(bin({v})) - 6) + shiftright({v}, length(bin({v})) - 6) END"
    )


def bucket_value(b: str) -> Column:
    """Least value of a bucket."""
    return F.expr(
        f"CASE WHEN {b} < 64 THEN {b} ELSE shiftleft({b} % 32 + 32, cast({b} div 32 - 1 as int)) END"
    )


def sketch(counted: DataFrame) -> DataFrame:
    """(lang, source, share, b, n): the mergeable sketches of the rows that pass the base rules."""
    return (
        counted.where(~base_failed()).select("lang", "source", F.explode(shares()).alias("s"))
        .select("lang", "source", "s.share", bucket("s.v").alias("b"))
        .groupBy("lang", "source", "share", "b").agg(F.count(F.lit(1)).alias("n"))
    )


def fences(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, share, total, fence) of the sketches merged to ``keys``. A sketch has at most some 1,200 buckets."""
    merged = sketches.groupBy(*keys, "share", "b").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "share")
    cum = merged.select(
        *keys, "share", "b", F.sum("n").over(group.orderBy("b")).alias("cum"), F.sum("n").over(group).alias("total")
    )
    quartile = lambda q: F.min(F.when(F.col("cum") * 4 >= F.col("total") * q, F.col("b")))
    q = cum.groupBy(*keys, "share").agg(
        F.max("total").alias("total"), quartile(1).alias("b1"), quartile(3).alias("b3")
    )
    slack = F.create_map(*[F.lit(x).cast(t) for k, v in SLACK.items() for x, t in ((k, "string"), (v, "bigint"))])
    low, high = bucket_value("b1"), bucket_value("b3")
    return q.select(
        *keys, "share", "total", (high + FENCE * F.greatest(high - low, slack[F.col("share")])).alias("fence")
    )


def thresholds(sketches: DataFrame) -> DataFrame:
    """(lang, source, fence): for each language and source a map from share to its upper fence."""
    own = fences(sketches, ["lang", "source"])
    lang = fences(sketches, ["lang"]).select(
        F.col("lang").alias("l"), F.col("share").alias("s"), F.col("total").alias("t"), F.col("fence").alias("f")
    )
    every = fences(sketches, []).select(F.col("share").alias("s2"), F.col("fence").alias("f2"))
    chosen = F.when(F.col("total") >= ENOUGH, F.col("fence")).when(F.col("t") >= ENOUGH, F.col("f")).otherwise(F.col("f2"))
    return (
        own.join(lang, own.lang.eqNullSafe(F.col("l")) & (own.share == F.col("s")))
        .join(every, F.col("share") == F.col("s2")).select("lang", "source", "share", chosen.alias("fence"))
        .groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("share", "fence"))).alias("fence"))
    )


def judge(
    docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row.

    Null texts are empty; a null language or source is a group of its own;
    repeated rows count and stay. A row is kept when it passes the base rules and none
    of its shares is above the fence.
    """
    keep = [F.col(key).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source")]
    counted = stored(with_counts(docs, text, keep), "counts")
    limits = stored(thresholds(sketch(counted)), "limits").select(
        F.col("lang").alias("l"), F.col("source").alias("s"), "fence"
    )
    judged = counted.join(
        limits, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left"
    )
    inside = F.forall(shares(), lambda x: x.v <= F.col("fence")[x.share])
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), F.coalesce(~base_failed() & inside, F.lit(False)).alias("kept"),
    )


#: The same in DuckDB, over the view ``documents``.
SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS body FROM documents),
w AS (
  SELECT r, word, row_number() OVER (PARTITION BY r ORDER BY p) AS i FROM (
    SELECT r, unnest(string_split_regex(body, '[\\x20\\x09-\\x0D]+')) AS word, generate_subscripts(string_split_regex(body, '[\\x20\\x09-\\x0D]+'), 1) AS p
    FROM d) WHERE word <> ''),
win AS (
  SELECT r, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o
    || ' ' || lead(word, 4) OVER o AS g FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win WHERE g IS NOT NULL) WHERE c > 1),
rep AS (
  SELECT r, count(*) AS n_repeat_words FROM (SELECT DISTINCT r, i + k AS j FROM twice, range(5) x(k)) GROUP BY r),
wc AS (SELECT r, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars FROM w GROUP BY r),
ln AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (
    SELECT r, unnest(string_split(body, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
c AS (
  SELECT d.r, doc_id, lang, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
    length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    length(body) - length(replace(body, '!', '')) AS n_bangs,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN wc USING (r) LEFT JOIN ln USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
s AS (
  SELECT r, lang, source, base_failed, unnest(['symbols', 'lines', 'repeats', 'bangs']) AS share,
    unnest([n_symbols * 1000000 // greatest(word_chars, 1), n_dup_lines * 1000000 // greatest(n_lines, 1),
      n_repeat_words * 1000000 // greatest(n_words, 1), n_bangs * 1000000 // greatest(n_words, 1)]) AS v FROM b),
k AS (
  SELECT lang, source, share, CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END AS v
  FROM s WHERE NOT base_failed),
slack(share, least) AS (VALUES ('symbols', 15000), ('lines', 100000), ('repeats', 60000), ('bangs', 20000)),
f1 AS (SELECT lang, source, share, count(*) AS n, quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.75) AS q3 FROM k GROUP BY ALL),
f2 AS (SELECT lang, share, count(*) AS n, quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.75) AS q3 FROM k GROUP BY ALL),
f3 AS (SELECT share, quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.75) AS q3 FROM k GROUP BY ALL),
t AS (
  SELECT f1.lang, f1.source, share, CASE WHEN f1.n >= 50 THEN f1.q3 + 3 * greatest(f1.q3 - f1.q1, least)
    WHEN f2.n >= 50 THEN f2.q3 + 3 * greatest(f2.q3 - f2.q1, least) ELSE f3.q3 + 3 * greatest(f3.q3 - f3.q1, least) END AS fence
  FROM f1 JOIN f2 USING (share) JOIN f3 USING (share) JOIN slack USING (share) WHERE f1.lang IS NOT DISTINCT FROM f2.lang),
j AS (
  SELECT s.r, bool_and(s.v <= t.fence) AS inside FROM s JOIN t
    ON s.share = t.share AND s.lang IS NOT DISTINCT FROM t.lang AND s.source IS NOT DISTINCT FROM t.source GROUP BY s.r)
SELECT doc_id, n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
  coalesce(NOT base_failed AND inside, false) AS kept
FROM b LEFT JOIN j USING (r)
"""
