"""The operators with production parameters over their whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.llm import bpe, line_dedup, mixing, neardup, prefix_forest, quality, substrings, token_counts, topk, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"), width=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).withColumn("duplicate", ~F.col("doc_id").eqNullSafe(F.col("class_id")))


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.token_lengths(table(spark, sf_dir, "documents"))
    return token_counts.context_totals(token_counts.length_histogram(lengths))


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), with_ids=False, keep=True)


@query
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=[3, 1, 2], share=1.5, most=2.0, seed=17)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def _fill_sql(n: int, final: bool) -> str:
    """Once more through the documents after the cut, in order of rank, for what is left of the gap."""
    fits = "over <= 0 OR (over < size AND 2 * over <= size)" if final else "over <= 0"
    able = "open" if final else "open AND size <= gap"
    return f"""
    gap{n} AS (SELECT *, gap0 - sum(CASE WHEN more THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM fill{n - 1}),
    fill{n} AS (
      SELECT * EXCLUDE (gap, more, open, able, over), open AND NOT (able AND ({fits}) AND gap > 0) AS open, more OR (able AND ({fits}) AND gap > 0) AS more FROM (
        SELECT *, {able} AS able, sum(CASE WHEN {able} THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, CAST(doc_id AS VARCHAR) NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - gap AS over FROM gap{n}) AS x0)"""


ORACLE_SQL["op2_mix_sources"] = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS DOUBLE) AS w
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, source_size * CAST(2.0 AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) AS total,
         coalesce(sum(source_size * CAST(2.0 AS DOUBLE)) OVER (ORDER BY source_size * CAST(2.0 AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         sum(w) OVER (ORDER BY source_size * CAST(2.0 AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
  FROM sums),
level AS (
  SELECT arg_min((total - cap_before) / w_left, cap / w) AS level FROM ordered WHERE (total - cap_before) / w_left * w <= cap),
targets AS (
  SELECT source, source_size, least(cap, coalesce((SELECT level FROM level) * w, cap)) AS target FROM ordered),
rated AS (
  SELECT d.*, t.source_size, t.target, least(CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END, CAST(2.0 AS DOUBLE)) AS rate,
         (CAST(CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':17'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
odds AS (
  SELECT *, floor(rate) AS whole, CASE WHEN rate > floor(rate) THEN (u / (1 - u)) / ((rate - floor(rate)) / (1 - (rate - floor(rate)))) END AS odds FROM rated),
ranked AS (
  SELECT doc_id, source, size, source_size, target, whole, odds / (1 + odds) AS rank,
         target - sum(whole * size) OVER (PARTITION BY source) AS rest FROM odds),
run AS (
  SELECT *, rank IS NOT NULL AND sum(CASE WHEN rank IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, CAST(doc_id AS VARCHAR) NULLS FIRST, size ROWS UNBOUNDED PRECEDING) <= rest AS main FROM ranked),
fill0 AS (
  SELECT *, rest - sum(CASE WHEN main THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap0, FALSE AS more,
         rank IS NOT NULL AND NOT main AND sum(CASE WHEN rank IS NOT NULL AND NOT main THEN 1 ELSE 0 END)
           OVER (PARTITION BY source ORDER BY rank NULLS LAST, CAST(doc_id AS VARCHAR) NULLS FIRST, size ROWS UNBOUNDED PRECEDING) <= {mixing.LOOK} AS open FROM run),
{",".join(_fill_sql(i, i == mixing.FILLS + 1) for i in range(1, mixing.FILLS + 2))}
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN main OR more THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM fill{mixing.FILLS + 1}
"""


@query
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.withColumn("toxic", (F.col("grade") >= 1).cast("int"))


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    count = lambda: F.when(F.col("text").isNotNull(), F.size(F.split("text", "\n", -1)).cast("long"))
    out = line_dedup.drop_boilerplate(docs.withColumn("n_lines", count()))
    return out.select("doc_id", "n_lines", count().alias("n_lines_left"), F.length("text").cast("long").alias("n_chars_left"), F.md5("text").alias("text_md5"))


def _lines_sql(docs: str, site: str) -> str:
    """What is left of the rows (doc_id, site, text, row_at) of docs; row_at tells rows apart."""
    return f"""
src AS ({docs}),
lines AS (
  SELECT row_at, {site} AS site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM src WHERE text IS NOT NULL),
bare AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS b FROM lines),
counts AS (SELECT site, b, count(DISTINCT row_at) AS pages FROM bare WHERE b <> '' GROUP BY ALL),
totals AS (SELECT {site} AS site, count(*) AS site_pages FROM src GROUP BY ALL),
gone AS (SELECT c.site, b FROM counts c JOIN totals t ON c.site IS NOT DISTINCT FROM t.site WHERE pages >= {line_dedup.LEAST} AND pages > {line_dedup.RATIO} * site_pages),
kept AS (
  SELECT row_at, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n FROM bare
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.site IS NOT DISTINCT FROM bare.site AND g.b = bare.b) GROUP BY row_at),
left_ AS (SELECT r.*, coalesce(n, 1) AS n_left, CASE WHEN r.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS kept FROM src r LEFT JOIN kept k USING (row_at))"""


_LINES_LEFT = """CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, CASE WHEN text IS NOT NULL THEN CAST(n_left AS BIGINT) END AS n_lines_left,
       CAST(length(kept) AS BIGINT) AS n_chars_left, md5(kept) AS text_md5"""

ORACLE_SQL["op4_line_dedup"] = f"""
WITH {_lines_sql("SELECT doc_id, source, text, row_number() OVER () AS row_at FROM documents", "source")}
SELECT doc_id, {_LINES_LEFT} FROM left_
"""


@query
def line_dedup_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", line_dedup.host(F.col("url")).alias("host"), line_dedup.page_lines(F.col("html")).alias("text"))
    count = lambda: F.when(F.col("text").isNotNull(), F.size(F.split("text", "\n", -1)).cast("long"))
    out = line_dedup.drop_boilerplate(pages.withColumn("n_lines", count()), id_col="page_id", site_col="host")
    return out.select("page_id", "host", "n_lines", count().alias("n_lines_left"), F.length("text").cast("long").alias("n_chars_left"), F.md5("text").alias("text_md5"))


_PAGE_TEXT = r"""regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', chr(10), 'g'), '[ \t\r\n]*\n[ \t\r\n]*', chr(10), 'g')"""

ORACLE_SQL["line_dedup_pages"] = f"""
WITH {_lines_sql("SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host, " + _PAGE_TEXT + " AS text, row_number() OVER () AS row_at FROM pages", "host")}
SELECT page_id, host, {_LINES_LEFT} FROM left_
"""


@query
def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows.where("vec_id % 100 = 0"), rows, k=10)


ORACLE_SQL["op7_topk_search"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS z FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.z) + 1), lambda i: q.z[i] * c.z[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.z) = len(c.z) WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query
def op10_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return prefix_forest.nearest(rows.where("vec_id % 20 = 0"), rows, k=20)
