"""One query for each operator over the record view of the documents table, and the SQL that it must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftlink import schema
from weftlink.functions import text
from weftlink.operators import assign, blocking, export, metrics, pairs, profile, sampling, scoring, vectors
from weftlink.plans import fixture, linkage
from weftlink.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

CAP, K, THRESHOLD = schema.MAX_BLOCK, 10, 0.4


def query(sql: str | None = None, *parts: str) -> Callable:
    """Registers a function of the record view; sql continues the common tables named in parts."""

    def add(f: Callable[[fixture.Records], DataFrame]) -> Callable[[fixture.Records], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(fixture.Records(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = "WITH " + ",\n".join([fixture.SQL, *(SQL_PARTS[p] for p in parts)]) + "\n" + sql
        return f

    return add


def _clean(x: str) -> str:
    return f"(CASE WHEN coalesce({x}, '') IN ('', 'nan') THEN '' ELSE trim(regexp_replace(replace(strip_accents(lower({x})), '&', ' and '), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) END)"


def _words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def _sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _jaccard(a: str, b: str) -> str:
    inter = f"len(list_intersect({a}, {b}))"
    return f"(CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE CAST({inter} AS DOUBLE) / (len({a}) + len({b}) - {inter}) END)"


_NAME_TOKENS = f"list_filter({_words('cn')}, lambda w: NOT list_contains({_sql_list(text.LEGAL_FORMS)}, w))"
_ADDRESS = "array_to_string(list_transform(" + _words("ca") + ", lambda w: coalesce(MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in text.ADDRESS_WORDS.items()) + "}[w], w)), ' ')"
_NUMBERS = "list_distinct(list_filter(string_split(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '), lambda t: regexp_full_match(t, '\\p{{Nd}}+')))"
_POSTAL = "list_filter({n}, lambda t: len(t) IN (5, 6))"
_AGAIN = "CASE WHEN {x} = 'nan' THEN '' ELSE lower({x}) END"

SQL_PARTS = {
    "clean": f"""clean0 AS (
  SELECT entity_id, source, business_name, coalesce(business_address, '') AS raw_addr, country, {_clean("business_name")} AS cn, {_clean("business_address")} AS ca, {_clean("country")} AS cc FROM src),
clean AS (
  SELECT *, CASE WHEN len({_NAME_TOKENS}) > 0 THEN array_to_string({_NAME_TOKENS}, ' ') ELSE cn END AS name, {_ADDRESS} AS addr FROM clean0)""",
    "keys": f"""keys0 AS (
  SELECT entity_id, source, replace(name, ' ', '') AS tight, name, cc, {_NUMBERS.format(x="raw_addr")} AS nums, {_words("name")} AS nw FROM clean),
keys1 AS (
  SELECT entity_id, source, list_distinct(
    CASE WHEN len(tight) >= 3 THEN [cc || ':np:' || substr(tight, 1, 4)] ELSE [] END
    || list_transform(list_filter(nw, lambda w: len(w) >= 3 AND NOT list_contains({_sql_list(blocking.STOP_WORDS)}, w)), lambda w: cc || ':nw:' || w)
    || list_transform({_POSTAL.format(n="nums")}, lambda c: cc || ':pc:' || c)
    || list_transform(list_filter(nums, lambda c: len(c) >= 2), lambda c: cc || ':num:' || (CASE WHEN name = '' THEN 'x' ELSE substr(name, 1, 1) END) || '_' || c)) AS ks FROM keys0),
keys AS (SELECT DISTINCT entity_id, source, unnest(ks) AS key FROM keys1),
index_ AS (SELECT key, entity_id AS target_id FROM keys WHERE source <> 'S1' AND key IN (SELECT key FROM keys WHERE source <> 'S1' GROUP BY key HAVING count(*) <= {CAP})),
shared AS (SELECT k.entity_id AS s1_id, i.target_id, count(*) AS shared FROM keys k JOIN index_ i USING (key) WHERE k.source = 'S1' GROUP BY ALL),
cand AS (SELECT s1_id, target_id, shared FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY shared DESC, target_id) AS at0 FROM shared) WHERE at0 <= {K})""",
    "prof": f"""prof0 AS (
  SELECT entity_id, source, name, addr, replace({_AGAIN.format(x="name")}, ' ', '') AS tight, list_distinct({_words("(" + _AGAIN.format(x="name") + ")")}) AS nwords,
         list_distinct({_words("(" + _AGAIN.format(x="addr") + ")")}) AS awords, {_NUMBERS.format(x="addr")} AS anums FROM clean),
prof AS (
  SELECT *, CASE WHEN tight = '' THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(tight) - 2, 1) + 1), lambda i: substr(tight, i, 3))) END AS grams,
         {_POSTAL.format(n="anums")} AS codes FROM prof0)""",
    "scored": f"""scored AS (
  SELECT c.s1_id, c.target_id, {_jaccard("a.nwords", "b.nwords")} AS p FROM cand c JOIN prof a ON a.entity_id = c.s1_id JOIN prof b ON b.entity_id = c.target_id)""",
    "winners": """winners AS (SELECT s1_id, target_id, p FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY p DESC, s1_id) AS at0 FROM scored) WHERE at0 = 1)""",
    "matches": f"""matches AS (SELECT * FROM winners WHERE p >= {THRESHOLD})""",
    "per": """per0 AS (
  SELECT s1.entity_id AS s1_id, (SELECT count(*) FROM matches m WHERE m.s1_id = s1.entity_id) AS np, (SELECT count(*) FROM truth t WHERE t.s1_id = s1.entity_id) AS nt,
         (SELECT count(*) FROM matches m JOIN truth t USING (s1_id, target_id) WHERE m.s1_id = s1.entity_id) AS tp FROM s1),
per AS (
  SELECT *, CASE WHEN nt = 0 THEN CASE WHEN np = 0 THEN 1.0 ELSE 0.0 END WHEN tp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / np END AS precision,
         CASE WHEN nt = 0 THEN CASE WHEN np = 0 THEN 1.0 ELSE 0.0 END WHEN tp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / nt END AS recall,
         CASE WHEN nt = 0 THEN CASE WHEN np = 0 THEN 1.0 ELSE 0.0 END WHEN tp = 0 THEN 0.0
              ELSE 1.25 * (CAST(tp AS DOUBLE) / np) * (CAST(tp AS DOUBLE) / nt) / (0.25 * (CAST(tp AS DOUBLE) / np) + (CAST(tp AS DOUBLE) / nt)) END AS f FROM per0)""",
}
_BLOCK, _SCORE = ("clean", "keys"), ("clean", "keys", "prof", "scored")
_MACRO = """round(coalesce(avg(f), 0), 6) AS macro_f, round(coalesce(avg(precision), 0), 6) AS macro_precision, round(coalesce(avg(recall), 0), 6) AS macro_recall,
round(coalesce(avg(f) FILTER (WHERE nt = 0), 0), 6) AS singleton_f, round(coalesce(avg(f) FILTER (WHERE nt > 0), 0), 6) AS matched_f,
count(*) AS entities, count(*) FILTER (WHERE nt = 0) AS singletons, count(*) FILTER (WHERE nt > 0) AS matched"""


def _found(r: fixture.Records) -> DataFrame:
    return blocking.candidates(blocking.block_index(r.s23, CAP), r.s1, K)


def _both(r: fixture.Records, found: DataFrame | None = None) -> DataFrame:
    profiles = pairs.profiles(r.sources)
    return pairs.paired(_found(r) if found is None else found, profiles, profiles)


def _scored(r: fixture.Records) -> DataFrame:
    return linkage.word_jaccard(_both(r))


def _joined(a: Column) -> Column:
    return F.array_join(F.array_sort(a), "|")


# scans and relational operators


@query("SELECT entity_id, business_name, country FROM src ORDER BY entity_id LIMIT 20")
def scan_head(r: fixture.Records) -> DataFrame:
    return sampling.head(r.raw.select("entity_id", "business_name", "country"), 20)


@query("SELECT entity_id, business_name, business_address, country FROM src")
def scan_all(r: fixture.Records) -> DataFrame:
    return r.raw.select(*schema.SOURCE_COLUMNS)


@query("SELECT source1_entity_id AS s1_id, target_id FROM (SELECT source1_entity_id, unnest(string_split(matched_entity_ids, ',')) AS target_id FROM gt) WHERE target_id <> ''")
def gt_explode(r: fixture.Records) -> DataFrame:
    return tables.ground_truth_edges(r.gt)


@query("SELECT entity_id, country FROM src")
def project_cols(r: fixture.Records) -> DataFrame:
    return r.raw.select("entity_id", "country")


@query("SELECT entity_id, country FROM src WHERE country = 'fr'")
def filter_country(r: fixture.Records) -> DataFrame:
    return r.raw.where(F.col("country") == "fr").select("entity_id", "country")


@query("SELECT entity_id, source FROM s23 WHERE entity_id IN (SELECT target_id FROM truth)")
def semi_needed_ids(r: fixture.Records) -> DataFrame:
    return r.s23.join(r.truth.select(F.col("target_id").alias("entity_id")), "entity_id", "left_semi").select("entity_id", "source")


@query("SELECT CASE WHEN entity_id LIKE 'S1-%' THEN 'S1' WHEN entity_id LIKE 'S2-%' THEN 'S2' ELSE 'S3' END AS routed, count(*) AS n FROM src GROUP BY 1")
def route_source(r: fixture.Records) -> DataFrame:
    i = F.col("entity_id")
    return r.raw.groupBy(F.when(i.startswith("S1-"), "S1").when(i.startswith("S2-"), "S2").otherwise("S3").alias("routed")).agg(F.count("*").alias("n"))


@query("SELECT entity_id, country FROM src ORDER BY entity_id LIMIT 30 OFFSET 40")
def offset_page(r: fixture.Records) -> DataFrame:
    return r.raw.select("entity_id", "country").orderBy("entity_id").offset(40).limit(30)


@query("SELECT DISTINCT country FROM src ORDER BY country")
def distinct_countries(r: fixture.Records) -> DataFrame:
    return r.raw.select("country").distinct().orderBy("country")


@query("SELECT t.s1_id, t.target_id, a.business_name AS name1, b.business_name AS name2 FROM truth t JOIN s1 a ON a.entity_id = t.s1_id JOIN s23 b ON b.entity_id = t.target_id")
def gt_pairs_join(r: fixture.Records) -> DataFrame:
    edges = r.gt.select(F.col("source1_entity_id").alias("s1_id"), F.explode(F.split("matched_entity_ids", ",")).alias("target_id"))
    left = r.raw.select(F.col("entity_id").alias("s1_id"), F.col("business_name").alias("name1"))
    right = r.raw.where("source <> 'S1'").select(F.col("entity_id").alias("target_id"), F.col("business_name").alias("name2"))
    return edges.join(left, "s1_id").join(right, "target_id").select("s1_id", "target_id", "name1", "name2")


@query("SELECT s.entity_id AS source1_entity_id, coalesce(g.matched_entity_ids, '') AS matched_entity_ids FROM s1 s LEFT JOIN gt g ON g.source1_entity_id = s.entity_id WHERE s.country = 'en'")
def split_gt(r: fixture.Records) -> DataFrame:
    return sampling.split_ground_truth(r.gt, r.s1.where("country = 'en'"))


# text


@query("SELECT entity_id, strip_accents(business_name) AS plain FROM src")
def strip_accents(r: fixture.Records) -> DataFrame:
    return r.raw.select("entity_id", text.strip_accents(F.col("business_name")).alias("plain"))


@query("SELECT entity_id, cn AS clean_business_name, ca AS clean_business_address FROM clean", "clean")
def clean_text(r: fixture.Records) -> DataFrame:
    return r.raw.select("entity_id", text.clean_text(F.col("business_name")).alias("clean_business_name"), text.clean_text(F.col("business_address")).alias("clean_business_address"))


@query("SELECT entity_id, name AS clean_name FROM clean", "clean")
def clean_name(r: fixture.Records) -> DataFrame:
    return r.raw.select("entity_id", text.clean_name(F.col("business_name")).alias("clean_name"))


@query("SELECT entity_id, addr AS clean_addr FROM clean", "clean")
def clean_address(r: fixture.Records) -> DataFrame:
    return r.raw.select("entity_id", text.clean_address(F.col("business_address")).alias("clean_addr"))


def _numbers_of_text(r: fixture.Records) -> DataFrame:
    return r.raw.select("entity_id", F.col("text").alias("t"))


@query("SELECT entity_id, array_to_string(list_sort(" + _POSTAL.format(n=_NUMBERS.format(x="coalesce(text, '')")) + "), '|') AS codes FROM src")
def postal_codes(r: fixture.Records) -> DataFrame:
    return _numbers_of_text(r).select("entity_id", _joined(text.postal_codes(F.col("t"))).alias("codes"))


@query("SELECT entity_id, array_to_string(list_sort(" + _NUMBERS.format(x="coalesce(text, '')") + "), '|') AS nums FROM src")
def numbers(r: fixture.Records) -> DataFrame:
    return _numbers_of_text(r).select("entity_id", _joined(text.numbers(F.col("t"))).alias("nums"))


@query("SELECT entity_id, array_to_string(list_sort(grams), '|') AS grams FROM prof", "clean", "prof")
def char_ngrams(r: fixture.Records) -> DataFrame:
    return pairs.profiles(r.sources).select("entity_id", _joined(F.col("name_ngrams")).alias("grams"))


@query("SELECT entity_id, array_to_string(" + _words("(" + _AGAIN.format(x="cn") + ")") + ", '|') AS words FROM clean", "clean")
def word_tokens(r: fixture.Records) -> DataFrame:
    return r.raw.select("entity_id", F.array_join(text.word_tokens(text.clean_text(F.col("business_name"))), "|").alias("words"))


@query("SELECT entity_id, 'Business: ' || name || ' | Address: ' || addr || ' | Country: ' || trim(coalesce(country, '')) AS text FROM clean", "clean")
def format_text(r: fixture.Records) -> DataFrame:
    return r.raw.select("entity_id", text.format_record(text.clean_name(F.col("business_name")), text.clean_address(F.col("business_address")), F.col("country")).alias("text"))


@query("SELECT entity_id, 'Instruct: Retrieve matching business identity records across noisy sources' || chr(10) || 'Query: Business: ' || name || ' | Address: ' || addr || ' | Country: ' || trim(coalesce(country, '')) AS text FROM clean WHERE source = 'S1'", "clean")
def format_query_text(r: fixture.Records) -> DataFrame:
    s1 = r.raw.where("source = 'S1'")
    return s1.select("entity_id", text.format_record(text.clean_name(F.col("business_name")), text.clean_address(F.col("business_address")), F.col("country"), is_query=True).alias("text"))


@query("SELECT t.s1_id, t.target_id, 'Business: ' || a.name || ' | Address: ' || a.addr AS text1, 'Business: ' || b.name || ' | Address: ' || b.addr AS text2 FROM truth t JOIN clean a ON a.entity_id = t.s1_id JOIN clean b ON b.entity_id = t.target_id", "clean")
def format_pair(r: fixture.Records) -> DataFrame:
    both = _both(r, r.truth)
    pair = text.format_pair(F.col("p1.clean_name"), F.col("p1.clean_addr"), F.col("p2.clean_name"), F.col("p2.clean_addr"))
    return both.select("s1_id", "target_id", pair.alias("t")).select("s1_id", "target_id", "t.text1", "t.text2")


@query("SELECT country, string_agg(DISTINCT entity_id, ',' ORDER BY entity_id) AS ids FROM src GROUP BY country")
def fold_ids(r: fixture.Records) -> DataFrame:
    return r.raw.groupBy("country").agg(text.fold_ids(F.col("entity_id")).alias("ids"))


# blocking and retrieval


@query("SELECT entity_id, key FROM keys", *_BLOCK)
def block_keys(r: fixture.Records) -> DataFrame:
    return blocking.postings(r.sources).select("entity_id", "key")


@query("SELECT key, target_id FROM index_", *_BLOCK)
def block_index(r: fixture.Records) -> DataFrame:
    return blocking.block_index(r.s23, CAP)


@query("SELECT s1_id, target_id, shared FROM cand", *_BLOCK)
def block_topk(r: fixture.Records) -> DataFrame:
    return _found(r)


@query("SELECT (SELECT count(*) FROM truth JOIN cand USING (s1_id, target_id)) AS found_true, (SELECT count(*) FROM truth) AS total_true, count(*) AS n_s1, (SELECT count(*) FROM cand) AS total_candidates, round(CAST((SELECT count(*) FROM truth JOIN cand USING (s1_id, target_id)) AS DOUBLE) / (SELECT count(*) FROM truth), 6) AS pair_recall, round(1 - CAST((SELECT count(*) FROM cand) AS DOUBLE) / (count(*) * (SELECT count(*) FROM s23)), 6) AS reduction_ratio, round(CAST((SELECT count(*) FROM cand) AS DOUBLE) / count(*), 6) AS avg_candidates FROM s1", *_BLOCK)
def blocking_eval(r: fixture.Records) -> DataFrame:
    return blocking.evaluate(_found(r), r.truth, r.spine, r.s23.count()).select("found_true", "total_true", "n_s1", "total_candidates", "pair_recall", "reduction_ratio", "avg_candidates")


_TERMS = """terms AS (
  SELECT entity_id, source, w AS term, CAST(count(*) AS DOUBLE) AS w FROM (SELECT entity_id, source, unnest(string_split(cn, ' ')) AS w FROM clean) WHERE len(w) >= 4 GROUP BY ALL),
products AS (SELECT q.entity_id AS query_id, t.entity_id AS target_id, round(sum(q.w * t.w), 6) AS score FROM terms q JOIN terms t USING (term) WHERE q.source = 'S1' AND t.source <> 'S1' GROUP BY ALL),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, target_id) AS rank FROM products) WHERE rank <= 4)"""
SQL_PARTS["sparse"] = _TERMS


def _terms(r: fixture.Records) -> DataFrame:
    words = r.sources.select(F.col("entity_id").alias("id"), "source", F.explode(text.words(text.clean_text(F.col("business_name")))).alias("term")).where(F.length("term") >= 4)
    return words.groupBy("id", "source", "term").agg(F.count("*").cast("double").alias("w"))


def _sparse(r: fixture.Records) -> DataFrame:
    terms = _terms(r)
    return vectors.sparse_topk(terms.where("source = 'S1'"), terms.where("source <> 'S1'"), 4)


@query("SELECT query_id, target_id, score, rank FROM sparse", "clean", "sparse")
def sparse_topk(r: fixture.Records) -> DataFrame:
    return _sparse(r)


_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _letter_counts() -> Callable[[list[str]], np.ndarray]:
    """An encoder that SQL can repeat: how often each letter and digit is in a text. Whole numbers, so products are exact."""
    return lambda texts: np.array([[t.count(c) for c in _LETTERS] for t in texts], np.float64).reshape(len(texts), len(_LETTERS))


SQL_PARTS["hybrid"] = f"""written AS (
  SELECT entity_id, source, list_distinct(list_filter(string_split(name || ' ' || addr, ' '), lambda w: len(w) > 3)) AS ws,
         CASE WHEN source = 'S1' THEN 'Instruct: Retrieve matching business identity records across noisy sources' || chr(10) || 'Query: ' ELSE '' END
         || 'Business: ' || name || ' | Address: ' || addr || ' | Country: ' || trim(CASE WHEN coalesce(country, '') IN ('', 'nan') THEN '' ELSE country END) AS t FROM clean),
counted AS (
  SELECT entity_id, source, list_transform(range(1, {len(_LETTERS) + 1}), lambda i: CAST(length(t) - length(replace(t, substr('{_LETTERS}', i, 1), '')) AS DOUBLE)) AS c FROM written),
units AS (
  SELECT entity_id, source, list_transform(c, lambda x: floor(x / norm * 1048576) / 1048576) AS v
  FROM (SELECT *, CASE WHEN list_sum(c) = 0 THEN 1.0 ELSE sqrt(list_inner_product(c, c)) END AS norm FROM counted)),
near AS (
  SELECT query_id, target_id FROM (
    SELECT q.entity_id AS query_id, t.entity_id AS target_id, row_number() OVER (PARTITION BY q.entity_id ORDER BY list_inner_product(q.v, t.v) DESC, t.entity_id) AS rank
    FROM units q JOIN units t ON q.source = 'S1' AND t.source <> 'S1') WHERE rank <= 6),
heavy AS (
  SELECT entity_id, source, e.term AS term, floor(1024 * ln(1 - 3 - e.n)) AS w FROM (
    SELECT entity_id, source, unnest(list_sort(list_transform(ws, lambda w: {{'n': -len(w), 'term': w}}))[1:30]) AS e FROM written)),
weighed AS (SELECT q.entity_id AS query_id, t.entity_id AS target_id, sum(q.w * t.w) AS score FROM heavy q JOIN heavy t USING (term) WHERE q.source = 'S1' AND t.source <> 'S1' GROUP BY ALL),
alike AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, target_id) AS rank FROM weighed) WHERE rank <= 4)"""


def _word_logits(words: Column) -> Column:
    """Logits that SQL can repeat: at each word's place the word alone, by its letters beyond three."""
    return F.transform(text.words(words), lambda w: F.create_map(w, (F.length(w) - 3).cast("double")))


@query("""SELECT s1_id, target_id, string_agg(DISTINCT b, ',' ORDER BY b) AS branches FROM (
  SELECT s1_id, target_id, 'exact' AS b FROM cand UNION ALL SELECT query_id, target_id, 'dense' FROM near UNION ALL SELECT query_id, target_id, 'sparse' FROM alike) GROUP BY ALL""", "clean", "keys", "hybrid")
def hybrid_union(r: fixture.Records) -> DataFrame:
    """10 candidates by keys, 6 by vectors of whole records and 4 by weighted terms."""
    return blocking.hybrid_candidates(r.s1, r.s23, _letter_counts, _word_logits, cap=CAP, k_exact=K, k_dense=6, k_sparse=4)


SQL_PARTS["dense"] = f"""letters AS (
  SELECT entity_id, source, list_transform(range(1, {len(_LETTERS) + 1}), lambda i: CAST(length(cn) - length(replace(cn, substr('{_LETTERS}', i, 1), '')) AS DOUBLE)) AS v FROM clean),
dense AS (
  SELECT query_id, target_id FROM (
    SELECT q.entity_id AS query_id, t.entity_id AS target_id, row_number() OVER (PARTITION BY q.entity_id ORDER BY list_inner_product(q.v, t.v) DESC, t.entity_id) AS rank
    FROM letters q JOIN letters t ON q.source = 'S1' AND t.source <> 'S1') WHERE rank <= 3)"""


def _dense(r: fixture.Records) -> DataFrame:
    names = r.sources.select("entity_id", "source", text.clean_text(F.col("business_name")).alias("text"))
    side = lambda which: vectors.encode(names.where(which), _letter_counts).withColumnRenamed("entity_id", "id")
    return vectors.dense_topk(side("source = 'S1'"), side("source <> 'S1'"), 3)


@query("""SELECT s1_id, target_id, string_agg(b, ',' ORDER BY b) AS branches FROM (
  SELECT s1_id, target_id, 'exact' AS b FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY shared DESC, target_id) AS n FROM cand) WHERE n <= 6
  UNION ALL SELECT query_id, target_id, 'sparse' FROM sparse UNION ALL SELECT query_id, target_id, 'dense' FROM dense) GROUP BY ALL""", "clean", "keys", "sparse", "dense")
def hybrid_three(r: fixture.Records) -> DataFrame:
    """6 candidates by keys, 4 by terms and 3 by vectors."""
    exact = blocking.candidates(blocking.block_index(r.s23, CAP), r.s1, 6)
    return blocking.union_candidates(exact=exact, **{name: df.withColumnRenamed("query_id", "s1_id") for name, df in (("sparse", _sparse(r)), ("dense", _dense(r)))})


def on_embeddings(sql: str) -> Callable:
    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


@on_embeddings("SELECT vec_id, round(sqrt(list_sum(list_transform(z, lambda x: x * x))), 6) AS norm, round(z[1], 6) AS first, round(z[32], 6) AS last FROM (SELECT vec_id, list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) AS z FROM (SELECT vec_id, list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE)) AS c FROM embeddings))")
def emb_truncate_norm(emb: DataFrame) -> DataFrame:
    z = emb.select("vec_id", vectors.truncate_normalise(F.col("embedding"), 32).alias("z"))
    norm = F.sqrt(F.aggregate("z", F.lit(0.0), lambda s, x: s + x * x))
    return z.select("vec_id", F.round(norm, 6).alias("norm"), F.round(F.col("z")[0], 6).alias("first"), F.round(F.col("z")[31], 6).alias("last"))


@on_embeddings("WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), s AS (SELECT CAST(q.vec_id AS VARCHAR) AS query_id, CAST(t.vec_id AS VARCHAR) AS target_id, list_inner_product(q.v, t.v) AS score FROM e q JOIN e t ON q.vec_id % 10 = 0 AND t.vec_id <> q.vec_id) SELECT query_id, target_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, target_id) AS rank FROM s) WHERE rank <= 6")
def dense_topk(emb: DataFrame) -> DataFrame:
    rows = emb.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    others = vectors.dense_topk(rows.where("id % 10 = 0"), rows, 7).where("query_id != target_id")  # one more, for the query itself
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "target_id")
    return others.withColumn("rank", F.row_number().over(order)).where("rank <= 6").withColumn("score", F.round("score", 6))


# pairs


@query(f"SELECT c.s1_id, c.target_id, round({_jaccard('a.grams', 'b.grams')}, 6) AS name_ngram_jaccard, round({_jaccard('a.nwords', 'b.nwords')}, 6) AS name_word_jaccard, round({_jaccard('a.awords', 'b.awords')}, 6) AS addr_word_jaccard FROM cand c JOIN prof a ON a.entity_id = c.s1_id JOIN prof b ON b.entity_id = c.target_id", "clean", "keys", "prof")
def pair_jaccard(r: fixture.Records) -> DataFrame:
    values = pairs.set_features()
    return _both(r).select("s1_id", "target_id", *[F.round(values[c], 6).alias(c) for c in ("name_ngram_jaccard", "name_word_jaccard", "addr_word_jaccard")])


@query("SELECT c.s1_id, c.target_id, CAST(a.name <> '' AND a.name = b.name AS DOUBLE) AS name_exact_match, CAST(abs(len(a.name) - len(b.name)) AS DOUBLE) AS name_len_diff, round(CASE WHEN greatest(len(a.name), len(b.name)) > 0 THEN CAST(least(len(a.name), len(b.name)) AS DOUBLE) / greatest(len(a.name), len(b.name)) ELSE 1.0 END, 6) AS name_len_ratio FROM cand c JOIN prof a ON a.entity_id = c.s1_id JOIN prof b ON b.entity_id = c.target_id", "clean", "keys", "prof")
def pair_exact_len(r: fixture.Records) -> DataFrame:
    values = pairs.set_features()
    return _both(r).select("s1_id", "target_id", *[F.round(values[c], 6).alias(c) for c in ("name_exact_match", "name_len_diff", "name_len_ratio")])


@query(f"SELECT c.s1_id, c.target_id, round({_jaccard('a.anums', 'b.anums')}, 6) AS addr_num_jaccard, CAST(len(list_intersect(a.anums, b.anums)) AS DOUBLE) AS addr_num_overlap, CAST(len(list_intersect(a.codes, b.codes)) > 0 AS DOUBLE) AS postal_code_match, CAST(b.addr IN ('', 'nan') AS DOUBLE) AS is_addr_missing, CAST(c.target_id LIKE 'S2%' AS DOUBLE) AS is_source2 FROM cand c JOIN prof a ON a.entity_id = c.s1_id JOIN prof b ON b.entity_id = c.target_id", "clean", "keys", "prof")
def pair_numbers(r: fixture.Records) -> DataFrame:
    values = pairs.set_features()
    return _both(r).select("s1_id", "target_id", F.round(values["addr_num_jaccard"], 6).alias("addr_num_jaccard"), *[values[c].alias(c) for c in ("addr_num_overlap", "postal_code_match", "is_addr_missing")], F.col("target_id").startswith("S2").cast("double").alias("is_source2"))


@query()
def pair_features(r: fixture.Records) -> DataFrame:
    return pairs.full_features(_both(r))


@query()
def pair_features_fast(r: fixture.Records) -> DataFrame:
    return pairs.fast_features(_both(r))


@query("SELECT s1_id, target_id, CAST((s1_id, target_id) IN (SELECT (s1_id, target_id) FROM truth) AS INTEGER) AS label FROM (SELECT s1_id, target_id FROM cand UNION SELECT s1_id, target_id FROM truth)", *_BLOCK)
def pair_labels(r: fixture.Records) -> DataFrame:
    return pairs.labelled_pairs(_found(r), r.truth, True)


# scores, matches, metrics


@query("SELECT s1_id, target_id, round(p * 0.5 + p * p * 0.25 + 0.25 * 0.5, 6) AS p FROM scored", *_SCORE)
def ensemble_blend(r: fixture.Records) -> DataFrame:
    rows = _scored(r).select("s1_id", "target_id", F.col("p").alias("p_a"), (F.col("p") * F.col("p")).alias("p_b"), F.lit(0.5).alias("p_c"))
    return rows.select("s1_id", "target_id", F.round(scoring.blend({"p_a": 2.0, "p_b": 1.0, "p_c": 1.0}), 6).alias("p"))


@query()
def heuristic_match(r: fixture.Records) -> DataFrame:
    return scoring.heuristic_match(pairs.full_features(_both(r)))


@query("SELECT s1_id, target_id, round(p, 6) AS p FROM matches", *_SCORE, "winners", "matches")
def injective_assign(r: fixture.Records) -> DataFrame:
    return assign.injective(_scored(r), THRESHOLD).withColumn("p", F.round("p", 6))


@query()
def hungarian_assign(r: fixture.Records) -> DataFrame:
    return assign.one_to_one(_scored(r), THRESHOLD)


@query(f"""SELECT threshold, {_MACRO} FROM (
  SELECT g.threshold, x.nt, CASE WHEN x.nt = 0 THEN CASE WHEN x.np = 0 THEN 1.0 ELSE 0.0 END WHEN x.tp = 0 THEN 0.0 ELSE CAST(x.tp AS DOUBLE) / x.np END AS precision,
    CASE WHEN x.nt = 0 THEN CASE WHEN x.np = 0 THEN 1.0 ELSE 0.0 END WHEN x.tp = 0 THEN 0.0 ELSE CAST(x.tp AS DOUBLE) / x.nt END AS recall,
    CASE WHEN x.nt = 0 THEN CASE WHEN x.np = 0 THEN 1.0 ELSE 0.0 END WHEN x.tp = 0 THEN 0.0
         ELSE 1.25 * (CAST(x.tp AS DOUBLE) / x.np) * (CAST(x.tp AS DOUBLE) / x.nt) / (0.25 * (CAST(x.tp AS DOUBLE) / x.np) + (CAST(x.tp AS DOUBLE) / x.nt)) END AS f
  FROM (SELECT unnest({list(assign.GRID)})::DOUBLE AS threshold) g JOIN LATERAL (
    SELECT s.entity_id, coalesce(t.nt, 0) AS nt, coalesce(w.np, 0) AS np, coalesce(w.tp, 0) AS tp FROM s1 s
    LEFT JOIN (SELECT s1_id, count(*) AS nt FROM truth GROUP BY 1) t ON t.s1_id = s.entity_id
    LEFT JOIN (SELECT w0.s1_id, count(*) AS np, count(t0.s1_id) AS tp FROM winners w0 LEFT JOIN truth t0 ON t0.s1_id = w0.s1_id AND t0.target_id = w0.target_id WHERE w0.p >= g.threshold GROUP BY 1) w ON w.s1_id = s.entity_id) x ON TRUE)
GROUP BY threshold""", *_SCORE, "winners")
def threshold_sweep(r: fixture.Records) -> DataFrame:
    return assign.threshold_sweep(_scored(r), r.truth, r.spine)


_EVAL = (*_SCORE, "winners", "matches", "per")


@query("SELECT s1_id, np, nt, tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f, 6) AS f FROM per", *_EVAL)
def entity_fbeta(r: fixture.Records) -> DataFrame:
    out = metrics.with_scores(metrics.counts(assign.injective(_scored(r), THRESHOLD), r.truth, r.spine))
    return out.select("s1_id", "np", "nt", "tp", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f")])


@query(f"SELECT {_MACRO} FROM per", *_EVAL)
def macro_fbeta(r: fixture.Records) -> DataFrame:
    return metrics.evaluate(assign.injective(_scored(r), THRESHOLD), r.truth, r.spine)


@query("SELECT count(*) AS entities, count(*) FILTER (WHERE np > 0) AS matched, count(*) FILTER (WHERE np > 1) AS multi_matched, count(*) FILTER (WHERE np = 0) AS singletons, CAST(sum(np) AS BIGINT) AS links FROM per", *_EVAL)
def match_summary(r: fixture.Records) -> DataFrame:
    return profile.match_summary(assign.injective(_scored(r), THRESHOLD), r.spine)


_OUTPUT = """SELECT s1.entity_id AS source1_entity_id, coalesce((SELECT string_agg(target_id, ',' ORDER BY target_id) FROM matches m WHERE m.s1_id = s1.entity_id), '') AS matched_entity_ids,
coalesce((SELECT string_agg(target_id, ',' ORDER BY target_id) FROM (SELECT s1_id, target_id FROM cand UNION SELECT s1_id, target_id FROM matches) c WHERE c.s1_id = s1.entity_id), '') AS candidate_entity_ids FROM s1"""


def _output(r: fixture.Records) -> DataFrame:
    found = _found(r)
    return export.format_output(assign.injective(linkage.word_jaccard(_both(r, found)), THRESHOLD), found, r.spine)


@query(_OUTPUT, *_SCORE, "winners", "matches")
def format_output(r: fixture.Records) -> DataFrame:
    return _output(r)


_BROKEN = f"""broken AS (
  SELECT * FROM ({_OUTPUT}) WHERE source1_entity_id NOT LIKE '%7'
  UNION ALL SELECT * FROM ({_OUTPUT}) WHERE source1_entity_id LIKE '%4'
  UNION ALL SELECT 'X' || source1_entity_id, matched_entity_ids, '' FROM ({_OUTPUT}) WHERE source1_entity_id LIKE '%2')"""
SQL_PARTS["broken"] = _BROKEN


@query("""SELECT 'missing_entities' AS "check", count(*) AS failures FROM s1 WHERE entity_id NOT IN (SELECT source1_entity_id FROM broken)
UNION ALL SELECT 'unknown_entities', count(*) FROM broken WHERE source1_entity_id NOT IN (SELECT entity_id FROM s1)
UNION ALL SELECT 'repeated_entities', count(*) FROM (SELECT source1_entity_id FROM broken GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'matches_without_candidate', count(*) FROM broken WHERE len(list_filter(string_split(matched_entity_ids, ','), lambda x: x <> '' AND NOT list_contains(string_split(candidate_entity_ids, ','), x))) > 0""", *_SCORE, "winners", "matches", "broken")
def validate_output(r: fixture.Records) -> DataFrame:
    """An output that lacks, repeats and makes up rows, and has matches that are no candidates."""
    whole, i = _output(r), F.col("source1_entity_id")
    made_up = whole.where(i.endswith("2")).select(F.concat(F.lit("X"), i).alias("source1_entity_id"), "matched_entity_ids", F.lit("").alias("candidate_entity_ids"))
    return export.validate(whole.where(~i.endswith("7")).unionByName(whole.where(i.endswith("4"))).unionByName(made_up), r.spine)


@query(f"""SELECT source1_entity_id, CASE WHEN source1_entity_id LIKE '%3' THEN '' WHEN source1_entity_id LIKE '%5' THEN 'S2-x,S3-y' ELSE matched_entity_ids END AS matched_entity_ids,
  CASE WHEN source1_entity_id LIKE '%3' THEN '' WHEN source1_entity_id LIKE '%5' THEN 'S2-x,S3-y' ELSE candidate_entity_ids END AS candidate_entity_ids FROM ({_OUTPUT})""", *_SCORE, "winners", "matches")
def merge_outputs(r: fixture.Records) -> DataFrame:
    """A whole run whose candidates lack the matches, then a later one over some entities; an entity of neither has an empty row."""
    whole, i = _output(r), F.col("source1_entity_id")
    less = F.array_join(F.array_except(F.split("candidate_entity_ids", ","), F.split("matched_entity_ids", ",")), ",")
    first = whole.where(~i.endswith("3")).withColumn("candidate_entity_ids", less)
    later = whole.where(i.endswith("5")).select("source1_entity_id", F.lit("S3-y, S2-x").alias("matched_entity_ids"), F.lit("S2-x").alias("candidate_entity_ids"))
    return export.merge_outputs([first, later], r.spine)


@query(f"SELECT source1_entity_id, matched_entity_ids, candidate_entity_ids FROM ({_OUTPUT})", *_SCORE, "winners", "matches")
def link_tsv(r: fixture.Records) -> DataFrame:
    """Three tab-separated files in, the two result files out, and these read again."""
    spark = r.raw.sparkSession
    folder = f"{tables.shared_dir(spark)}/link-{uuid.uuid4().hex}"
    paths = [f"{folder}/{s}.tsv" for s in ("S1", "S2", "S3")]
    for source, path in zip(("S1", "S2", "S3"), paths, strict=True):
        tables.write_tsv(r.raw.where(F.col("source") == source).select(*schema.SOURCE_COLUMNS), path, one_file=False)
    linkage.link_files(spark, paths[0], paths[1:], folder, linkage.word_jaccard, linkage.Settings(cap=CAP, k=K, threshold=THRESHOLD))
    read = lambda name, columns: tables.read_tsv(spark, f"{folder}/{name}.tsv", fields=T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return read("matching_results", schema.GROUND_TRUTH_COLUMNS).join(read("candidate_pairs", schema.CANDIDATE_COLUMNS), "source1_entity_id")


@query(f"SELECT o.source1_entity_id, o.matched_entity_ids FROM ({_OUTPUT}) o JOIN s1 x ON x.entity_id = o.source1_entity_id WHERE x.country IN ('en', 'fr')", *_SCORE, "winners", "matches")
def link_countries(r: fixture.Records) -> DataFrame:
    """Keys hold the country, so a run over some countries gives their rows of the run over all."""
    settings = linkage.Settings(cap=CAP, k=K, threshold=THRESHOLD, countries=("en", "fr"))
    matches, found = linkage.link_by(r.s1, r.s23, linkage.word_jaccard, settings)
    return linkage.result(matches, found, linkage.only(r.s1, settings.countries)).select(*schema.GROUND_TRUTH_COLUMNS)


def _length_scorer() -> scoring.PairScorer:
    """A scorer that SQL can repeat: a logit that falls with the difference of lengths."""
    return lambda some: np.array([2.0 - abs(len(a) - len(b)) / 8.0 for a, b in some])


@query("SELECT c.s1_id, c.target_id, round(1 / (1 + exp(-(2.0::DOUBLE - abs(length('Business: ' || a.name || ' | Address: ' || a.addr) - length('Business: ' || b.name || ' | Address: ' || b.addr)) / 8.0::DOUBLE))), 6) AS p FROM cand c JOIN clean a ON a.entity_id = c.s1_id JOIN clean b ON b.entity_id = c.target_id", *_BLOCK)
def rerank_fixed(r: fixture.Records) -> DataFrame:
    pair = text.format_pair(F.col("p1.clean_name"), F.col("p1.clean_addr"), F.col("p2.clean_name"), F.col("p2.clean_addr"))
    both = _both(r).select("s1_id", "target_id", pair.alias("t")).select("s1_id", "target_id", "t.text1", "t.text2")
    return scoring.rerank(both, _length_scorer, "logit").withColumn("p", F.round("p", 6))


# profiling and sampling


@query("SELECT source, count(*) AS total_rows, count(*) FILTER (WHERE coalesce(business_name, '') IN ('', 'nan')) AS missing_names, count(*) FILTER (WHERE coalesce(business_address, '') IN ('', 'nan')) AS missing_addresses, count(*) FILTER (WHERE coalesce(country, '') IN ('', 'nan')) AS missing_countries FROM src GROUP BY source UNION ALL SELECT 'ground_truth', count(*), 0, 0, 0 FROM gt")
def file_stats(r: fixture.Records) -> DataFrame:
    return profile.file_stats(**{s: r.raw.where(F.col("source") == s) for s in ("S1", "S2", "S3")}, ground_truth=r.gt)


@query("SELECT source, country, count(*) AS row_count, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY source), 2) AS pct FROM src GROUP BY source, country")
def country_breakdown(r: fixture.Records) -> DataFrame:
    return profile.country_breakdown(r.raw)


_COUNT = "CASE WHEN trim(coalesce(matched_entity_ids, '')) = '' OR matched_entity_ids = 'nan' THEN 0 ELSE length(matched_entity_ids) - length(replace(matched_entity_ids, ',', '')) + 1 END"


@query(f"SELECT CAST({_COUNT} AS INTEGER) AS num_matches, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM gt GROUP BY 1")
def gt_cardinality(r: fixture.Records) -> DataFrame:
    return profile.gt_cardinality(r.gt)


@query(f"SELECT count(*) AS total_s1, count(*) FILTER (WHERE n = 0) AS singleton_count, round(100.0 * count(*) FILTER (WHERE n = 0) / count(*), 2) AS singleton_pct, round(avg(n), 6) AS avg_matches, CAST(median(n) AS DOUBLE) AS median_matches, CAST(max(n) AS BIGINT) AS max_matches, CAST(min(n) AS BIGINT) AS min_matches, CAST(sum(n) AS BIGINT) AS total_links FROM (SELECT {_COUNT} AS n FROM gt)")
def gt_summary(r: fixture.Records) -> DataFrame:
    return profile.gt_summary(r.gt)


@query("SELECT source, round(avg(length(business_name)), 2) AS avg_name_len, CAST(max(length(business_name)) AS BIGINT) AS max_name_len, round(avg(length(business_name) - length(replace(business_name, ' ', '')) + 1), 2) AS avg_name_words, round(avg(length(business_address)), 2) AS avg_addr_len, CAST(max(length(business_address)) AS BIGINT) AS max_addr_len, round(avg(length(business_address) - length(replace(business_address, ' ', '')) + 1), 2) AS avg_addr_words FROM src GROUP BY source")
def text_profile(r: fixture.Records) -> DataFrame:
    return profile.text_profile(r.raw)


@query("SELECT source, count(*) AS n FROM src WHERE country = 'en' GROUP BY source")
def filter_count(r: fixture.Records) -> DataFrame:
    return profile.filter_count(r.raw, "en")


@query("SELECT entity_id, country FROM src ORDER BY md5(entity_id || ':42'), entity_id LIMIT 60")
def hash_sample(r: fixture.Records) -> DataFrame:
    return sampling.sample(r.raw.select("entity_id", "country"), 60)


@query("SELECT entity_id, row_number() OVER (ORDER BY md5(entity_id || ':42'), entity_id) <= floor(count(*) OVER () * CAST(0.9 AS DOUBLE)) AS is_train FROM s1")
def holdout_split(r: fixture.Records) -> DataFrame:
    return sampling.holdout_split(r.s1.select("entity_id"), 0.9)


@query("SELECT entity_id, source FROM s23 WHERE entity_id IN (SELECT target_id FROM truth) UNION SELECT entity_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(entity_id || ':42'), entity_id) AS n FROM s23) WHERE (source = 'S2' AND n <= 30) OR (source = 'S3' AND n <= 50)")
def cohesive_pool(r: fixture.Records) -> DataFrame:
    return sampling.cohesive_pool(r.s23.select("entity_id", "source"), r.truth, {"S2": 30, "S3": 50})


# whole runs


@query()
def train_validate_link(r: fixture.Records) -> DataFrame:
    """The cap on keys, the models, their rounds and their blend are those of linkage.Settings."""
    settings = linkage.Settings(k=K)
    is_train = F.substring(F.md5("entity_id"), 1, 1) < "c"
    trained = linkage.train_and_validate(r.s1, r.s23, r.truth, is_train, settings)
    matches, found = linkage.link(r.s1, r.s23, trained, settings, True)
    return linkage.result(matches, found, r.s1)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, candidates, word Jaccard, assignment and macro scores of the record view."""
    r = fixture.Records(spark, sf_dir)
    matches, _ = linkage.link_by(r.s1, r.s23, linkage.word_jaccard, linkage.Settings(cap=CAP, k=K, threshold=THRESHOLD))
    return linkage.report(matches, r.truth, r.s1)

