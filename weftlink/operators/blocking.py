"""Candidate generation by shared keys, and its evaluation.

The cap on a key counts target postings over all targets of the table at once
(or of each country, or whatever the scope column holds). It bounds what one key
can add to an entity's candidates, and it is applied before the join, so a word
that fills the corpus never meets itself there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlink import schema
from weftlink.functions import text
from weftlink.operators import vectors

# Words that make no key.
STOP_WORDS = (
    "the", "and", "co", "company", "services", "shop", "store", "center",
    "hotel", "restaurant", "solutions", "traders", "trading", "mart", "bazaar",
    "pvt", "ltd", "inc", "corp", "llc", "enterprises", "group", "associates",
)

Keys = Callable[[Column, Column, Column], Column]


def block_keys(clean_name: Column, raw_address: Column, clean_country: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Distinct keys of a record: start of the name, its words, postal codes, and numbers with the name's first letter."""
    tight = F.replace(clean_name, F.lit(" "), F.lit(""))
    key = lambda kind, value: F.concat(clean_country, F.lit(f":{kind}:"), value)
    none = F.array().cast("array<string>")
    start = F.when(F.length(tight) >= 3, F.array(key("np", F.substring(tight, 1, 4)))).otherwise(none)
    names = F.filter(text.words(clean_name), lambda w: (F.length(w) >= 3) & (~w.isin(*stop_words) if stop_words else F.lit(True)))
    first = F.when(clean_name == "", "x").otherwise(F.substring(clean_name, 1, 1))
    long_numbers = F.filter(text.numbers(raw_address), lambda x: F.length(x) >= 2)
    return F.array_distinct(
        F.concat(
            start,
            F.transform(names, lambda w: key("nw", w)),
            F.transform(text.postal_codes(raw_address), lambda x: key("pc", x)),
            F.transform(long_numbers, lambda x: key("num", F.concat(first, F.lit("_"), x))),
        )
    )


def postings(records: DataFrame, keys: Keys = block_keys, id_name: str = "entity_id") -> DataFrame:
    """(key, id): a row for each distinct key of each record. keys: from the clean name, the raw address and the clean country."""
    clean = records.select(
        F.col("entity_id").alias(id_name), text.clean_name(F.col("business_name")).alias("name"), F.coalesce("business_address", F.lit("")).alias("address"), text.clean_text(F.col("country")).alias("country"),
    )
    rows = clean.select(id_name, F.explode(keys(F.col("name"), F.col("address"), F.col("country"))).alias("key"))
    return rows.select("key", id_name).distinct()


def block_index(targets: DataFrame, cap: int = schema.MAX_BLOCK, keys: Keys = block_keys) -> DataFrame:
    """(key, target_id) of the keys that at most cap targets have; every key if cap is 0 or less.

    One shuffle by key serves the removal of doubles, the count and the join that follows.
    """
    index = postings(targets, keys, "target_id")
    if cap <= 0:
        return index
    few = index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") <= cap).select("key")
    return index.join(few, "key", "left_semi")


def candidates(index: DataFrame, records: DataFrame, k: int = schema.TOP_K, keys: Keys = block_keys) -> DataFrame:
    """(s1_id, target_id, shared): each record's k targets with the most shared keys, ties to smaller target ids.

    Pairs are dealt by record once, for their counts and for the choice of k.
    """
    pairs = postings(records, keys, "s1_id").join(index, "key").select("s1_id", "target_id").repartition("s1_id")
    shared = pairs.groupBy("s1_id", "target_id").agg(F.count("*").alias("shared"))
    order = Window.partitionBy("s1_id").orderBy(F.desc("shared"), "target_id")
    return shared.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).drop("at")


def union_candidates(**branches: DataFrame) -> DataFrame:
    """(s1_id, target_id, branches): pairs from any branch, with the names of those that have it, in order."""
    tagged = [df.select("s1_id", "target_id", F.lit(name).alias("branch")) for name, df in sorted(branches.items())]
    every = tagged[0]
    for df in tagged[1:]:
        every = every.unionByName(df)
    return every.groupBy("s1_id", "target_id").agg(text.fold_ids(F.col("branch")).alias("branches"))


def _written_out(records: DataFrame, is_query: bool = False) -> DataFrame:
    """(entity_id, text, terms): the whole record for an encoder; its name and address for weights of terms."""
    clean = records.select("entity_id", text.clean_name(F.col("business_name")).alias("name"), text.clean_address(F.col("business_address")).alias("address"), "country")
    name, address = F.col("name"), F.col("address")
    return clean.select("entity_id", text.format_record(name, address, F.col("country"), is_query).alias("text"), F.concat(name, F.lit(" "), address).alias("terms"))


def hybrid_candidates(
    records: DataFrame, targets: DataFrame, encoder: Callable[[], vectors.Encoder], logits: Callable[[Column], Column],
    cap: int = 200, k_exact: int = 4, k_dense: int = 6, k_sparse: int = 3, dims: int = 512, n_terms: int = 30,
) -> DataFrame:
    """(s1_id, target_id, branches): what shared keys, vectors of whole records and weighted terms find for each record.

    The encoder's vectors are cut to dims at length 1, so dense scores are cosines;
    logits: of a text's places, as an array of maps. A branch that fails is an error.
    """
    asked, rows = _written_out(records, is_query=True), _written_out(targets)
    encoded = lambda df: vectors.encode(df, vectors.unit(encoder, dims)).withColumnRenamed("entity_id", "id")
    weighted = lambda df: vectors.term_weights(df, logits, n_terms, "terms")
    return union_candidates(
        exact=candidates(block_index(targets, cap), records, k_exact),
        dense=vectors.dense_topk(encoded(asked), encoded(rows), k_dense).withColumnRenamed("query_id", "s1_id"),
        sparse=vectors.sparse_topk(weighted(asked), weighted(rows), k_sparse).withColumnRenamed("query_id", "s1_id"),
    )


def evaluate(found: DataFrame, truth: DataFrame, spine: DataFrame, n_targets: int) -> DataFrame:
    """One row: pair recall, reduction ratio, candidates an entity, totals and coverage of entities that have matches."""
    hits = truth.join(found.select("s1_id", "target_id").distinct(), ["s1_id", "target_id"], "left_semi").groupBy("s1_id").agg(F.count("*").alias("tp"))
    true = truth.groupBy("s1_id").agg(F.count("*").alias("nt"))
    cand = found.groupBy("s1_id").agg(F.countDistinct("target_id").alias("nc"))
    per = spine.select("s1_id").distinct().join(true, "s1_id", "left").join(hits, "s1_id", "left").join(cand, "s1_id", "left").na.fill(0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = per.agg(
        F.count("*").alias("n_s1"), total("nt").alias("total_true"), total("tp").alias("found_true"), total("nc").alias("total_candidates"),
        F.count_if(F.col("nt") > 0).alias("with_truth"), F.count_if((F.col("nt") > 0) & (F.col("tp") == F.col("nt"))).alias("fully_covered"), F.count_if(F.col("tp") > 0).alias("partly_covered"),
    )
    space = F.greatest(F.col("n_s1") * F.lit(n_targets), F.lit(1))
    share = lambda a, b, scale=1.0: F.round(F.when(b > 0, scale * a / b).otherwise(0.0), 6)
    return out.select(
        "*",
        share(F.col("found_true"), F.col("total_true")).alias("pair_recall"),
        F.round(1 - F.col("total_candidates") / space, 6).alias("reduction_ratio"),
        share(F.col("total_candidates"), F.col("n_s1")).alias("avg_candidates"),
        share(F.col("fully_covered"), F.col("with_truth"), 100.0).alias("full_coverage_pct"),
        share(F.col("partly_covered"), F.col("with_truth"), 100.0).alias("partial_coverage_pct"),
    )
