"""Profiles of records and features of candidate pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlink.functions import similarity, text

FEATURES = (
    "name_fuzz_ratio", "name_token_sort", "name_token_set", "name_ngram_jaccard", "name_word_jaccard", "name_exact_match", "name_len_diff", "name_len_ratio",
    "addr_token_sort", "addr_token_set", "addr_word_jaccard", "addr_num_jaccard", "addr_num_overlap", "postal_code_match", "is_addr_missing", "is_source2",
)
#: Below this token-set ratio of names the other features are not worked out.
SHORT_CUT = 0.35


def profiles(records: DataFrame) -> DataFrame:
    """Each record's clean values, sets and flags, worked out once however many pairs it is in."""
    clean = records.select("entity_id", text.clean_name(F.col("business_name")).alias("clean_name"), text.clean_address(F.col("business_address")).alias("clean_addr"))
    name, addr = F.col("clean_name"), F.col("clean_addr")
    return clean.select(
        "entity_id", "clean_name", "clean_addr",
        text.char_ngrams(name).alias("name_ngrams"), F.array_distinct(text.word_tokens(name)).alias("name_words"), F.array_distinct(text.word_tokens(addr)).alias("addr_words"),
        text.words(name).alias("name_tokens"), text.words(addr).alias("addr_tokens"), text.numbers(addr).alias("addr_nums"), text.postal_codes(addr).alias("postal_codes"),
        addr.isin("", "nan").cast("double").alias("is_missing_addr"), F.length(name).alias("name_len"),
    )


def paired(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs with both profiles as structs p1 and p2; pairs without a profile on both sides drop out."""
    side = lambda df, key, name: df.select(F.col("entity_id").alias(key), F.struct(*[c for c in df.columns if c != "entity_id"]).alias(name))
    return pairs.join(side(left, "s1_id", "p1"), "s1_id").join(side(right, "target_id", "p2"), "target_id")


def set_features(p1: str = "p1", p2: str = "p2") -> dict[str, Column]:
    """The features that are built in."""
    a, b = (lambda c: F.col(f"{p1}.{c}")), (lambda c: F.col(f"{p2}.{c}"))
    longest = F.greatest(a("name_len"), b("name_len"))
    return {
        "name_ngram_jaccard": similarity.jaccard(a("name_ngrams"), b("name_ngrams")),
        "name_word_jaccard": similarity.jaccard(a("name_words"), b("name_words")),
        "name_exact_match": ((a("clean_name") != "") & (a("clean_name") == b("clean_name"))).cast("double"),
        "name_len_diff": F.abs(a("name_len") - b("name_len")).cast("double"),
        "name_len_ratio": F.when(longest > 0, F.least(a("name_len"), b("name_len")) / longest).otherwise(1.0),
        "addr_word_jaccard": similarity.jaccard(a("addr_words"), b("addr_words")),
        "addr_num_jaccard": similarity.jaccard(a("addr_nums"), b("addr_nums")),
        "addr_num_overlap": F.size(F.array_intersect(a("addr_nums"), b("addr_nums"))).cast("double"),
        "postal_code_match": F.arrays_overlap(a("postal_codes"), b("postal_codes")).cast("double"),
        "is_addr_missing": b("is_missing_addr"),
    }


def _edit_features() -> dict[str, Column]:
    a, b = (lambda c: F.col(f"p1.{c}")), (lambda c: F.col(f"p2.{c}"))
    return {
        "name_fuzz_ratio": similarity.edit_ratio(a("clean_name"), b("clean_name")),
        "name_token_sort": similarity.token_sort_ratio(a("name_tokens"), b("name_tokens")),
        "name_token_set": similarity.token_set_ratio(a("name_tokens"), b("name_tokens")),
        "addr_token_sort": similarity.token_sort_ratio(a("addr_tokens"), b("addr_tokens")),
        "addr_token_set": similarity.token_set_ratio(a("addr_tokens"), b("addr_tokens")),
    }


def full_features(both: DataFrame) -> DataFrame:
    """Every feature as defined, and composite_score, from pairs with p1 and p2. Address features are 0 without a target address."""
    values = _edit_features() | set_features() | {"is_source2": F.col("target_id").startswith("S2").cast("double")}
    out = both.select("s1_id", "target_id", *[values[c].alias(c) for c in FEATURES])
    there = F.col("is_addr_missing") == 0
    gone = {c: F.when(there, F.col(c)).otherwise(0.0) for c in FEATURES if c.startswith("addr_") or c == "postal_code_match"}
    return out.withColumns(gone).withColumn("composite_score", composite())


def composite() -> Column:
    """A weighted mean of the main features; names alone where the target has no address."""
    name_set, hint = F.col("name_token_set"), ((F.col("postal_code_match") > 0) | (F.col("addr_num_overlap") > 0)).cast("double")
    both = 0.45 * name_set + 0.20 * F.col("name_ngram_jaccard") + 0.25 * F.col("addr_token_set") + 0.10 * hint
    return F.when(F.col("is_addr_missing") == 1, 0.9 * name_set + 0.1 * F.col("name_token_sort")).otherwise(both)


def fast_features(both: DataFrame) -> DataFrame:
    """What models take: as full_features, with short cuts that change values.

    Equal names fix the name features. A token-set ratio of names under
    SHORT_CUT stands for both other ratios and leaves the rest at 0. Address
    features need an address on both sides. The token-set ratio is worked out
    first; other edit ratios see empty strings where their value is fixed, which
    the kernel answers at once.
    """
    a, b = (lambda c: F.col(f"p1.{c}")), (lambda c: F.col(f"p2.{c}"))
    none = F.array().cast("array<string>")
    same = (a("clean_name") != "") & (a("clean_name") == b("clean_name"))
    base = both.withColumn("same", same).withColumn("token_set", F.when(F.col("same"), 1.0).otherwise(similarity.token_set_ratio(F.when(same, none).otherwise(a("name_tokens")), F.when(same, none).otherwise(b("name_tokens")))))
    base = base.withColumn("short", ~F.col("same") & (F.col("token_set") < SHORT_CUT)).withColumn("addr", (b("is_missing_addr") == 0) & (a("clean_addr") != "") & ~F.col("short"))
    full = ~F.col("same") & ~F.col("short")
    some = lambda cond, c: F.when(cond, c).otherwise("")
    words = lambda cond, c: F.when(cond, c).otherwise(none)
    values = set_features()
    name = lambda c: F.when(F.col("same"), 1.0).when(F.col("short"), F.col("token_set")).otherwise(c)
    rest = lambda c: F.when(F.col("same"), 1.0).when(F.col("short"), 0.0).otherwise(c)
    addr = lambda c: F.when(F.col("addr"), c).otherwise(0.0)
    on = F.col("addr")
    out = base.select(
        "s1_id", "target_id",
        name(similarity.edit_ratio(some(full, a("clean_name")), some(full, b("clean_name")))).alias("name_fuzz_ratio"),
        name(similarity.token_sort_ratio(words(full, a("name_tokens")), words(full, b("name_tokens")))).alias("name_token_sort"),
        F.col("token_set").alias("name_token_set"),
        rest(values["name_ngram_jaccard"]).alias("name_ngram_jaccard"), rest(values["name_word_jaccard"]).alias("name_word_jaccard"),
        F.col("same").cast("double").alias("name_exact_match"), values["name_len_diff"].alias("name_len_diff"), values["name_len_ratio"].alias("name_len_ratio"),
        addr(similarity.token_sort_ratio(words(on, a("addr_tokens")), words(on, b("addr_tokens")))).alias("addr_token_sort"),
        addr(similarity.token_set_ratio(words(on, a("addr_tokens")), words(on, b("addr_tokens")))).alias("addr_token_set"),
        *[addr(values[c]).alias(c) for c in ("addr_word_jaccard", "addr_num_jaccard", "addr_num_overlap", "postal_code_match")],
        values["is_addr_missing"].alias("is_addr_missing"), F.col("target_id").startswith("S2").cast("double").alias("is_source2"),
    )
    return out.withColumn("composite_score", composite())


def labelled_pairs(found: DataFrame, truth: DataFrame, with_all_true: bool) -> DataFrame:
    """(s1_id, target_id, label): candidates, and for training all true pairs as well."""
    pairs = found.select("s1_id", "target_id")
    pairs = pairs.union(truth.select("s1_id", "target_id")) if with_all_true else pairs
    true = truth.select("s1_id", "target_id", F.lit(1).alias("hit")).distinct()
    return pairs.distinct().join(true, ["s1_id", "target_id"], "left").select("s1_id", "target_id", F.coalesce("hit", F.lit(0)).alias("label"))
