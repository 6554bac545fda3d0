"""Exact-size samples and splits that are the same each time.

Rows are ordered by a hash of their id and a seed; a sample of n is a top-n, and
a split cuts that order. The hash is MD5, so any engine can repeat the choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlink import schema


def order_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def head(df: DataFrame, n: int, id_col: str = "entity_id") -> DataFrame:
    return df.orderBy(id_col).limit(n)


def sample(df: DataFrame, n: int | None, seed: int | None = schema.SEED, id_col: str = "entity_id") -> DataFrame:
    """Exactly n rows (all, if there are fewer or n is None or not above 0); without a seed the first n by id."""
    if n is None or n <= 0:
        return df
    return head(df, n, id_col) if seed is None else df.orderBy(order_key(id_col, seed), id_col).limit(n)


def load_sample(tables: dict[str, DataFrame], key: str, n: int, method: str = "reservoir", seed: int | None = schema.SEED) -> DataFrame:
    if key not in tables:
        raise ValueError(f"unknown table {key!r}; there are {sorted(tables)}")
    if method not in ("head", "reservoir"):
        raise ValueError(f"unknown method {method!r}")
    return sample(tables[key], n, None if method == "head" else seed)


def holdout_split(df: DataFrame, train_share: float = 0.9, seed: int = schema.SEED, id_col: str = "entity_id") -> DataFrame:
    """df with is_train: exactly floor(rows * train_share) rows, those of the smallest hashes.

    The cut is found from counts of hash prefixes, then of the full hashes under
    one prefix, so no task orders all rows.
    """
    keyed = df.withColumn("_h", order_key(id_col, seed))
    n = keyed.count()
    left, low = int(n * train_share), ""
    for width in (3, 6, 9):
        # the prefix within which the cut falls, and how many rows come before it
        counts = keyed.where(F.col("_h").startswith(low)).groupBy(F.substring("_h", 1, width).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
        for p, m in counts:
            if left < m:
                low = p
                break
            left -= m
        else:
            return keyed.withColumn("is_train", F.lit(True)).drop("_h")
        if m <= 1000:
            break
    edge = keyed.where(F.col("_h").startswith(low)).select("_h", F.col(id_col).cast("string").alias("i")).orderBy("_h", "i").limit(left + 1).collect()
    last = edge[left]
    before = (F.col("_h") < last[0]) | ((F.col("_h") == last[0]) & (F.col(id_col).cast("string") < last[1]))
    return keyed.withColumn("is_train", before).drop("_h")


def split_ground_truth(gt: DataFrame, ids: DataFrame, id_col: str = "entity_id") -> DataFrame:
    """Ground truth of some entities; an entity without a row has an empty list."""
    return ids.select(F.col(id_col).alias("source1_entity_id")).join(gt, "source1_entity_id", "left").select("source1_entity_id", F.coalesce("matched_entity_ids", F.lit("")).alias("matched_entity_ids"))


def benchmark_slice(s1: DataFrame, gt: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The first n entities by id and their ground truth."""
    some = head(s1, n)
    return some, gt.join(some.select(F.col("entity_id").alias("source1_entity_id")), "source1_entity_id", "left_semi")


def cohesive_pool(targets: DataFrame, truth: DataFrame, background: dict[str, int], seed: int = schema.SEED) -> DataFrame:
    """All targets of true pairs and, of each source, a sample of so many rows; each id once."""
    pool = targets.join(truth.select(F.col("target_id").alias("entity_id")), "entity_id", "left_semi")
    for prefix, n in sorted(background.items()):
        pool = pool.unionByName(sample(targets.where(F.col("entity_id").startswith(prefix)), n, seed))
    return pool.dropDuplicates(["entity_id"])
