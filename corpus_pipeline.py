"""From raw documents to token ids: quality, boilerplate lines, near duplicates, mixing, encoding.

Each stage reads all that the one before kept and returns the columns of its
input, but for the last, which returns token ids. Between stages the rows are a
Parquet table in the shared folder, so a lost executor repeats no earlier stage.

Edge cases. A null or empty text has the quality score of an empty one, no lines
to lose, no near duplicates and no tokens; it goes or stays by its score. Rows
without an id stay as others do and come back without one. Repeated rows are
copies of each other, of which near duplicates leave one; a document that the mix
takes twice is there twice. Long texts are read whole in each stage. An empty
table gives empty tables. Further columns, whatever their names, are kept up to
the last stage. Ties are settled as each operator says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.llm import _spark, bpe, line_dedup, mixing, neardup, quality

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.7 or more; the classifier learns from labels of documents in its input."""
    forest = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, forest, quality.THRESHOLD)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on more than a tenth of a source's documents go; n_chars follows the text."""
    out = line_dedup.drop_boilerplate(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that of the smallest id."""
    return neardup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to weights 3, 1, 2 in turn, 150 % of the words in all; a document taken twice is there twice."""
    return mixing.mixed_documents(docs, weights=[3, 1, 2], share=1.5, most=2.0, seed=17)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids as little-endian 32-bit integers, and digests of ids and of the decoded bytes.

    Workers keep half of the usual tables: they share an executor with a heap that earlier stages have filled.
    """
    return bpe.round_trip(docs, tables=0.5)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("lines", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Fitted trees and sampled hashes have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = _spark.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
