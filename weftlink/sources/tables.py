"""Reading and writing of record tables, ground truth, results and models."""

from __future__ import annotations

import json
import re
import tempfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftlink import schema
from weftlink.functions import text


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors must share; only a local master, as in tests, may use one of its machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and re.match(r"local(\[|$)", spark.sparkContext.master):
        found = tempfile.mkdtemp(prefix="weftlink-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not found:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


def use_checkpoints(spark: SparkSession) -> None:
    """Lets checkpoint() write to the shared folder, unless another is set."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def read_tsv(spark: SparkSession, path: str, nrows: int | None = None, usecols: Sequence[str] | None = None, fields: T.StructType = schema.SOURCE, order_by: str | None = None) -> DataFrame:
    """Tab-separated strings with a header; missing fields are empty strings. The columns asked for are all that is parsed.

    nrows takes the first rows in the order of a column (the first one, unless order_by names another), so it is the same each time.
    """
    df = spark.read.csv(path, sep=schema.DELIMITER, header=True, schema=fields, encoding=schema.ENCODING, quote="", enforceSchema=True)
    df = df.select(*usecols) if usecols else df
    df = df.na.fill("")
    return df if nrows is None else df.orderBy(order_by or df.columns[0]).limit(nrows)


def chunks(df: DataFrame, rows: int = schema.CHUNK_ROWS) -> Iterator[pd.DataFrame]:
    """df as pandas frames of at most rows rows, one partition at a time on the driver."""
    held: list = []
    for row in df.toLocalIterator(prefetchPartitions=False):
        held.append(row)
        if len(held) == rows:
            yield pd.DataFrame(held, columns=df.columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=df.columns)


def file_metadata(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(name, path, size_mb, exists) through the file system of each path, so any store that Spark reads will do."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    rows = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        there = fs.exists(path)
        rows.append((p.rstrip("/").rsplit("/", 1)[-1], p, round(fs.getContentSummary(path).getLength() / 2**20, 2) if there else 0.0, there))
    return spark.createDataFrame(rows, "name string, path string, size_mb double, exists boolean")


def ground_truth_edges(gt: DataFrame) -> DataFrame:
    """(s1_id, target_id), a row for each distinct true pair; entities without a match have none (their ids are the spine)."""
    ids = text.split_ids(F.col("matched_entity_ids"))
    return gt.select(F.trim("source1_entity_id").alias("s1_id"), F.explode(ids).alias("target_id")).distinct()


def ground_truth_spine(gt: DataFrame) -> DataFrame:
    return gt.select(F.trim("source1_entity_id").alias("s1_id")).distinct()


def write_tsv(df: DataFrame, path: str, one_file: bool = True) -> None:
    """Tab-separated with a header; one file for tables that a single reader expects, else one for each partition.

    The format has no quotes, so tabs and line ends within values become blanks; nothing else changes.
    """
    values = [F.regexp_replace(f.name, "[\\t\\r\\n]", " ").alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema]
    out = df.select(*values)
    out = out.coalesce(1) if one_file else out
    out.write.mode("overwrite").csv(
        path, sep=schema.DELIMITER, header=True, emptyValue="", quote="", encoding=schema.ENCODING, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def write_results(matches: DataFrame, candidates: DataFrame, folder: str) -> None:
    write_tsv(matches.select(*schema.GROUND_TRUTH_COLUMNS), f"{folder}/matching_results.tsv")
    write_tsv(candidates.select(*schema.CANDIDATE_COLUMNS), f"{folder}/candidate_pairs.tsv")


def write_by_country(df: DataFrame, path: str) -> None:
    """One job for all countries, a folder for each, in place of appending country by country."""
    df.write.mode("overwrite").partitionBy("country").parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def save_bundle(models: dict[str, PipelineModel], facts: dict, folder: str) -> None:
    """Models, and facts (weights, threshold) as one JSON line, which is written last: a folder without it is no bundle."""
    spark = SparkSession.active()
    for name, model in models.items():
        save_model(model, f"{folder}/models/{name}")
    spark.createDataFrame([(json.dumps({**facts, "models": list(models)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/facts")


def load_bundle(folder: str) -> tuple[dict[str, PipelineModel], dict] | None:
    """(models, facts) of save_bundle; None where there is no whole bundle, so that the caller trains one."""
    spark = SparkSession.active()
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/facts/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        return None
    facts = json.loads(spark.read.text(f"{folder}/facts").first().value)
    return {name: PipelineModel.load(f"{folder}/models/{name}") for name in facts.pop("models")}, facts


def load_model(path: str) -> PipelineModel | None:
    """The saved model; None where there is none, so that the caller trains one. Other errors are raised."""
    spark = SparkSession.active()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return PipelineModel.load(path)
