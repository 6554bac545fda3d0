"""Session helpers: a shared folder for intermediate tables, and integer hashes."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import time
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id inside operators; it sorts before all others.
NULL_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors must share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and re.match(r"local(\[|$)", spark.sparkContext.master):
        # driver and executors are one process, as in tests
        found = tempfile.mkdtemp(prefix="weftlink-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    if not found:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


#: Bytes of an Arrow batch between Spark and Python, unless the session sets another number.
BATCH = 8 << 20


def with_small_batches(spark: SparkSession) -> SparkSession:
    """The session, in which a batch holds few long texts: each is there several times on its way."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(key, None) is None:
        spark.conf.set(key, str(BATCH))
    return spark


_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: later reads don't repeat its work and survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again."""
    for df in tables:
        if path := _paths.pop(df, None):
            sc = df.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def free_shuffles(spark: SparkSession) -> None:
    """Asks the driver's collector to find ended plans, whose shuffle files Spark then removes; else they wait for chance.

    Twice, as the events of the last job still hold its plan for a moment.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def id_or_min(name: str) -> Column:
    """An integer id as a long, with null as NULL_ID."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def id_back(name: str) -> Column:
    return F.when(F.col(name) != NULL_ID, F.col(name))
