"""Scratch tables in the folder that all executors share, and functions that travel with their tasks."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

#: So much of the files under a table goes to one part of ``spread``.
SPREAD_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder is set only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="quarrygraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage for loops."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` over parts whose number follows the files that ``df`` is made from, so that a part, and what a
    task holds of it, does not grow with them. Where a size is unknown there are ``spark.sql.shuffle.partitions`` at least."""
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = [x for x in sizes if x < 1 << 50]
    n = max(spark.sparkContext.defaultParallelism, -(-sum(known) // SPREAD_BYTES))
    return df.repartition(n if len(known) == len(sizes) else max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def by_value(module_name: str) -> None:
    """Ship a module's functions with the tasks, so that executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
