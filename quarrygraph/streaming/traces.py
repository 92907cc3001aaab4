"""Trace ingestion as a stream: each micro-batch is merged into the stored observations of one folder.

``foreachBatch`` writes a new version per batch id; a batch that is run again after a failure overwrites its own
version from the same predecessor, so counts are added exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.traces import merge
from ..schema import OBSERVATION
from ..session import shared_dir


def _read(spark: SparkSession, path: str, batch: int) -> DataFrame | None:
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={batch}/_SUCCESS")
    if batch < 0 or not fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
        return None
    return spark.read.schema(OBSERVATION).parquet(f"{path}/batch={batch}")


def merge_stream(entries: DataFrame, path: str, seq: str = "seq", project: str = "", zero: bool = False):
    """A streaming writer of merged observations; start it with a trigger and a checkpoint location."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        merge(batch, _read(spark, path, batch_id - 1), seq, project, zero).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return entries.writeStream.foreachBatch(step)


def observations(spark: SparkSession, path: str) -> DataFrame:
    """The newest version."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    ids = [int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(root) if x.getPath().getName().startswith("batch=")] if fs.exists(root) else []
    ids = [i for i in ids if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={i}/_SUCCESS"))]
    return _read(spark, path, max(ids)) if ids else spark.createDataFrame([], OBSERVATION)


def run_once(entries: DataFrame, name: str, seq: str = "seq", project: str = "", zero: bool = False) -> DataFrame:
    """Merge everything the source has now, in its micro-batches, and return the observations."""
    import uuid

    base = f"{shared_dir(entries.sparkSession)}/{name}-{uuid.uuid4().hex}"
    q = merge_stream(entries, f"{base}/out", seq, project, zero).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return observations(entries.sparkSession, f"{base}/out")


def windowed(entries: DataFrame, lateness: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Calls and errors by window and callee, with late entries dropped beyond the watermark."""
    errors = F.count_if(F.coalesce(F.col("status_code").try_cast("int") >= 400, F.lit(False)))
    return entries.withWatermark("ts", lateness).groupBy(F.window("ts", width), "callee").agg(F.sum("count").alias("calls"), errors.alias("errors"))
