"""Relations written once and read many times, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. A local session without one gets a folder of its own; a cluster gets an error,
    as its machines don't share local folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vaultql-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(frame: DataFrame, name: str, by: str | None = None, order: tuple[str, ...] = (), parts: int = 1, path: str | None = None) -> DataFrame:
    """frame as a Parquet table, read back; it cuts lineage and outlives lost executors.

    With `by` the table has a folder for each value of that column, of which there are few. Its rows are dealt out evenly
    to `parts` tasks, so each folder has that many files at most, whichever value holds most rows. Files are sorted by `order`, so that their statistics serve filters.
    Without `path` the table is in the shared folder and goes when this process ends.
    """
    spark = frame.sparkSession
    where = path or f"{shared_folder(spark)}/vaultql-{uuid.uuid4().hex}/{name}"
    out = frame
    if by:
        out = out.repartition(parts, *frame.columns)
    if order:
        out = out.sortWithinPartitions(*([by] if by else []), *order)
    writer = out.write.mode("overwrite" if path else "errorifexists")
    (writer.partitionBy(by) if by else writer).parquet(where)
    if not path:
        atexit.register(_remove, spark, where)
    return spark.read.schema(frame.schema).parquet(where)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
