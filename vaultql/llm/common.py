"""What the text operators share: shared-folder tables, Arrow batches, word rules, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\f\r"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# -- tables in the folder that all executors share ---------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset a local session gets a folder of its own; a cluster, whose
    machines don't share local folders, gets an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vaultql-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: cuts lineage and survives lost executors. `by`: a column of
    few values to lay it out by.

    The table goes with `discard`, or when this Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vaultql-{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # once the table is there, nothing reads this query's shuffles again
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    atexit.register(_remove, spark, path)
    made = spark.read.schema(df.schema).parquet(path)
    made._vq_path = path
    return made


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` made, once all that was planned on them has been written in turn."""
    for t in tables:
        _remove(t.sparkSession, t._vq_path)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


# -- Arrow batches -----------------------------------------------------------------------------


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes, without decoding."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def column_strings(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def with_columns(
    df: DataFrame,
    fields: list[tuple[str, str]],
    task: Callable[[], Callable[[pa.RecordBatch], list]],
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns `keep` of df (all if None) and new columns that a Python task computes by Arrow batch.

    `task` runs once in each task and returns the function that turns a batch into the new columns.
    A column of df whose name is among the new ones gives way to the new one.
    """
    names = [n for n, _ in fields]
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])
    types = [_arrow(t) for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = task()
        for batch in batches:
            for part in slices(batch):
                made = [pa.array(v, t) for v, t in zip(make(part), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in kept] + made, names=kept + names)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A batch in parts of a few rows, so that what a task holds doesn't follow Spark's batch size."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _arrow(ddl: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(T._parse_datatype_string(ddl))


# -- words -------------------------------------------------------------------------------------


def ascii_lower(c):
    return F.translate(c, UPPER, LOWER)


#: Keeps 0-9, a-z and all bytes of non-ASCII characters; A-Z become a-z; the rest become spaces.
ALNUM_TABLE = bytes(b if b >= 128 or chr(b).isalnum() and not chr(b).isupper() else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def alnum_words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of letters and digits, any non-ASCII character among them."""
    return text.translate(ALNUM_TABLE).split() if text else []


def blank_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words between ASCII white space."""
    return text.lower().split() if text else []


# -- connected components ----------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, component), a written table: the smallest node that each node of edges(a, b) reaches.

    Alternates large-star and small-star steps, which only group by a node and join to its minimum: no group is
    ever gathered, and the edges never outgrow the input. Every round is written to the shared folder.
    """
    now = written(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), "edges")
    before = None
    while (mark := _fingerprint(now)) != before:
        before = mark
        both = now.unionByName(now.selectExpr("b AS a", "a AS b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(low, "a").selectExpr("b AS a", "low AS b").where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").selectExpr("b AS a", "low AS b").unionByName(low.selectExpr("a", "low AS b"))
        old, now = now, written(small.where("a <> b").distinct(), "edges")
        discard(old)
    made = written(now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node"), "components")
    discard(now)
    return made


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
