"""The audit log: JSON lines as a batch or a stream, filters, windows, and changes between snapshots."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ..functions import templates
from ..operators import graph
from ..sources import markdown
from ..sources.store import stored

RAW = "Timestamp STRING, TraceId STRING, SpanId STRING, SeverityNumber INT, SeverityText STRING, EventName STRING, Body STRING, Attributes MAP<STRING, STRING>, Resource MAP<STRING, STRING>"


def _flat(raw: DataFrame) -> DataFrame:
    """Lines that aren't JSON objects, or without a name, are skipped."""
    a = F.col("Attributes")
    return raw.where("EventName IS NOT NULL").select(
        F.to_timestamp("Timestamp").alias("timestamp"), F.col("TraceId").alias("trace"), F.col("SpanId").alias("span"), F.col("SeverityText").alias("severity"),
        F.col("EventName").alias("event"), F.col("Body").alias("body"), a["status"].alias("status"), a["target"].alias("target"), a["target_to"].alias("target_to"), a.alias("attributes"),
    )


def read(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(spark.read.schema(RAW).option("mode", "PERMISSIVE").json(folder))


def stream(spark: SparkSession, folder: str, files_per_batch: int = 100, late: str = "10 minutes") -> DataFrame:
    """The folder's events as they arrive; state and windows wait for those up to `late` behind."""
    return _flat(spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_batch).json(folder)).withWatermark("timestamp", late)


def select(events: DataFrame, trace: str | None = None, status: str | Column | None = None, target: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Exact trace and status; target as source or destination; both time bounds inclusive."""
    if trace is not None:
        events = events.where(F.col("trace") == trace)
    if status is not None:
        events = events.where(F.col("status") == status)
    if target is not None:
        events = events.where((F.col("target") == target) | (F.col("target_to") == target))
    if since is not None:
        events = events.where(F.col("timestamp") >= F.to_timestamp(F.lit(bound(since))))
    if until is not None:
        events = events.where(F.col("timestamp") <= F.to_timestamp(F.lit(bound(until, end=True))))
    return events


def newest(events: DataFrame, limit: int = 20) -> DataFrame:
    return events.orderBy(F.desc("timestamp"), F.desc("span")).limit(limit)


def windowed(events: DataFrame, every: str = "1 hour") -> DataFrame:
    """Events by tumbling window and name; on a stream, windows close when the watermark passes."""
    return events.groupBy(F.window("timestamp", every).alias("w"), "event").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event", "n")


def once(events: DataFrame) -> DataFrame:
    """Each span once; on a stream the state goes with the watermark."""
    if events.isStreaming:
        return events.dropDuplicatesWithinWatermark(["span"])
    return events.dropDuplicates(["span"])


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) between two snapshots (path, hash): added, modified or deleted."""
    both = old.select("path", F.col("hash").alias("_old")).join(new.select("path", F.col("hash").alias("_new")), "path", "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "modified")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")


def bound(text: str, end: bool = False) -> str:
    """A time bound as written: a day is its first moment, or its last one for the end; anything else is an instant."""
    if len(text) == 10:
        return text + ("T23:59:59.999999Z" if end else "T00:00:00Z")
    return text


def _raw(events: DataFrame) -> DataFrame:
    """Events as the log has them, so that `read` and `stream` give them back; columns that are missing are null."""
    have = lambda c, kind="string": F.col(c) if c in events.columns else F.lit(None).cast(kind)
    own = F.map_from_entries(F.array_compact(F.array(*[F.when(have(c).isNotNull(), F.struct(F.lit(c).alias("k"), have(c).alias("v"))) for c in ("status", "target", "target_to")])))
    rest = F.map_filter(F.coalesce(have("attributes", "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("status", "target", "target_to"))
    return events.select(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("Timestamp"), have("trace").alias("TraceId"), F.col("span").cast("string").alias("SpanId"), have("severity").alias("SeverityText"), F.col("event").alias("EventName"),
        have("body").alias("Body"), F.map_concat(rest, own).alias("Attributes"), F.date_format("timestamp", "yyyy-MM-dd").alias("day"),
    )


def append(events: DataFrame, folder: str, retention: str | None = "90d", cap_bytes: int | None = 256 << 20):
    """Appends a batch, or starts a stream that appends, to one folder a day (day=YYYY-MM-DD) of JSON lines.

    Old days go after each batch: those beyond `retention` (see templates.seconds), then the oldest ones while the whole
    log has more than `cap_bytes`; the newest day stays. For a stream the checkpoint is the folder's _checkpoint.
    """
    daily = _raw(events)
    if not daily.isStreaming:
        daily.write.mode("append").partitionBy("day").json(folder)
        return prune(daily.sparkSession, folder, retention, cap_bytes)

    def step(batch: DataFrame, number: int) -> None:
        # a batch that runs again replaces its own files
        batch.write.mode("overwrite").partitionBy("day").json(f"{folder}/batch={number}")
        prune(batch.sparkSession, folder, retention, cap_bytes)

    return daily.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/_checkpoint")


def expired(days: DataFrame, today: str, keep_days: int | None, cap_bytes: int | None) -> DataFrame:
    """(day): of days(day, bytes), those to drop. As many rows as days, so one window over all is small."""
    newest_first = Window.orderBy(F.desc("day"))
    ranked = days.withColumns({"rank": F.row_number().over(newest_first), "upto": F.sum("bytes").over(newest_first)})
    old = F.lit(False) if keep_days is None else F.col("day") < F.date_format(F.date_sub(F.to_date(F.lit(today)), keep_days), "yyyy-MM-dd")
    large = F.lit(False) if cap_bytes is None else (F.col("upto") > cap_bytes) & (F.col("rank") > 1)
    return ranked.where(old | large).select("day")


def prune(spark: SparkSession, folder: str, retention: str | None, cap_bytes: int | None, today: str | None = None) -> list[str]:
    """Deletes the folders of expired days; returns those days."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [p for pattern in ("day=*", "batch=*/day=*") for p in (fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")) or [])]
    sizes: dict[str, int] = {}
    for p in parts:
        day = p.getPath().getName().removeprefix("day=")
        sizes[day] = sizes.get(day, 0) + fs.getContentSummary(p.getPath()).getLength()
    if not sizes:
        return []
    keep = None if retention is None or (s := templates.seconds(retention)) is None else s // 86_400
    days = spark.createDataFrame(list(sizes.items()), "day string, bytes long")
    gone = sorted(r["day"] for r in expired(days, today or date.today().isoformat(), keep, cap_bytes).collect())
    for p in parts:
        if p.getPath().getName().removeprefix("day=") in gone:
            fs.delete(p.getPath(), True)
    return gone


def refreshed(old: dict[str, DataFrame], parsed: DataFrame, gone: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """The relations (see markdown.relations) after some documents changed: their rows are replaced by those of `parsed`,
    those of `gone`(path) go, and links are resolved again: all of them if old["links"] has no `status` yet, else those
    that may lead elsewhere now (see `affected`). `files`(path) are those after the change; old["files"], if it is there,
    those before (else the old documents count).
    """
    new = markdown.relations(parsed)
    touched = parsed.select("path").unionByName(gone.select("path")).distinct()
    out = {}
    for name, key in (("documents", "path"), ("headings", "doc_path"), ("block_ids", "doc_path"), ("diagnostics", "doc_path")):
        out[name] = old[name].select(*new[name].columns).join(touched.withColumnRenamed("path", key), key, "left_anti").unionByName(new[name])
    rest = old["links"].join(touched.withColumnRenamed("path", "source_path"), "source_path", "left_anti")
    columns, known = new["links"].columns, ["candidates", "n_candidates", "resolved_path", "status", "reason"]
    if "status" not in rest.columns:
        out["links"] = graph.resolve(rest.select(*columns).unionByName(new["links"]), files, out["documents"], out["headings"], out["block_ids"], graph.aliases_of(out["documents"]))
        return out
    before = old.get("files", old["documents"]).select("path")
    group = ["source_path", "kind", "target"]
    stale = stored(affected(rest, old["documents"], parsed_documents=new["documents"], touched=touched, before=before, after=files.select("path")), "affected")
    again = stored(rest.join(stale, group, "left_semi").select(*columns).unionByName(new["links"]), "again")
    needed = stored(graph.link_keys(again).select("key").distinct(), "needed")
    near = lambda frame: frame.withColumn("key", F.explode(graph.document_keys(frame))).join(needed, "key", "left_semi").drop("key").distinct()
    paths = near(files.select("path", F.lit(None).cast("string").alias("stem"))).select("path")
    owners = graph.aliases_of(out["documents"])
    owners = owners.join(needed.where("key LIKE 'alias:%'").select(F.substring("key", 7, 1 << 30).alias("alias")), "alias", "left_semi")
    docs = near(out["documents"].select("path", "stem")).unionByName(out["documents"].select("path", "stem").join(owners.select(F.col("doc_path").alias("path")).unionByName(again.select(F.col("source_path").alias("path"))), "path", "left_semi")).distinct()
    solved = graph.resolve(again, paths, docs, out["headings"], out["block_ids"], owners)
    out["links"] = rest.join(stale, group, "left_anti").select(*columns, *known).unionByName(solved)
    return out


def affected(links: DataFrame, old_documents: DataFrame, *, parsed_documents: DataFrame, touched: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(source_path, kind, target) of the resolved links that may lead elsewhere now.

    Where a link leads is decided by its keys: the paths that it tries, the stem and the alias that it names. The keys that
    changed are those of paths that came or went, and the aliases that touched documents had or have; links that led to
    a touched document are looked at too, as its headings and block ids may be others. Everything else stays as it is.
    """
    came_or_went = before.join(after, "path", "left_anti").unionByName(after.join(before, "path", "left_anti"))
    moved = came_or_went.withColumn("stem", F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", ""))
    keys = moved.select(F.explode(graph.document_keys(moved)).alias("key"))
    aliases = graph.aliases_of(old_documents.join(touched, "path", "left_semi").select("path", "metadata")).unionByName(graph.aliases_of(parsed_documents.select("path", "metadata")))
    keys = keys.unionByName(aliases.select(F.concat(F.lit("alias:"), "alias").alias("key"))).distinct()
    asked = graph.link_keys(links.select("source_path", "kind", "target").distinct())
    by_key = asked.join(keys, "key", "left_semi").select("source_path", "kind", "target")
    led = links.join(touched.withColumnRenamed("path", "resolved_path"), "resolved_path", "left_semi").select("source_path", "kind", "target")
    return by_key.unionByName(led).distinct()


def maintain(source: DataFrame, target: str, checkpoint: str, parts: int = 64, keep: int = 2):
    """A stream of snapshot rows (path, hash, seen, ...) into versions of latest rows, dealt into `parts` by path.

    A micro-batch rewrites the parts that its paths fall into and no others: version n's folder has those only, and
    `current` reads each part from its newest version. A batch that runs again writes the same folder. A part's versions
    before the last `keep` go.
    """
    spark = source.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("path").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "path"]), "seen").alias("r")).select("path", "r.*")
        latest = latest.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(parts)).cast("int"))
        before = current(spark, target, latest.drop("part"), below=number)
        touched = latest.select("part").distinct()  # `parts` rows at most
        old = before.join(F.broadcast(touched), "part", "left_semi").join(latest.select("path"), "path", "left_anti")
        both = old.select(*latest.columns).unionByName(latest)
        both.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{target}/version={number}")
        for p, versions in _versions(spark, target).items():
            for v in sorted(versions)[:-keep]:
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/version={v}/part={p}")
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def _versions(spark: SparkSession, target: str) -> dict[int, list[int]]:
    """The complete versions that each part has."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/version=*/part=*")
    found: dict[int, list[int]] = {}
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for p in fs.globStatus(path) or []:
        version = p.getPath().getParent()
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(version, "_SUCCESS")):
            found.setdefault(int(p.getPath().getName()[5:]), []).append(int(version.getName()[8:]))
    return found


def current(spark: SparkSession, target: str, like: DataFrame, below: int | None = None) -> DataFrame:
    """The snapshot that `maintain` keeps, with its part; `like` has its columns. `below`: as of an earlier batch."""
    best = {p: max(v) for p, vs in _versions(spark, target).items() if (v := [x for x in vs if below is None or x < below])}
    schema = StructType([f for f in like.schema if f.name != "part"]).add("version", IntegerType()).add("part", IntegerType())
    if not best:
        return spark.createDataFrame([], schema).drop("version")
    return spark.read.schema(schema).option("basePath", target).parquet(*[f"{target}/version={v}/part={p}" for p, v in best.items()]).drop("version")
