"""Incremental work as Structured Streaming: idempotent imports, deliveries by policy, and an append-only log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """STR-01: new files of a folder as a stream of (path, size_bytes, modified, sha256)."""
    stream = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return stream.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def imported_once(stream: DataFrame, library: str, checkpoint: str) -> StreamingQuery:
    """STR-01: each content once, whatever the number of files with it; a run again imports nothing twice.

    What was imported is known by the library itself, cut by the first digits of the hash, so no state grows with it: a
    batch reads the hashes of those folders only that its own contents belong to.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows = rows.groupBy("sha256").agg(F.min_by(F.struct(*rows.columns), "path").alias("one")).select("one.*").withColumn("prefix", F.substring("sha256", 1, 2)).persist()
        try:
            wanted = [r["prefix"] for r in rows.select("prefix").distinct().collect()]  # 256 at most
            before = spark.read.schema("sha256 string, prefix string").parquet(library).where(F.col("prefix").isin(*wanted)).select("sha256")
            fresh = rows.join(before, "sha256", "left_anti")
        except Exception as e:  # no library yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            fresh = rows
        fresh.write.mode("append").partitionBy("prefix").parquet(library)
        rows.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def delivered(stream: DataFrame, done: str, policy: str, checkpoint: str) -> StreamingQuery:
    """STR-02: targets that the delivery table lacks under this policy, appended to it batch by batch."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows = rows.withColumn("policy", F.lit(policy)).dropDuplicates(["sha256", "policy"])
        try:
            before = spark.read.parquet(done).select("sha256", "policy")
            rows = rows.join(before, ["sha256", "policy"], "left_anti")
        except Exception as e:  # no delivery yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        rows.write.mode("append").parquet(done)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audit_log(events: DataFrame, path: str, most_rows: int = 1_000_000, keep: int = 0) -> None:
    """STR-03, SNK-12: events appended as JSON lines, in files of a bounded number of rows; beyond `keep` days the oldest go.

    Files are never rewritten: a day is a folder, and rotation drops whole folders.
    """
    rows = events.withColumn("day", F.current_date())
    rows.write.mode("append").option("maxRecordsPerFile", most_rows).partitionBy("day").json(path)
    if keep:
        jvm, conf = events.sparkSession.sparkContext._jvm, events.sparkSession.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(path)
        files = root.getFileSystem(conf)
        days = sorted(f.getPath().getName() for f in files.listStatus(root) if f.getPath().getName().startswith("day="))
        for day in days[:-keep]:
            files.delete(jvm.org.apache.hadoop.fs.Path(path, day), True)


def monitored(query: StreamingQuery, report: Callable[[int, int], None], cancelled: Callable[[], bool], every: float = 0.2) -> bool:
    """STR-04: reports the batch and its rows while the stream runs, and stops it when asked to; whether it ended by itself."""
    while query.isActive:
        if cancelled():
            query.stop()
            return False
        if progress := query.lastProgress:
            report(progress["batchId"], progress["numInputRows"])
        query.awaitTermination(every)
    return True


def tripped(events: DataFrame, key: str, at: str, minutes: int = 30) -> DataFrame:
    """STR-05: keys in their cool-down: those whose last failure is less than so many minutes before the newest event."""
    now = events.agg(F.max(at).alias("now"))
    last = events.where("failed").groupBy(key).agg(F.max(at).alias("last_failure"))
    return last.join(F.broadcast(now), F.lit(True)).where(F.col("now") < F.col("last_failure") + F.make_dt_interval(mins=F.lit(minutes))).select(key, "last_failure")
