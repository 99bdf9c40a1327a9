"""State that lasts over restarts: cool-downs with timers, and a log that is cut and rotated by bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from assetloom.operators.ordered import running

#: Seconds of a cool-down, and the least that one may have.
COOLDOWN, LEAST_COOLDOWN = 30 * 60, 60
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TRANSITIONS = "app string, state string, at timestamp, until timestamp, reason string"


def _time(ms: int) -> pd.Timestamp:
    return pd.Timestamp(ms, unit="ms")


class Cooldown(StatefulProcessor):
    """One application's circuit: open from a failure until the cool-down of the last one is over."""

    def __init__(self, seconds: int) -> None:
        self.ms = 1000 * max(LEAST_COOLDOWN, seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "until long, reason string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.open.get()
        until, reason = (held[0], held[1]) if held else (None, None)
        failures: list[tuple[int, str]] = []
        for batch in rows:
            failed = batch[batch["failed"]]
            failures += zip((failed["at"].astype("datetime64[ms]").astype("int64")).tolist(), failed["reason"].tolist(), strict=True)
        out, before = [], until
        for at, why in sorted(failures, key=lambda x: x[0]):
            if until is not None and at >= until:  # it was over when this one came
                out.append((key[0], "closed", _time(until), _time(until), reason))
                until = None
            if until is None:
                out.append((key[0], "open", _time(at), _time(at + self.ms), why))
            until, reason = max(until or 0, at + self.ms), why
        if until != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.open.update((until, reason))
            self.handle.registerTimer(until)
        yield pd.DataFrame(out, columns=["app", "state", "at", "until", "reason"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.open.get()
        out = []
        if held and held[0] <= expiredTimerInfo.getExpiryTimeInMs():
            out.append((key[0], "closed", _time(held[0]), _time(held[0]), held[1]))
            self.open.clear()
        yield pd.DataFrame(out, columns=["app", "state", "at", "until", "reason"])

    def close(self) -> None:
        pass


def cooldowns(events: DataFrame, out: str, checkpoint: str, seconds: int = COOLDOWN, late: str = "1 minute") -> StreamingQuery:
    """STR-05: a stream of (app, at, failed, reason) to the circuits' changes, appended to `out` as Parquet.

    A failure opens its application's circuit, or holds it open for longer; a timer closes it when event time has passed the
    end of the cool-down. State is one row for each open circuit, goes when it closes, and is found again by a stream that is
    started anew with the same checkpoint.
    """
    spark = events.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)  # the query keeps what holds when it starts
    try:
        rows = events.select("app", "at", "failed", "reason").withWatermark("at", late)
        changed = rows.groupBy("app").transformWithStateInPandas(statefulProcessor=Cooldown(seconds), outputStructType=TRANSITIONS, outputMode="Append", timeMode="eventTime")
        return changed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before)


def in_cooldown(transitions: DataFrame, now: object) -> DataFrame:
    """STR-05: applications whose circuit is open at a time, by the stored changes."""
    last = transitions.where(F.col("at") <= now).groupBy("app").agg(F.max_by(F.struct("state", "until", "reason"), F.struct("at", (F.col("state") == "open").alias("o"))).alias("x"))
    return last.where("x.state = 'open'").select("app", "x.until", "x.reason")


def rotated_log(events: DataFrame, path: str, checkpoint: str, order: list[str], most_bytes: int = 5_000_000, keep: int = 10) -> StreamingQuery:
    """SNK-12, STR-03: a stream of events as JSON lines in segments of about `most_bytes` bytes, of which the newest `keep` stay.

    A batch's lines are laid in order and cut where their bytes pass a multiple of the bound, so a segment is larger than that
    by one line at most. A batch writes to folders of its own number and overwrites them when it is run again, so a crash
    neither loses nor repeats a line.
    """

    def batch(rows: DataFrame, number: int) -> None:
        if rows.isEmpty():
            return
        spark = rows.sparkSession
        lines = rows.select(*order, F.to_json(F.struct(*rows.columns)).alias("line")).withColumn("row", F.monotonically_increasing_id())
        laid = running(lines, [], [*order, "line", "row"], F.octet_length("line") + 1, "before")
        cut = laid.withColumn("segment", F.format_string("%012d-%08d", F.lit(number), F.floor(F.col("before") / most_bytes)))
        target = f"{path}/batch={number}"
        cut.repartition("segment").sortWithinPartitions("segment", "before").select("segment", F.col("line").alias("value")).write.mode("overwrite").partitionBy("segment").text(target)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(path)
        files = root.getFileSystem(conf)
        found = files.globStatus(jvm.org.apache.hadoop.fs.Path(path, "batch=*/segment=*"))
        for old in sorted((f.getPath() for f in found), key=lambda p: p.getName())[:-keep]:
            files.delete(old, True)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
