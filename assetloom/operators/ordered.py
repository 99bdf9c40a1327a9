"""Ordered analytics: ranks, running sums, latest records, argmax with stable ties."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def renumbered(rows: DataFrame, partition: str, order: str, visible: Column) -> DataFrame:
    """WIN-02, SRC-19, JON-22: a dense number for visible rows; hidden rows have none."""
    running = F.sum(F.when(visible, 1).otherwise(0)).over(W.partitionBy(partition).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("number", F.when(visible, running).cast("long"))


def indexed(rows: DataFrame, partition: list[str], order: str) -> DataFrame:
    """WIN-03."""
    return rows.withColumn("index", F.row_number().over(W.partitionBy(*partition).orderBy(order)).cast("long"))


def shared_folder(spark: SparkSession) -> None:
    """The folder the cluster names in spark.checkpoint.dir; one of its own only where none is set on a single machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="assetloom-"))


def settled(df: DataFrame) -> DataFrame:
    """`df` as a table of its own in the shared folder: nothing of its plan is left, nor of what the plan implies.

    A checkpoint keeps estimates and constraints, which grow with every round of a loop that joins its own results.
    """
    shared_folder(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def running(rows: DataFrame, group: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """`rows` with the sum of `value` over those before them in their group.

    Rows are dealt by ranges of (group, order), and each range starts from the sum of those before it, so that a group of
    any size spreads over tasks.
    """
    shared_folder(rows.sparkSession)
    part, before = f"{name}_part", f"{name}_before"
    ranges = rows.withColumn(name, value).repartitionByRange(*group, *order).withColumn(part, F.spark_partition_id()).checkpoint()
    sums = ranges.groupBy(*group, part).agg(F.sum(name).alias("total"))
    earlier = W.partitionBy(*group) if group else W.partitionBy(F.lit(1))
    sums = sums.withColumn(before, F.coalesce(F.sum("total").over(earlier.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    sums = sums.select(F.col(part).alias("p"), before, *[F.col(g).alias(f"g{k}") for k, g in enumerate(group)])
    same = F.col(part) == F.col("p")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"g{k}"))
    out = ranges.withColumn(name, F.coalesce(F.sum(name).over(W.partitionBy(*group, part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return out.join(sums, same).withColumn(name, F.col(name) + F.col(before)).select(*rows.columns, name)


def running_max(rows: DataFrame, group: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """WIN-06: `rows` with the greatest `value` so far in their group, by ranges as `running`; null before the first value."""
    shared_folder(rows.sparkSession)
    part = f"{name}_part"
    ranges = rows.withColumn(name, value).repartitionByRange(*group, *order).withColumn(part, F.spark_partition_id()).checkpoint()
    most = ranges.groupBy(*group, part).agg(F.max(name).alias("most"))
    earlier = W.partitionBy(*group) if group else W.partitionBy(F.lit(1))
    most = most.withColumn("earlier", F.max("most").over(earlier.orderBy(part).rowsBetween(W.unboundedPreceding, -1)))
    most = most.select(F.col(part).alias("p"), "earlier", *[F.col(g).alias(f"g{k}") for k, g in enumerate(group)])
    same = F.col(part) == F.col("p")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"g{k}"))
    out = ranges.withColumn(name, F.max(name).over(W.partitionBy(*group, part).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)))
    return out.join(most, same).withColumn(name, F.greatest(name, "earlier")).select(*rows.columns, name)


def progress(rows: DataFrame, partition: str, order: str, size: str) -> DataFrame:
    """WIN-05, WIN-06: what is done after each row, its share of all, and the share shown, which never falls as no size is below 0."""
    total = rows.groupBy(F.col(partition).alias("of")).agg(F.sum(F.greatest(F.col(size), F.lit(0))).alias("all"))
    out = running(rows, [partition], [F.col(order)], F.greatest(F.col(size), F.lit(0)), "done").withColumn("done", F.col("done") + F.greatest(F.col(size), F.lit(0)))
    out = out.join(total.hint("rebalance"), F.col(partition).eqNullSafe(F.col("of")))
    share = F.bround(F.col("done") / F.greatest(F.col("all"), F.lit(1)), 6)
    return out.select(*rows.columns, "done", share.alias("share"), share.alias("shown"))


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """WIN-08, SNK-16: the newest record of each key."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def best(rows: DataFrame, key: str, quality: list[str], order: str, columns: list[str]) -> DataFrame:
    """AGG-20, AGG-08, SRT-07: the row of the highest quality, of equals the first."""
    rank = F.struct(*[F.col(c) for c in quality], (-F.col(order)).alias("_first"))
    return rows.groupBy(key).agg(F.max_by(F.struct(order, *columns), rank).alias("_b")).select(key, "_b.*")


def upper_median(x: str) -> Column:
    """AGG-12: the element in the middle, of two the higher."""
    a = F.array_sort(F.collect_list(x))
    return F.get(a, F.floor(F.size(a) / 2).cast("int"))


def exact_upper_median(rows: DataFrame, key: str, x: str) -> DataFrame:
    """AGG-12 for groups of any size: equal values are counted first, and the middle is where their running sum passes half."""
    values = rows.where(F.col(x).isNotNull()).groupBy(key, x).agg(F.count("*").alias("n"))
    total = values.groupBy(F.col(key).alias("of")).agg(F.sum("n").alias("all"))
    placed = running(values, [key], [F.col(x)], F.col("n"), "before").join(total.hint("rebalance"), F.col(key).eqNullSafe(F.col("of")))
    middle = F.floor(F.col("all") / 2)
    return placed.where((F.col("before") <= middle) & (middle < F.col("before") + F.col("n"))).select(key, F.col(x).alias("upper_median"))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """SNK-06: rows of the new table in place of those with their key, and all others."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
