"""What the operators share: reading, names that clash with nothing, checkpoints, ranks, words and null handling."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: White space of the word contract (a regular-expression class body).
WS = r"\x20\x09-\x0D"
WORD = rf"[^{WS}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Aside:
    """A table whose columns are named by their places (in_0, in_1, ...), so that no helper column clashes with one.

    `back` gives them their names again, beside the results. A column of the input that is named like a result (in any
    case) is kept as `<name>_input`.
    """

    def __init__(self, df: DataFrame) -> None:
        self.columns = df.columns
        self.rows = df.toDF(*[f"in_{k}" for k in range(len(df.columns))])

    def __contains__(self, name: str) -> bool:
        return name.lower() in [c.lower() for c in self.columns]

    def __call__(self, name: str) -> str:
        """Where the column of that name is."""
        return f"in_{[c.lower() for c in self.columns].index(name.lower())}"

    def back(self, rows: DataFrame, results: list[str] | None = None) -> DataFrame:
        results = results or []
        made = {r.lower() for r in results}
        taken = made | {c.lower() for c in self.columns}
        out = []
        for k, name in enumerate(self.columns):
            if name.lower() in made:
                while name.lower() in taken:
                    name += "_input"
                taken.add(name.lower())
            out.append(F.col(f"in_{k}").alias(name))
        return rows.select(*out, *results)


def with_results(df: DataFrame, results: dict[str, Column]) -> DataFrame:
    """`df` with columns computed from it. A column of `df` named like one (in any case) is kept as `<name>_input`."""
    names = Aside(df)
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
    return names.back(df.select(*quoted, *results.values()).toDF(*names.rows.columns, *results), list(results))


#: Rows and bytes of the batches that Python workers get, where the session doesn't say otherwise.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Python workers get small batches from here on. These are settings of the session; only their defaults are lowered."""
    for name, least, value in (("maxRecordsPerBatch", 10_000, BATCH_ROWS), ("maxBytesPerBatch", 1 << 25, BATCH_BYTES)):
        try:
            if int(spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("b")) >= least:
                spark.conf.set(f"spark.sql.execution.arrow.{name}", str(value))
        except PySparkException:  # this version of Spark has no such setting
            pass


def trimmed(results: Iterator) -> Iterator:
    """The results of a task; afterwards its worker, which others use again, gives back the memory that it took."""
    yield from results
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def mapped(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """`df.mapInArrow(work, schema)` in small batches and with `trimmed` workers."""
    small_batches(df.sparkSession)
    return df.mapInArrow(lambda batches: trimmed(work(batches)), schema)


def portions(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """The texts in portions of a bounded number of bytes, each with the place where it begins; a longer text is one."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start, n = 0, len(texts)
    while start < n:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield start, texts.slice(start, stop - start).to_pylist()
        start = stop


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; one of its own only where none is set on a single machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="assetloom-checkpoint-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> str:
    """Write a table to the shared folder; its path."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: columns that a later step lacks aren't read."""
    return df.sparkSession.read.parquet(written(df, name))


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that `written` made and nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt anew, so that a join by a key that it was grouped by deals both sides.

    Spark splits a partition of a hot key at run time only where both sides of the join are dealt for it.
    """
    return df.hint("rebalance")


def running(rows: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """`rows` with the sum of `value` over those before them within `group`, in the order of `order`.

    Rows are dealt by ranges of (group, order), so that a group of any size spreads over tasks, and each range starts
    from the sum of those before it. `rows` should be cheap to read twice, and `order` should tell rows apart.
    """
    part, total, before = f"{name}_part", f"{name}_total", f"{name}_before"
    ranges = checkpointed(rows.withColumn(name, value).repartitionByRange(*group, *order).withColumn(part, F.spark_partition_id()))
    sums = ranges.groupBy(*group, part).agg(F.sum(name).alias(total))
    earlier = W.partitionBy(*group) if group else W.partitionBy(F.lit(1))
    sums = sums.withColumn(before, F.coalesce(F.sum(total).over(earlier.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    sums = sums.select(*[F.col(g).alias(f"{name}_g{k}") for k, g in enumerate(group)], F.col(part).alias(f"{name}_p"), before)
    within = W.partitionBy(*group, part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = ranges.withColumn(name, F.coalesce(F.sum(name).over(within), F.lit(0)))
    same = F.col(part) == F.col(f"{name}_p")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"{name}_g{k}"))
    return out.join(sums, same).withColumn(name, F.col(name) + F.col(before)).select(*rows.columns, name)


def n_words(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
