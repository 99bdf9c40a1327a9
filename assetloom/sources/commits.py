"""A table as a log of commits: numbered entries that only one writer can create, replayed by readers.

A commit is a Parquet table of changed rows (`op` is put or delete, with the key columns and the row) and an entry that
names it. An entry appears complete or not at all, under the next number, and never replaces one: it is written aside and
then renamed without overwriting (linked, on a local file system, where renaming would overwrite). So of two writers one
gets a number and the other learns of it. The loser looks at what was committed since it read: if a key of its own is among
it, it has lost and changes nothing; else it tries the next number. Readers take the last checkpoint and the entries behind
it, newest row of a key first. Tables that no entry names belong to writers that crashed or lost and are never read.
"""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DIGITS = 20


def create_once(spark: SparkSession, path: str, content: str) -> bool:
    """Create a file that appears whole or not at all; false, and nothing changed, where there is one of that path."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    final = jvm.org.apache.hadoop.fs.Path(path)
    files = final.getFileSystem(conf)
    aside = jvm.org.apache.hadoop.fs.Path(final.getParent(), f".{uuid.uuid4().hex}")
    stream = files.create(aside, False)
    stream.write(bytearray(content, "utf-8"))
    stream.close()
    try:
        if files.getUri().getScheme() == "file":
            os.link(aside.toUri().getPath(), final.toUri().getPath())
        else:
            kinds = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            kinds[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf).rename(aside, final, kinds)
        return True
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in e.java_exception.toString():
            return False
        raise
    finally:
        files.delete(aside, False)


class Conflict(Exception):
    """Somebody else has changed what a commit changes since it read the table."""


class CommitLog:
    """SNK-01, SRC-11, SNK-10: a catalog or a journal of intents at `root`, with rows told apart by `key`."""

    def __init__(self, spark: SparkSession, root: str, key: list[str]) -> None:
        self.spark, self.key = spark, key
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(conf)
        self.root = self._fs.makeQualified(self._path(root)).toString()
        self._fs.mkdirs(self._path(f"{self.root}/_log"))

    def _entries(self) -> dict[int, str]:
        """Paths of entries by number."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/_log"))]
        return {int(n[:_DIGITS]): f"{self.root}/_log/{n}" for n in names if len(n) == _DIGITS + 5 and n[:_DIGITS].isdigit() and n.endswith(".json")}

    def _read(self, path: str) -> dict:
        stream = self._fs.open(self._path(path))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _create(self, number: int, entry: dict) -> bool:
        """Whether the entry of that number is this one; false where there is another."""
        return create_once(self.spark, f"{self.root}/_log/{number:0{_DIGITS}d}.json", json.dumps(entry))

    def version(self) -> int:
        """The number of the last commit; 0 before the first."""
        return max(self._entries(), default=0)

    def _changes(self, after: int, until: int) -> DataFrame | None:
        """Changed rows of the commits in a range of numbers, with `_number`."""
        out = None
        for n, path in sorted(self._entries().items()):
            if after < n <= until and (at := self._read(path).get("table")):
                rows = self.spark.read.parquet(f"{self.root}/{at}").withColumn("_number", F.lit(n).cast("long"))
                out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def state(self, version: int | None = None) -> DataFrame | None:
        """The table as of a commit (the last one by default); null before the first."""
        until = self.version() if version is None else version
        points = [(n, e["checkpoint"]) for n, p in self._entries().items() if n <= until and "checkpoint" in (e := self._read(p))]
        begin, at = max(points, default=(0, None))
        rows = self._changes(begin, until)
        if at is not None:
            whole = self.spark.read.parquet(f"{self.root}/{at}").withColumns({"_op": F.lit("put"), "_number": F.lit(begin).cast("long")})
            rows = whole if rows is None else whole.unionByName(rows, allowMissingColumns=True)
        if rows is None:
            return None
        newest = rows.groupBy(*self.key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in self.key]), "_number").alias("_last"))
        kept = newest.where("_last._op = 'put'")
        return kept.select(*[F.col(c) if c in self.key else F.col(f"_last.{c}").alias(c) for c in rows.columns if c not in ("_op", "_number")])

    def commit(self, base: int, puts: DataFrame | None = None, deletes: DataFrame | None = None) -> int:
        """Commit rows to put and keys to delete, by one who read the table as of `base`; the commit's number.

        Raises `Conflict` where a commit since `base` has changed one of these keys. A key may be named once.
        """
        rows = None
        for df, op in ((puts, "put"), (deletes, "delete")):
            if df is not None:
                part = (df if op == "put" else df.select(*self.key)).withColumn("_op", F.lit(op))
                rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        if rows is None:
            raise ValueError("nothing to commit")
        at = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{at}")
        mine = self.spark.read.parquet(f"{self.root}/{at}")
        if not mine.groupBy(*self.key).count().where("count > 1").isEmpty():
            raise ValueError("a key is named twice")
        seen = base
        while True:
            last = self.version()
            if last > seen:
                theirs = self._changes(seen, last)
                if theirs is not None and not mine.join(theirs.select(*self.key).distinct(), self.key, "left_semi").isEmpty():
                    raise Conflict(f"commits {seen + 1} to {last} have changed the same rows")
                seen = last
            if self._create(seen + 1, {"table": at, "base": base}):
                return seen + 1

    def checkpoint(self) -> int:
        """Write the whole table beside the last commit, so that readers needn't replay what is before it; the number of the entry."""
        while True:
            last = self.version()
            rows = self.state(last)
            if rows is None:
                return 0
            at = f"data/{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.root}/{at}")
            if self._create(last + 1, {"checkpoint": at}):
                return last + 1
