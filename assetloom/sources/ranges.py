"""Files of any size by byte ranges: executors open them where they are and read only what is asked for.

Spark's reader of binary files gives a whole file as one value, of 2 GB at most. Here rows hold paths, and Arrow's file
systems give seekable files in tasks. Members of packages are rows dealt over the cluster one by one, so that a package's
large members are read by different tasks, each in pieces of a bounded size.
"""

from __future__ import annotations

import hashlib
import re
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes read at a time.
PIECE = 1 << 20
#: Windows that are compared, and bytes of each.
SAMPLES, WINDOW = 48, 65_536


def opened(path: str) -> pa.NativeFile:
    """A seekable file by its path or URI."""
    uri = re.sub(r"^file:/+", "file:///", path)
    if "://" not in uri:
        return pa.fs.LocalFileSystem().open_input_file(uri)
    if uri.startswith("file:///"):
        from urllib.parse import unquote, urlparse

        return pa.fs.LocalFileSystem().open_input_file(unquote(urlparse(uri).path))
    files, inside = pa.fs.FileSystem.from_uri(uri)
    return files.open_input_file(inside)


_BROKEN = (zipfile.BadZipFile, KeyError, ValueError, NotImplementedError, RuntimeError, EOFError, OSError, zlib.error)


def directory(files: DataFrame) -> DataFrame:
    """SRC-01, SNK-07: (package, member, size, compressed, crc, error) from the central directories of packages (package)."""
    schema = "package string, member string, size long, compressed long, crc long, error string"
    names = ["package", "member", "size", "compressed", "crc", "error"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for package in batch.column(0).to_pylist():
                try:
                    with opened(package) as f, zipfile.ZipFile(f) as z:
                        rows = [(package, i.filename, i.file_size, i.compress_size, i.CRC, None) for i in z.infolist() if not i.is_dir()]
                except _BROKEN as e:
                    rows = [(package, None, None, None, None, f"{type(e).__name__}: {e}")]
                if rows:
                    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.select("package").mapInArrow(work, schema)


def hashed_members(files: DataFrame) -> DataFrame:
    """SUP-05, SCL-43, SNK-07: `directory` with `sha256` of each member, read in pieces; large members go to tasks of their own."""
    entries = directory(files)
    schema = "package string, member string, size long, compressed long, crc long, error string, sha256 string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, errors = [], batch.column(5).to_pylist()
            for k, (package, member) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                digest = None
                if member is not None:
                    try:
                        h = hashlib.sha256()
                        with opened(package) as f, zipfile.ZipFile(f) as z, z.open(member) as part:
                            while piece := part.read(PIECE):
                                h.update(piece)
                        digest = h.hexdigest()
                    except _BROKEN as e:
                        errors[k] = f"{type(e).__name__}: {e}"
                out.append(digest)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(errors, pa.string()), pa.array(out, pa.string())], ["package", "member", "size", "compressed", "crc", "error", "sha256"])

    return entries.repartition(F.xxhash64("package", "member")).mapInArrow(work, schema)


def _windows(n: int, samples: int, window: int) -> tuple[int, list[int]]:
    window = min(window, n)
    return window, [0] if window == n else [round(k * (n - window) / (samples - 1)) for k in range(samples)]


def aligned_share(a: str, b: str, samples: int = SAMPLES, window: int = WINDOW) -> float:
    """SCL-36: the share of equal bytes in evenly spread windows over the shorter of two files; only these are read."""
    with opened(a) as x, opened(b) as y:
        n = min(x.size(), y.size())
        window, places = _windows(n, samples, window)
        same = 0
        for p in places:
            x.seek(p)
            y.seek(p)
            same += int((np.frombuffer(x.read(window), dtype=np.uint8) == np.frombuffer(y.read(window), dtype=np.uint8)).sum())
        return same / (len(places) * window) if n else 0.0


def file_similarity(pairs: DataFrame) -> DataFrame:
    """SCL-36: pairs (a, b, path_a, path_b) with `similarity`, null where a file can't be read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                try:
                    out.append(aligned_share(a, b))
                except OSError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], ["a", "b", "path_a", "path_b", "similarity"])

    rows = pairs.select("a", "b", "path_a", "path_b")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(work, f"{kinds}, similarity double")


def damaged_copies(sources: DataFrame, least: float = 0.7) -> DataFrame:
    """JON-10: pairs (a < b, broken, similarity) of equally named sources of which one is damaged and whose bytes agree.

    sources: (id, name, path, width, height, duration_sec, size_bytes, error), `name` as `names.cleanup_name` gives it.
    Both have one size of picture, lengths within a quarter second and sizes of files within a factor of four; exactly one
    has an error. Broken ones meet sound ones only, by name, picture and quarter seconds, so groups of one name and length
    make broken times sound pairs.
    """
    at = F.floor(F.col("duration_sec") * 4)
    rows = sources.where("width > 0 AND height > 0 AND duration_sec > 0 AND name <> ''").withColumns({"bad": F.coalesce("error", F.lit("")) != "", "at": at})
    keep = lambda side: [F.col(c).alias(f"{c}_{side}") for c in ("id", "path", "duration_sec", "size_bytes")]
    broken = rows.where("bad").select("name", "width", "height", F.explode(F.array(F.col("at") - 1, F.col("at"), F.col("at") + 1)).alias("at"), *keep("x"))
    sound = rows.where("NOT bad").select("name", "width", "height", "at", *keep("y"))
    near = broken.join(sound, ["name", "width", "height", "at"]).where((F.abs(F.col("duration_sec_x") - F.col("duration_sec_y")) <= 0.25) & (F.least("size_bytes_x", "size_bytes_y") >= F.greatest("size_bytes_x", "size_bytes_y") * 0.25))
    met = file_similarity(near.select(F.col("id_x").alias("a"), F.col("id_y").alias("b"), F.col("path_x").alias("path_a"), F.col("path_y").alias("path_b")))
    return met.where(F.col("similarity") >= least).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("a").alias("broken"), "similarity")
