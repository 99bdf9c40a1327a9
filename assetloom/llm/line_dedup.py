"""Operator 1: fuzzy line dedup by MinHash.

A line is compared without outer white space and in lower case; lines of white space alone are not compared and
stay. Lines are near-duplicates when the Jaccard similarity of their distinct character shingles (`SHINGLE`
characters; a shorter line is one shingle) is `THRESHOLD` or more. Of each component of near-duplicate lines
the one with the smallest (doc_id, line number) stays.

Equal lines are one item, by a 64-bit hash. Signatures are one-permutation MinHash: one hash a shingle,
its upper bits give the bin, empty bins borrow from the next full one. With few shingles most bins would borrow
alike, so below `FEW` distinct shingles the values are independent MinHash instead. A near-duplicate has up to
1 / `THRESHOLD` times as many shingles, so lines up to there get both kinds of bands. `BANDS` bands of `ROWS` values
give a recall of 0.998 at similarity 0.8 for lines of any length and more above, and few candidates among unlike
lines. Candidates are verified exactly and joined by distributed union-find.

The texts are read twice: once for the bands, and once for the lines' places, with the lines themselves only where
they have a candidate.

Cases: a null or empty text has no lines; ties are broken by line number; a row is known by its doc_id and text, so
rows of one doc_id (or none) and different texts are rows of their own, and of repeated rows one keeps its lines and
the others are gone; doc_ids may be of any type that has an order; an empty table gives an empty result; extra columns
pass through, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import minhash, neardup
from .common import Aside, checkpointed, mapped, portions, spread, stored
from .components import components

#: The shingle's length is a power of two.
SHINGLE, THRESHOLD, BANDS, ROWS = 8, 0.8, 12, 4
#: Distinct shingles below which a line's bins don't do (at 75, one permutation has the recall of independent values).
FEW = 80
#: Items that a task remembers to have seen.
REMEMBERED = 100_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLANK = " \t\n\x0b\x0c\r"


def lines_of(texts: list[str | None]) -> tuple[list[int], list[int], list[str], np.ndarray]:
    """Of all compared lines of the texts: the text's place, the line's number, the line as it is compared, and its hash."""
    owner, number, norms = [], [], []
    for k, text in enumerate(texts):
        if text:
            for i, raw in enumerate(text.split("\n")):
                norm = raw.strip(_BLANK).lower()
                if norm:
                    owner.append(k)
                    number.append(i)
                    norms.append(norm)
    return owner, number, norms, np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in norms], dtype=np.uint64).view(np.int64)


class Seen:
    """Which items weren't there before, as far as is remembered."""

    def __init__(self) -> None:
        self.items: set[int] = set()

    def fresh(self, items: np.ndarray) -> np.ndarray:
        if len(self.items) > REMEMBERED:
            self.items = set()
        out = np.zeros(len(items), dtype=bool)
        for k, x in enumerate(items.tolist()):
            if x not in self.items:
                self.items.add(x)
                out[k] = True
        return out


def shingle_hashes(lines: list[str], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every character shingle of every line, flat, and how many each line has."""
    data = np.frombuffer("".join(lines).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    length = np.array([len(x) for x in lines], dtype=np.int64)
    # A polynomial over the window, of twice the width at each step; windows that leave their line are dropped below.
    rolled = data + np.uint64(1)
    base, width = _BASE, 1
    while width < n:
        longer = rolled * base
        longer[:-width] += rolled[width:]
        rolled, base, width = longer, np.uint64(int(base) ** 2 & 0xFFFFFFFFFFFFFFFF), 2 * width
    at = np.cumsum(length) - length
    sizes = np.where(length > 0, np.maximum(length - n + 1, 1), 0)
    for i in np.flatnonzero((length > 0) & (length < n)).tolist():
        h = int(length[i])
        for c in data[at[i] : at[i] + length[i]].tolist():
            h = (h * int(_BASE) + c + 1) & 0xFFFFFFFFFFFFFFFF
        rolled[at[i]] = np.uint64(h)
    valid = np.ones(len(data), dtype=bool)
    for k in range(1, n):  # the last characters of a line begin no window, but for the first one of a short line
        valid[(at + length - k)[length > k]] = False
    return minhash.mixed(rolled[valid]), sizes


def one_permutation(values: np.ndarray, sizes: np.ndarray, bins: int) -> np.ndarray:
    """Signatures of shape (lines, bins) in 32 bits from one hash a shingle; every line has a shingle."""
    n = len(sizes)
    slot = np.repeat(np.arange(n, dtype=np.int64) * bins, sizes) + ((values >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    out = np.full(n * bins, 0xFFFFFFFF, dtype=np.uint32)
    np.minimum.at(out, slot, (values & np.uint64(0xFFFFFFFE)).astype(np.uint32))
    out = out.reshape(n, bins)
    empty = out == 0xFFFFFFFF
    # The next full bin to the right, around the end; how far it was becomes part of the value.
    place = np.where(empty, 2 * bins, np.arange(bins))
    both = np.concatenate([place, np.where(empty, 2 * bins, np.arange(bins) + bins)], axis=1)
    after = np.minimum.accumulate(both[:, ::-1], axis=1)[:, ::-1][:, :bins]
    taken = np.take_along_axis(out, after % bins, axis=1)
    return taken + ((after - np.arange(bins)) * 0x9E3779B1).astype(np.uint32)


def fewer_distinct(values: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """Which rows have fewer than n distinct values; n is well below 1024."""
    few = sizes < n
    slots = np.zeros((len(sizes), 1024), dtype=bool)
    slots[np.repeat(np.arange(len(sizes)), sizes), (values & np.uint64(1023)).astype(np.int64)] = True
    ends = np.cumsum(sizes)
    for k in np.flatnonzero(~few & (slots.sum(axis=1) < n)).tolist():  # only these need counting
        few[k] = len(np.unique(values[ends[k] - sizes[k] : ends[k]])) < n
    return few


def band_keys(values: np.ndarray, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, keys of shape (rows, BANDS)) of each kind of bands."""
    both = fewer_distinct(values, sizes, math.ceil(FEW / THRESHOLD))
    few = both.copy()
    ends = np.cumsum(sizes)
    for k in np.flatnonzero(both & (sizes >= FEW)).tolist():
        few[k] = len(np.unique(values[ends[k] - sizes[k] : ends[k]])) < FEW
    out = []
    for some, independent in ((~few, False), (both, True)):
        if some.any():
            part, of = values[np.repeat(some, sizes)], sizes[some]
            if independent:
                signature = minhash.signatures(part, of, BANDS * ROWS, 1)
            else:  # bins of a band lie far apart, as neighbours may have borrowed from one another
                signature = one_permutation(part, of, BANDS * ROWS).reshape(-1, ROWS, BANDS).swapaxes(1, 2).reshape(len(of), -1)
            out.append((np.flatnonzero(some), minhash.bands(signature, ROWS)))
    return out


def banded(rows: DataFrame) -> DataFrame:
    """Rows of `neardup.Bands` for the lines of a column `text`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = neardup.Bands(), Seen()
        for batch in batches:
            for _, texts in portions(batch.column(0)):
                _, _, norms, items = lines_of(texts)
                fresh = np.flatnonzero(seen.fresh(items))
                if len(fresh):
                    for at, keys in band_keys(*shingle_hashes([norms[k] for k in fresh.tolist()])):
                        yield from bands.add(items[fresh[at]], keys)
        yield from bands.rest()

    return mapped(rows.select("text"), work, neardup.BANDED)


def shingle_sets(norms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each line."""
    return minhash.distinct(*shingle_hashes(norms.to_pylist()))


def numbered(rows: DataFrame) -> DataFrame:
    """(doc, row, text) -> (doc, row, line, item, norm) of every compared line; norm is null where the task had the item before."""
    kind = T.StructType([rows.schema["doc"], rows.schema["row"], T.StructField("line", T.IntegerType()), T.StructField("item", T.LongType()), T.StructField("norm", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            for start, texts in portions(batch.column(2)):
                owner, number, norms, items = lines_of(texts)
                at = pa.array(np.array(owner, dtype=np.int64) + start)
                given = pa.array(norms, pa.string(), mask=~seen.fresh(items))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(number, pa.int32()), pa.array(items), given], ["doc", "row", "line", "item", "norm"])

    return mapped(rows.select("doc", "row", "text"), work, kind)


def row_key(doc_id: str, text: str) -> Column:
    """What a row is known by; nulls, which a hash skips, are told."""
    return F.xxhash64(F.lit("row"), F.col(doc_id).isNull(), F.col(doc_id), F.col(text).isNull(), F.col(text))


def line_links(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (doc, row, text): every compared line (doc, row, line, item), and those that go, with the one that stays (first)."""
    members = neardup.buckets(banded(rows))
    found = neardup.maybe_wanted(numbered(rows), members.select("item").distinct(), "item", "wanted")
    lines = stored(found.select("doc", "row", "line", "item", F.when(F.col("wanted"), F.col("norm")).alias("norm")), "lines")
    payload = lines.where("norm IS NOT NULL").groupBy("item").agg(F.first("norm").alias("shingles")).withColumn("copies", F.lit(1).cast("long"))
    links = checkpointed(neardup.verified(members, payload, THRESHOLD, shingle_sets))
    roots = components(links.where("b IS NOT NULL")).select(F.col("node").alias("item"), "root")
    place = lines.groupBy("item").agg(F.min(F.struct("doc", "line", "row")).alias("first"), F.count("*").alias("n"))
    several = checkpointed(place.join(roots, "item", "left").where("root IS NOT NULL OR n > 1").drop("n"))
    best = several.where("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("best"))
    linked = several.where("root IS NOT NULL").join(spread(best), "root").select("item", F.col("best").alias("first"))
    classes = linked.unionByName(several.where("root IS NULL").select("item", "first"))
    gone = lines.select("doc", "row", "line", "item").join(spread(classes), "item").where("NOT (first.row = row AND first.line = line)")
    return lines.select("doc", "row", "line", "item"), gone


def report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each distinct row of `docs`: compared lines, lines that stay, and (line, kept doc, kept line) of each that goes."""
    rows = docs.select(F.col(doc_id).alias("doc"), row_key(doc_id, text).alias("row"), F.col(text).alias("text"))
    lines, gone = line_links(rows)
    ids = rows.groupBy("row", "doc").agg(F.count("*").alias("copies"))
    per = lines.groupBy("row").agg(F.count("*").alias("n"))
    removed = gone.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("line", F.col("first.doc").alias("kept_doc"), F.col("first.line").alias("kept_line")))).alias("removed"))
    out = ids.join(per, "row", "left").join(removed, "row", "left")
    n = F.coalesce(F.expr("n div copies"), F.lit(0)).cast("long")
    none = F.array().cast(removed.schema["removed"].dataType)
    return out.select(F.col("doc").alias(doc_id), n.alias("n_lines"), (n - F.size(F.coalesce("removed", none))).cast("long").alias("n_kept"), F.coalesce("removed", none).alias("removed"))


def _once(rows: DataFrame, text: str) -> DataFrame:
    """One of each group of rows with the same key, if it has a line that is compared."""
    again = rows.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select("row")
    if again.isEmpty():
        return rows
    again = checkpointed(again)
    has_line = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    several = rows.join(spread(again), "row", "left_semi").select(*rows.columns)
    alone = rows.join(spread(again), "row", "left_anti").select(*rows.columns)
    one = several.where(has_line).groupBy("row").agg(F.min_by(F.struct(*rows.columns), F.xxhash64(*rows.columns)).alias("one")).select("one.*")
    return alone.unionByName(one).unionByName(several.where(~has_line))


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`docs` with only the lines that stay; documents that lose their last line go, those that never had one stay.

    Of repeated rows (same doc_id and text) one stays, unless they have no line. A column `n_chars` is counted anew.
    """
    names = Aside(docs)
    body = names(text)
    rows = _once(names.rows.withColumn("row", row_key(names(doc_id), body)), body)
    _, gone = line_links(rows.select(F.col(names(doc_id)).alias("doc"), "row", F.col(body).alias("text")))
    lost = gone.groupBy("row").agg(F.collect_set("line").alias("gone"))
    # The places that stay, by a hashed difference; the split text is bound once, as a lambda would split it for each place.
    stay = lambda parts: F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))
    parts = F.array(F.split(F.col(body), "\n"))
    joined = F.get(F.transform(parts, lambda p: F.array_join(F.transform(stay(p), lambda i: F.get(p, i)), "\n")), F.lit(0))
    out = rows.join(spread(lost), "row", "left")
    out = out.withColumn("new", F.when(F.col("gone").isNull(), F.col(body)).otherwise(joined))
    out = out.where(F.col("gone").isNull() | F.col("new").rlike(r"[^\x20\x09-\x0D]"))
    changed = {body: F.col("new")}
    if "n_chars" in docs.columns:
        changed[names("n_chars")] = F.when(F.col("gone").isNull(), F.col(names("n_chars"))).otherwise(F.length("new").cast(docs.schema["n_chars"].dataType))
    return names.back(out.withColumns(changed))
