"""Operator 2: n-gram Jaccard join with Bayesian candidate pruning.

Documents are linked when the Jaccard similarity of their distinct `SHINGLE`-word shingles is `THRESHOLD` or
more; words are `[^\\x20\\x09-\\x0D]+`, as they stand. A text of fewer words is one shingle.

Documents with the same words are one item with copies. Items that share a band of MinHash values are
candidates (recall 0.9997 at similarity 0.8). Their signatures are compared `CHUNK` values at a time: with m of
n values equal, the similarity has a Beta(m + 1, n - m + 1) posterior, and the pair is dropped once the chance
that it reaches the threshold is below `TOLERANCE`. What is left is verified exactly.

Cases: a text without words (null, empty, white space) is linked with nothing and is its own class; repeated
rows are copies of one another, of which `deduplicated` keeps one; an empty table gives an empty result; extra columns
pass through `deduplicated`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import minhash, neardup
from .common import WS, Aside, checkpointed, mapped, spread
from .components import components

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 20, 5
HASHES, CHUNK, TOLERANCE, SEED = 128, 16, 1e-4, 7
#: Items that a task remembers to have banded.
REMEMBERED = 100_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest of n equal values with which P(similarity >= threshold) is at least the tolerance.

    For a uniform prior that chance is P(Binomial(n + 1, threshold) <= m).
    """
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


#: For each number of values compared.
LEAST = {n: least_matches(n) for n in range(CHUNK, HASHES + 1, CHUNK)}


def pruned(signature: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) of rows no step drops."""
    out = np.zeros(len(i), dtype=bool)
    for lo in range(0, len(i), 1 << 15):
        a, b = i[lo : lo + (1 << 15)], j[lo : lo + (1 << 15)]
        at = np.arange(lo, lo + len(a))
        same = np.zeros(len(a), dtype=np.int32)
        for k in range(0, signature.shape[1], CHUNK):
            same += (signature[a, k : k + CHUNK] == signature[b, k : k + CHUNK]).sum(axis=1, dtype=np.int32)
            left = same >= LEAST[k + CHUNK]
            a, b, at, same = a[left], b[left], at[left], same[left]
        out[at] = True
    return out


def shingle_hashes(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every word shingle of every text, flat, and how many each text has."""
    split = pc.ascii_split_whitespace(texts)
    words = split.flatten()
    keep = pc.greater(pc.binary_length(words), 0)
    owner = np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    mask = keep.to_numpy(zero_copy_only=False)
    words, owner = words.filter(keep), owner[mask]
    h = _word_hashes(words)
    count = np.bincount(owner, minlength=len(split))
    at = np.cumsum(count) - count
    m = len(h)
    rolled = np.zeros(m, dtype=np.uint64)
    for k in range(min(n, m)):
        rolled[: m - k] = rolled[: m - k] * _BASE + h[k:]
    sizes = np.where(count > 0, np.maximum(count - n + 1, 1), 0)
    for i in np.flatnonzero((count > 0) & (count < n)).tolist():
        x = int(count[i])
        for w in h[at[i] : at[i] + count[i]].tolist():
            x = (x * int(_BASE) + w) & 0xFFFFFFFFFFFFFFFF
        rolled[at[i]] = np.uint64(x)
    starts = np.repeat(at, sizes)
    inside = np.arange(len(starts)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return minhash.mixed(rolled[starts + inside]), sizes


def _word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of the words' bytes: distinct words of the batch are hashed once, byte place by byte place."""
    coded = words.dictionary_encode()
    unique = coded.dictionary
    offsets = np.frombuffer(unique.buffers()[1], dtype=np.int32)[unique.offset : unique.offset + len(unique) + 1].astype(np.int64)
    data = np.frombuffer(unique.buffers()[2] or b"", dtype=np.uint8)
    start, size = offsets[:-1], np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    h = size.astype(np.uint64)
    for k in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -k, side="left"))  # words longer than k
        h[:n] = (h[:n] ^ data[start[:n] + k].astype(np.uint64)) * np.uint64(0x100000001B3) + np.uint64(k)
        h[:n] ^= h[:n] >> np.uint64(29)
    out = np.empty_like(h)
    out[order] = minhash.mixed(h)
    return out[coded.indices.to_numpy()] if len(words) else np.zeros(0, dtype=np.uint64)


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def banded(rows: DataFrame) -> DataFrame:
    """(item, words) -> rows of `neardup.Bands`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = neardup.Bands(), set()
        for part in _slices(batches, 256):
            fresh = []
            for k, x in enumerate(part.column(0).to_pylist()):
                if x not in seen:
                    seen.add(x)
                    fresh.append(k)
            if len(seen) > REMEMBERED:
                seen.clear()
            part = part.take(pa.array(fresh, pa.int64()))
            if part.num_rows:
                values, sizes = shingle_hashes(part.column(1))
                yield from bands.add(part.column(0).to_numpy(), minhash.bands(minhash.signatures(values, sizes, BANDS * ROWS, SEED), ROWS))
        yield from bands.rest()

    return mapped(rows.select("item", "words"), work, neardup.BANDED)


def _payload(rows: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, 256):
            values, sizes = shingle_hashes(part.column(1))
            signature = minhash.signatures(values, sizes, HASHES, SEED + 1)
            values, sizes = minhash.distinct(values, sizes)
            ends = np.cumsum(sizes)
            shingles = [values[e - s : e].tobytes() for s, e in zip(sizes, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(shingles, pa.binary()), pa.array([s.tobytes() for s in signature], pa.binary())], ["item", "copies", "shingles", "signature"])

    return mapped(rows.select("item", "words", "copies"), work, "item long, copies long, shingles binary, signature binary")


def items(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc, words, item) of every document; item is null without words."""
    each = docs.select(F.col(doc_id).alias("doc"), F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"[{WS}]+", " ")).alias("words"))
    return each.withColumn("item", F.when(F.col("words") != "", F.xxhash64("words")))


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(item, first_doc, copies, class_id, n_links) of each distinct text with words.

    class_id is the smallest doc_id of the component; n_links counts the other documents linked directly.
    """
    each = items(docs, text, doc_id).where("item IS NOT NULL")
    first = checkpointed(each.groupBy("item").agg(F.min("doc").alias("first_doc"), F.count("*").alias("copies")))
    members = neardup.buckets(banded(each))
    # One text of each item that has a candidate: the first document's.
    candidates = members.select("item").distinct()
    wanted = candidates.join(first, "item").select(F.col("item").alias("_item"), F.col("first_doc").alias("_doc"), "copies")
    maybe = neardup.maybe_wanted(each, candidates, "item", "maybe").where("maybe")
    texts = maybe.join(spread(wanted), F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("item") == F.col("_item"))).dropDuplicates(["item"])
    found = checkpointed(neardup.verified(members, checkpointed(_payload(texts)), THRESHOLD, neardup.stored_sets, pruned))
    links = found.where("b IS NULL").groupBy(F.col("a").alias("item")).agg(F.sum("links").alias("links"))
    roots = components(found.where("b IS NOT NULL")).select(F.col("node").alias("item"), "root")
    rooted = checkpointed(first.join(roots, "item"))
    best = rooted.groupBy("root").agg(F.min("first_doc").alias("class_id"))
    better = rooted.join(spread(best), "root").join(links, "item", "left").select("item", "class_id", "links")
    out = first.join(better, "item", "left")
    return out.select("item", "first_doc", "copies", F.coalesce("class_id", "first_doc").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))


def report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: class_id (the smallest doc_id of its class), n_links and kept (the class's first)."""
    slim = items(docs, text, doc_id).select("doc", "item")
    found = checkpointed(classes(docs, text, doc_id)).withColumnRenamed("item", "_item")
    out = slim.join(spread(found), F.col("item") == F.col("_item"), "left")
    class_id = F.coalesce("class_id", "doc")
    return out.select(F.col("doc").alias(doc_id), class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), class_id.eqNullSafe(F.col("doc")).alias("kept"))


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`docs` with one document of each class; of repeated rows of it one stays. Documents without words stay."""
    names = Aside(docs)
    id_at, text_at = names(doc_id), names(text)
    keep = classes(names.rows, text_at, id_at).where(F.col("class_id").eqNullSafe(F.col("first_doc"))).select(F.col("item").alias("kept_item"), F.col("first_doc").alias("kept_doc"))
    words = F.trim(F.regexp_replace(F.coalesce(F.col(text_at), F.lit("")), f"[{WS}]+", " "))
    rows = names.rows.withColumn("item", F.when(words != "", F.xxhash64(words)))
    bare = rows.where("item IS NULL")
    full = rows.join(spread(keep), F.col(id_at).eqNullSafe(F.col("kept_doc")) & (F.col("item") == F.col("kept_item")))
    one = full.select(*rows.columns).groupBy("item").agg(F.min_by(F.struct(*names.rows.columns), F.xxhash64(*names.rows.columns)).alias("one")).select("one.*")
    return names.back(one.unionByName(bare.select(*names.rows.columns)))
