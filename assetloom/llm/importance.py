"""Operator 11: importance resampling towards a target distribution (hashed n-grams, weights, Gumbel top-k).

Identical texts are collapsed by grouping full texts; what follows is done once for each distinct text: words, runs of
one and two words, their buckets. Features of the source are counted with multiplicity (a text's counts times its
copies), those of the target likewise; a bucket's gain is the scaled logarithm of the ratio of both smoothed shares, and
a text's weight the mean gain of its features. Weights go back to documents by the text's SHA-256, before each
document's own noise is added; the highest scores are drawn, ranked by ranges of the order.

What leaves a task is bounded: 10,000 counts from each, and the driver gets 10,000 sums. Shuffled are each distinct text
of a task once and 32-byte digests; the join of a hot text's many documents is one that Spark splits at run time.

Cases: a null text has no words, like an empty one (weight 0); documents below the least number of words have a score
and no rank; repeated rows are separate documents with equal scores, all of them ranked, in any order among themselves;
a null doc_id has the noise of the empty string and comes last among equal scores; texts of any length are read in
parts; an empty table gives an empty result, an empty target gains from smoothing alone; extra columns pass through,
those named like a result as `<name>_input`.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Aside, discard, mapped, running, spread, stored, written
from .words import _buffers, kinds, stretches

BUCKETS, SCALE, LEAST_WORDS, SHARE, SEED = 10_000, 1000, 20, 25, 7
#: Words are runs of digits, letters a-z (after lower-casing) and all that isn't ASCII.
_KIND = kinds(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
#: Word lengths for which the step of a checksum over so many bytes is tabled; longer words are read byte by byte.
_TABLED = 48


def _steps() -> np.ndarray:
    """tables[n][k][b]: what n zero bytes make of a CRC-32 state whose k-th byte is b and whose others are 0."""
    one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], dtype=np.uint32)
    tables = np.zeros((_TABLED + 1, 4, 256), dtype=np.uint32)
    tables[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, _TABLED + 1):
        tables[n] = (tables[n - 1] >> 8) ^ one[tables[n - 1] & 255]
    return tables


_STEPS = _steps()


def _joined(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of strings whose first parts have checksums `left` and whose rests have `right` and `size` bytes."""
    out = right.copy()
    for k in range(4):
        out ^= _STEPS[size, k, (left >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of words of each row, its number of features, and the buckets of all rows' features."""
    n_words = np.zeros(len(texts), dtype=np.int64)
    found: list[np.ndarray] = []
    for s in stretches(texts, _KIND, lead=1):
        if not len(s.word):
            continue
        vocabulary = s.vocabulary.cast(pa.binary()).to_pylist()
        alone = np.fromiter(map(zlib.crc32, vocabulary), dtype=np.uint32, count=len(vocabulary))
        after = np.fromiter((zlib.crc32(b" " + w) for w in vocabulary), dtype=np.uint32, count=len(vocabulary))
        size = np.fromiter((len(w) + 1 for w in vocabulary), dtype=np.int64, count=len(vocabulary))
        here, then = s.word[:-1], s.word[1:]
        pair = _joined(alone[here], after[then], np.minimum(size, _TABLED)[then])
        for k in np.flatnonzero(size[then] > _TABLED).tolist():
            pair[k] = zlib.crc32(b" " + vocabulary[then[k]], int(alone[here[k]]))
        both = np.zeros(2 * len(s.word), dtype=np.uint32)
        both[::2], both[1:-1:2] = alone[s.word], pair
        keep = np.ones(len(both), dtype=bool)
        keep[1:-1:2], keep[-1] = s.row[1:] == s.row[:-1], False
        keep[: s.again] = False  # the word that the part before had; its pair with the next one is new
        found.append((both[keep] % np.uint32(buckets)).astype(np.uint16))
        n_words += np.bincount(s.row[s.again :], minlength=len(texts))
    flat = np.concatenate(found) if found else np.zeros(0, dtype=np.uint16)
    return n_words, np.maximum(2 * n_words - 1, 0), flat


def _flat(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all rows, and how many each has."""
    ends, data = _buffers(packed)
    return data[ends[0] : ends[-1]].view(np.uint16) if len(data) else np.zeros(0, dtype=np.uint16), np.diff(ends) // 2


def distinct_texts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(key, copies, n_words, buckets) for each distinct text; `buckets` holds those of its features as 16-bit numbers."""
    if not 0 < buckets <= 65_536:
        raise ValueError("buckets are 16-bit numbers")
    groups = docs.groupBy(F.coalesce(F.col(text), F.lit("")).alias("body")).agg(F.count("*").alias("copies"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n, flat = _features(batch.column(2), buckets)
            ends = np.zeros(len(n) + 1, dtype=np.int32)
            np.cumsum(2 * n, out=ends[1:])
            packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words), packed], ["key", "copies", "n_words", "buckets"])

    return mapped(groups.select(F.sha2("body", 256).alias("key"), "copies", "body"), work, "key string, copies long, n_words long, buckets binary")


def histogram(distinct: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs over all rows, copies counted; the driver gets one row for each bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            flat, n = _flat(batch.column(1))
            times = np.repeat(batch.column(0).to_numpy(), n)
            once = times == 1
            total += np.bincount(flat[once], minlength=buckets)
            total += np.bincount(flat[~once], weights=times[~once], minlength=buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in mapped(distinct.select("copies", "buckets"), work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Scaled log-ratio of each bucket's smoothed shares of the target and of the source."""
    s_all, t_all = float(int(source.sum()) + len(source)), float(int(target.sum()) + len(target))
    return np.array([math.floor(SCALE * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def text_weights(distinct: DataFrame, gain: np.ndarray) -> DataFrame:
    """(key, n_words, n_features, weight) for each distinct text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, n = _flat(batch.column(2))
            sums = np.concatenate([[0], np.cumsum(gain[flat])])
            ends = np.concatenate([[0], np.cumsum(n)])
            weight = (sums[ends[1:]] - sums[ends[:-1]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n.astype(np.int64)), pa.array(weight)], ["key", "n_words", "n_features", "weight"])

    return mapped(distinct.select("key", "n_words", "buckets"), work, "key string, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A document's scaled Gumbel noise."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h.cast("double") + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, text: str = "text", doc_id: str = "doc_id", target_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `docs` (all where None) with `n_features`, `weight`, `score` and `rank`: 1, 2, 3... for the `share` in a hundred that is drawn."""
    kept = docs.select(*("`" + c.replace("`", "``") + "`" for c in (docs.columns if keep is None else keep)))
    names, spark = Aside(kept), docs.sparkSession
    held = docs.select(*("`" + c.replace("`", "``") + "`" for c in kept.columns), F.col(doc_id), F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).toDF(*names.rows.columns, "id", "key")
    path = written(distinct_texts(docs.select(text), text, buckets), "importance")
    distinct = spark.read.parquet(path)
    gain = gains(histogram(distinct, buckets), histogram(distinct_texts(target, target_text, buckets), buckets))
    weights = text_weights(distinct, gain)
    scored = held.join(spread(weights), "key").drop("key")
    scored = stored(scored.withColumn("score", F.col("weight") + noise(F.col("id"), seed)).withColumn("row", F.monotonically_increasing_id()), "importance-scores")
    discard(spark, path)
    taken = scored.where(F.col("n_words") >= least_words).count() * share // 100
    slim = scored.where(F.col("n_words") >= least_words).select("row", (-F.col("score")).alias("falling"), F.col("id").isNull().alias("none"), "id")
    ranks = running(slim, [], ["falling", "none", "id", "row"], F.lit(1).cast("long"), "before").where(F.col("before") < taken)
    out = scored.join(ranks.select("row", (F.col("before") + 1).alias("rank")), "row", "left")
    return names.back(out, ["n_features", "weight", "score", "rank"])
