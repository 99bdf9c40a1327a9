"""From raw documents to token ids: toxic documents go, repeated lines go, one of each group of near-copies stays,
sources are mixed to their weights, and the mix is encoded.

Each stage works on all that its predecessor kept, and is judged on that: lines that repeat go before near copies are
looked for, so of a near copy only the lines that differ may be left by then, and it stays with these. Stages but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.llm import jaccard_join, line_dedup, mixing, pieces, toxicity
from assetloom.llm.common import discard, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned lexicon doesn't reject."""
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    return toxicity.accepted(docs, lexicon)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that nearly repeat an earlier one; documents left without a line go."""
    return line_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-copies."""
    return jaccard_join.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.emitted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with the digests of the ids and of what they decode to."""
    rows = pieces.digests(pieces.encoded(docs, keep=["doc_id", "lang", "source"]))
    return rows.select("doc_id", "lang", "source", "ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL can't express the merges of stages 2 and 5; a test holds the five stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        last, path = path, written(stage(spark, docs, sf_dir), name)
        docs = spark.read.parquet(path)
        if last is not None:  # nothing reads it any more
            discard(spark, last)
    return STAGES[-1][1](spark, docs, sf_dir)
