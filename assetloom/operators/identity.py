"""Identity of assets by exact hashes: owners, canonical rows, lookups, relinking, set operations.

All joins are equi-joins on a hash; cardinality is counted and classified, never settled by taking a first row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def content_hash(text: Column) -> Column:
    """SCL-43."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def ambiguous_owners(assets: DataFrame, digest: str, owner: str) -> DataFrame:
    """AGG-02, INT-01: digests with more than one owner, as issue rows."""
    grouped = assets.groupBy(digest).agg(F.sort_array(F.collect_set(owner)).alias("owners"), F.count("*").alias("n_rows"))
    return grouped.where(F.size("owners") > 1).select(F.lit("error").alias("severity"), F.lit("ambiguous_known_hash").alias("code"), digest, F.array_join("owners", ",").alias("owners"), F.size("owners").cast("long").alias("n_owners"), "n_rows")


def joined(rows: DataFrame, key: str, value: str, part: Column, out: str) -> DataFrame:
    """Each key's values in order as one string, with commas, and their number `n`.

    `part` rises with the value: values are sorted part by part, so that only the parts' strings meet in one task.
    """
    each = rows.withColumn("_part", part).groupBy(key, "_part").agg(F.array_join(F.sort_array(F.collect_list(value)), ",").alias("_s"), F.count(value).alias("n"))
    held = F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.struct("_part", "_s"))))
    return each.groupBy(key).agg(F.array_join(F.transform(held, lambda x: x["_s"]), ",").alias(out), F.sum("n").alias("n"))


def canonical(assets: DataFrame, key: str, order: str, largest: list[str]) -> DataFrame:
    """AGG-01: the first row of each key stands for all, with their number and the largest measures; `membership` has the rows."""
    return assets.groupBy(key).agg(F.min(order).alias("canonical"), F.count("*").alias("n_occurrences"), *[F.max(c).alias(f"max_{c}") for c in largest])


def with_occurrences(assets: DataFrame, key: str, order: str, largest: list[str]) -> DataFrame:
    """AGG-01, SCL-60: `canonical` with all occurrences (whole numbers) of a key in order, as a string."""
    parts = joined(assets.select(key, order), key, order, F.floor(F.col(order) / 4096), "occurrences").drop("n")
    return canonical(assets, key, order, largest).join(parts, key)


def membership(assets: DataFrame, key: str, order: str) -> DataFrame:
    """AGG-01, SCL-60: each row with the one that stands for it; a hot key's rows are never gathered."""
    first = assets.groupBy(key).agg(F.min(order).alias("canonical"))
    return assets.select(key, order).join(first, key).select("canonical", order)


def duplicate_map(assets: DataFrame, key: str, order: str) -> DataFrame:
    """WIN-01: each later row of a key with the first one."""
    first = assets.groupBy(key).agg(F.min(order).alias("canonical"))
    return assets.join(first, key).where(F.col(order) != F.col("canonical")).select(F.col(order).alias("duplicate"), "canonical")


def hash_catalog(assets: DataFrame, owner: str, digest: str) -> DataFrame:
    """SNK-09, SET-01: each owner's distinct hashes, a row each."""
    return assets.select(owner, digest).distinct()


def hash_lists(assets: DataFrame, owner: str, digest: str) -> DataFrame:
    """SNK-09, SET-01, SCL-66: each owner's distinct hashes in order as a string, and their number."""
    lists = joined(hash_catalog(assets, owner, digest), owner, digest, F.left(digest, F.lit(2)), "hashes")
    return lists.withColumnRenamed("n", "n_hashes")


def classified(lookups: DataFrame, owners: DataFrame, digest: str, owner: str) -> DataFrame:
    """JON-01: lookups with the number of owners of their digest: none, one (given), or several (an error)."""
    counted = owners.select(digest, owner).distinct().groupBy(digest).agg(F.count("*").alias("n_owners"), F.min(owner).alias("_one"))
    n = F.coalesce("n_owners", F.lit(0))
    return lookups.join(counted, digest, "left").withColumns({"n_owners": n, "owner": F.when(n == 1, F.col("_one")), "match": F.when(n == 0, "none").when(n == 1, "unique").otherwise("ambiguous")}).drop("_one")


def first_by_hash(assets: DataFrame, digest: str, order: str) -> DataFrame:
    """JON-02: the first row of each digest in catalog order."""
    return assets.withColumn("_r", F.row_number().over(W.partitionBy(digest).orderBy(order))).where("_r = 1").drop("_r")


def anchored(incoming: DataFrame, local: DataFrame, group: str, digest: str, family: str) -> DataFrame:
    """JON-12 without the order of arrival: groups with no, one or several local families that share a hash."""
    shared = incoming.select(group, digest).distinct().join(local.select(digest, family).distinct(), digest, "left")
    per = shared.groupBy(group).agg(F.count_distinct(family).alias("n_anchors"), F.min(family).alias("_one"), F.count_distinct(digest).alias("n_hashes"), F.count_distinct(F.when(F.col(family).isNull(), F.col(digest))).alias("_new"))
    state = F.when(F.col("n_anchors") == 0, "skipped").when(F.col("n_anchors") == 1, "matched").otherwise("conflict")
    return per.select(group, "n_hashes", "n_anchors", state.alias("state"), F.when(F.col("n_anchors") == 1, F.col("_one")).alias("anchor"), F.when(F.col("n_anchors") == 1, F.col("_new")).otherwise(0).alias("n_added"))


def relinked(missing: DataFrame, found: DataFrame, size: str, digest: str, order: str) -> DataFrame:
    """JON-13: rows without a file with the first found file of their hash; only sizes that occur are compared."""
    sized = found.join(missing.select(size).distinct(), size, "left_semi")
    first = sized.groupBy(digest).agg(F.min(order).alias("relinked_to"))
    return missing.join(first, digest)


def unreferenced(parents: DataFrame, children: DataFrame, key: str, reference: str) -> DataFrame:
    """JON-19, JON-20: parents without a child."""
    return parents.join(children.select(F.col(reference).alias(key)), key, "left_anti")


def cascade(exact: Column, fuzzy: Column, prefix: Column) -> tuple[Column, Column]:
    """JON-04: the first identity that is found, and which it was."""
    return F.coalesce(exact, fuzzy, prefix), F.when(exact.isNotNull(), "exact").when(fuzzy.isNotNull(), "fingerprint").when(prefix.isNotNull(), "prefix").otherwise("none")


def unique_candidate(pairs: DataFrame, key: str, owner: str) -> DataFrame:
    """JON-05: each key's number of candidate owners, and the owner where there is exactly one."""
    n = F.count_distinct(owner)
    return pairs.groupBy(key).agg(n.alias("n_candidates"), F.when(n == 1, F.min(owner)).alias("match"))


def prefix_facts(rows: DataFrame, columns: list[str], text: str, least: int = 64) -> DataFrame:
    """Columns of rows with n (characters), h (content hash) and marks (hashes of the first `least`, twice, four times as many
    characters, as far as the text goes). Shorter texts are left out."""
    n = F.length(text)
    levels = F.sequence(F.lit(0), F.length(F.bin(F.floor(n / least))) - 1)
    marks = F.transform(levels, lambda k: F.xxhash64(F.left(text, (F.lit(least) * F.pow(F.lit(2), k)).cast("int"))))
    return rows.where(n >= least).select(*columns, n.alias("n"), content_hash(F.col(text)).alias("h"), marks.alias("marks"))


@F.arrow_udf(T.ArrayType(T.StringType()))
def prefix_hashes(texts: pa.Array, lengths: pa.Array) -> pa.Array:
    """The content hash of each text (UTF-8 bytes) up to each of its lengths, which rise: in one pass over it."""
    out = []
    for text, cuts in zip(texts, lengths.to_pylist(), strict=True):
        data = text.as_buffer()
        begins = np.flatnonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)  # of characters; each length is below their number
        whole, at, found = hashlib.sha256(), 0, []
        for end in begins[np.asarray(cuts)].tolist():
            whole.update(data[at:end])
            at = end
            found.append(whole.copy().hexdigest())
        out.append(found)
    return pa.array(out, pa.list_(pa.string()))


def prefix_matches(incoming: DataFrame, known: DataFrame, texts: DataFrame, key: str, owner: str) -> DataFrame:
    """JON-06: incoming rows (key) that a longer known text (owner) begins with, from `prefix_facts` of both and texts (h, text).

    A text and what it is the beginning of share the last of its marks. Known texts are hashed up to each length that occurs
    among the incoming ones of such a mark, in one pass; so no text makes more rows than it has characters, however many
    begin alike. Copies are looked up once.
    """
    cut = incoming.select("n", "h", (F.size("marks") - 1).alias("level"), F.element_at("marks", -1).alias("mark")).distinct()
    blocks = cut.groupBy("level", "mark").agg(F.collect_set("n").alias("lengths"), F.min("n").alias("shortest"))
    each = known.select(F.col("h").alias("of"), F.col("n").alias("m"), "marks").dropDuplicates(["of"]).select("of", "m", F.posexplode("marks").alias("level", "mark"))
    met = each.join(blocks, ["level", "mark"]).where("m > shortest").select("of", F.filter("lengths", lambda x: x < F.col("m")).alias("lengths"))
    wanted = met.groupBy("of").agg(F.sort_array(F.flatten(F.collect_list("lengths"))).alias("lengths"))
    hashed = texts.join(wanted, F.col("h") == F.col("of")).select("of", "lengths", prefix_hashes(F.col("text").cast("binary"), F.col("lengths")).alias("hashes"))
    begun = hashed.select("of", F.explode(F.arrays_zip(F.col("lengths").alias("n"), F.col("hashes").alias("h"))).alias("x")).select("of", F.col("x.n").alias("n"), F.col("x.h").alias("h"))
    owners = known.select(F.col("h").alias("of"), owner).distinct()
    found = unique_candidate(begun.join(cut.select("n", "h"), ["n", "h"]).select("of", "h").distinct().join(owners, "of"), "h", owner)
    return incoming.select(key, "h").join(found, "h").drop("h")


def damaged_prefix(incoming: DataFrame, known: DataFrame, key: str, text: str, owner: str, least: int = 64) -> DataFrame:
    """JON-06: incoming texts that are the beginning of a longer known one, with their owner where there is exactly one.

    Texts shorter than `least` characters aren't matched.
    """
    texts = known.select(content_hash(F.col(text)).alias("h"), F.col(text).alias("text"))
    return prefix_matches(prefix_facts(incoming, [key], text, least), prefix_facts(known, [owner], text, least), texts, key, owner)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """JON-18, SET-05, SET-09: rows of one side only, with the side."""
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


def append_by_key(left: Column, right: Column, key: str) -> Column:
    """SCL-60: an array with the elements of another whose key it lacks, in order."""
    return F.concat(left, F.filter(right, lambda x: ~F.exists(left, lambda y: y[key].eqNullSafe(x[key]))))


def clean_tags(tags: Column) -> Column:
    """SCL-61: trimmed, without blanks, each once in order of first use."""
    return F.array_distinct(F.filter(F.transform(tags, lambda x: F.trim(x)), lambda x: x != ""))
