"""Queries on exact identity over the driver tables: a document is an asset, its source the owner."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.operators import folds
from assetloom.operators import identity as I
from assetloom.operators.ordered import shared_folder

from .registry import query, table

_DOCS = "WITH d AS (SELECT *, sha256(coalesce(text, '')) AS sha, doc_id IN (SELECT doc_id FROM labels) AS known FROM documents)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("sha", I.content_hash(F.col("text")))


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents that labels know (the catalog) and all others (what comes in)."""
    docs, labels = _docs(spark, sf_dir), table(spark, sf_dir, "labels").select("doc_id")
    return docs.join(labels, "doc_id", "left_semi"), docs.join(labels, "doc_id", "left_anti")


@query(f"""{_DOCS} SELECT 'error' AS severity, 'ambiguous_known_hash' AS code, sha, array_to_string(list_sort(list(DISTINCT source)), ',') AS owners,
       count(DISTINCT source) AS n_owners, count(*) AS n_rows FROM d GROUP BY sha HAVING count(DISTINCT source) > 1""")
def exact_dup_ownership(spark, sf_dir):
    """AGG-02, SCL-43, INT-01."""
    return I.ambiguous_owners(_docs(spark, sf_dir), "sha", "source")


@query(f"""{_DOCS} SELECT sha, min(doc_id) AS canonical, count(*) AS n_occurrences, array_to_string(list_sort(list(doc_id)), ',') AS occurrences, max(n_chars) AS max_n_chars FROM d GROUP BY sha""")
def exact_dup_canonical(spark, sf_dir):
    """AGG-01, SCL-60."""
    return I.with_occurrences(_docs(spark, sf_dir), "sha", "doc_id", ["n_chars"])


@query(f"""{_DOCS} SELECT min(doc_id) OVER (PARTITION BY sha) AS canonical, doc_id FROM d""")
def occurrence_members(spark, sf_dir):
    """AGG-01, SCL-60: every occurrence with the one that stands for it."""
    return I.membership(_docs(spark, sf_dir), "sha", "doc_id")


@query(f"""{_DOCS}, f AS (SELECT sha, min(doc_id) AS canonical FROM d GROUP BY sha) SELECT doc_id AS duplicate, canonical FROM d JOIN f USING (sha) WHERE doc_id <> canonical""")
def duplicate_map(spark, sf_dir):
    """WIN-01, AGG-01: the map from duplicates to the row that stands for them."""
    return I.duplicate_map(_docs(spark, sf_dir).select("sha", "doc_id"), "sha", "doc_id")


@query(f"""{_DOCS} SELECT source, array_to_string(list_sort(list(DISTINCT sha)), ',') AS hashes, count(DISTINCT sha) AS n_hashes FROM d GROUP BY source""")
def hash_union_catalog(spark, sf_dir):
    """SNK-09, SET-01, SCL-66, D17."""
    return I.hash_lists(_docs(spark, sf_dir), "source", "sha")


@query(f"""{_DOCS}, k AS (SELECT doc_id, sha FROM d WHERE NOT known), o AS (SELECT sha, count(DISTINCT source) AS n, min(source) AS one FROM d WHERE known GROUP BY sha)
SELECT doc_id, k.sha, coalesce(n, 0) AS n_owners, CASE WHEN n = 1 THEN one END AS owner, CASE WHEN coalesce(n, 0) = 0 THEN 'none' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS match FROM k LEFT JOIN o ON k.sha = o.sha""")
def hash_lookup_cardinality(spark, sf_dir):
    """JON-01, JON-03, N7: incoming documents looked up in the catalog."""
    known, incoming = _halves(spark, sf_dir)
    return I.classified(incoming.select("doc_id", "sha"), known, "sha", "source").select("doc_id", "sha", "n_owners", "owner", "match")


@query(f"""{_DOCS}, i AS (SELECT DISTINCT lang || ':' || source AS grp, sha FROM d WHERE NOT known), l AS (SELECT DISTINCT source AS family, sha FROM d WHERE known), j AS (SELECT i.*, family FROM i LEFT JOIN l USING (sha))
SELECT grp, count(DISTINCT sha) AS n_hashes, count(DISTINCT family) AS n_anchors, CASE count(DISTINCT family) WHEN 0 THEN 'skipped' WHEN 1 THEN 'matched' ELSE 'conflict' END AS state,
       CASE WHEN count(DISTINCT family) = 1 THEN min(family) END AS anchor, CASE WHEN count(DISTINCT family) = 1 THEN count(DISTINCT CASE WHEN family IS NULL THEN sha END) ELSE 0 END AS n_added FROM j GROUP BY grp""")
def catalog_anchor_classify(spark, sf_dir):
    """JON-12, DML-07: incoming groups against local families."""
    known, rest = _halves(spark, sf_dir)
    incoming = rest.select(F.concat_ws(":", "lang", "source").alias("grp"), "sha")
    local = known.select(F.col("source").alias("family"), "sha")
    return I.anchored(incoming, local, "grp", "sha", "family")


@query(f"""{_DOCS} SELECT sha, doc_id, source FROM d QUALIFY row_number() OVER (PARTITION BY sha ORDER BY doc_id) = 1""")
def first_variant_by_hash(spark, sf_dir):
    """JON-02, WIN-01."""
    return I.first_by_hash(_docs(spark, sf_dir).select("sha", "doc_id", "source"), "sha", "doc_id")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def orphan_rows(spark, sf_dir):
    """JON-19, SET-04: documents that no label refers to."""
    return I.unreferenced(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id", "doc_id")


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def unlinked_parents(spark, sf_dir):
    """JON-20: customers without an order."""
    return I.unreferenced(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey")


@query(f"""{_DOCS}, m AS (SELECT doc_id, n_chars, sha FROM d WHERE NOT known), f AS (SELECT sha, min(doc_id) AS relinked_to FROM d WHERE known AND n_chars IN (SELECT n_chars FROM m) GROUP BY sha)
SELECT doc_id, n_chars, sha, relinked_to FROM m JOIN f USING (sha)""")
def missing_relink(spark, sf_dir):
    """JON-13, SUP-02: sizes are compared before hashes."""
    known, rest = _halves(spark, sf_dir)
    return I.relinked(rest, known, "n_chars", "sha", "doc_id").select("doc_id", "n_chars", "sha", "relinked_to")


@query(f"""{_DOCS}, k AS (SELECT doc_id, sha, n_chars, string_split(text, chr(10))[1] AS lead FROM d WHERE NOT known), o AS (SELECT * FROM d WHERE known),
e AS (SELECT sha, count(DISTINCT source) AS n, min(source) AS one FROM o GROUP BY sha), p AS (SELECT n_chars, count(DISTINCT source) AS n, min(source) AS one FROM o GROUP BY n_chars),
l AS (SELECT string_split(text, chr(10))[1] AS lead, count(DISTINCT source) AS n, min(source) AS one FROM o GROUP BY 1)
SELECT doc_id, coalesce(CASE WHEN e.n = 1 THEN e.one END, CASE WHEN p.n = 1 THEN p.one END, CASE WHEN l.n = 1 THEN l.one END) AS family,
       CASE WHEN e.n = 1 THEN 'exact' WHEN p.n = 1 THEN 'fingerprint' WHEN l.n = 1 THEN 'prefix' ELSE 'none' END AS match_kind
FROM k LEFT JOIN e USING (sha) LEFT JOIN p USING (n_chars) LEFT JOIN l USING (lead)""")
def identity_cascade(spark, sf_dir):
    """JON-04: exact hash, then a unique measure, then a unique first line.

    The last two stand in for the fingerprint and the damaged prefix and are neither: equal lengths or first lines don't
    show equal content. See fingerprint_unique_match for JON-05 and damaged_prefix_match for JON-06.
    """
    known, rest = (x.withColumn("lead", F.get(F.split("text", "\n"), F.lit(0))) for x in _halves(spark, sf_dir))
    one = lambda key, name: known.groupBy(key).agg(F.when(F.count_distinct("source") == 1, F.min("source")).alias(name))
    rows = rest.select("doc_id", "sha", "n_chars", "lead").join(one("sha", "_e"), "sha", "left").join(one("n_chars", "_p"), "n_chars", "left").join(one("lead", "_l"), "lead", "left")
    family, kind = I.cascade(F.col("_e"), F.col("_p"), F.col("_l"))
    return rows.select("doc_id", family.alias("family"), kind.alias("match_kind"))


@query(f"""{_DOCS} SELECT k.doc_id, count(DISTINCT o.source) AS n_candidates, CASE WHEN count(DISTINCT o.source) = 1 THEN min(o.source) END AS match
FROM d k JOIN d o ON NOT k.known AND o.known AND left(k.text, 64) = left(o.text, 64) AND length(k.text) >= 64 AND length(o.text) > length(k.text) AND left(o.text, length(k.text)) = k.text GROUP BY k.doc_id""")
def damaged_prefix_match(spark, sf_dir):
    """JON-06: incoming documents that a longer document of the catalog begins with."""
    shared_folder(spark)
    docs, labels = _docs(spark, sf_dir), table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("known", F.lit(True))
    # Facts are taken before rows meet the labels, so that texts stay where they are.
    facts = I.prefix_facts(docs, ["doc_id", "source"], "text").join(labels, "doc_id", "left").checkpoint()
    return I.prefix_matches(facts.where("known IS NULL"), facts.where("known"), docs.select(F.col("sha").alias("h"), "text"), "doc_id", "source")


@query(f"""{_DOCS}, a AS (SELECT DISTINCT sha FROM d WHERE NOT known), b AS (SELECT DISTINCT sha FROM d WHERE known)
SELECT 'left' AS side, sha FROM (SELECT sha FROM a EXCEPT SELECT sha FROM b) UNION ALL SELECT 'right', sha FROM (SELECT sha FROM b EXCEPT SELECT sha FROM a) UNION ALL SELECT 'both', sha FROM (SELECT sha FROM a INTERSECT SELECT sha FROM b)""")
def set_ops(spark, sf_dir):
    """SET-02, SET-03, SET-05, SET-09, JON-18: hashes that come in only, of the catalog only, of both."""
    known, rest = _halves(spark, sf_dir)
    a, b = rest.select("sha").distinct(), known.select("sha").distinct()
    return I.symmetric_difference(a, b).select("side", "sha").unionByName(a.intersect(b).select(F.lit("both").alias("side"), "sha"))


@query(f"""{_DOCS}, g AS (SELECT source, sha, count(*) AS n, min(doc_id) AS keep, sum(n_chars) AS total FROM d GROUP BY source, sha HAVING count(*) > 1),
x AS (SELECT sha FROM d GROUP BY sha HAVING count(DISTINCT source) > 1)
SELECT source, sha, keep, n, total - (SELECT n_chars FROM d WHERE d.doc_id = keep) AS savings FROM g WHERE sha NOT IN (SELECT sha FROM x)
UNION ALL SELECT NULL, sha, min(doc_id), count(*), sum(n_chars) - arg_min(n_chars, doc_id) FROM d WHERE sha IN (SELECT sha FROM x) GROUP BY sha""")
def cleanup_savings(spark, sf_dir):
    """AGG-18, SRT-04, SET-08: groups across sources first, then those within a source that no such group covers."""
    docs = _docs(spark, sf_dir).select("sha", "source", "doc_id", "n_chars")
    measures = [F.min("doc_id").alias("keep"), F.count("*").alias("n"), (F.sum("n_chars") - F.min_by("n_chars", "doc_id")).alias("savings")]
    across = docs.groupBy("sha").agg(F.count_distinct("source").alias("k"), *measures).where("k > 1").drop("k").withColumn("source", F.lit(None).cast("string"))
    within = docs.groupBy("source", "sha").agg(*measures).where("n > 1").join(across.select("sha"), "sha", "left_anti")
    return within.unionByName(across).select("source", "sha", "keep", "n", "savings").orderBy(F.desc("savings"), "keep")


@query(f"""WITH RECURSIVE {_DOCS.replace("WITH ", "")}, g AS (SELECT doc_id % 60 AS ord, list(DISTINCT sha) AS hashes FROM d WHERE NOT known GROUP BY doc_id % 60),
o AS (SELECT ord, hashes, row_number() OVER (ORDER BY ord) AS k FROM g),
walk AS (
  SELECT 0::BIGINT AS k, 0::BIGINT AS ord, (SELECT list(DISTINCT sha || '|' || source) FROM d WHERE known) AS known, CAST([] AS VARCHAR[]) AS anchors, 0::BIGINT AS n_added
  UNION ALL SELECT k, ord, CASE WHEN len(a) = 1 THEN list_distinct(list_concat(known, [h || '|' || a[1] FOR h IN hashes])) ELSE known END, a, CASE WHEN len(a) = 1 THEN len([h FOR h IN hashes IF NOT list_contains(known, h || '|' || a[1])]) ELSE 0 END
  FROM (SELECT o.k, o.ord, o.hashes, walk.known, list_distinct([split_part(x, '|', 2) FOR x IN walk.known IF list_contains(o.hashes, split_part(x, '|', 1))]) AS a FROM walk JOIN o ON o.k = walk.k + 1))
SELECT ord, CASE len(anchors) WHEN 0 THEN 'skipped' WHEN 1 THEN 'matched' ELSE 'conflict' END AS state, CASE WHEN len(anchors) = 1 THEN anchors[1] END AS anchor, n_added FROM walk WHERE k > 0""")
def hash_catalog_merge(spark, sf_dir):
    """DML-07, SRT-08, JON-12: groups of incoming hashes merged one after another into the families that they share one with."""
    known, rest = _halves(spark, sf_dir)
    found, _ = folds.merged_catalog(known.select(F.col("sha").alias("hash"), F.col("source").alias("family")), rest.select((F.col("doc_id") % 60).alias("ord"), F.col("sha").alias("hash")))
    return found
