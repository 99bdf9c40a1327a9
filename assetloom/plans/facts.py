"""Queries on catalog health and statistics over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetloom.operators import health as H
from assetloom.operators.identity import content_hash

from .registry import query, table


@query("""WITH r AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)
SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM r WHERE n = 0) AS unlinked, (SELECT count(*) FROM r WHERE n > 1) AS multi,
       (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS finished, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open""")
def stats_rollup(spark, sf_dir):
    """AGG-05, AGG-03, AGG-25: one row of counts."""
    orders = table(spark, sf_dir, "orders")
    r = H.references(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", "o_custkey")
    per = r.agg(F.count("*").alias("customers"), F.count_if(F.col("n_references") == 0).alias("unlinked"), F.count_if(F.col("n_references") > 1).alias("multi"))
    of = orders.agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))
    return per.join(of, F.lit(True)).select("customers", "orders", "unlinked", "multi", "finished", "open")


@query("""WITH d AS (SELECT *, count(*) OVER (PARTITION BY sha256(coalesce(text, ''))) AS k FROM documents)
SELECT count(*) AS all_assets, count(*) FILTER (k > 1) AS duplicate_origins, count(*) FILTER (n_chars < 200) AS undersized, count(*) FILTER (source IS NULL) AS no_origin, count(*) FILTER (lang <> 'en') AS foreign_language FROM d""")
def facet_counts(spark, sf_dir):
    """AGG-06, FLT-02."""
    d = table(spark, sf_dir, "documents").select("n_chars", "source", "lang", content_hash(F.col("text")).alias("sha"))
    k = d.groupBy("sha").agg(F.count("*").alias("k"))
    row = d.agg(F.count("*").alias("all_assets"), F.count_if(F.col("n_chars") < 200).alias("undersized"), F.count_if(F.col("source").isNull()).alias("no_origin"), F.count_if(F.col("lang") != "en").alias("foreign_language"))
    dup = k.agg(F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k"))), F.lit(0)).alias("duplicate_origins"))
    return row.join(dup, F.lit(True)).select("all_assets", "duplicate_origins", "undersized", "no_origin", "foreign_language")


@query("""WITH r AS (SELECT c_custkey, c_acctbal, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
SELECT c_custkey, concat_ws(',', CASE WHEN n = 0 THEN 'unlinked' END, CASE WHEN n > 10 THEN 'multi' END, CASE WHEN c_acctbal < 0 THEN 'abnormal' END) AS tags FROM r""")
def review_tags(spark, sf_dir):
    """AGG-07, SCL-69: what a family is to be reviewed for."""
    r = H.references(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey")
    tests = [(F.col("n_references") == 0, "unlinked"), (F.col("n_references") > 10, "multi"), (F.col("c_acctbal") < 0, "abnormal")]
    return r.select("c_custkey", F.array_join(H.reasons(tests), ",").alias("tags"))


_ISSUES = """d AS (SELECT *, sha256(coalesce(text, '')) AS sha FROM documents),
i AS (SELECT 'error' AS severity, 'ambiguous_known_hash' AS code, sha AS subject FROM d GROUP BY sha HAVING count(DISTINCT source) > 1
UNION ALL SELECT 'error', 'duplicate_variant_hash', source || ':' || sha FROM d GROUP BY source, sha HAVING count(*) > 1
UNION ALL SELECT 'error', 'missing_variant', CAST(doc_id AS VARCHAR) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'warning', 'variant_metadata_drift', CAST(doc_id AS VARCHAR) FROM documents WHERE n_chars <> length(text)
UNION ALL SELECT 'warning', 'unreadable_variant', CAST(doc_id AS VARCHAR) FROM documents WHERE trim(coalesce(text, '')) = ''
UNION ALL SELECT 'warning', 'untracked_media', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'info', 'missing_output_record', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'error', 'invalid_family_pointer', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation))"""


def _issues(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("sha", content_hash(F.col("text")))
    labels, customer = table(spark, sf_dir, "labels"), table(spark, sf_dir, "customer")
    owners = d.groupBy("sha").agg(F.count_distinct("source").alias("k")).where("k > 1")
    within = d.groupBy("source", "sha").agg(F.count("*").alias("k")).where("k > 1")
    return H.issues([
        (owners, "error", "ambiguous_known_hash", F.col("sha")),
        (within, "error", "duplicate_variant_hash", F.concat("source", F.lit(":"), "sha")),
        (labels.join(d.select("doc_id"), "doc_id", "left_anti"), "error", "missing_variant", F.col("doc_id")),
        (d.where(F.col("n_chars") != F.length("text")), "warning", "variant_metadata_drift", F.col("doc_id")),
        (d.where(F.trim(F.coalesce("text", F.lit(""))) == ""), "warning", "unreadable_variant", F.col("doc_id")),
        (d.join(labels.select("doc_id"), "doc_id", "left_anti"), "warning", "untracked_media", F.col("doc_id")),
        (customer.join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti"), "info", "missing_output_record", F.col("c_custkey")),
        (customer.join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey", "left_anti"), "error", "invalid_family_pointer", F.col("c_custkey")),
    ])


@query(f"WITH {_ISSUES} SELECT * FROM i")
def issue_fact(spark, sf_dir):
    """INT-01, INT-02, PRJ-06, AGG-02."""
    return _issues(spark, sf_dir)


@query(f"WITH {_ISSUES} SELECT severity, code, count(*) AS n FROM i GROUP BY severity, code")
def issue_counts(spark, sf_dir):
    """AGG-04."""
    return H.issue_counts(_issues(spark, sf_dir))


@query(f"WITH {_ISSUES} SELECT count(*) FILTER (severity = 'error') = 0 AS ok, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos FROM i")
def health_verdict(spark, sf_dir):
    """AGG-04, AGG-26, SNK-11."""
    return H.is_ok(_issues(spark, sf_dir))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'missing' WHEN n <> 4 THEN 'modified' WHEN o_orderkey % 7 <> 0 AND o_orderpriority <> '1-URGENT' THEN 'metadata_drift' ELSE 'available' END AS status
FROM (SELECT o_orderkey, o_orderstatus, o_orderpriority, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)""")
def status_case(spark, sf_dir):
    """SCL-67, SUP-02: an order's lines stand for its size, its priority for the time of change."""
    o = H.references(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey")
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey") % 7).otherwise(F.lit(-1))
    state = H.status(F.col("o_orderstatus") != "P", F.col("n_references"), F.lit(4), urgent, F.col("o_orderkey") % 7)
    return o.select("o_orderkey", state.alias("status"))


@query("""SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_quantity > 45 THEN 'too_many' END, CASE WHEN l_discount > 0.09 THEN 'discount' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END, CASE WHEN l_tax = 0 THEN 'untaxed' END) AS reasons FROM lineitem""")
def compat_reasons(spark, sf_dir):
    """FLT-06, FLT-05, FLT-13, FLT-22."""
    tests = [(F.col("l_quantity") > 45, "too_many"), (F.col("l_discount") > 0.09, "discount"), (F.col("l_returnflag") == "R", "returned"), (F.col("l_tax") == 0, "untaxed")]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(H.reasons(tests), ",").alias("reasons"))


@query("SELECT l.doc_id, lang, quality FROM labels l JOIN documents d USING (doc_id) WHERE n_chars < CASE WHEN lang = 'en' THEN 1000 ELSE 500 END")
def failed_by_type_threshold(spark, sf_dir):
    """FLT-20, FLT-14: a bound for each type."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return j.where(F.col("n_chars") < F.when(F.col("lang") == "en", 1000).otherwise(500)).select("doc_id", "lang", "quality")


@query("""SELECT user_id, count(*) AS sample_count, count(*) FILTER (event_type <> 'error') AS completed_count, count(*) FILTER (event_type = 'error') AS error_count,
round_even(avg(value) FILTER (event_type <> 'error'), 6) AS ratio_mean, round_even(min(value) FILTER (event_type <> 'error'), 6) AS ratio_min, round_even(max(value) FILTER (event_type <> 'error'), 6) AS ratio_max,
bool_or(event_type = 'purchase') AS any_purchase, count(*) FILTER (event_type = 'signup') AS correction_rounds FROM events GROUP BY user_id""")
def bench_aggregate(spark, sf_dir):
    """AGG-14, AGG-15, AGG-16, AGG-17, SNK-14: errors are counted and kept out of the measures."""
    done = lambda f: F.bround(f(F.when(F.col("event_type") != "error", F.col("value"))), 6)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("sample_count"), F.count_if(F.col("event_type") != "error").alias("completed_count"), F.count_if(F.col("event_type") == "error").alias("error_count"),
        done(F.avg).alias("ratio_mean"), done(F.min).alias("ratio_min"), done(F.max).alias("ratio_max"), F.bool_or(F.col("event_type") == "purchase").alias("any_purchase"), F.count_if(F.col("event_type") == "signup").alias("correction_rounds"),
    )


@query("""SELECT 'nation.n_regionkey' AS constraint_name, count(*) AS n FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)
UNION ALL SELECT 'customer.c_nationkey', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)
UNION ALL SELECT 'orders.o_custkey', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'lineitem.l_orderkey', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'labels.doc_id', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'documents.pk', count(*) FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)
UNION ALL SELECT 'conversations.pk', count(*) FROM (SELECT conv_id, turn FROM conversations GROUP BY conv_id, turn HAVING count(*) > 1)""")
def cast_constraints(spark, sf_dir):
    """INT-03, JON-03: keys and references of the catalog."""
    t = lambda name: table(spark, sf_dir, name)
    parts = [
        H.violations(t("nation"), t("region"), "n_regionkey", "r_regionkey", "nation.n_regionkey"), H.violations(t("customer"), t("nation"), "c_nationkey", "n_nationkey", "customer.c_nationkey"),
        H.violations(t("orders"), t("customer"), "o_custkey", "c_custkey", "orders.o_custkey"), H.violations(t("lineitem"), t("orders"), "l_orderkey", "o_orderkey", "lineitem.l_orderkey"),
        H.violations(t("labels"), t("documents"), "doc_id", "doc_id", "labels.doc_id"), H.repeated_keys(t("documents"), ["doc_id"], "documents.pk"), H.repeated_keys(t("conversations"), ["conv_id", "turn"], "conversations.pk"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'ring')")
def catalog_search(spark, sf_dir):
    """FLT-03, FLT-04."""
    return H.search(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"], "RING").select("p_partkey", "p_name")


@query("""SELECT event_id, CASE WHEN props IS NULL OR trim(props) = '' THEN 'empty' WHEN NOT json_valid(props) THEN 'invalid' WHEN json_type(props) <> 'OBJECT' THEN 'not_object' ELSE 'ok' END AS state, CASE WHEN json_valid(props) THEN TRY_CAST(props->>'$.k' AS BIGINT) END AS k FROM events""")
def json_guard(spark, sf_dir):
    """SRC-14, SCL-64, SUP-04: every payload is classified, none raises."""
    e = table(spark, sf_dir, "events")
    v = F.try_parse_json("props")
    state = F.when(F.coalesce(F.trim("props"), F.lit("")) == "", "empty").when(v.isNull(), "invalid").when(~F.schema_of_variant(v).startswith("OBJECT"), "not_object").otherwise("ok")
    return e.select("event_id", state.alias("state"), F.try_variant_get(v, "$.k", "bigint").alias("k"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round_even(sum(l_quantity), 2) AS total FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def byte_totals(spark, sf_dir):
    """AGG-11, SET-07."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.bround(F.sum("l_quantity"), 2).alias("total"))


@query("""WITH d AS (SELECT *, sha256(coalesce(text, '')) AS sha FROM documents) SELECT sha, 'copies: ' || array_to_string(list_sort(list(doc_id)), ', ') AS description FROM d GROUP BY sha HAVING count(*) > 1""")
def duplicate_usage(spark, sf_dir):
    """AGG-23."""
    d = table(spark, sf_dir, "documents").select("doc_id", content_hash(F.col("text")).alias("sha"))
    return d.groupBy("sha").agg(F.sort_array(F.collect_list("doc_id")).alias("ids")).where(F.size("ids") > 1).select("sha", F.concat(F.lit("copies: "), F.array_join("ids", ", ")).alias("description"))


@query("""SELECT conv_id, sha256(array_to_string(list(CAST(turn AS VARCHAR) || ':' || role ORDER BY turn), '|')) AS structure, count(*) AS n FROM conversations GROUP BY conv_id""")
def structure_digest(spark, sf_dir):
    """AGG-22, SCL-46, N10: a digest of ordered anchors."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("a"), F.count("*").alias("n"))
    return rows.select("conv_id", F.sha2(F.array_join(F.transform("a", lambda x: F.concat_ws(":", x["turn"].cast("string"), x["role"])), "|"), 256).alias("structure"), "n")
