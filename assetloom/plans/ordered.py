"""Queries on ordered analytics over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetloom.operators import ordered as O

from .registry import query, table


@query("""SELECT conv_id, turn, role, CASE WHEN role <> 'system' THEN CAST(sum(CASE WHEN role <> 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) END AS number FROM conversations""")
def visible_renumber(spark, sf_dir):
    """WIN-02, SRC-19, JON-22, SRC-02: turns count without those of the system."""
    return O.renumbered(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", F.col("role") != "system")


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS index FROM conversations")
def occurrence_index(spark, sf_dir):
    """WIN-03."""
    return O.indexed(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id", "role"], "turn")


@query("""WITH p AS (SELECT source, doc_id, n_chars, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS done, sum(n_chars) OVER (PARTITION BY source) AS total FROM documents),
s AS (SELECT *, round_even(done::DOUBLE / greatest(total, 1), 6) AS share FROM p) SELECT source, doc_id, n_chars, done, share, max(share) OVER (PARTITION BY source ORDER BY doc_id) AS shown FROM s""")
def progress_prefix(spark, sf_dir):
    """WIN-05, WIN-06."""
    return O.progress(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_output(spark, sf_dir):
    """WIN-08, SNK-16: each customer's newest order."""
    return O.latest(table(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT p_name, p_partkey, p_size, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC, p_retailprice DESC, p_partkey) = 1")
def best_variant_per_family(spark, sf_dir):
    """AGG-20, N3, SUP-01."""
    return O.best(table(spark, sf_dir, "part"), "p_name", ["p_size", "p_retailprice"], "p_partkey", ["p_size", "p_retailprice"])


@query("""WITH s AS (SELECT p_brand, min(p_partkey) AS source FROM part GROUP BY p_brand)
SELECT p.p_brand, p_partkey, p_partkey = source AS is_source, row_number() OVER (PARTITION BY p.p_brand ORDER BY p_partkey = source DESC, p_size DESC, p_retailprice DESC, p_partkey) AS place FROM part p JOIN s ON p.p_brand = s.p_brand""")
def source_first_order(spark, sf_dir):
    """WIN-04, SRT-06: the source first, then by quality."""
    from pyspark.sql import Window as W

    p = table(spark, sf_dir, "part").withColumn("is_source", F.col("p_partkey") == F.min("p_partkey").over(W.partitionBy("p_brand")))
    place = F.row_number().over(W.partitionBy("p_brand").orderBy(F.desc("is_source"), F.desc("p_size"), F.desc("p_retailprice"), "p_partkey"))
    return p.select("p_brand", "p_partkey", "is_source", place.cast("long").alias("place"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_discount FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) = 1")
def largest_occurrence(spark, sf_dir):
    """AGG-08: the largest line of each order with its own other measures."""
    return O.best(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_extendedprice"], "l_linenumber", ["l_extendedprice", "l_quantity", "l_discount"])


@query("SELECT l_orderkey, max(l_extendedprice) AS max_price, max(l_quantity) AS max_quantity, max(l_discount) AS max_discount FROM lineitem GROUP BY l_orderkey")
def independent_maxima(spark, sf_dir):
    """AGG-09, AGG-10: each measure's own largest value."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("max_price"), F.max("l_quantity").alias("max_quantity"), F.max("l_discount").alias("max_discount"))


@query("SELECT l_returnflag, l_extendedprice AS upper_median FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) = count(*) OVER (PARTITION BY l_returnflag) // 2 + 1")
def upper_median(spark, sf_dir):
    """AGG-12, N4."""
    return O.exact_upper_median(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")


@query("""SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT o_orderkey, 'revised', o_totalprice * 2 FROM orders WHERE o_orderstatus = 'F'""")
def report_upsert(spark, sf_dir):
    """SNK-06, ITR-08: finished orders come in again and take their old rows' place."""
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = old.where("o_orderstatus = 'F'").select("o_orderkey", F.lit("revised").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return O.upserted(old, new, "o_orderkey")


@query("""SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, lower(p_name), p_partkey) AS by_size, row_number() OVER (ORDER BY lower(p_name), p_size DESC, p_partkey) AS by_name,
row_number() OVER (ORDER BY p_retailprice, p_partkey) AS by_price FROM part""")
def library_sort_modes(spark, sf_dir):
    """SRT-03, SRT-05, SRT-09, FLT-04: places in several orders with stable ties."""
    p = table(spark, sf_dir, "part")
    out = p.select("p_partkey")
    orders = {"by_size": [F.desc("p_size"), F.lower("p_name"), F.col("p_partkey")], "by_name": [F.lower("p_name"), F.desc("p_size"), F.col("p_partkey")], "by_price": [F.col("p_retailprice"), F.col("p_partkey")]}
    for name, by in orders.items():
        out = out.join(ranked(p, by, "p_partkey", name), "p_partkey")
    return out


def ranked(rows, by, key, name):
    """Places of a whole table, from ranges of the order."""
    out = O.running(rows, [], by, F.lit(1).cast("long"), "place")
    return out.select(key, (F.col("place") + 1).alias(name))


@query("""SELECT n_nationkey AS source, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders, count(DISTINCT c_mktsegment) AS segments, coalesce(min(c_name), '') AS first_name
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_nationkey""")
def merge_impact(spark, sf_dir):
    """AGG-19, DML-05: what merging a nation into another would move."""
    j = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.groupBy(F.col("n_nationkey").alias("source")).agg(F.count_distinct("c_custkey").alias("customers"), F.count("o_orderkey").alias("orders"), F.count_distinct("c_mktsegment").alias("segments"), F.coalesce(F.min("c_name"), F.lit("")).alias("first_name"))


@query("SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS shown FROM events")
def monotone_progress(spark, sf_dir):
    """WIN-06: each user's values as a progress that never falls."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    return O.running_max(rows, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("value"), "shown").select("user_id", "event_id", "value", "shown")
