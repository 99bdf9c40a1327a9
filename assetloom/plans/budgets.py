"""Queries on byte budgets: order lines stand for the videos and images of a deck."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetloom.functions import numbers as N
from assetloom.operators import budget as B

from .registry import query, table


@query("""WITH b AS (SELECT l_returnflag, CAST(sum(l_quantity) * 1000 AS BIGINT) AS v, CAST(sum(l_extendedprice) / 100 AS BIGINT) AS i, CAST(trunc(sum(l_quantity) * 700) AS BIGINT) AS t FROM lineitem GROUP BY l_returnflag),
f AS (SELECT *, greatest(0, v - CAST(trunc(v * 0.5::DOUBLE) AS BIGINT)) AS vr, greatest(0, i - CAST(trunc(i * 0.82::DOUBLE) AS BIGINT)) AS ir, greatest(0, v + i - t) AS need FROM b),
g AS (SELECT *, CASE WHEN vr + ir > 0 THEN CAST(trunc(least(need, vr + ir) * vr / (vr + ir)::DOUBLE) AS BIGINT) ELSE 0 END AS vs FROM f), h AS (SELECT *, least(need, vr + ir) - vs AS is_ FROM g),
k AS (SELECT *, need - vs - is_ AS remain, greatest(0, v - vs) AS mv, greatest(0, i - is_) AS mi FROM h), m AS (SELECT *, CASE WHEN remain > 0 AND mv + mi > 0 THEN least(mv, CAST(trunc(remain * mv / (mv + mi)::DOUBLE) AS BIGINT)) ELSE 0 END AS ev FROM k)
SELECT l_returnflag, v AS video, i AS image, t AS target, CASE WHEN t >= v + i THEN v ELSE greatest(0, v - vs - ev) END AS video_budget, CASE WHEN t >= v + i THEN i ELSE greatest(0, i - is_ - CASE WHEN remain > 0 AND mv + mi > 0 THEN least(mi, remain - ev) ELSE 0 END) END AS image_budget FROM m""")
def budget_split(spark, sf_dir):
    """ITR-04, AGG-11."""
    b = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.rint(F.sum("l_quantity") * 1000).cast("long").alias("video"), F.rint(F.sum("l_extendedprice") / 100).cast("long").alias("image"), (F.sum("l_quantity") * 700).cast("long").alias("target"))
    return B.split(b, "video", "image", "target", "balanced", "balanced")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS area, l_discount * 10 AS w, l_tax * 10 AS h, l_quantity * 25 AS px FROM lineitem),
f AS (SELECT *, CASE WHEN area >= 0.45 OR w >= 0.78 OR h >= 0.78 THEN 1080 WHEN area >= 0.12 OR w >= 0.5 OR h >= 0.5 THEN 720 ELSE 480 END AS floor_height FROM x)
SELECT l_orderkey, l_linenumber, floor_height, CASE WHEN px <= 480 THEN 480 WHEN px <= 720 THEN 720 ELSE 1080 END AS bucket,
round_even(greatest(0.9::DOUBLE, least(0.995::DOUBLE, 0.95::DOUBLE + (sqrt(greatest(0.01::DOUBLE, least(1.0::DOUBLE, area))) - 0.5) * 0.04::DOUBLE + least(0.015::DOUBLE, log2(l_linenumber) * 0.005::DOUBLE))), 4) AS threshold FROM f""")
def plan_bands(spark, sf_dir):
    """SCL-21, SCL-22, SCL-26, FLT-12, SRC-13."""
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("area"), (F.col("l_discount") * 10).alias("w"), (F.col("l_tax") * 10).alias("h"), (F.col("l_quantity") * 25).alias("px"))
    return x.select("l_orderkey", "l_linenumber", N.height_floor(F.col("area"), F.col("w"), F.col("h")).alias("floor_height"), N.height_bucket(F.col("px"), F.lit(480), F.lit(1080)).alias("bucket"), N.quality_threshold(0.95, F.col("area"), F.col("l_linenumber"), 0.90).alias("threshold"))


@query("""WITH o AS (SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS actual, 100000::BIGINT AS target, 90000::BIGINT AS budget, 120000::BIGINT AS most FROM orders),
n AS (SELECT *, greatest(1, least(budget - 1, CAST(trunc(budget * target / actual::DOUBLE * 0.98::DOUBLE) AS BIGINT))) AS lower_, least(most, greatest(budget + 1, CAST(trunc(budget * target * 0.975::DOUBLE / actual::DOUBLE) AS BIGINT))) AS higher FROM o WHERE actual > 0)
SELECT o_orderkey, actual, CASE WHEN actual > target AND lower_ < budget THEN lower_ WHEN actual < 95000 AND higher > budget THEN higher END AS next_budget,
CASE WHEN actual > target AND lower_ < budget THEN 'correction' WHEN actual < 95000 AND higher > budget THEN 'quality_giveback' END AS kind, round_even(actual / 100000.0::DOUBLE, 6) AS ratio, CASE WHEN actual <= target THEN 'met' ELSE 'quality_limited' END AS status FROM n""")
def capacity_controller_step(spark, sf_dir):
    """ITR-06, PRJ-03."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("long").alias("actual")).where("actual > 0")
    step = B.next_budget(F.col("actual"), F.lit(100_000), F.lit(90_000), F.lit(120_000), F.lit(0), F.lit(False))
    report = B.target_report(F.lit(0.1), F.col("actual"))
    return o.select("o_orderkey", "actual", step["budget"].alias("next_budget"), step["kind"].alias("kind"), report["target_ratio"].alias("ratio"), report["status"].alias("status"))


def _videos(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("area"), (F.col("l_discount") * 10).alias("width_ratio"), (F.col("l_tax") * 10).alias("height_ratio"), (F.col("l_quantity") * 25).alias("display_px"),
        (F.col("l_quantity") * 24).cast("int").alias("height"), (F.col("l_quantity") + 10).alias("fps"), (F.col("l_linenumber") * 10.0).alias("seconds"), (F.col("l_returnflag") != "R").alias("has_audio"), (F.col("l_quantity") * 100).cast("long").alias("video_kbps"), F.lit(160).alias("audio_source_kbps"),
    )


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS area, l_discount * 10 AS w, l_tax * 10 AS h, l_quantity * 25 AS px, l_quantity + 10 AS fps, l_linenumber * 10.0::DOUBLE AS sec, l_returnflag <> 'R' AS au, CAST(l_quantity * 100 AS BIGINT) AS kb FROM lineitem),
f AS (SELECT *, CASE WHEN area >= 0.45 OR w >= 0.78 OR h >= 0.78 THEN 1080 ELSE 720 END AS fl FROM x),
p AS (SELECT *, greatest(CASE WHEN px <= 480 THEN 480 WHEN px <= 720 THEN 720 ELSE 1080 END, fl) AS plan_height FROM f),
r AS (SELECT *, least(CASE plan_height WHEN 720 THEN 980 ELSE 1950 END, CASE WHEN kb > 1 THEN kb ELSE 3900 END) AS lo, CASE plan_height WHEN 720 THEN 2150 ELSE 3900 END AS best, CASE WHEN NOT au THEN 0 WHEN area >= 0.45 OR w >= 0.78 OR h >= 0.78 OR area >= 0.12 THEN 128 WHEN area >= 0.08 THEN 96 ELSE 64 END AS audio FROM p),
s AS (SELECT *, greatest(least(best, CASE WHEN kb > 1 THEN kb ELSE best END), lo) AS hi FROM r), v AS (SELECT *, greatest(least(lo + CAST(trunc((hi - lo) * 0.62::DOUBLE) AS BIGINT), hi), lo) AS vk FROM s)
SELECT l_orderkey, l_linenumber, plan_height, CAST(vk AS BIGINT) AS video_target_kbps, audio AS audio_kbps, CAST(trunc((vk + audio) * 1000 / 8.0::DOUBLE * sec) AS BIGINT) AS target_bytes, least(fps, 30.0::DOUBLE) AS target_fps FROM v""")
def profile_plan(spark, sf_dir):
    """SCL-22, SCL-23, SCL-27, SUP-07, SUP-09, PRJ-05."""
    return B.profile_plan(_videos(spark, sf_dir), "balanced").select("l_orderkey", "l_linenumber", "plan_height", "video_target_kbps", "audio_kbps", "target_bytes", "target_fps")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity * 1000 AS BIGINT) AS size, l_quantity / 50 AS area, l_linenumber AS uses, l_returnflag = 'A' AS art, l_linestatus = 'F' AS sup FROM lineitem),
p AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 80000.0::DOUBLE / sum(size) OVER (PARTITION BY l_orderkey))) AS pr, greatest(0.65::DOUBLE, least(1.25::DOUBLE, 0.65::DOUBLE + sqrt(greatest(0.01::DOUBLE, least(1.0::DOUBLE, area))) * 0.35::DOUBLE + least(0.15::DOUBLE, log2(uses) * 0.05::DOUBLE) + CASE WHEN art THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END)) AS imp FROM x),
s AS (SELECT *, CASE WHEN pr >= 1 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE + 0.2::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, (pr - 0.70::DOUBLE) / 0.30::DOUBLE)) END AS sc FROM p)
SELECT l_orderkey, l_linenumber, CASE WHEN NOT sup THEN 100 ELSE 75 END AS quality, round_even(CASE WHEN NOT sup THEN 1.0::DOUBLE ELSE sc END, 6) AS scale FROM s""")
def image_plan(spark, sf_dir):
    """SCL-25, SCL-28, SCL-70: the pressure of an order's budget on its images."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 1000).cast("long").alias("size"), (F.col("l_quantity") / 50).alias("area"), F.col("l_linenumber").alias("uses"), F.when(F.col("l_returnflag") == "A", "line_art").otherwise("photo").alias("content"), (F.col("l_linestatus") == "F").alias("supported"))
    out = B.image_plan(rows, "aggressive", F.lit(80_000.0), "l_orderkey")
    return out.select("l_orderkey", "l_linenumber", "quality", F.bround("scale", 6).alias("scale"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN true WHEN l_returnflag = 'R' OR l_linenumber > 6 OR l_quantity < 20 THEN false ELSE l_extendedprice * 0.9 >= CAST(trunc(l_extendedprice * 0.98) AS BIGINT) OR l_quantity * 0.99 >= CAST(trunc(l_quantity * 0.98) AS BIGINT) END AS copied,
l_returnflag = 'R' OR l_extendedprice * (1 - l_discount) < l_extendedprice * 0.85::DOUBLE AS worth, l_discount < 0.05 AND l_extendedprice * l_discount < 10485760 AS file_stays FROM lineitem""")
def copy_decisions(spark, sf_dir):
    """FLT-07, FLT-08, FLT-09, FLT-10, FLT-11."""
    q, p, d = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount")
    copied = B.should_copy(F.col("l_tax") != 0, F.col("l_returnflag") == "R", F.col("l_linenumber") > 6, q, F.lit(20), q * 0.99, q, p * 0.9, p)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", copied.alias("copied"), B.is_worth(F.col("l_returnflag") == "R", p * (1 - d), p).alias("worth"), ((d < 0.05) & (p * d < 10 * 1024 * 1024)).alias("file_stays"))


@query()
def water_fill(spark, sf_dir):
    """ITR-05, AGG-13: each order's byte budget poured over its lines."""
    low, high = N.bitrate_bounds(F.lit(720), F.col("video_kbps"))
    rows = _videos(spark, sf_dir).withColumns({"floor_kbps": low.cast("long"), "cap_kbps": high.cast("long"), "weight": F.col("area"), "target": F.lit(20_000_000).cast("long")})
    return B.water_fill(rows.select("l_orderkey", "l_linenumber", "floor_kbps", "cap_kbps", "seconds", "weight", "target"), "l_orderkey", "l_linenumber")
