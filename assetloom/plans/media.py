"""Queries on rules of media, plans and reports over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetloom.functions import media as M
from assetloom.operators import budget as B
from assetloom.operators import reports as R
from assetloom.sources import rewrites as W

from .registry import query, table


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity * 50 AS INT) AS w, CAST(l_quantity * 30 AS INT) AS h, CASE WHEN l_returnflag = 'R' THEN '.mov' ELSE '.MP4' END AS s, CASE WHEN l_linestatus = 'O' THEN 'h264' ELSE 'vp9' END AS v, CASE WHEN l_linenumber = 1 THEN NULL ELSE 'aac' END AS a, CAST(l_extendedprice / 10 AS INT) AS k FROM lineitem),
f AS (SELECT *, w > 0 AND h > 0 AND (CASE WHEN w >= h THEN w <= 1280 AND h <= 720 ELSE w <= 720 AND h <= 1280 END) AND w % 2 = 0 AND h % 2 = 0 AND s <> '.mov' AND v = 'h264' AND k > 0 AND k <= 5000 AS fits FROM x)
SELECT l_orderkey, l_linenumber, fits, CASE WHEN w <= 0 OR h <= 0 THEN 'by the tier''s rules' WHEN fits THEN 'as it is' ELSE 'encode to 720p, CRF 23, at most 5 Mbps' END AS plan FROM f""")
def tier_plan(spark, sf_dir):
    """FLT-05, SCL-68, SUP-10."""
    q = F.col("l_quantity")
    whole = lambda x: F.rint(x).cast("int")
    w, h = whole(q * 50), whole(q * 30)
    rules = M.tier("balanced")
    fits = M.embeddable(w, h, F.when(F.col("l_returnflag") == "R", ".mov").otherwise(".MP4"), F.when(F.col("l_linestatus") == "O", "h264").otherwise("vp9"), F.when(F.col("l_linenumber") != 1, "aac"), whole(F.col("l_extendedprice") / 10), rules)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fits.alias("fits"), M.plan_text(w, h, fits, rules).alias("plan"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN true ELSE l_linenumber > 1 OR l_quantity > 25 END AS usable, l_quantity > 24.5 AS fewer_frames,
CASE WHEN l_quantity / 50 < 0.75 THEN 'digital' WHEN l_linestatus = 'O' THEN 'mixed' ELSE 'scanned' END AS page, least(1920, CAST(trunc(1920 * (l_quantity / 50) * 1.5::DOUBLE) AS BIGINT)) AS pixels,
CASE WHEN least(l_quantity / 50, 0.9::DOUBLE) < 0.5 OR l_discount * 10 < CASE WHEN l_returnflag = 'A' THEN 0.98 ELSE 0.9 END THEN 'image_quality_below_threshold' WHEN l_linestatus = 'O' THEN 'image_metadata_changed' END AS gate FROM lineitem""")
def media_rules(spark, sf_dir):
    """FLT-10, FLT-11, FLT-14, AGG-10, PRJ-05."""
    q = F.col("l_quantity")
    known = F.col("l_returnflag") != "N"
    usable = M.audio_usable(F.when(known, F.when(q > 25, "1.5").otherwise("0")), F.when(known, F.col("l_linenumber").cast("string")).otherwise("N/A"))
    gate = M.image_gate(q / 50, F.lit(0.9), F.col("l_discount") * 10, F.lit(1.0), F.lit(0.5), F.when(F.col("l_returnflag") == "A", "line_art").otherwise("photo"), F.col("l_linestatus") != "O")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", usable.alias("usable"), M.fewer_frames(F.lit(24.0), q).alias("fewer_frames"), M.page_class(q / 50, F.col("l_linestatus") == "O").alias("page"), M.display_pixels(F.lit(1920), q / 50, 1.5).alias("pixels"), gate.alias("gate"))


@query("""SELECT page_id, regexp_extract(url, '/([^/?#]*)$', 1) = '.env' OR regexp_matches(lower(url), '\\.(log|key|pem|db)$') OR contains(url, '/.ssh/') AS sensitive FROM pages""")
def sensitive_paths(spark, sf_dir):
    """FLT-18."""
    return table(spark, sf_dir, "pages").select("page_id", M.sensitive(F.col("url")).alias("sensitive"))


@query("""WITH r AS (SELECT o_orderkey, o_custkey, o_totalprice / 500000 AS ssim FROM orders)
SELECT o_custkey, count(*) AS n, round_even(avg(ssim), 6) AS mean_ssim, round_even(min(ssim), 6) AS min_ssim, arg_min(o_orderkey, (ssim, o_orderkey)) AS worst, arg_max(o_orderkey, (ssim, o_orderkey)) AS best,
CASE WHEN round_even(avg(ssim), 6) >= 0.98 THEN 'A+' WHEN round_even(avg(ssim), 6) >= 0.95 THEN 'A' WHEN round_even(avg(ssim), 6) >= 0.9 THEN 'B' ELSE 'C' END AS grade FROM r GROUP BY o_custkey""")
def audit_summary(spark, sf_dir):
    """AGG-17, AGG-21, SCL-34."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("media_path"), (F.col("o_totalprice") / 500000).alias("ssim"))
    return R.audit_summary(rows, "o_custkey")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 25 AND l_discount < 0.05 THEN 'retry' WHEN l_quantity < 25 AND l_tax > 0.02 THEN 'retry' ELSE 'restore_original' END AS action,
CASE WHEN l_quantity < 25 AND l_discount < 0.05 THEN 1.0 WHEN l_quantity < 25 AND l_tax > 0.02 THEN 1.0 END AS scale, CASE WHEN l_quantity < 25 AND l_discount < 0.05 THEN 85 WHEN l_quantity < 25 AND l_tax > 0.02 THEN 88 END AS quality FROM lineitem""")
def quality_ladder(spark, sf_dir):
    """ITR-07."""
    step = R.next_try(F.when(F.col("l_quantity") < 25, "image_quality_below_threshold").otherwise("image_metadata_changed"), F.when(F.col("l_discount") < 0.05, 0.8).otherwise(1.0), F.lit(85), F.col("l_tax") > 0.02, F.lit(True))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", step["action"].alias("action"), step["scale"].alias("scale"), step["quality"].alias("quality"))


@query("""SELECT o_custkey, '| media | bytes | status | SSIM |' || chr(10) || '|-|-|-|-|' || chr(10) || string_agg('| ' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || ' | ' || CAST(o_orderkey % 1000 AS VARCHAR) || ' | ' || o_orderstatus || ' | ' || printf('%.4f', 0.5::DOUBLE) || ' |', chr(10) ORDER BY lpad(CAST(o_orderkey AS VARCHAR), 9, '0')) AS markdown FROM orders GROUP BY o_custkey""")
def report_markdown(spark, sf_dir):
    """SNK-05, SNK-14."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("media_path"), (F.col("o_orderkey") % 1000).alias("zip_size_bytes"), F.col("o_orderstatus").alias("status"), F.lit(0.5).alias("source_ssim"))
    return R.markdown(rows, "o_custkey")


@query()
def quality_plan(spark, sf_dir):
    """ITR-05, AGG-13, SCL-24: heights down the ladder, the rest of the budget poured, rates clamped; an order is a deck."""
    from assetloom.functions import numbers as N

    from .budgets import _videos

    v = _videos(spark, sf_dir)
    a, w, h = F.col("area"), F.col("width_ratio"), F.col("height_ratio")
    rows = v.select(
        "l_orderkey", "l_linenumber", F.lit(1080).alias("height"), N.height_floor(a, w, h).alias("soft"), M.hard_floor(a, w, h).alias("hard"), "video_kbps", N.audio_kbps(F.col("has_audio"), a, w, h, F.lit(0.5), F.col("audio_source_kbps")).cast("long").alias("audio_kbps"),
        (F.col("video_kbps") + 160).alias("total_kbps"), "seconds", N.priority(a, F.col("video_kbps") * 100, F.col("video_kbps"), F.col("seconds"), F.lit(250_000), F.lit(2500)).alias("weight"), F.lit(15_000_000).cast("long").alias("target"),
    )
    return B.quality_plan(rows, "l_orderkey", "l_linenumber")


@query("""WITH h AS (SELECT sha256(CAST(c_custkey AS VARCHAR)) AS s, c_nationkey AS k FROM customer)
SELECT o_orderkey, CASE WHEN k < 3 THEN 'ambiguous' WHEN k < 10 THEN 'existing' WHEN k < 15 THEN 'matched' ELSE 'new' END AS how,
CASE WHEN k < 3 THEN NULL WHEN k < 10 THEN 'f' || CAST(k AS VARCHAR) WHEN k < 15 THEN 'm' || CAST(k AS VARCHAR) ELSE 'family-' || left(sha256(CAST(o_custkey AS VARCHAR)), 16) END AS family_id
FROM orders LEFT JOIN h ON s = sha256(CAST(o_custkey AS VARCHAR))""")
def archived_media(spark, sf_dir):
    """SNK-03: an order is a medium, its status the deck, its customer the content; nations tell what the library knows."""
    sha = lambda c: F.sha2(F.col(c).cast("string"), 256).alias("sha256")
    c, k = table(spark, sf_dir, "customer"), F.col("c_nationkey").cast("string")
    media = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("package"), F.concat(F.lit("ppt/media/"), F.col("o_orderkey").cast("string")).alias("media"), sha("o_custkey"), (F.col("o_orderkey") % 1000).alias("size_bytes"))
    hashes = c.where("c_nationkey < 10").select(sha("c_custkey"), F.concat(F.lit("f"), k).alias("family_id"))
    hashes = hashes.unionByName(c.where("c_nationkey < 3").select(sha("c_custkey"), F.lit("other").alias("family_id")))
    matches = c.where("c_nationkey BETWEEN 10 AND 14").select(sha("c_custkey"), F.concat(F.lit("m"), k).alias("family_id"))
    return W.archived(media, hashes, matches)[0].select("o_orderkey", "how", "family_id")
