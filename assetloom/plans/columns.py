"""Queries on scalar functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetloom.functions import bits, names, numbers
from assetloom.operators import identity as I

from .registry import query, table

_SUF = "(mp4|mov|m4v|wmv|avi|mkv|webm)"


@query(f"""WITH p AS (SELECT p_partkey, p_name || ' copy.MP4.mov' AS raw FROM part),
m AS (SELECT *, trim(regexp_replace(lower(trim(raw)), '(\\.{_SUF}\\s*)+$', '')) AS media FROM p)
SELECT p_partkey, media AS media_name, regexp_replace(regexp_replace(media, '(?i)(?:[\\s._-]+(?:copy|副本)|\\s*\\(\\d+\\)|[_-]\\d+)$', ''), '^[ ._-]+|[ ._-]+$', '', 'g') AS cleanup_name, regexp_replace(trim(raw), '(?i)\\.{_SUF}$', '') AS stem FROM m""")
def name_normalize(spark, sf_dir):
    """SCL-02, SCL-03, SCL-04."""
    raw = F.concat("p_name", F.lit(" copy.MP4.mov"))
    return table(spark, sf_dir, "part").select("p_partkey", names.media_name(raw).alias("media_name"), names.cleanup_name(raw).alias("cleanup_name"), names.media_stem(raw).alias("stem"))


@query("""WITH p AS (SELECT p_partkey, '._' || p_name || '/' || p_brand || '?' AS raw FROM part)
SELECT p_partkey, substr(regexp_replace(regexp_replace(raw, '[^\\p{L}\\p{N}_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 1, 80) AS safe FROM p""")
def safe_name(spark, sf_dir):
    """SCL-01, N11."""
    raw = F.concat(F.lit("._"), "p_name", F.lit("/"), "p_brand", F.lit("?"))
    return table(spark, sf_dir, "part").select("p_partkey", names.safe_name(raw).alias("safe"))


@query("""SELECT p_partkey, regexp_replace(p_type, '[^\\p{L}\\p{N}_.-]+', '_', 'g') || '/' || regexp_replace(regexp_replace(p_name, '[^\\p{L}\\p{N}_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS category, CAST(NULL AS VARCHAR) AS refused FROM part""")
def category_normalize(spark, sf_dir):
    """SCL-05, SCL-06: separators are unified; absolute paths are refused."""
    return table(spark, sf_dir, "part").select("p_partkey", names.category(F.concat("p_type", F.lit("\\"), "p_name", F.lit("/"))).alias("category"), names.category(F.concat(F.lit("/"), "p_name")).alias("refused"))


@query("""SELECT p_partkey, regexp_replace(p_name, '[^\\p{L}\\p{N}_.-]+', '_', 'g') || '_[' || p_size || 'x' || (p_size + 1) || '_' || printf('%.1f', p_size / 2.0::DOUBLE) || 's]_' || substr(sha256(p_name), 1, 8) || '.mp4' AS filename,
CASE WHEN row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1 THEN p_name ELSE p_name || '_' || row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) END AS free_name FROM part""")
def variant_filenames(spark, sf_dir):
    """SCL-04, SCL-09, SCL-43."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("p_name").orderBy("p_partkey"))
    name = names.variant_filename(F.col("p_name"), F.col("p_size"), F.col("p_size") + 1, F.col("p_size") / 2, F.sha2("p_name", 256), F.lit(".mp4"))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("filename"), names.numbered(F.col("p_name"), place).alias("free_name"))


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || '|model-1|text' AS scope, 'media/' || page_id || '.png' AS resolved, CASE WHEN contains(url, '?') THEN true ELSE false END AS has_query FROM pages""")
def path_functions(spark, sf_dir):
    """SCL-06, SCL-07, SCL-10, SCL-11, PRJ-09."""
    path = F.concat(F.lit("slides\\./rels/../../media//"), F.col("page_id").cast("string"), F.lit(".png"))
    return table(spark, sf_dir, "pages").select("page_id", names.scope_key(F.col("url"), F.lit(" model–1 "), F.lit(False)).alias("scope"), names.resolved(path).alias("resolved"), F.contains("url", F.lit("?")).alias("has_query"))


@query("SELECT doc_id, CASE WHEN lang = source THEN lang ELSE concat_ws(',', lang, source) END AS tags FROM documents")
def tag_normalize(spark, sf_dir):
    """SCL-61, SET-11, PRJ-07."""
    tags = F.array(F.concat(F.lit(" "), "lang"), F.lit("  "), "source", "lang", F.concat("source", F.lit(" ")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(I.clean_tags(tags), ",").alias("tags"))


@query("""SELECT l_orderkey, l_linenumber, CAST(greatest(2, ceil(l_quantity / 2) * 2) AS BIGINT) AS even, CAST(l_quantity * 1000000 AS BIGINT) AS bytes,
CASE WHEN 20 * l_quantity <= 480 THEN 480 WHEN 20 * l_quantity <= 720 THEN 720 ELSE 1080 END AS bucket, CAST(least(1000000, greatest(64000, CAST(trunc(greatest(0, l_extendedprice * 10000 - 1000) * 0.005) AS BIGINT))) AS BIGINT) AS reserve FROM lineitem""")
def numeric_functions(spark, sf_dir):
    """SCL-20, SCL-21, SCL-31."""
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.even_up(q).alias("even"), numbers.mb_to_bytes(q).alias("bytes"), numbers.height_bucket(20 * q, F.lit(480), F.lit(1080)).alias("bucket"), numbers.package_reserve(F.col("l_extendedprice") * 10000, F.lit(1000)).alias("reserve"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS area, l_extendedprice AS size, l_quantity * 100 AS kbps FROM lineitem)
SELECT l_orderkey, l_linenumber, round_even(pow(greatest(0.04::DOUBLE, area), 0.6::DOUBLE) * greatest(0.7::DOUBLE, least(1.6::DOUBLE, sqrt(size / 25000))) * greatest(0.7::DOUBLE, least(1.6::DOUBLE, sqrt(kbps / 2500))) * 2.0::DOUBLE, 4) AS priority,
round_even(greatest(0.65::DOUBLE, least(1.25::DOUBLE, 0.65::DOUBLE + sqrt(greatest(0.01::DOUBLE, least(1.0::DOUBLE, area))) * 0.35::DOUBLE + least(0.15::DOUBLE, log2(l_linenumber) * 0.05::DOUBLE))), 4) AS importance FROM x""")
def priority_score(spark, sf_dir):
    """SCL-24, SCL-25."""
    area = F.col("l_quantity") / 50
    p = numbers.priority(area, F.col("l_extendedprice"), F.col("l_quantity") * 100, F.lit(2.0), F.lit(25000), F.lit(2500))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.bround(p, 4).alias("priority"), F.bround(numbers.importance(area, F.col("l_linenumber"), F.lit("photo")), 4).alias("importance"))


@query("""WITH h AS (SELECT doc_id, md5(coalesce(text, '')) AS m, sha256(coalesce(text, '')) AS s FROM documents)
SELECT doc_id, (SELECT CAST(sum(bit_count(xor(CAST('0x' || m[k] AS INT), CAST('0x' || m[k + 16] AS INT)))) AS BIGINT) FROM range(1, 17) t(k)) AS distance, least(m, s) || ':' || greatest(m, s) AS pair FROM h""")
def hash_functions(spark, sf_dir):
    """SCL-40, SCL-43, SCL-45: the distance of the two halves of a digest."""
    t = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5(t).alias("m"), F.sha2(t, 256).alias("s"))
    return rows.select("doc_id", bits.hamming_hex(F.substring("m", 1, 16), F.substring("m", 17, 16)).cast("long").alias("distance"), bits.pair_key(F.col("m"), F.col("s")).alias("pair"))


@query("""SELECT event_id, round_even(corr_v, 6) AS c FROM (SELECT user_id AS event_id, CASE WHEN var_pop(value) = 0 OR var_pop(CAST(event_id AS DOUBLE)) = 0 OR count(*) < 2 THEN 0.0::DOUBLE ELSE corr(value, CAST(event_id AS DOUBLE)) END AS corr_v FROM events GROUP BY user_id)""")
def series_correlation(spark, sf_dir):
    """SCL-35: Pearson correlation, 0 for a series without energy."""
    flat = (F.var_pop("value") == 0) | (F.var_pop(F.col("event_id").cast("double")) == 0) | (F.count("*") < 2)
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("event_id")).agg(F.bround(F.when(flat, 0.0).otherwise(F.corr("value", F.col("event_id").cast("double"))), 6).alias("c"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 >= 0.98 THEN 'A+' WHEN l_discount * 10 >= 0.95 THEN 'A' WHEN l_discount * 10 >= 0.90 THEN 'B' ELSE 'C' END AS grade,
CAST(greatest(2, floor(CAST(trunc(l_partkey * least(1.0, CASE WHEN l_partkey >= l_suppkey THEN 192 ELSE 108 END::DOUBLE / l_partkey, CASE WHEN l_partkey >= l_suppkey THEN 108 ELSE 192 END::DOUBLE / l_suppkey)) AS BIGINT) / 2) * 2) AS BIGINT) AS width FROM lineitem WHERE l_suppkey > 0 AND l_partkey > 0""")
def scaling(spark, sf_dir):
    """SCL-29, SCL-34."""
    w, _ = numbers.scaled(F.col("l_partkey"), F.col("l_suppkey"), 192, 108)
    return table(spark, sf_dir, "lineitem").where("l_suppkey > 0 AND l_partkey > 0").select("l_orderkey", "l_linenumber", numbers.ssim_grade(F.col("l_discount") * 10).alias("grade"), w.alias("width"))
