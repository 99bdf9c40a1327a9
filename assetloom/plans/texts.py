"""Queries on texts and markup over the driver tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assetloom.functions import names

from .registry import query, table

# What counts as a secret or a private address in a public file.
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "ipv4": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", "access_key": r"AKIA[0-9A-Z]{16}", "token": r"(?i)(?:token|password)\s?=\s?\"?[A-Za-z0-9]{8,}"}


def findings(text: Column) -> Column:
    """FLT-17: (pattern, how often) of each pattern that the text holds; what a text must hold for one is looked for first."""
    must = {"email": F.contains(text, F.lit("@")), "ipv4": text.rlike(r"[0-9]\.[0-9]"), "access_key": F.contains(text, F.lit("AKIA")), "token": F.contains(text, F.lit("="))}
    count = lambda n, p: F.when(F.coalesce(must[n], F.lit(False)), F.regexp_count(text, F.lit(p))).otherwise(0)
    each = [F.struct(F.lit(n).alias("pattern"), F.coalesce(count(n, p), F.lit(0)).cast("long").alias("hits")) for n, p in PATTERNS.items()]
    return F.filter(F.array(*each), lambda x: x["hits"] > 0)


_FOUND = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS pattern, CAST(len(regexp_extract_all(coalesce(text, ''), '{p}')) AS BIGINT) AS hits FROM documents" for n, p in PATTERNS.items())


@query(f"SELECT * FROM ({_FOUND}) WHERE hits > 0")
def secret_scan(spark, sf_dir):
    """FLT-17, FLT-18, INT-05."""
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(findings(F.col("text"))))


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages""")
def link_extract(spark, sf_dir):
    """SRC-03, SCL-65: one row for each relationship of a page."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))


@query("""WITH t AS (SELECT DISTINCT page_id, lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages), a AS (SELECT unnest(['html', 'head', 'body', 'p', 'a', 'li', 'ul', 'div', 'meta', 'title']) AS tag)
SELECT tag, count(*) AS n_pages FROM t WHERE tag NOT IN (SELECT tag FROM a) GROUP BY tag""")
def missing_fonts_like(spark, sf_dir):
    """FLT-24, SRC-17, SCL-14: what is referred to and not at hand, by a folded key."""
    tags = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1))).alias("raw")).select("page_id", names.font_key(F.col("raw")).alias("tag"))
    at_hand = spark.createDataFrame([(x,) for x in ("html", "head", "body", "p", "a", "li", "ul", "div", "meta", "title")], "tag string")
    return tags.distinct().join(at_hand, "tag", "left_anti").groupBy("tag").agg(F.count("*").alias("n_pages"))


@query("""SELECT page_id, len(regexp_extract_all(html, '<script')) AS scripts, len(regexp_extract_all(html, '<li>')) AS items, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs, len(regexp_extract_all(html, '<div class="ad">')) > 0 AS has_ads FROM pages""")
def fidelity_counts(spark, sf_dir):
    """SRC-18, SRC-04: how often each kind of element stands in a page."""
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", n("<script").alias("scripts"), n("<li>").alias("items"), n("<p[ >]").alias("paragraphs"), (n('<div class="ad">') > 0).alias("has_ads"))


@query("""SELECT page_id, replace(replace(url, 'http://', '<web>'), 'https://', '<secure-web>') AS redacted, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '(\\.[^./]+)$', 1)) AS suffix FROM pages""")
def path_redaction(spark, sf_dir):
    """PRJ-08, SCL-63, SRT-10, FLT-01: roots are replaced, the longest first."""
    u = F.col("url")
    bare = F.regexp_replace(u, r"[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", names.redacted(u, [("http://", "<web>"), ("https://", "<secure-web>")]).alias("redacted"), F.lower(F.regexp_extract(bare, r"(\.[^./]+)$", 1)).alias("suffix"))


@query("""SELECT doc_id, substr(trim(string_split(text, chr(10))[1]), 1, 160) AS suggested_name, substr(trim(source), 1, 240) AS category, greatest(0.0::DOUBLE, least(1.0::DOUBLE, n_chars / 10000.0::DOUBLE)) AS confidence FROM documents""")
def suggestion_cleaning(spark, sf_dir):
    """PRJ-07: texts cut to their widths, confidence within 0 and 1."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.substring(F.trim(F.get(F.split("text", "\n"), F.lit(0))), 1, 160).alias("suggested_name"), F.substring(F.trim("source"), 1, 240).alias("category"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("n_chars") / F.lit(10000.0))).alias("confidence"))


_ROOTS = [("http://", "<web>"), ("https://", "<secure-web>"), ("/p/", "/<page>/"), ("https://site", "<site>")]
_R = lambda x: "replace(replace(replace(replace(" + x + ", 'https://site', '<site>'), 'https://', '<secure-web>'), 'http://', '<web>'), '/p/', '/<page>/')"


@query(f"""WITH n AS (SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS links FROM pages)
SELECT page_id, {_R("url")} AS url, array_to_string([{_R("x")} FOR x IN links], ' ') AS links, {_R("coalesce(links[1], url)")} AS first_link, 'http://' AS kept_key FROM n""")
def nested_redaction(spark, sf_dir):
    """PRJ-08: roots go from texts in structs, arrays and values of maps; keys stay."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    rows = table(spark, sf_dir, "pages").select("page_id", F.struct("url", links.alias("links")).alias("page"), F.create_map(F.lit("http://"), F.array(F.struct(F.coalesce(F.get(links, F.lit(0)), "url").alias("to")))).alias("by"))
    out = names.redacted_table(rows, _ROOTS)
    return out.select("page_id", "page.url", F.array_join("page.links", " ").alias("links"), F.get(F.element_at("by", F.lit("http://")), F.lit(0))["to"].alias("first_link"), F.get(F.map_keys("by"), F.lit(0)).alias("kept_key"))
