"""Reports in and out: rows of assets to nested reports and Markdown, reports and manifests back to rows, audits, rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.functions import numbers

VIDEO = "struct<media_path:string,output_media_path:string,zip_size_bytes:bigint,duration_sec:double,status:string,source_ssim:double,display_ssim:double,applied_threshold:double,quality_status:string>"
IMAGE = "struct<media_path:string,output_media_path:string,zip_size_bytes:bigint,status:string,source_ssim:double,display_ssim:double,applied_threshold:double,quality_status:string>"
REPORT = f"input_pptx string, output_pptx string, target_size_mb double, target struct<target_bytes:bigint,actual_bytes:bigint,delta_bytes:bigint,target_ratio:double,status:string>, attempts array<struct<kind:string,media_budget_bytes:bigint,actual_bytes:bigint>>, videos array<{VIDEO}>, images array<{IMAGE}>, _corrupt string"
# States of assets that were written.
VIDEO_DONE, IMAGE_DONE = ("encoded", "encoded_gpu", "copied"), ("encoded", "optimize", "copied")


def report_rows(assets: DataFrame) -> DataFrame:
    """PRJ-01: assets as report rows: sizes as pairs, measures rounded half to even, unknown numbers null.

    assets: media_path, output_media_path, zip_size, duration_sec, width, height, target_width, target_height, fps, frames, ...
    """
    c, half = F.col, lambda x, n: F.bround(F.col(x), n).alias(x)
    return assets.select(
        "media_path", F.coalesce(F.nullif(c("output_media_path"), F.lit("")), "media_path").alias("output_media_path"), c("zip_size").alias("zip_size_bytes"), half("duration_sec", 3), F.array("width", "height").alias("source_resolution"),
        F.array("target_width", "target_height").alias("target_resolution"), half("fps", 3), F.nullif(c("frames"), F.lit(0)).alias("frames"), "status", "source_ssim", "display_ssim", "applied_threshold", "quality_status",
    )


def compact_variants(variants: DataFrame) -> DataFrame:
    """PRJ-04: what a list shows of variants: unknown numbers are 0, unknown texts empty."""
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)).alias(x)
    return variants.select("family_id", "id", F.coalesce("profile", F.lit("")).alias("profile"), zero("width"), zero("height"), F.coalesce("duration_sec", F.lit(0.0)).alias("duration_sec"), zero("bitrate_kbps"), zero("size_bytes"))


def without_empty(columns: dict[str, Column]) -> Column:
    """PRJ-06: a map of what is neither null nor empty."""
    pairs = F.map_from_arrays(F.array(*[F.lit(k) for k in columns]), F.array(*[v.cast("string") for v in columns.values()]))
    return F.map_filter(pairs, lambda k, v: v.isNotNull() & (v != ""))


def nested(rows: DataFrame, group: str, kind: Column) -> DataFrame:
    """SNK-04, SET-07: one report a group, its rows by path in arrays of videos and images (`kind`); a report is as large as its document."""
    one = F.struct(*[c for c in rows.columns if c != group])
    of = lambda k: F.array_sort(F.collect_list(F.when(kind == k, one))).alias(f"{k}s")
    return rows.groupBy(group).agg(of("video"), of("image"))


def markdown(rows: DataFrame, group: str) -> DataFrame:
    """SNK-05, SNK-14: a table in Markdown for each group, rows by media_path, one line each."""
    text = lambda c, f="%s": F.coalesce(F.format_string(f, F.col(c)), F.lit("-"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.replace("media_path", F.lit("|"), F.lit("\\|")), text("zip_size_bytes"), text("status"), text("source_ssim", "%.4f")), F.lit(" |"))
    lines = F.array_sort(F.collect_list(F.struct("media_path", line.alias("line"))))
    head = F.lit("| media | bytes | status | SSIM |\n|-|-|-|-|\n")
    return rows.groupBy(group).agg(lines.alias("lines")).select(group, F.concat(head, F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("markdown"))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """SRC-15: reports as rows; what can't be parsed is kept in `_corrupt`."""
    return spark.read.schema(REPORT).option("multiLine", "true").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def is_standalone(report: DataFrame) -> DataFrame:
    """SUP-19: with `standalone`: reports of single media files, not of documents."""
    return report.withColumn("standalone", ~F.lower(F.coalesce("input_pptx", F.lit(""))).rlike(r"\.(pptx|docx|xlsx|pdf)$"))


def audited_assets(report: DataFrame) -> DataFrame:
    """SRC-15, SET-07: (output_pptx, media_path, output_media_path, is_video, size) of all assets that were written."""
    part = lambda c, done, video: report.select("output_pptx", F.explode(c).alias("x")).where(F.col("x.status").isin(*done)).select("output_pptx", "x.media_path", F.coalesce("x.output_media_path", "x.media_path").alias("output_media_path"), F.lit(video).alias("is_video"), F.coalesce("x.zip_size_bytes", F.lit(1000)).alias("size"))
    return part("videos", VIDEO_DONE, True).unionByName(part("images", IMAGE_DONE, False))


def audit_summary(scores: DataFrame, group: str) -> DataFrame:
    """AGG-17, AGG-21: mean, worst and best SSIM with where they are, the grade of the mean, and each group's minimum."""
    out = scores.groupBy(group).agg(F.count("*").alias("n"), F.bround(F.avg("ssim"), 6).alias("mean_ssim"), F.bround(F.min("ssim"), 6).alias("min_ssim"), F.min_by("media_path", F.struct("ssim", "media_path")).alias("worst"), F.max_by("media_path", F.struct(F.col("ssim"), F.col("media_path"))).alias("best"))
    return out.withColumn("grade", numbers.ssim_grade(F.col("mean_ssim")))


def attempts(report: DataFrame) -> DataFrame:
    """WIN-07, AGG-16: capacity attempts numbered from 1."""
    return report.select("input_pptx", F.posexplode("attempts").alias("place", "a")).select("input_pptx", (F.col("place") + 1).alias("attempt"), "a.kind", "a.media_budget_bytes", "a.actual_bytes")


def next_try(reason: Column, scale: Column, quality: Column, lossy: Column, restore: Column) -> Column:
    """ITR-07: what a failed image is tried with next: full scale first, then three more of quality, else the original."""
    low = F.coalesce(reason == "image_quality_below_threshold", F.lit(False))
    again = lambda s, q: F.struct(F.lit("retry").alias("action"), s.cast("double").alias("scale"), q.cast("int").alias("quality"))
    last = F.struct(F.when(restore | ~low, "restore_original").otherwise("below_threshold").alias("action"), F.lit(None).cast("double").alias("scale"), F.lit(None).cast("int").alias("quality"))
    return F.when(restore & low & (scale < 0.999), again(F.lit(1.0), quality)).when(restore & low & lossy & (quality < 100), again(scale, F.least(F.lit(100), quality + 3))).otherwise(last)


def escalated(profile: Column) -> Column:
    """ITR-08: the profile that failed assets are encoded with next; null where there is no better one."""
    return F.when(profile == "aggressive", "balanced").when(profile == "balanced", "high")


def retried(rows: DataFrame, failed: DataFrame, key: str, profile: str) -> tuple[DataFrame, DataFrame]:
    """ITR-08, FLT-21: the failing subset with its next profile, and the rows that stay as they are."""
    again = rows.join(failed.select(key), key, "left_semi").withColumn(profile, escalated(F.col(profile)))
    return again.where(F.col(profile).isNotNull()), rows.join(again.where(F.col(profile).isNotNull()).select(key), key, "left_anti")


SAMPLE = "path string, target_size_mb double, label string, profile string, image_profile string, encoder string, quality_mode string, video_ssim_threshold double, image_ssim_threshold double, preset string, reserve_mb double"
# What a benchmark sample may name.
PROFILES, MODES, ENCODERS = ("none", "high", "balanced", "aggressive"), ("safe", "forced"), ("auto", "gpu", "cpu")


def manifest_samples(spark: SparkSession, path: str) -> DataFrame:
    """SRC-16: benchmark samples with `problems`; unknown fields go, but those that begin with meta_ (`meta`, a map)."""
    raw = spark.read.schema("samples array<string>").option("multiLine", "true").json(path).select(F.posexplode("samples").alias("ord", "entry"))
    rows = raw.select("ord", F.from_json("entry", SAMPLE).alias("s"), F.from_json("entry", "map<string,string>").alias("all")).select("ord", "s.*", F.map_filter("all", lambda k, v: F.startswith(k, F.lit("meta_")) & v.isNotNull()).alias("meta"))
    default = {"profile": "high", "image_profile": "high", "encoder": "auto", "quality_mode": "safe", "preset": "medium", "video_ssim_threshold": 0.95, "image_ssim_threshold": 0.99}
    rows = rows.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in default.items()})
    bad = lambda c, ok: ~F.coalesce(ok, F.lit(True)) & F.col(c).isNotNull()
    finite = lambda c: (F.abs(c) < F.lit(float("inf"))) & ~F.isnan(c)
    tests = [
        (F.coalesce(F.trim("path"), F.lit("")) == "", "path_missing"), (~F.coalesce(F.col("path"), F.lit("/")).rlike(r"^(/|~|[A-Za-z]:[\\/])"), "path_not_absolute"),
        (bad("target_size_mb", finite(F.col("target_size_mb")) & (F.col("target_size_mb") > 0)), "target_size_mb"), (bad("reserve_mb", finite(F.col("reserve_mb")) & (F.col("reserve_mb") >= 0)), "reserve_mb"),
        (~F.col("video_ssim_threshold").between(1e-12, 1), "video_ssim_threshold"), (~F.col("image_ssim_threshold").between(1e-12, 1), "image_ssim_threshold"), (~F.col("profile").isin(*PROFILES), "profile"), (~F.col("encoder").isin(*ENCODERS), "encoder"), (~F.col("quality_mode").isin(*MODES), "quality_mode"),
    ]
    return rows.withColumn("problems", F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, n in tests])))


def rule_table(spark: SparkSession, path: str, profile: str) -> DataFrame:
    """SRC-13: a profile's height rules of a JSON file {profile: [{area, width, height, floor}, ...]}, in their order."""
    kind = "map<string,array<struct<area:double,width:double,height:double,floor:int>>>"
    text = spark.read.option("wholetext", "true").text(path).select(F.from_json("value", kind).alias("m"))
    return text.select(F.posexplode(F.element_at("m", F.lit(profile))).alias("ord", "r")).select("ord", "r.*")


def rules(table: DataFrame, most: int = 100) -> tuple[tuple[float, float, float, int], ...]:
    """SRC-13, FLT-12: a rule table as what `numbers.first_rule` takes: a few rows become a CASE."""
    rows = table.orderBy("ord").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    return tuple((r["area"] or 0.0, r["width"] or 0.0, r["height"] or 0.0, r["floor"]) for r in rows)


def checkpointed_steps(done: DataFrame, steps: DataFrame) -> DataFrame:
    """SNK-15: steps (relative, ...) that a batch report lacks; each finished one is appended to it, so a batch goes on where it stopped."""
    return steps.join(done.select("relative").distinct(), "relative", "left_anti")


def sidecar_manifest(occurrences: DataFrame) -> DataFrame:
    """SNK-13: one row an occurrence: page, position, and the file that its media is exported to, each media once."""
    name = F.concat(F.lit("video_"), F.substring("sha256", 1, 12), F.regexp_extract("media", r"(\.[^./]+)$", 1))
    return occurrences.select("package", "number", "shape_name", "x", "y", "cx", "cy", "media", name.alias("file"))


def missing_requirements(options: DataFrame, needed: DataFrame, available: DataFrame) -> DataFrame:
    """SUP-13: (option, dependency) of enabled options whose dependency isn't at hand."""
    wanted = options.where("enabled").select("option").join(needed, "option")
    return wanted.join(available.select("dependency"), "dependency", "left_anti").select("option", "dependency")


def translated(rows: DataFrame, key: str, texts: DataFrame, language: str) -> DataFrame:
    """SCL-12: a text of the language for each key, the key itself where there is none."""
    of = texts.where(F.col("language") == language).groupBy(F.col("key").alias(key)).agg(F.min("text").alias("text"))
    return rows.join(of, key, "left").withColumn("text", F.coalesce("text", key))


def looked_up(rows: DataFrame, rules_: DataFrame, key: str) -> DataFrame:
    """SUP-10: rows with the columns of their key's rule; an unknown key fails the job."""
    found = rows.join(rules_.withColumn("known", F.lit(True)), key, "left")
    checked = F.when(F.col("known").isNull(), F.raise_error(F.concat(F.lit(f"unknown {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).otherwise(F.col(key))
    return found.withColumn(key, checked).drop("known")


def nested_get(value: Column, path: list[str], default: object) -> Column:
    """SCL-62: a field of nested structs, or a default."""
    for name in path:
        value = value.getField(name)
    return F.coalesce(value, F.lit(default))


def tree_digest(files: DataFrame) -> DataFrame:
    """SUP-16: one digest of a tree of (path, sha256): folders first, then their digests, so that no list is unbounded but by a folder."""
    folder = F.regexp_extract("path", r"^(.*/)", 1)
    per = files.groupBy(folder.alias("folder")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "path", "sha256"))), "\n"), 256).alias("digest"), F.count("*").alias("n"))
    return per.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "folder", "digest"))), "\n"), 256).alias("digest"), F.sum("n").alias("files"))


def link_findings(files: DataFrame) -> DataFrame:
    """SUP-17: symbolic links that leave the tree or lead nowhere, and files of several names."""
    outside = F.coalesce(F.col("link_target").rlike(r"^/|(^|/)\.\.(/|$)"), F.lit(False))
    finding = F.when(F.col("link_target").isNotNull() & outside, "link_leaves_tree").when(F.col("link_target").isNotNull() & ~F.col("target_exists"), "broken_link").when(F.col("link_target").isNull() & (F.col("n_links") > 1), "hard_link")
    return files.withColumn("finding", finding).where("finding IS NOT NULL").select("path", "finding")


def stale_entries(entries: DataFrame, patterns: list[str], hours: float, now: Column) -> DataFrame:
    """SUP-15: runtime folders of known names, old enough and without a living owner."""
    known = F.col("name").rlike("|".join(f"^(?:{p})$" for p in patterns))
    return entries.where(known & ~F.coalesce("owner_alive", F.lit(False)) & ((now.cast("double") - F.col("modified").cast("double")) > hours * 3600))
