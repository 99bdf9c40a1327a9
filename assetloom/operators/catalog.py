"""Changes of a catalog as queries over immutable tables: merges, removals, imports, quarantine, deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merged_families(variants: DataFrame, hashes: DataFrame, assets: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """DML-05: the source family's variants, hashes and references become the target's; equal contents become one."""
    moved = lambda df: df.withColumn("family_id", F.when(F.col("family_id") == source, target).otherwise(F.col("family_id")))
    mine = variants.where(F.col("family_id") == target).groupBy("sha256").agg(F.min_by("id", "ord").alias("same"))
    twins = variants.where(F.col("family_id") == source).join(mine, "sha256").select(F.col("id").alias("variant_id"), "same")
    kept = moved(variants.join(twins.select(F.col("variant_id").alias("id")), "id", "left_anti"))
    pointed = moved(assets).join(twins, "variant_id", "left").withColumn("variant_id", F.coalesce("same", "variant_id")).drop("same")
    return kept, moved(hashes).distinct(), pointed.select(*assets.columns)


def merged_assets(assets: DataFrame, primary: str, ids: list[str]) -> DataFrame:
    """DML-06: origins once by source and member, tags in order, the first category and summary that isn't empty."""
    rank = F.when(F.col("id") == primary, 0)
    for k, i in enumerate(ids, 1):
        rank = rank.when(F.col("id") == i, k)
    rows = assets.withColumn("_rank", rank).where("_rank IS NOT NULL")
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("_rank", F.col(c).alias("v")))), lambda x: x["v"])
    first = lambda c: F.get(F.filter(ordered(c), lambda v: F.coalesce(v, F.lit("")) != ""), F.lit(0))
    return rows.agg(F.lit(primary).alias("id"), F.array_distinct(F.flatten(ordered("tags"))).alias("tags"), F.array_distinct(F.flatten(ordered("origins"))).alias("origins"), F.coalesce(first("category"), F.lit("")).alias("category"), F.coalesce(first("summary"), F.lit("")).alias("summary"))


def imported(library: DataFrame, incoming: DataFrame) -> DataFrame:
    """DML-04, AGG-24, STR-01: what becomes of each incoming asset: skipped, reused (by bytes or pixels), a repeat, or added.

    Both hold sha256 and pixel_sha256; incoming also ord, width, height, least_width and least_height.
    """
    known = library.select("sha256", F.lit(True).alias("_bytes")).distinct()
    pixels = library.where("pixel_sha256 IS NOT NULL").select("pixel_sha256", F.lit(True).alias("_pixels")).distinct()
    first = incoming.groupBy("sha256").agg(F.min("ord").alias("_first"))
    rows = incoming.join(known, "sha256", "left").join(pixels, "pixel_sha256", "left").join(first, "sha256")
    small = (F.col("width") < F.col("least_width")) | (F.col("height") < F.col("least_height"))
    outcome = F.when(small, "skipped").when(F.col("_bytes"), "reused").when(F.col("_pixels"), "reused_pixels").when(F.col("ord") > F.col("_first"), "repeated").otherwise("added")
    return rows.withColumn("outcome", outcome).select(*incoming.columns, "outcome")


def classified_import(exact: Column, fuzzy: Column, suggested: Column) -> Column:
    """DML-03: counts of matches of each kind to what is done with a new video."""
    return F.when(exact == 1, "existing").when(exact > 1, "ambiguous").when(fuzzy == 1, "matched").when(fuzzy > 1, "ambiguous").when(suggested > 0, "suggested").otherwise("created")


def registered_decks(decks: DataFrame, incoming: DataFrame) -> DataFrame:
    """DML-02: decks of known bytes become an alias of the first deck with them, others are new."""
    known = decks.groupBy(F.col("source_sha256").alias("sha256")).agg(F.min("id").alias("alias_of"))
    return incoming.join(known, "sha256", "left").withColumn("action", F.when(F.col("alias_of").isNull(), "register").otherwise("alias"))


def removed_variant(family: DataFrame, variants: DataFrame, variant: str) -> tuple[DataFrame, DataFrame]:
    """DML-08: without the variant; pointers and lineage that named it fall back to the family's first other one."""
    left = variants.where(F.col("id") != variant)
    first = left.groupBy("family_id").agg(F.min_by("id", "ord").alias("_first"))
    fallback = lambda c: F.when(F.col(c) == variant, F.col("_first")).otherwise(F.col(c)).alias(c)
    heads = family.join(first, family["id"] == first["family_id"], "left")
    heads = heads.select(*[fallback(c) if c in ("active_variant_id", "source_variant_id") else family[c] for c in family.columns])
    left = left.withColumn("source_variant_id", F.when(F.col("source_variant_id") != variant, F.col("source_variant_id")))
    return heads, left


def quarantine_candidates(variants: DataFrame, family: DataFrame, assets: DataFrame) -> DataFrame:
    """FLT-25: abnormal variants that nothing points to."""
    pointers = family.select(F.explode(F.array("active_variant_id", "source_variant_id")).alias("id")).unionByName(assets.select(F.col("variant_id").alias("id")))
    return variants.where("coalesce(probe_error, '') <> ''").join(pointers.where("id IS NOT NULL").distinct(), "id", "left_anti")


def purge_blockers(quarantine: DataFrame, family: DataFrame, assets: DataFrame) -> DataFrame:
    """JON-23, DML-10: quarantined entries that are still moving or that something still points to."""
    live = family.select(F.explode(F.array("active_variant_id", "source_variant_id")).alias("variant_id")).unionByName(assets.select("variant_id")).distinct()
    held = quarantine.join(live, "variant_id", "left_semi").withColumn("reason", F.lit("referenced"))
    return held.unionByName(quarantine.where("state = 'moving'").withColumn("reason", F.lit("moving")))


def recovered(quarantine: DataFrame, files: DataFrame) -> DataFrame:
    """DML-10: entries that a crash left moving: moved if the file is in quarantine, else back where it was."""
    found = files.select(F.col("path").alias("quarantined_path"), F.lit(True).alias("_there"))
    rows = quarantine.join(found, "quarantined_path", "left")
    return rows.withColumn("state", F.when(F.col("state") != "moving", F.col("state")).when(F.col("_there"), "quarantined").otherwise("reverted")).drop("_there")


def pruned(records: DataFrame, files: DataFrame) -> DataFrame:
    """DML-13: records whose file is there."""
    return records.join(files.select("path"), "path", "left_semi")


def rebaselined(variants: DataFrame, files: DataFrame) -> DataFrame:
    """DML-12: a file of the recorded hash and another time gets the time on disk."""
    disk = files.select("path", F.col("sha256").alias("_sha"), F.col("mtime_ns").alias("_time"))
    rows = variants.join(disk, "path", "left")
    return rows.withColumn("mtime_ns", F.when(F.col("_sha") == F.col("sha256"), F.col("_time")).otherwise(F.col("mtime_ns"))).select(*variants.columns)


def needing_build(targets: DataFrame, reports: DataFrame, policy: str) -> DataFrame:
    """FLT-19, STR-02: targets without a current report: same source, same policy, and skipped or validated with its output."""
    r = reports.select("relative", F.col("source_sha256").alias("_sha"), F.col("source_size_bytes").alias("_size"), "policy", "status", "output_sha256", "found_sha256")
    rows = targets.join(r, "relative", "left")
    same = F.col("_sha").eqNullSafe(F.col("source_sha256")) & F.col("_size").eqNullSafe(F.col("source_size_bytes")) & F.col("policy").eqNullSafe(F.lit(policy))
    done = (F.col("status") == "skipped") | ((F.col("status") == "validated") & F.col("output_sha256").eqNullSafe(F.col("found_sha256")))
    return rows.where(~(same & F.coalesce(done, F.lit(False)))).select(*targets.columns)


def recommended(candidates: DataFrame, least_ssim: float = 0.95) -> DataFrame:
    """ITR-03: of each group the best variant, the original and the smallest one that is close enough.

    candidates: group_id, variant_id, ord, profile, height, kbps, pixels, size_bytes, ssim, allowed.
    """
    quality = F.struct("pixels", "kbps", "size_bytes", (-F.col("ord")).alias("first"))
    best = candidates.groupBy("group_id").agg(F.max_by("variant_id", quality).alias("keep_best"), F.max_by("height", quality).alias("_height"), F.min_by("variant_id", F.when(F.col("profile") == "original", F.col("ord"))).alias("keep_original"), F.count_if("allowed").alias("_n"), F.sum("size_bytes").alias("_all"), F.max_by("size_bytes", quality).alias("_kept"))
    near = candidates.join(best, "group_id").where((F.col("variant_id") != F.col("keep_best")) & F.col("allowed") & (F.col("ssim") >= least_ssim) & (F.col("height") >= F.least("_height", F.lit(1080))))
    smallest = near.groupBy("group_id").agg(F.min_by("variant_id", F.struct("size_bytes", "ord")).alias("keep_smallest_close"))
    out = best.join(smallest, "group_id", "left")
    return out.select("group_id", "keep_best", "keep_original", "keep_smallest_close", (F.col("_n") >= 2).alias("unify_available"), (F.col("_all") - F.col("_kept")).alias("savings"))

