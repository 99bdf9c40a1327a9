"""INT-01, INT-02: audits of whole catalogs: every finding of each of sixteen codes as one row of a long table.

Tables (see `sources.catalogs`): family (id, name, source_variant_id, active_variant_id), variants (family_id, id, path,
sha256, size_bytes, mtime_ns, probe_error), hashes (family_id, sha256), decks (id, source_path, source_aliases), outputs
(deck_id, id, kind, path, size_bytes), quarantine (token, problem) and files (path, size_bytes, mtime_ns, sha256): what a
crawl found. All joins are equi-joins; owners are counted and named by their smallest few, never gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code -> severity; `unreadable_variant` is an error for a variant that its family points to.
CODES = {
    "invalid_family_pointer": "error", "missing_variant": "error", "hash_mismatch": "error", "variant_metadata_drift": "warning", "modified_variant": "error", "unreadable_variant": "warning",
    "ambiguous_known_hash": "error", "duplicate_variant_hash": "error", "duplicate_variant_path": "error", "deck_primary_missing_alias_available": "warning", "deck_source_missing": "warning",
    "missing_output_record": "info", "changed_output_record": "warning", "untracked_media": "warning", "cleanup_index_issue": "error", "cleanup_index_invalid": "error",
}
_COLUMNS = ["severity", "code", "family_id", "variant_id", "deck_id", "output_id", "path", "sha256", "n"]


def _found(rows: DataFrame, code: Column | str, severity: Column | None = None, **given: Column) -> DataFrame:
    name = F.lit(code) if isinstance(code, str) else code
    level = severity if severity is not None else F.lit(CODES[code]) if isinstance(code, str) else F.element_at(F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv]), name)
    return rows.select(level.alias("severity"), name.alias("code"), *[given.get(c, F.lit(None)).cast("long" if c == "n" else "string").alias(c) for c in _COLUMNS[2:]])


def variant_states(variants: DataFrame, files: DataFrame, verify: bool = False) -> DataFrame:
    """SCL-67: variants with `state`: missing, modified, metadata_drift or available; hashes are compared where `verify`."""
    disk = files.select("path", F.col("size_bytes").alias("disk_size"), F.col("mtime_ns").alias("disk_time"), F.col("sha256").alias("disk_sha"))
    rows = variants.join(disk, "path", "left")
    late = (F.coalesce("mtime_ns", F.lit(0)) != 0) & (F.col("disk_time") != F.col("mtime_ns"))
    other = ~F.col("disk_sha").eqNullSafe(F.col("sha256")) if verify else F.lit(False)
    state = F.when(F.col("disk_size").isNull(), "missing").when(other, "hash_mismatch").when(F.lit(not verify) & (F.col("disk_size") != F.col("size_bytes")), "modified").when(late, "metadata_drift").otherwise("available")
    return rows.withColumn("state", state)


def library_issues(family: DataFrame, variants: DataFrame, hashes: DataFrame, decks: DataFrame, outputs: DataFrame, quarantine: DataFrame, files: DataFrame, media_root: str, verify: bool = False) -> DataFrame:
    """INT-01: (severity, code, family_id, variant_id, deck_id, output_id, path, sha256, n); n counts owners."""
    c, there = F.col, files.select("path")
    pointers = family.select(c("id").alias("family_id"), F.explode(F.array("source_variant_id", "active_variant_id")).alias("id"))
    own = variants.select("family_id", "id").distinct()
    broken = pointers.join(own.withColumn("ok", F.lit(True)), ["family_id", "id"], "left").where("ok IS NULL")
    states = variant_states(variants, files, verify)
    code = F.when(c("state") == "missing", "missing_variant").when(c("state") == "hash_mismatch", "hash_mismatch").when(c("state") == "modified", "modified_variant").when(c("state") == "metadata_drift", "variant_metadata_drift")
    pointed = pointers.where("id IS NOT NULL").distinct().withColumn("pointed", F.lit(True))
    unreadable = variants.where("coalesce(probe_error, '') <> ''").join(pointed, ["family_id", "id"], "left")
    owned = lambda rows, key: rows.where(c(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min("owner").alias("owner")).where("n > 1")
    known = owned(hashes.select("sha256", c("family_id").alias("owner")).unionByName(variants.select("sha256", c("family_id").alias("owner"))).distinct(), "sha256")
    same = owned(variants.select("sha256", c("family_id").alias("owner")).distinct(), "sha256")
    paths = owned(variants.select("path", c("id").alias("owner")), "path")
    gone = decks.join(there, decks["source_path"] == there["path"], "left_anti")
    alias = gone.select("id", F.explode("source_aliases").alias("path")).join(there, "path", "left_semi").select("id").distinct().withColumn("alias", F.lit(True))
    gone = gone.join(alias, "id", "left")
    made = outputs.join(files.select("path", c("size_bytes").alias("disk_size")), "path", "left")
    tracked = variants.select("path").distinct()
    parts = [
        _found(broken, "invalid_family_pointer", family_id=c("family_id"), variant_id=c("id")),
        _found(states.where(code.isNotNull()), code, family_id=c("family_id"), variant_id=c("id"), path=c("path")),
        _found(unreadable, "unreadable_variant", F.when(c("pointed"), "error").otherwise("warning"), family_id=c("family_id"), variant_id=c("id"), path=c("path")),
        _found(known, "ambiguous_known_hash", sha256=c("sha256"), family_id=c("owner"), n=c("n")),
        _found(same, "duplicate_variant_hash", sha256=c("sha256"), family_id=c("owner"), n=c("n")),
        _found(paths, "duplicate_variant_path", path=c("path"), variant_id=c("owner"), n=c("n")),
        _found(gone, F.when(c("alias"), "deck_primary_missing_alias_available").otherwise("deck_source_missing"), deck_id=c("id"), path=c("source_path")),
        _found(made.where("disk_size IS NULL"), "missing_output_record", deck_id=c("deck_id"), output_id=c("id"), path=c("path")),
        _found(made.where("coalesce(size_bytes, 0) <> 0 AND disk_size <> size_bytes"), "changed_output_record", deck_id=c("deck_id"), output_id=c("id"), path=c("path")),
        _found(files.where(F.startswith("path", F.lit(media_root))).join(tracked, "path", "left_anti"), "untracked_media", path=c("path")),
        _found(quarantine.where("problem IS NOT NULL"), F.when(c("token").isNull(), "cleanup_index_invalid").otherwise("cleanup_index_issue"), path=c("token")),
    ]
    return reduce(DataFrame.unionByName, parts)


def library_report(issues: DataFrame, family: DataFrame, variants: DataFrame, decks: DataFrame, references: DataFrame) -> DataFrame:
    """AGG-04, AGG-05, SNK-11: one row: totals, findings by severity, `ok`, and the exit code of a checker."""
    n = variants.groupBy("family_id").agg(F.count("*").alias("n_variants"))
    r = references.groupBy("family_id").agg(F.count("*").alias("n_references"))
    per = family.select(F.col("id").alias("family_id")).join(n, "family_id", "left").join(r, "family_id", "left")
    totals = per.agg(F.count("*").alias("families"), F.coalesce(F.sum("n_variants"), F.lit(0)).alias("variants"), F.count_if(F.coalesce("n_references", F.lit(0)) == 0).alias("unlinked"), F.count_if(F.col("n_variants") > 1).alias("multi_version"))
    found = issues.agg(*[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in ("error", "warning", "info")])
    out = totals.join(decks.agg(F.count("*").alias("decks")), F.lit(True)).join(found, F.lit(True))
    return out.withColumns({"ok": F.col("errors") == 0, "exit_code": F.when(F.col("errors") == 0, 0).otherwise(1)})


def image_issues(assets: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """INT-02: (code, id, path): images without a file, with another hash, and files that no image has."""
    disk = files.select("path", F.col("sha256").alias("disk_sha"))
    rows = assets.select("id", "path", "sha256").join(disk, "path", "left")
    missing = rows.where("disk_sha IS NULL").select(F.lit("missing_image").alias("code"), "id", "path")
    changed = rows.where("disk_sha IS NOT NULL AND disk_sha <> sha256").select(F.lit("changed_image").alias("code"), "id", "path")
    orphan = files.where(F.startswith("path", F.lit(root))).join(assets.select("path"), "path", "left_anti").select(F.lit("orphan_file").alias("code"), F.lit(None).cast("string").alias("id"), "path")
    return missing.unionByName(changed).unionByName(orphan)
