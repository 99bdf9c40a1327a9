"""Decisions on a catalog and what comes of them: cleanup plans, upgrades, new versions, restores, metadata.

Every change takes immutable tables and gives new ones; a decision that isn't valid comes back with its reason and
changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assetloom.functions import names


def subset(part: Column, whole: Column) -> Column:
    """SET-10: whether an array holds nothing that another lacks."""
    return F.size(F.array_except(F.coalesce(part, F.array().cast("array<string>")), whole)) == 0


def _match(family: DataFrame, variants: DataFrame) -> DataFrame:
    """Variants with `same`: known to be of their family's content, by pointer, hash or derivation."""
    source = family.select(F.col("id").alias("family_id"), "source_variant_id")
    sha = variants.select("family_id", F.col("id").alias("source_variant_id"), F.col("sha256").alias("source_sha"))
    ids = variants.groupBy("family_id").agg(F.collect_set("id").alias("ids"))  # the versions of one asset: a few
    rows = variants.withColumnRenamed("source_variant_id", "made_from").join(source.join(sha, ["family_id", "source_variant_id"], "left"), "family_id").join(ids, "family_id")
    derived = F.col("made_from").isNotNull() & F.array_contains("ids", F.col("made_from"))
    return rows.withColumn("same", (F.col("id") == F.col("source_variant_id")) | F.coalesce(F.col("sha256") == F.col("source_sha"), F.lit(False)) | F.coalesce(derived, F.lit(False)))


def checked_decisions(decisions: DataFrame, family: DataFrame, variants: DataFrame, identical: DataFrame) -> DataFrame:
    """DML-09, SET-10, JON-17: decisions with `problem`, null where one may be applied.

    decisions: (decision_id, kind, family_id, keep_variant_id, remove_variant_ids, force_remove_variant_ids,
    merge_family_ids); identical: (a, b), families known to hold the same content.
    """
    rows = _match(family, variants)
    per = rows.groupBy("family_id").agg(F.collect_set("id").alias("own"), F.collect_set(F.when(F.col("same"), F.col("id"))).alias("verified"))
    none = F.array().cast("array<string>")
    removed, forced = F.array_distinct(F.coalesce("remove_variant_ids", none)), F.array_distinct(F.coalesce("force_remove_variant_ids", none))
    merged = F.array_distinct(F.coalesce("merge_family_ids", none))
    d = decisions.withColumns({"removed": removed, "forced": forced, "merged": merged}).join(per, "family_id", "left")
    others = d.select("decision_id", F.col("family_id").alias("target"), F.explode("merged").alias("other")).where("other <> target")
    both = identical.select(F.col("a").alias("target"), F.col("b").alias("other")).unionByName(identical.select(F.col("b").alias("target"), F.col("a").alias("other"))).distinct().withColumn("ok", F.lit(True))
    theirs = per.select(F.col("family_id").alias("other"), F.col("own").alias("their"))
    across = others.join(both, ["target", "other"], "left").join(theirs, "other", "left").groupBy("decision_id").agg(F.count_if(F.col("ok").isNull()).alias("unlike"), F.flatten(F.collect_list("their")).alias("all_theirs"))
    d = d.join(across, "decision_id", "left")
    keep, own = F.col("keep_variant_id"), F.coalesce("own", none)
    within = F.when(~F.array_contains(own, keep) | keep.isNull() | ~subset(F.col("removed"), own), "foreign_variant").when(~subset(F.col("forced"), F.col("removed")), "forced_but_not_removed")
    within = within.when((F.size("forced") > 0) & ~F.array_contains("verified", keep), "kept_not_verified").when(~subset(F.array_except(F.array_union(F.array(keep), F.col("removed")), F.col("forced")), F.col("verified")), "not_verified")
    every = F.array_union(own, F.coalesce("all_theirs", none))
    cross = F.when(F.size("forced") > 0, "force_across_families").when(~F.array_contains("merged", F.col("family_id")) | (F.size("merged") < 2), "no_target").when(~F.array_contains(own, keep) | keep.isNull(), "kept_not_in_target")
    cross = cross.when(~subset(F.col("removed"), every), "unknown_variant").when(F.coalesce("unlike", F.lit(0)) > 0, "not_identical")
    problem = F.when(F.col("own").isNull(), "unknown_family").when(F.col("kind") == "within_family", within).when(F.col("kind") == "cross_family", cross).otherwise("unknown_kind")
    return d.select(*decisions.columns, problem.alias("problem"))


def applied_decisions(checked: DataFrame, variants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DML-09: the variants that stay, and those that go to quarantine, by valid decisions; what is kept by one stays."""
    valid = checked.where("problem IS NULL")
    gone = valid.select("decision_id", F.explode("remove_variant_ids").alias("id")).distinct()
    kept = valid.select(F.col("keep_variant_id").alias("id")).distinct()
    gone = gone.join(kept, "id", "left_anti").groupBy("id").agg(F.min("decision_id").alias("decision_id"))
    moved = valid.where("kind = 'cross_family'").select(F.col("family_id").alias("target"), F.explode("merge_family_ids").alias("family_id")).where("family_id <> target").groupBy("family_id").agg(F.min("target").alias("target"))
    left = variants.join(gone, "id", "left_anti").join(moved, "family_id", "left").withColumn("family_id", F.coalesce("target", "family_id"))
    return left.select(*variants.columns), variants.join(gone, "id")


def identical_families(hashes: DataFrame, fingerprint_pairs: DataFrame, correlations: DataFrame, damaged: DataFrame) -> DataFrame:
    """JON-11: pairs (a < b) of families with the same content and why: a shared hash, fingerprints (whose sound agrees
    where there is any), or a damaged copy.

    fingerprint_pairs: (a, b, has_audio); correlations: (a, b, correlation) of decoded sound. Families that share a hash
    are joined to the smallest of them, so a hot hash gives a row a family.
    """
    first = hashes.groupBy("sha256").agg(F.min("family_id").alias("a"))
    shared = hashes.join(first, "sha256").where("a <> family_id").select("a", F.col("family_id").alias("b"), F.lit("hash").alias("why")).distinct()
    heard = fingerprint_pairs.join(correlations, ["a", "b"], "left").where("NOT has_audio OR correlation >= 0.98").select("a", "b", F.lit("fingerprint").alias("why"))
    every = shared.unionByName(heard).unionByName(damaged.select("a", "b", F.lit("damaged_copy").alias("why")))
    return every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "why").groupBy("a", "b").agg(F.min("why").alias("why"))


def anchor_problems(before: DataFrame, after: DataFrame) -> DataFrame:
    """JON-14, SET-09, INT-04: anchors (deck_id, slide_path, shape_id) that one side lacks or that name another family."""
    keys = ["deck_id", "slide_path", "shape_id"]
    a, b = before.select(*keys, F.col("family_id").alias("was")), after.select(*keys, F.col("family_id").alias("is"))
    rows = a.join(b, keys, "full_outer")
    problem = F.when(F.col("is").isNull(), "lost").when(F.col("was").isNull(), "new").when(F.col("was") != F.col("is"), "other_family")
    return rows.withColumn("problem", problem).where("problem IS NOT NULL")


def upgrade_problems(before: DataFrame, after: DataFrame, pairs: DataFrame) -> DataFrame:
    """INT-04, SUP-12: what forbids to adopt an upgraded package: lost anchors, or media that aren't the same.

    pairs: (media, width, height, seconds, has_audio of the old) and new_... of the new part.
    """
    unlike = F.when(F.col("new_width").isNull(), "missing").when((F.col("new_width") < F.col("width")) | (F.col("new_height") < F.col("height")), "smaller").when(F.abs(F.col("new_seconds") - F.col("seconds")) > F.greatest(F.lit(0.25), F.col("seconds") * 0.01), "length").when(F.col("new_has_audio") != F.col("has_audio"), "audio")
    media = pairs.withColumn("problem", unlike).where("problem IS NOT NULL").select(F.col("media").alias("subject"), "problem")
    anchors = anchor_problems(before, after).select(F.concat_ws(":", "slide_path", "shape_id").alias("subject"), "problem")
    return anchors.unionByName(media)


def learned_hashes(report: DataFrame, media_family: DataFrame, members: DataFrame, hashes: DataFrame) -> DataFrame:
    """JON-15: hashes that compressed packages add to families: report ⋈ media's family ⋈ package members, without known ones."""
    rows = report.select("media_path", "output_media_path").join(media_family, "media_path").join(members.select(F.col("member").alias("output_media_path"), "sha256"), "output_media_path")
    return rows.select("family_id", "sha256").distinct().join(hashes, ["family_id", "sha256"], "left_anti")


def selections(decisions: DataFrame, variants: DataFrame, quarantine: DataFrame) -> DataFrame:
    """JON-17, JON-24: selected variants, matched by id, hash, profile and lineage: ready, changed, restorable or missing."""
    live = variants.select("family_id", F.col("id").alias("selected_variant_id"), F.col("sha256").alias("v_sha"), F.col("profile").alias("v_profile"), F.col("source_variant_id").alias("v_source"), F.lit(True).alias("live"))
    held = quarantine.groupBy("family_id", F.col("variant_id").alias("selected_variant_id")).agg(F.min("token").alias("token"))
    rows = decisions.join(live, ["family_id", "selected_variant_id"], "left").join(held, ["family_id", "selected_variant_id"], "left")
    equal = F.col("v_sha").eqNullSafe(F.col("sha256")) & F.col("v_profile").eqNullSafe(F.col("profile")) & F.col("v_source").eqNullSafe(F.col("source_variant_id"))
    state = F.when(F.col("live") & equal, "ready").when(F.col("live"), "changed").when(F.col("token").isNotNull(), "restorable").otherwise("missing")
    return rows.withColumn("state", state).select(*decisions.columns, "state", F.when(state == "restorable", F.col("token")).alias("token"))


def reusable(wanted: DataFrame, reported: DataFrame, variants: DataFrame) -> DataFrame:
    """SUP-06: a compressed variant for each wanted (family_id, profile, source_variant_id): the reported one that still
    exists, else one of that profile and source, else null: to be made."""
    mine = variants.groupBy("family_id", "profile", "source_variant_id").agg(F.min_by("id", "ord").alias("by_rule"))
    there = reported.join(variants.select("family_id", F.col("id").alias("variant_id")), ["family_id", "variant_id"], "left_semi").select("family_id", "profile", F.col("variant_id").alias("by_report")).groupBy("family_id", "profile").agg(F.min("by_report").alias("by_report"))
    out = wanted.join(there, ["family_id", "profile"], "left").join(mine, ["family_id", "profile", "source_variant_id"], "left")
    return out.select(*wanted.columns, F.coalesce("by_report", "by_rule").alias("variant_id"), F.when(F.col("by_report").isNotNull(), "reported").when(F.col("by_rule").isNotNull(), "reused").otherwise("to_make").alias("how"))


def with_version(variants: DataFrame, family: DataFrame, made: DataFrame, unified: bool = False) -> tuple[DataFrame, DataFrame]:
    """DML-16, DML-11: made versions (family_id, id, sha256, source_variant_id, ...): a hash that the family has makes that
    variant active again, others become variants; a unified one becomes the source, too.

    Versions were made in the order of `ord` where there is one, else of their ids: of equal hashes the first becomes the
    variant, and the last one made is the active one.
    """
    turn = F.struct("ord", "id") if "ord" in made.columns else F.struct("id")
    known = variants.groupBy("family_id", "sha256").agg(F.min_by("id", "ord").alias("known"))
    first = made.groupBy("family_id", "sha256").agg(F.min_by("id", turn).alias("first"))
    rows = made.join(known, ["family_id", "sha256"], "left").join(first, ["family_id", "sha256"])
    fresh = rows.where("known IS NULL AND id = first").select(*[c for c in variants.columns if c in made.columns])
    chosen = rows.groupBy("family_id").agg(F.max_by(F.coalesce("known", "first"), turn).alias("chosen"))
    heads = family.join(chosen, family["id"] == chosen["family_id"], "left").drop(chosen["family_id"])
    heads = heads.withColumn("active_variant_id", F.coalesce("chosen", "active_variant_id"))
    if unified:
        heads = heads.withColumn("source_variant_id", F.coalesce("chosen", "source_variant_id"))
    return variants.unionByName(fresh, allowMissingColumns=True), heads.select(*family.columns)


def activated(family: DataFrame, variants: DataFrame, family_id: str, variant_id: str, source: bool = False) -> DataFrame:
    """DML-11: the family with another active variant or source; null pointers to foreign variants are refused by a filter.

    A new source resets the hashes and the fingerprint that the old one gave.
    """
    mine = variants.where((F.col("family_id") == family_id) & (F.col("id") == variant_id)).select(F.lit(family_id).alias("id"), F.lit(True).alias("ok"), F.col("sha256").alias("new_sha")).limit(1)
    rows = family.join(mine, "id", "left")
    hit = F.coalesce("ok", F.lit(False))
    out = rows.withColumn("active_variant_id", F.when(hit, F.lit(variant_id)).otherwise(F.col("active_variant_id")))
    if source:
        out = out.withColumn("source_variant_id", F.when(hit, F.lit(variant_id)).otherwise(F.col("source_variant_id")))
        if "source_hashes" in family.columns:
            out = out.withColumn("source_hashes", F.when(hit, F.array("new_sha")).otherwise(F.col("source_hashes")))
        if "content_fingerprint" in family.columns:
            out = out.withColumn("content_fingerprint", F.when(~hit, F.col("content_fingerprint")))
    return out.select(*family.columns)


def _single(changes: DataFrame, columns: list[str]) -> DataFrame:
    """One change for each id: of several the greatest, so that no row is multiplied."""
    return changes.groupBy("id").agg(F.max(F.struct(*columns)).alias("_c")).select("id", "_c.*")


def renamed(family: DataFrame, changes: DataFrame) -> DataFrame:
    """DML-11: families with new names and categories, all or none: an unsafe category or a name twice refuses the change.

    Of several changes of one family the last in order of name and category holds.
    """
    changes = _single(changes, ["name", "category"])
    rows = family.join(changes.select(F.col("id"), F.col("name").alias("new_name"), F.col("category").alias("new_category")), "id", "left")
    out = rows.withColumns({"name": F.coalesce(F.trim("new_name"), "name"), "category": F.coalesce(names.category(F.col("new_category")), "category"), "bad": F.col("new_category").isNotNull() & names.category(F.col("new_category")).isNull()})
    twice = out.groupBy("category", "name").agg(F.count("*").alias("k"), F.count("new_name").alias("changed")).where("k > 1 AND changed > 0")
    if not out.where("bad").isEmpty() or not twice.isEmpty():
        return family
    return out.select(*family.columns)


def moved_paths(variants: DataFrame, folder: str, files: DataFrame) -> DataFrame:
    """DML-11: (id, path, new_path, blocked) of moving variants to a folder: one taken name blocks all."""
    rows = variants.select("id", "path", F.concat(F.lit(f"{folder}/"), F.regexp_extract("path", r"([^/]+)$", 1)).alias("new_path"))
    taken = rows.join(files.select(F.col("path").alias("new_path"), F.lit(True).alias("there")), "new_path", "left")
    twice = rows.groupBy("new_path").agg(F.count("*").alias("k"))
    out = taken.join(twice, "new_path").withColumn("hit", (F.coalesce("there", F.lit(False)) & (F.col("path") != F.col("new_path"))) | (F.col("k") > 1))
    total = out.agg(F.count_if("hit").alias("hits"))
    return out.join(F.broadcast(total), F.lit(True)).select("id", "path", "new_path", (F.col("hits") > 0).alias("blocked"))


def restored(quarantine: DataFrame, family: DataFrame, files: DataFrame, free_name: bool = True) -> DataFrame:
    """DML-10: quarantined entries with `outcome`: restored (to `target`), or why not: no family, other content, path taken.

    Videos get a free name where theirs is taken; images (`free_name` false) are refused.
    """
    disk = files.select(F.col("path").alias("quarantined_path"), F.col("sha256").alias("disk_sha"))
    taken = files.select(F.col("path").alias("original_path"), F.lit(True).alias("taken"))
    rows = quarantine.join(disk, "quarantined_path", "left").join(taken, "original_path", "left").join(family.select(F.col("id").alias("family_id"), F.lit(True).alias("alive")), "family_id", "left")
    # Entries that would get one free name are told apart by a number.
    place = F.row_number().over(W.partitionBy("original_path", F.substring("sha256", 1, 8)).orderBy("token"))
    tail = names.numbered(F.concat(F.lit("_"), F.substring("sha256", 1, 8)), place)
    free = F.regexp_replace("original_path", r"(\.[^./]+)$", F.concat(tail, F.lit("$1")))
    outcome = F.when(F.col("alive").isNull(), "no_family").when(F.col("disk_sha").isNull(), "no_file").when(F.col("disk_sha") != F.col("sha256"), "changed").when(F.col("taken") & F.lit(not free_name), "occupied").otherwise("restored")
    target = F.when(outcome == "restored", F.when(F.col("taken"), free).otherwise(F.col("original_path")))
    return rows.withColumn("outcome", outcome).withColumn("target", target).select(*quarantine.columns, "outcome", "target")


def detached(assets: DataFrame, decks: DataFrame, files: DataFrame, variants: DataFrame, family: DataFrame) -> DataFrame:
    """DML-15: plan of replacing a deck's media by placeholders: decks whose file isn't the registered one are refused;
    `restore_variant` is what a later restore puts back: the family's active variant, under a part name of its suffix."""
    now = files.select(F.col("path").alias("source_path"), F.col("sha256").alias("disk_sha"))
    ready = decks.select(F.col("id").alias("deck_id"), "source_path", "source_sha256").join(now, "source_path", "left")
    active = family.select(F.col("id").alias("family_id"), F.col("active_variant_id").alias("restore_variant"))
    suffix = variants.select(F.col("id").alias("restore_variant"), names.suffix(F.col("path")).alias("new_suffix"))
    rows = assets.join(ready, "deck_id").join(active, "family_id", "left").join(suffix, "restore_variant", "left")
    part = F.when(names.suffix(F.col("part")) == F.col("new_suffix"), F.col("part")).otherwise(F.concat(F.regexp_replace("part", r"\.[^./]+$", ""), F.lit("_restored"), F.col("new_suffix")))
    return rows.select("deck_id", "part", "family_id", "restore_variant", F.col("disk_sha").eqNullSafe(F.col("source_sha256")).alias("allowed"), part.alias("restored_part"))


def upgrade_plan(parts: DataFrame, matches: DataFrame, masters: DataFrame) -> DataFrame:
    """DML-14: for each part of a deck the family it matched, and one delivery part for equal masters.

    parts: (deck_id, part, ord, sha256); matches: (sha256, family_id, how); masters: (family_id, master_sha256).
    Parts without a match stay. The first part of a master in a deck is written, the others point to it.
    """
    rows = parts.join(matches, "sha256", "left").join(masters, "family_id", "left")
    first = rows.where("master_sha256 IS NOT NULL").groupBy("deck_id", "master_sha256").agg(F.min_by("part", "ord").alias("delivery_part"))
    out = rows.join(first, ["deck_id", "master_sha256"], "left")
    action = F.when(F.col("family_id").isNull(), "keep").when(F.col("master_sha256").eqNullSafe(F.col("sha256")), "same").when(F.col("delivery_part") == F.col("part"), "write").otherwise("point")
    return out.select(*parts.columns, "family_id", "how", "delivery_part", action.alias("action"))


def registered(decks: DataFrame, incoming: DataFrame, failed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DML-01: decks with incoming ones, and those left out: a deck with any failed asset is rolled back as a whole."""
    bad = failed.select("id").distinct()
    good = incoming.join(bad, "id", "left_anti")
    return decks.unionByName(good.select(*decks.columns)), incoming.join(bad, "id", "left_semi")


def moved_output(outputs: DataFrame, output_id: str, target: str, found_sha: str | None) -> DataFrame:
    """SUP-08: the outputs with one at a new path, if its file still has the recorded hash."""
    hit = (F.col("id") == output_id) & F.col("sha256").eqNullSafe(F.lit(found_sha))
    return outputs.withColumn("path", F.when(hit, F.lit(target)).otherwise(F.col("path")))


def without_ignored_of(ignored: DataFrame, shas: list[str] | None = None) -> DataFrame:
    """DML-17: the ignored pairs after a reset: of all, or of those that name one of a few hashes."""
    if shas is None:
        return ignored.limit(0)
    return ignored.where(~F.arrays_overlap(F.split("pair", ":"), F.array(*[F.lit(s) for s in shas])))


def updated_images(assets: DataFrame, changes: DataFrame) -> DataFrame:
    """DML-18: images with changed name, category, tags and summary; what a change leaves out stays, tags are cleaned."""
    from assetloom.operators.identity import clean_tags

    changes = _single(changes, ["name", "category", "tags", "summary"])
    new = changes.select("id", *[F.col(c).alias(f"new_{c}") for c in ("name", "category", "tags", "summary")])
    rows = assets.join(new, "id", "left")
    category = F.when(F.col("new_category").isNull(), F.col("category")).otherwise(F.coalesce(names.category(F.col("new_category")), "category"))
    return rows.withColumns({"name": F.coalesce(F.trim("new_name"), "name"), "category": category, "tags": F.coalesce(clean_tags(F.col("new_tags")), "tags"), "summary": F.coalesce(F.trim("new_summary"), "summary")}).select(*assets.columns)


def removed_images(assets: DataFrame, ignored: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """DML-18: images without those of `ids`, ignored pairs without theirs, and the paths that nothing needs any more."""
    gone = assets.join(ids.select("id"), "id", "left_semi")
    left = assets.join(ids.select("id"), "id", "left_anti")
    pairs = ignored.select("pair", F.explode(F.split("pair", ":")).alias("sha256")).join(gone.select("sha256"), "sha256", "left_semi").select("pair").distinct()
    return left, ignored.join(pairs, "pair", "left_anti"), gone.select("path").distinct().join(left.select("path"), "path", "left_anti")


def import_totals(outcomes: DataFrame) -> DataFrame:
    """AGG-24: one row: what became of incoming assets, and how many distinct contents there were."""
    n = lambda *of: F.count_if(F.col("outcome").isin(*of))
    return outcomes.agg(n("added").alias("added"), n("reused", "reused_pixels", "repeated").alias("reused"), n("skipped").alias("skipped"), n("failed").alias("failed"), F.count_distinct("sha256").alias("distinct_contents"))


def pending_cleanup(quarantine: DataFrame) -> DataFrame:
    """AGG-25: number and bytes of what waits in quarantine."""
    return quarantine.where("state = 'quarantined'").agg(F.count("*").alias("pending"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("pending_bytes"))


def stored_else(stored: DataFrame, computed: DataFrame, key: str, value: str) -> DataFrame:
    """SUP-03: a stored value, else the computed one; only what lacks a stored one is looked up."""
    lacking = stored.where(F.col(value).isNull()).select(key).join(computed.select(key, F.col(value).alias("made")), key, "left")
    return stored.join(lacking, key, "left").withColumn(value, F.coalesce(value, "made")).select(*stored.columns)


def unmatched(parts: DataFrame, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-22: crawled package members with their family, and those that no family knows (a batch must not go on with any)."""
    one = hashes.groupBy("sha256").agg(F.min("family_id").alias("family_id"), F.count_distinct("family_id").alias("owners"))
    rows = parts.join(one, "sha256", "left")
    return rows.where("owners = 1"), rows.where("owners IS NULL OR owners > 1")


def readable_index(entries: DataFrame, root: str) -> DataFrame:
    """SRC-20: quarantine entries with a `problem` where a path leaves the library or a field is missing."""
    inside = lambda c: F.startswith(F.concat(F.lit("/"), names.resolved(F.col(c))), F.concat(F.lit("/"), names.resolved(F.lit(root)), F.lit("/")))
    problem = F.when(F.col("token").isNull() | F.col("family_id").isNull(), "incomplete").when(~inside("original_path") | ~inside("quarantined_path"), "outside").when(~F.col("state").isin("moving", "quarantined"), "unknown_state")
    return entries.withColumn("problem", problem)
