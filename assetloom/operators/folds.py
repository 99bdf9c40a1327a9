"""Changes whose order counts, without a walk over them: what doesn't depend on anything undecided is settled at once.

A hash catalog and a plan of decisions are applied one entry after another, each against the state that those before it
left. Entries that share nothing don't see each other, so rounds over tables give what the walk gives: each round settles
all entries for which what they see can't change any more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.operators import changes
from assetloom.operators.ordered import settled


def _hopeful(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(ord) of groups that may find an anchor: a hash of theirs is known, or an earlier hopeful group shares one.

    Each hash has the earliest place at which it may become known; these fall until nothing changes.
    """
    found = rows.join(known.select("hash").distinct(), "hash", "left_semi").select("ord").distinct()
    at = known.select("hash").distinct().withColumn("since", F.lit(-1).cast("long"))
    while True:
        since = at.unionByName(rows.join(found, "ord").select("hash", F.col("ord").alias("since"))).groupBy("hash").agg(F.min("since").alias("since"))
        now = settled(rows.join(since, "hash").where("since < ord").select("ord").distinct())
        if now.count() == found.count():
            return now
        found = now


def merged_catalog(known: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DML-07, SRT-08, JON-12: groups of hashes merged one after another into families that share one.

    known: (hash, family); incoming: (ord, hash), `ord` is a group's place; a null hash stands for a group without any. A
    group whose known hashes name one family adds its other hashes to it, and these are known to the groups behind it; one
    that names none is skipped, one that names several is in conflict. Gives (ord, state, anchor, n_added), and the rows of
    `known` with those that were added.

    A group is settled when its anchors can't change any more: at once if there are several; if there is one, as soon as
    all earlier undecided groups that share a hash with it have that one, too, since these can add nothing else; if there
    is none, when no such group is left. So a hash that a third of all groups hold is no chain of rounds. Groups that no
    path of earlier ones connects with a known hash are skipped before the first round.
    """
    every = settled(incoming.select(F.col("ord").cast("long").alias("ord"), "hash").distinct())
    rows = every.where("hash IS NOT NULL")
    known = settled(known.select("hash", "family").where("hash IS NOT NULL").distinct())
    whole, decided = known, []
    left = settled(rows.join(_hopeful(rows, known), "ord", "left_semi"))
    while not left.isEmpty():
        by_hash = whole.groupBy("hash").agg(F.min("family").alias("lo"), F.max("family").alias("hi"))
        seen = left.join(by_hash, "hash", "left")
        anchors = seen.groupBy("ord").agg(F.min("lo").alias("anchor"), F.max("hi").alias("other"))
        state = settled(anchors.select("ord", "anchor", (F.col("anchor") != F.col("other")).alias("several")))
        conflict = state.where("several").select("ord", F.lit("conflict").alias("state"), F.lit(None).cast(known.schema["family"].dataType).alias("anchor"))
        open_ = left.join(state.where("several IS NULL OR NOT several"), "ord").select("ord", "hash", "anchor")
        first = open_.groupBy("hash").agg(F.min("ord").alias("first"), F.min_by(F.struct("anchor"), "ord").alias("lead"))
        beside = open_.join(first, "hash").withColumn("alike", F.coalesce(F.col("anchor") == F.col("lead.anchor"), F.lit(False)))
        until = beside.where("NOT alike").groupBy("hash").agg(F.min("ord").alias("until"))
        free = (F.col("ord") == F.col("first")) | (F.col("alike") & (F.col("until").isNull() | (F.col("ord") < F.col("until"))))
        ready = beside.join(until, "hash", "left").groupBy("ord").agg(F.bool_and(free).alias("ready"), F.first("anchor").alias("anchor")).where("ready")
        done = settled(ready.select("ord", F.when(F.col("anchor").isNull(), "skipped").otherwise("matched").alias("state"), "anchor").unionByName(conflict))
        decided.append(done)
        more = left.join(done.where("state = 'matched'").select("ord", F.col("anchor").alias("family")), "ord").select("hash", "family").distinct()
        whole = settled(whole.unionByName(more).distinct())
        left = settled(left.join(done, "ord", "left_anti"))
    if not decided:
        found = every.select("ord").distinct().select("ord", F.lit("skipped").alias("state"), F.lit(None).cast(known.schema["family"].dataType).alias("anchor"))
    else:
        found = decided[0]
        for k, more in enumerate(decided[1:], 1):
            found = found.unionByName(more)
            if k % 32 == 0:
                found = settled(found)
        found = found.unionByName(every.select("ord").distinct().join(found, "ord", "left_anti").select("ord", F.lit("skipped").alias("state"), F.lit(None).cast(known.schema["family"].dataType).alias("anchor")))
    # A hash counts for the first group that added it to a family.
    added = rows.join(found.where("state = 'matched'").select("ord", F.col("anchor").alias("family")), "ord").groupBy("hash", "family").agg(F.min("ord").alias("ord"))
    counted = added.join(known, ["hash", "family"], "left_anti").groupBy("ord").agg(F.count("*").alias("n_added"))
    return found.join(counted, "ord", "left").select("ord", "state", "anchor", F.coalesce("n_added", F.lit(0)).alias("n_added")), whole


def _touched(decisions: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    names = F.array_distinct(F.array_union(F.array("family_id"), F.coalesce("merge_family_ids", none)))
    return decisions.select("decision_id", F.struct("ord", "decision_id").alias("turn"), F.explode(names).alias("family"))


def _pointed(column: str) -> Column:
    """A family's pointer, which falls back to what is kept where its variant is gone."""
    return F.when(F.col(f"{column}_gone"), F.col("keep")).otherwise(F.col(column)).alias(column)


def _applied(ready: DataFrame, family: DataFrame, variants: DataFrame, identical: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Decisions that share no family, applied: families, variants, what went to quarantine, and outcomes."""
    merges = ready.where("kind = 'cross_family'").select("decision_id", F.col("family_id").alias("target"), F.posexplode(F.array_distinct("merge_family_ids")).alias("place", "loser")).where("loser <> target")
    sha = variants.select("family_id", "sha256").distinct()
    common = merges.join(sha.withColumnRenamed("family_id", "target"), "target").join(sha.withColumnRenamed("family_id", "loser"), ["loser", "sha256"])
    same = identical.select("a", "b").unionByName(common.select(F.col("target").alias("a"), F.col("loser").alias("b"))).distinct()
    checked = changes.checked_decisions(ready, family, variants, same)
    lost = merges.join(family.select(F.col("id").alias("loser")), "loser", "left_anti").select("decision_id").distinct().withColumn("lost", F.lit(True))
    checked = settled(checked.join(lost, "decision_id", "left").withColumn("problem", F.coalesce("problem", F.when(F.col("lost"), "unknown_family"))).drop("lost"))
    valid = checked.where("problem IS NULL")
    moves = merges.join(valid.select("decision_id"), "decision_id", "left_semi")
    # Losers' variants go to the target; of equal contents the first stays, the target's own before the losers' in turn.
    into = variants.join(moves.select(F.col("loser").alias("family_id"), "target", "place", "decision_id"), "family_id", "left")
    own = moves.select(F.col("target").alias("family_id"), F.lit(True).alias("grows")).distinct()
    into = into.withColumn("home", F.coalesce("target", "family_id")).join(own.withColumnRenamed("family_id", "home"), "home", "left")
    turn = F.struct(F.coalesce("place", F.lit(-1)).alias("p"), "ord", "id")
    twin = into.where("grows").groupBy("home", "sha256").agg(F.min(turn).alias("twin"))
    into = settled(into.join(twin, ["home", "sha256"], "left").withColumn("double", F.coalesce(F.col("place").isNotNull() & (F.col("twin.id") != F.col("id")), F.lit(False))))
    doubles = into.where("double").select("id", F.col("twin.id").alias("twin_id"), "decision_id", F.col("family_id").alias("from_family"))
    kept = into.where("NOT double").withColumn("family_id", F.col("home")).select(*variants.columns)
    kept = kept.join(doubles.select(F.col("id").alias("source_variant_id"), "twin_id"), "source_variant_id", "left").withColumn("source_variant_id", F.coalesce("twin_id", "source_variant_id")).select(*variants.columns)
    heads = valid.join(family.select(F.col("id").alias("family_id"), F.col("source_variant_id").alias("head")), "family_id")
    keep = F.when(F.col("kind") == "cross_family", F.col("head")).otherwise(F.col("keep_variant_id"))
    effective = heads.select("decision_id", "kind", "family_id", keep.alias("keep"), F.array_distinct(F.coalesce("remove_variant_ids", F.array().cast("array<string>"))).alias("removes"))
    removed = settled(effective.select("decision_id", "keep", F.explode("removes").alias("id")).where("id <> keep").join(kept.select("id", "family_id"), "id"))
    gone = removed.select("id", F.lit(True).alias("gone"))
    stay = kept.join(gone, "id", "left_anti").join(gone.withColumnsRenamed({"id": "source_variant_id", "gone": "origin_gone"}), "source_variant_id", "left")
    stay = stay.withColumn("source_variant_id", F.when(F.col("origin_gone").isNull(), F.col("source_variant_id"))).select(*variants.columns)
    left = family.join(moves.select(F.col("loser").alias("id")), "id", "left_anti").join(effective.select(F.col("family_id").alias("id"), "keep"), "id", "left")
    for c in ("source_variant_id", "active_variant_id"):
        left = left.join(gone.withColumnsRenamed({"id": c, "gone": f"{c}_gone"}), c, "left")
    left = left.select(*[_pointed(c) if c in ("source_variant_id", "active_variant_id") else F.col(c) for c in family.columns])
    n = removed.groupBy("decision_id").agg(F.count("*").alias("n"))
    asks = effective.select("decision_id", (F.size(F.array_except("removes", F.array("keep"))) > 0).alias("asks"))
    outcome = F.when(F.col("problem").isNotNull(), "failed").when((F.col("kind") == "within_family") & ~F.col("asks"), "skipped").otherwise("applied")
    outcomes = checked.join(n, "decision_id", "left").join(asks, "decision_id", "left").select("decision_id", outcome.alias("outcome"), "problem", F.coalesce("n", F.lit(0)).alias("n_removed"))
    away = removed.select("id", "decision_id", "family_id", F.lit("removed").alias("why")).unionByName(doubles.select("id", "decision_id", F.col("from_family").alias("family_id"), F.lit("duplicate").alias("why")))
    return left, stay, away, outcomes


def sequential_decisions(decisions: DataFrame, family: DataFrame, variants: DataFrame, identical: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """DML-09: a plan's decisions, each checked and applied against what those before it left.

    decisions: as for `changes.checked_decisions`, with `ord`; identical: (a, b), families that fingerprints tell to be the
    same (families that hold equal files are the same, too). Gives the families, the variants, what went to quarantine
    (id, decision_id, family_id, why) and each decision's outcome (applied, skipped as it changes nothing, or failed).

    Decisions that name no common family don't see each other, so a round applies all that are first at each of their
    families. There are as many rounds as the longest chain of decisions of which each names a family of the one before.
    """
    todo = settled(_touched(decisions))
    family, variants, away, told = settled(family), settled(variants), [], []
    while not todo.isEmpty():
        first = todo.groupBy("family").agg(F.min("turn").alias("first"))
        ready = settled(todo.join(first, "family").groupBy("decision_id").agg(F.bool_and(F.col("turn") == F.col("first")).alias("now")).where("now").select("decision_id"))
        family, variants, gone, outcomes = _applied(decisions.join(ready, "decision_id", "left_semi"), family, variants, identical)
        family, variants = settled(family), settled(variants)
        away.append(settled(gone))
        told.append(settled(outcomes))
        todo = settled(todo.join(ready, "decision_id", "left_anti"))
    if not told:
        empty = decisions.limit(0)
        return family, variants, empty.select(F.lit("").alias("id"), "decision_id", "family_id", F.lit("").alias("why")), empty.select("decision_id", F.lit("").alias("outcome"), F.lit("").alias("problem"), F.lit(0).alias("n_removed"))
    for parts in (away, told):
        for more in parts[1:]:
            parts[0] = parts[0].unionByName(more)
    return family, variants, away[0], told[0]
