"""Operator 10: mix sources to target weights by systematic sampling (native DataFrame operations only).

Every document of a source expects `target / source_size` copies. Documents are laid in a fixed order within
their source (by size, so that neighbours are alike, then by a hash of the id), the expected copies are prefix-summed,
one offset per source is added, and a document is emitted once per integer boundary its interval crosses.

No source is ever ordered in one task, nor are all sources: ranks and sums come from ranges of the order
(`common.running`), whatever the number of rows of a source or of sources. What is drawn depends on the documents
alone, not on the size of the cluster or the number of partitions.

Cases: a null text has size 0; a null source is a source of its own, ordered last; a source without words has
target 0 and is not taken; repeated rows are separate documents; an empty table gives an empty result; extra
columns pass through, those named like a result as `<name>_input`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Aside, checkpointed, n_words, running, spread, stored

SHARE, CAP, WEIGHTS, SEED = 1.5, 2.0, (5, 2, 1), "mix-1"


def _hash32(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _whole(rows: DataFrame) -> Column:
    """A hash of all that a row holds (but maps, which have no order), so that only equal rows are ordered by chance."""
    flat = [c for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
    return F.xxhash64(*[x for c in flat for x in (F.col(c).isNull(), F.col(c))])


def source_targets(sizes: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(none, key, source_size) -> the same with `target`; one row per source.

    Targets split `share` of all sizes by weight and stop at `cap` times the source's size. The excess is shared
    again by weight until none is above: sources sorted by cap over weight saturate in that order, so the level
    is the first one that the next source's own ratio is not below.
    """
    per = running(sizes, [], ["none", "key"], F.lit(1).cast("long"), "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    per = per.withColumns({"w": weight, "cap": F.col("source_size") * F.lit(float(cap))}).withColumn("ratio", F.col("cap") / F.col("w"))
    per = running(per, [], ["ratio", "none", "key"], F.col("cap"), "caps_before")
    per = checkpointed(running(per, [], ["ratio", "none", "key"], F.col("w"), "w_before"))
    totals = per.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()
    all_, w_all = float(totals["size"] or 0) * share, float(totals["w"] or 0)
    level = (F.lit(all_) - F.col("caps_before")) / (F.lit(w_all) - F.col("w_before"))
    found = per.agg(F.max(F.when(level <= F.col("ratio"), level)).alias("level")).first()["level"]
    target = F.col("cap") if found is None else F.least(F.col("cap"), F.col("w") * F.lit(float(found)))
    return per.select("none", "key", "source_size", target.alias("target"))


def _mixed(docs: DataFrame, size: Column, share: float, cap: float, weights: tuple[int, ...], seed: str, source: str, doc_id: str) -> tuple[Aside, DataFrame]:
    """`docs` under names aside, with size, source_size, target and copies."""
    names = Aside(docs)
    rows = docs.select(*["`" + c.replace("`", "``") + "`" for c in docs.columns], size.cast("long")).toDF(*names.rows.columns, "size")
    source_at, id_at = F.col(names(source)), F.col(names(doc_id))
    rows = rows.withColumns({
        "none": source_at.isNull().cast("int"), "key": F.coalesce(source_at.cast("string"), F.lit("")), "doc": id_at,
        "h": _hash32(F.coalesce(id_at.cast("string"), F.lit(""))), "own": _whole(rows), "row": F.monotonically_increasing_id(),
    })
    rows = stored(rows, "mix")  # the row's number holds from here on
    targets = source_targets(rows.groupBy("none", "key").agg(F.sum("size").alias("source_size")), share, cap, weights)
    ranked = running(rows.select("row", "none", "key", "size", "h", "doc", "own"), ["none", "key"], ["size", "h", "doc", "own", "row"], F.lit(1).cast("long"), "before")
    e = F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    u = _hash32(F.concat(F.lit(f"{seed}:"), F.col("none").cast("string"), F.lit(":"), F.col("key"))) / F.lit(4294967296.0)
    copies = F.floor(F.col("e") * (F.col("before") + 1) + F.col("u")) - F.floor(F.col("e") * F.col("before") + F.col("u"))
    drawn = ranked.join(spread(targets), ["none", "key"]).withColumns({"e": e, "u": u})
    drawn = drawn.select("row", F.col("source_size").cast("long").alias("source_size"), "target", copies.cast("long").alias("copies"))
    return names, rows.select(*names.rows.columns, "size", "row").join(drawn, "row")


def mix(docs: DataFrame, size: Column, share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED, source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """`docs` with `mix_size`, `mix_source_size`, `mix_target` and `mix_copies` (how often the mix takes the row)."""
    names, rows = _mixed(docs, size, share, cap, weights, seed, source, doc_id)
    results = {f"mix_{c}": F.col(c) for c in ("size", "source_size", "target", "copies")}
    return names.back(rows.withColumns(results), list(results))


def emitted(docs: DataFrame, text: str = "text", share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED, source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The mix itself: each row as often as it is taken, with the columns of `docs`."""
    names, rows = _mixed(docs, n_words(F.col(text)), share, cap, weights, seed, source, doc_id)
    taken = rows.where("copies > 0")
    return names.back(taken.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))))
