"""Operator 3: rule bitmask ledger (native DataFrame operations only).

Every rule is evaluated once for a document; the ledger keeps its failures as bits of a long and the
measurements beside them. Policies are versioned sets of rules, so a verdict is one bitwise AND with the
policy's mask, and ablations group the ledger by its bits, never by its texts.

All measurements of a document are made inside its row (arrays and higher-order functions); the only shuffle
is the ablation's count per bit pattern, which has at most 2^rules rows.

Cases: a null or empty text has no words and all counts 0, so it fails `few_words`; repeated rows get a row
each; an empty table gives an empty ledger; extra columns pass through, those named like a result as `<name>_input`.
An empty table of policies gives no verdicts; one that names an unknown rule is refused.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, Aside, with_results

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks"]

#: Name -> what fails it, over the measurements. A rule's bit is its place here: append, never reorder.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "exclamation": "10 * n_marks > n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}
#: Of the rules above and of what they mean; a ledger tells by which one it was made.
RULE_SET = 1
BASE = ("few_words", "repeated_words")
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "exclamation"),
    "v2": (*BASE, "symbols", "exclamation", "repeated_lines", "short_words", "long_words"),
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more; windows are compared by a 64-bit hash and their place.

    Only texts in which a window repeats are sorted. With the places of repeated windows in order, each
    covers the words up to the next one, three at most.
    """

    def covered(places: Column) -> Column:
        each = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))))
        return F.aggregate(each, F.lit(0), lambda a, x: a + x)

    def sorted_windows(s: Column) -> Column:
        same = lambda x, i: x["h"].eqNullSafe(F.get(s, i - 1)["h"]) | x["h"].eqNullSafe(F.get(s, i + 1)["h"])
        return _let(F.sort_array(F.transform(F.filter(s, same), lambda x: x["p"])), covered)

    def hashed(h: Column) -> Column:
        heavy = _let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), sorted_windows)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(heavy)

    def of(w: Column) -> Column:
        n = F.size(w)
        windows = F.arrays_zip(w.alias("a"), F.slice(w, F.lit(2), n), F.slice(w, F.lit(3), n))
        hashes = F.transform(F.slice(windows, F.lit(1), n - 2), lambda x: F.xxhash64(x["a"], x["1"], x["2"]))
        return F.when(n < 4, F.lit(0)).otherwise(_let(hashes, hashed))

    return _let(words, of)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the measurements, one pass over each text."""
    names = Aside(docs)
    t = F.coalesce(F.col(names(text)), F.lit(""))
    kept = lambda regex: F.length(F.regexp_replace(t, regex, F.lit("")))
    words = F.filter(F.split(t, f"[{WS}]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{WS}]"))
    per_line = _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    per_word = _let(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("repeat")))
    out = names.rows.withColumns({"words": per_word, "lines": per_line})
    out = out.withColumns({
        "n_words": F.col("words.n").cast("long"),
        "word_chars": kept(f"[{WS}]+").cast("long"),
        "n_symbols": kept("[^#*$%&|<>]+").cast("long"),
        "n_dup_lines": F.col("lines.dup").cast("long"),
        "n_repeat_words": F.col("words.repeat").cast("long"),
        "n_lines": F.col("lines.n").cast("long"),
        "n_marks": kept("[^!]+").cast("long"),
    })
    return names.back(out, MEASURES)


def mask(policy: str, policies: dict[str, tuple[str, ...]] | None = None, rules: dict[str, str] | None = None) -> int:
    names = list(RULES if rules is None else rules)
    return sum(1 << names.index(x) for x in (POLICIES if policies is None else policies)[policy])


def ledger(rows: DataFrame, rules: dict[str, str] | None = None, rule_set: int = RULE_SET) -> DataFrame:
    """Measured rows with `fail_bits` (bit k is set if rule k fails) and the `rule_set` that they are of."""
    bits = [F.when(F.expr(e), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, e in enumerate((RULES if rules is None else rules).values())]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return with_results(rows, {"fail_bits": out, "rule_set": F.lit(rule_set)})


def passes(policy: str) -> Column:
    """The verdict of a policy over a ledger."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def policy_table(spark: SparkSession, version: int = 1, policies: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Policies as rows (policy, version, rule), to be stored and changed beside ledgers."""
    rows = [(p, version, r) for p, rs in (POLICIES if policies is None else policies).items() for r in rs]
    return spark.createDataFrame(rows, "policy string, version int, rule string")


#: Rows that a table of policies has at most.
MOST_POLICY_ROWS = 10_000


def verdicts(entries: DataFrame, policies: DataFrame, rule_set: int = RULE_SET) -> DataFrame:
    """A stored ledger under each policy of a table: `policy`, `policy_version` and `kept` (null where the ledger is of other rules).

    No text is read: a verdict is one bitwise AND. The masks are few and become constants of the plan.
    """
    rows = policies.select("policy", "version", "rule").distinct().limit(MOST_POLICY_ROWS + 1).collect()
    if len(rows) > MOST_POLICY_ROWS:
        raise ValueError(f"more than {MOST_POLICY_ROWS} rows of policies")
    masks: dict[tuple[str, int], int] = {}
    for r in rows:
        if r["rule"] not in RULES:
            raise ValueError(f"policy {r['policy']} names the unknown rule {r['rule']}")
        key = (r["policy"], r["version"])
        masks[key] = masks.get(key, 0) | 1 << list(RULES).index(r["rule"])
    kind = "array<struct<policy:string,policy_version:int,mask:bigint>>"
    cases = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(v).alias("policy_version"), F.lit(m).cast("long").alias("mask")) for (p, v), m in sorted(masks.items())]).cast(kind)
    names = Aside(entries)
    each = names.rows.withColumn("case", F.explode(cases))
    bits, made_by = F.col(names("fail_bits")), F.col(names("rule_set"))
    kept = F.when(made_by == rule_set, bits.bitwiseAND(F.col("case.mask")) == 0)
    return names.back(each.withColumns({"policy": F.col("case.policy"), "policy_version": F.col("case.policy_version"), "kept": kept}), ["policy", "policy_version", "kept"])


def ablations(entries: DataFrame, policies: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """For each policy and rule of it: documents failing the rule, failing it alone, and kept with and without it."""
    patterns = entries.groupBy("fail_bits").agg(F.count("*").alias("n"))
    names = list(RULES)
    used = POLICIES if policies is None else policies
    cases = [F.struct(F.lit(v).alias("policy"), F.lit(r).alias("rule"), F.lit(mask(v, used)).cast("long").alias("mask"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for v, rs in used.items() for r in rs]
    x = patterns.select("fail_bits", "n", F.inline(F.array(*cases)))
    within = F.col("fail_bits").bitwiseAND(F.col("mask"))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long")
    return x.groupBy("policy", "rule").agg(
        total(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0).alias("n_fail"),
        total(within == F.col("bit")).alias("n_fail_alone"),
        total(within == 0).alias("n_kept"),
        total(within.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"),
    )
