"""Operator 5: quotation linking (native DataFrame operations only).

A line's quote level is the number of ">" before its text. Neighbouring lines of one level make a passage; the
passages of level 0 are the message's own words, the others quote earlier messages. Passages are compared by
the MD5 of their text in lower case with white space folded. The original of a quoted passage is the first
message of the conversation whose own words hold it: as a whole, as a run between quotes, as a paragraph or as
a line. A passage of several lines that no earlier message holds so may quote parts of one: its original is the first
message that holds each of its paragraphs, as a paragraph or else line by line. A message replies to the original of its least nested linked passage, of several the latest; following
replies up gives the head of its thread. Conversations are ordered by the head's turn and then by turn, so
that every reply stands after what it answers, and hold own words only. `conversations` assembles them as arrays of
at most `BLOCK` messages, so that a row is bounded however long a conversation is.

Originals are reduced to one row a conversation and passage before the join, so no join multiplies rows. Quotes of
parts are looked up once for each distinct passage, among distinct messages that hold the rarest of its pieces.
Heads are found by pointer doubling over the replies. Positions come from ranges of the order (`common.running`), so
that no conversation or thread is ordered in one task, nor are the rows without a conversation or turn. Messages are
parsed once, to a table in the shared folder.

Cases: a null or empty text is an empty message; a message that only quotes has an empty body; a passage found
in no earlier message stays unlinked and is dropped from the body all the same; rows without a conv_id or turn
link with nothing (positions count among their like); repeated rows get a row each; an empty table gives an
empty result; extra columns pass through, those named like a result as `<name>_input`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Aside, checkpointed, running, spread, stored

_MARKS = r"^(?:[ \t]*>)+"
_SEP = "\x01"
_GAP = r"\n\s*\n"
#: Messages in a row of `conversations`.
BLOCK = 1024


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), "[^>]", ""))


def normalised(passage: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(passage, r"\s+", " ")))


def passages(text: Column) -> Column:
    """array<struct<level, body>>: neighbouring lines of one level, without their marks."""
    lines = F.split(F.translate(F.coalesce(text, F.lit("")), _SEP, " "), "\n")
    leveled = F.transform(lines, lambda x: F.struct(_level(x).alias("level"), x.alias("line")))

    def runs(a: Column) -> Column:
        # A mark where the level changes; splitting at the marks keeps the work linear in the text.
        marked = F.transform(a, lambda x, i: F.concat(F.when((i > 0) & (F.get(a, i - 1)["level"] != x["level"]), F.lit(_SEP)).otherwise(F.lit("")), x["line"]))
        return F.split(F.array_join(marked, "\n"), _SEP)

    each = F.get(F.transform(F.array(leveled), runs), F.lit(0))
    out = F.transform(each, lambda x: F.struct(_level(x).alias("level"), F.trim(F.regexp_replace(x, r"(?m)" + _MARKS + r" ?", "")).alias("body")))
    return F.filter(out, lambda x: normalised(x["body"]) != "")


def _key(passage: Column) -> Column:
    return F.md5(normalised(passage))


def _keys(parts: Column) -> Column:
    return F.transform(F.filter(parts, lambda x: normalised(x) != ""), _key)


def _in_parts(missing: DataFrame, holders: DataFrame) -> DataFrame:
    """(c, h, also): the first message that holds each paragraph of a passage (c, h, q), whole or line by line.

    holders: (c, m, k), the keys of what each message holds.
    """
    paragraphs = F.transform(F.filter(F.split("q", _GAP), lambda p: normalised(p) != ""), lambda p: F.struct(_key(p).alias("k"), F.array_distinct(_keys(F.split(p, "\n"))).alias("lines")))
    wanted = missing.select("c", "h", F.md5("q").alias("v"), paragraphs.alias("ps"))
    each = wanted.select("c", "h", "v", F.posexplode("ps").alias("p", "x"))
    pieces = each.select("c", "h", "v", "p", F.lit(True).alias("whole"), F.col("x.k").alias("k")).unionByName(each.select("c", "h", "v", "p", F.lit(False).alias("whole"), F.explode("x.lines").alias("k")))
    pieces = checkpointed(pieces)
    held = checkpointed(holders.join(pieces.select("c", "k").distinct(), ["c", "k"], "left_semi"))
    # Whatever holds a paragraph holds its key or the rarest of its lines; the paragraph with the fewest such messages is followed.
    counted = pieces.join(held.groupBy("c", "k").agg(F.count("*").alias("n")), ["c", "k"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = counted.groupBy("c", "h", "v", "p", "whole").agg(F.min(F.struct("n", "k")).alias("r"))
    best = rarest.groupBy("c", "h", "v", "p").agg(F.sum("r.n").alias("n"), F.collect_set("r.k").alias("ks")).groupBy("c", "h", "v").agg(F.min(F.struct("n", "p", "ks")).alias("b"))
    candidates = best.where("b.n > 0").select("c", "h", "v", F.explode("b.ks").alias("k")).join(held, ["c", "k"]).select("c", "h", "v", "m").distinct()
    have = candidates.join(pieces.select("c", "h", "v", "k").distinct(), ["c", "h", "v"]).join(held, ["c", "m", "k"]).groupBy("c", "h", "v", "m").agg(F.collect_set("k").alias("have"))
    holds = F.forall("ps", lambda p: F.array_contains(F.col("have"), p["k"]) | (F.size(F.array_except(p["lines"], F.col("have"))) == 0))
    return have.join(wanted, ["c", "h", "v"]).where(holds).groupBy("c", "h").agg(F.min("m").alias("also"))


RESULTS = ["body", "n_quoted", "n_linked", "reply_to", "thread", "position"]


def linked(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """`messages` with body, n_quoted, n_linked, reply_to and thread (turns), and position in the conversation."""
    names = Aside(messages)
    rows = names.rows.withColumns({"c": F.col(names(conv)), "t": F.col(names(turn)), "p": passages(F.col(names(text)))})
    runs = F.transform(F.filter("p", lambda x: x["level"] == 0), lambda x: x["body"])
    rows = rows.withColumns({"body": F.array_join(runs, "\n"), "runs": runs, "quoted": F.filter("p", lambda x: x["level"] > 0), "row": F.monotonically_increasing_id()}).drop("p")
    rows = stored(rows, "messages")  # the row's number holds from here on
    placed = rows.where(F.col("c").isNotNull() & F.col("t").isNotNull())
    quoted = placed.where(F.size("quoted") > 0).select("c", "t", F.explode("quoted").alias("q"))
    quoted = quoted.select("c", "t", F.col("q.level").alias("level"), _key(F.col("q.body")).alias("h"), F.col("q.body").alias("q"))
    quoted = checkpointed(quoted.groupBy("c", "t", "level", "h").agg(F.collect_set("q").alias("q")))  # their lines may be cut differently
    parts = F.flatten(F.array(F.array("body"), F.col("runs"), F.split("body", _GAP), F.split("body", "\n")))
    keys = F.array_distinct(_keys(parts))
    quoting = placed.join(spread(quoted.select("c").distinct()), "c", "left_semi")  # other conversations have nothing to link
    originals = quoting.select("c", "t", F.explode(keys).alias("h")).groupBy("c", "h").agg(F.min("t").alias("first"))
    found = quoted.join(spread(originals), ["c", "h"], "left").withColumn("first", F.when(F.col("first") < F.col("t"), F.col("first")))
    found = checkpointed(found.withColumn("q", F.when(F.col("first").isNull(), F.filter("q", lambda x: x.contains("\n")))))
    missing = found.select("c", "h", F.explode("q").alias("q")).distinct()
    if not missing.isEmpty():
        whole = quoting.groupBy("c", "body", "runs").agg(F.min("t").alias("m"))
        holders = whole.select("c", "m", F.explode(keys).alias("k")).distinct()
        found = found.join(spread(_in_parts(missing, holders)), ["c", "h"], "left").withColumn("first", F.coalesce("first", F.when(F.col("also") < F.col("t"), F.col("also"))))
    nearest = F.min(F.when(F.col("first").isNotNull(), F.struct(F.col("level"), (-F.col("first")).alias("late"))))
    replies = checkpointed(found.groupBy("c", "t").agg(F.count("*").alias("n_quoted"), F.count("first").alias("n_linked"), nearest.alias("best")).select("c", "t", "n_quoted", "n_linked", (-F.col("best.late")).alias("reply_to")))
    heads = _heads(replies.where("reply_to IS NOT NULL").select("c", "t", F.col("reply_to").alias("head")))
    per = replies.join(heads, ["c", "t"], "left").select(F.col("c").alias("of_c"), F.col("t").alias("of_t"), "n_quoted", "n_linked", "reply_to", "head")
    state = rows.select("row", "c", "t", F.xxhash64("body").alias("h")).join(spread(per), (F.col("c") == F.col("of_c")) & (F.col("t") == F.col("of_t")), "left")
    thread = F.coalesce("head", "t")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    state = checkpointed(state.select("row", "c", "t", "h", count("n_quoted"), count("n_linked"), "reply_to", thread.alias("thread"), thread.isNull().cast("int").alias("none")))
    state = running(state, ["c"], ["none", "thread", "t", "h", "row"], F.lit(1).cast("long"), "position")
    out = rows.select(*names.rows.columns, "body", "row").join(state.select("row", "n_quoted", "n_linked", "reply_to", "thread", "position"), "row")
    return names.back(out, RESULTS)


def conversations(messages: DataFrame, conv: str = "conv_id", role: str = "role", block: int = BLOCK) -> DataFrame:
    """Rows of `linked` as (conv_id, block, messages): arrays of (position, role, body) in reply order, of at most `block` messages.

    A conversation is the concatenation of its blocks in order. Rows without a conversation are left out.
    """
    rows = messages.where(F.col(conv).isNotNull()).select(F.col(conv).alias("conv_id"), F.floor(F.col("position") / block).alias("block"), F.struct("position", F.col(role).alias("role"), "body").alias("m"))
    return rows.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("m")).alias("messages"))


def _heads(links: DataFrame) -> DataFrame:
    """(c, t, head): the end of each chain of replies, by pointer doubling."""
    now = checkpointed(links)
    while True:
        up = now.select("c", F.col("t").alias("head"), F.col("head").alias("further"))
        moved = checkpointed(now.join(up, ["c", "head"], "left"))
        if moved.where("further IS NOT NULL").isEmpty():
            return now
        now = moved.select("c", "t", F.coalesce("further", "head").alias("head"))


def formatted(role: Column, body: Column) -> Column:
    """One message as chat text."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("user")), F.lit("|>\n"), body, F.lit("\n"))
