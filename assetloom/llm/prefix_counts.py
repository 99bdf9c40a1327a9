"""Operator 12: exact token counts at every prefix of a text, by dynamic programming over prefixes.

The encoding of a prefix ends with exactly one piece: of those that end there it is the one that may follow the last
piece of the prefix before it (`may_follow`: joined and merged afresh, the two come out again). So the last piece and
the count of every prefix follow from those of shorter ones, and one sweep over the text gives the exact count of each of
its prefixes as if it were encoded alone. Pieces never span runs (see `pieces.py`), so prefixes are counted run by run,
and a bounded cache keeps the counts of runs.

`prefixes` keeps the counts as their differences, one signed byte a character, beside the text's totals. What follows
from them needs no text and no encoding: the count at any prefix (`counts_at`), the longest prefix within a number of
tokens (`longest_within`), and how much of an ordered table a budget of tokens pays for (`within_budget`). A text may have
fewer tokens than a prefix of it, so the longest prefix is looked for from the end.

Cases: a null text is counted as the empty one (0 tokens); characters that the vocabulary lacks count as the bytes of
their UTF-8; very long texts and runs are counted whole; a null limit or place gives null; repeated rows are counted each;
in a budget's order ties are told apart by what the caller orders by; an empty table gives an empty result; extra columns
pass through, those named like a result as `<name>_input`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Aside, mapped, portions, running
from .pieces import SPACE, Pieces, load

LIMIT = 4096
#: Characters of a run up to which its counts are cached; entries of each of the two generations of runs, and of pairs of pieces whose compatibility is.
SHORT, CACHED_RUNS, CACHED_PAIRS = 64, 250_000, 400_000


class Prefixes:
    """Counts of prefixes by a model; the caches are those of one worker."""

    def __init__(self, model: Pieces) -> None:
        self.model = model
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.piece = {i: p for p, i in model.id.items()}
        self.none = max(self.piece) + 1  # stands before the first piece, and for a character that the vocabulary lacks
        self.piece[self.none] = ""
        self.follows: dict[int, bool] = {}
        # Letters from which no piece goes on to a mark: a word of them and the mark behind it are runs of their own.
        bound = {c for p in model.id for c in re.findall(rf"([^\W\d_])[^\w{SPACE}]", p)}
        letter = rf"[^\W\d_{re.escape(''.join(sorted(bound)))}]"
        self.runs = re.compile(rf"{SPACE}*{letter}+(?=[^\w{SPACE}{model.breaks}])|{model.runs.pattern}") if model.by_runs else model.runs
        self.automaton = ahocorasick.Automaton()
        for p, i in model.id.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()

    def may_follow(self, before: int, piece: int) -> bool:
        """Whether a piece may follow another one (or `none`). A character that the vocabulary lacks merges with nothing."""
        key = before * (self.none + 1) + piece
        found = self.follows.get(key)
        if found is None:
            if len(self.follows) >= CACHED_PAIRS:
                self.follows.clear()
            x, y = self.piece[before], self.piece[piece]
            found = self.follows[key] = self.model.merged(x + y) == ([x, y] if x else [y])
        return found

    def of_run(self, run: str) -> bytes:
        """The differences between the counts of a run's neighbouring prefixes."""
        none, wide, known = self.none, self.none + 1, self.follows.get
        last, count, done, steps = [none], [0], 0, bytearray()

        def lacking(end: int) -> None:
            """The characters up to `end` that no piece ends with."""
            for c in run[done:end]:
                n = len(c.encode()) if self.model.byte_id else 1
                last.append(none)
                count.append(count[-1] + n)
                steps.append(n)

        for at, (size, piece) in self.automaton.iter(run):  # at each place the longest piece that ends there comes first
            if at < done:
                continue
            if at > done:
                lacking(at)
                done = at
            before = last[at + 1 - size]
            ok = known(before * wide + piece)
            if self.may_follow(before, piece) if ok is None else ok:
                n = count[at + 1 - size] + 1
                steps.append((n - count[at]) & 255)
                last.append(piece)
                count.append(n)
                done = at + 1
        lacking(len(run))
        return bytes(steps)

    def steps(self, text: str) -> bytes:
        """For each character the difference that it makes to the count of tokens."""
        if not text:
            return b""
        cache, older, out = self.cache, self.older, []
        for run in self.runs.findall(SPACE + text.replace(" ", SPACE)):
            got = cache.get(run)
            if got is None:
                got = older.get(run) or self.of_run(run)
                if len(run) <= SHORT:
                    if len(cache) >= CACHED_RUNS:
                        self.older, self.cache = older, cache = cache, {}
                    cache[run] = got
            out.append(got)
        joined = np.frombuffer(b"".join(out), dtype=np.int8).copy()
        joined[1] += joined[0]  # the mark before the text has no character of its own
        return joined[1:].tobytes()


_MADE: dict[str | None, Prefixes] = {}


def prefixes(docs: DataFrame, path: str | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `docs` (all where None), with `n_bytes`, `n_tokens` and `steps`, the counts of all prefixes."""
    kept = docs.select(*(docs.columns if keep is None else keep))
    names = Aside(kept)
    rows = docs.select(*kept.columns, F.coalesce(F.col(text), F.lit(""))).toDF(*names.rows.columns, "body")
    results = {"n_bytes": T.LongType(), "n_tokens": T.LongType(), "steps": T.BinaryType()}
    schema = T.StructType([*names.rows.schema.fields, *[T.StructField(c, t) for c, t in results.items()]])
    width = len(kept.columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _MADE.setdefault(path, Prefixes(load(path)))
        for batch in batches:
            for start, texts in portions(batch.column(width)):
                steps = [made.steps(t) for t in texts]
                n = [int(np.frombuffer(s, dtype=np.int8).sum(dtype=np.int64)) for s in steps]
                size = [len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([*batch.slice(start, len(texts)).columns[:width], pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(steps, pa.binary())], schema.names)

    return names.back(mapped(rows, work, schema), list(results))


def _answered(rows: DataFrame, asked: object, name: str, answer: object, steps: str) -> DataFrame:
    """`rows` with a column `name` that `answer` gives for counts and what is asked of them."""
    names = Aside(rows)
    quoted = ["`" + c.replace("`", "``") + "`" for c in rows.columns]
    given = rows.select(*quoted, F.col(steps), asked.cast("long")).toDF(*names.rows.columns, "steps", "asked")
    schema = T.StructType([*names.rows.schema.fields, T.StructField("answer", T.LongType())])
    width = len(rows.columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if s is None or q is None else answer(np.frombuffer(s.as_buffer() or b"", dtype=np.int8), q) for s, q in zip(batch.column(width), batch.column(width + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(out, pa.int64())], schema.names)

    return names.back(mapped(given, work, schema).withColumnRenamed("answer", name), [name])


def _at(steps: np.ndarray, chars: int) -> int:
    return int(steps[: max(0, chars)].sum(dtype=np.int64))


def _within(steps: np.ndarray, limit: int) -> int | None:
    if limit < 0:
        return None
    counts = np.cumsum(steps, dtype=np.int64)
    if not len(counts) or counts[-1] <= limit:
        return len(counts)
    fits = np.flatnonzero(counts <= limit)
    return int(fits[-1]) + 1 if len(fits) else 0


def counts_at(rows: DataFrame, chars: object, name: str = "tokens_at", steps: str = "steps") -> DataFrame:
    """`rows` of `prefixes` with the count of tokens of each text's first `chars` characters (a column)."""
    return _answered(rows, chars, name, _at, steps)


def longest_within(rows: DataFrame, limit: object, name: str = "chars_within", steps: str = "steps") -> DataFrame:
    """`rows` of `prefixes` with the most characters whose prefix has at most `limit` tokens (a column; null below 0)."""
    return _answered(rows, limit, name, _within, steps)


def within_budget(rows: DataFrame, budget: int, order: list[str], steps: str = "steps") -> DataFrame:
    """`rows` of `prefixes` with `chars_paid`: how much of each text `budget` tokens pay for, spent in the order `order`.

    Texts are taken whole while the budget lasts; of the one at which it ends the longest prefix that what is left pays
    for; later ones get 0. `order` should tell rows apart. The sums come from ranges of the order.
    """
    names = Aside(rows)
    slim = running(names.rows, [], [names(c) for c in order], F.col(names("n_tokens")), "spent")
    left = F.greatest(F.lit(budget) - F.col("spent"), F.lit(0))
    whole = F.col(names("n_tokens")) <= left
    paid = longest_within(slim.withColumn("left", F.when(~whole & (left > 0), left)), F.col("left"), "part", names(steps))
    chars = F.when(F.col(names("n_tokens")) <= F.greatest(F.lit(budget) - F.col("spent"), F.lit(0)), F.octet_length(names(steps))).otherwise(F.coalesce("part", F.lit(0)))
    return names.back(paid.withColumn("chars_paid", chars.cast("long")), ["chars_paid"])
