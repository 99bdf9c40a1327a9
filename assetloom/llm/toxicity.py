"""Operator 9: weighted lexicon for toxicity, learned from labels and matched by Aho-Corasick on folded text.

Folding lowers the text, maps homoglyphs and digit substitutions to plain letters, drops zero-width characters
and turns what separates words into one space. An entry is " stem" (words that begin so) or " word ". A word
gets the weight of its heaviest entry; words inside an exception phrase get none. The score is a logistic
function of the summed weight and of that weight normalised by length.

Learning reads labels of training rows only, on a bounded sample (`MAX_TOXIC`, `MAX_CLEAN` rows, taken by a
hash of the id, one text for each id); nothing else is bounded. Entries common in toxic and rare in clean documents are candidates, and a greedy cover keeps
those that explain toxic documents not yet explained, so that words which merely stand beside a toxic one in
copied texts stay out; entries nearly as common as those of the cover join it. Exceptions are two-word phrases around an entry that the sample shows mostly in clean
documents. Scoring reads every whole text of the table.

Cases: null and empty texts hold no word and get the lowest score; without toxic or clean training rows the
lexicon is empty and every score is the share of toxic training rows (0 without any); repeated label rows
count once, the larger label holding; repeated documents get a row each; an empty table gives an empty result; extra
columns pass through, those named like a result as `<name>_input`.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Aside, checkpointed, portions, small_batches, trimmed

#: Bounds of the labelled sample.
MAX_TOXIC, MAX_CLEAN = 3_000, 9_000
LEAST_DOCS, LEAST_RATIO, LEAST_STEM, MOST_STEM = 3, 20.0, 4, 7
#: Entries that a task counts before it hands the counts on.
COUNTED = 100_000
#: Entries in so large a share of the documents of the commonest one join the cover.
ENTRY_SHARE = 0.15

# Characters that look like Latin letters, and digits and signs that stand for them.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "3", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "һ": "h",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
}
_FOLD = {ord(a): LOOKALIKES.get(b, b) for a, b in LOOKALIKES.items()}
_FOLD |= {0xFF41 + k: chr(97 + k) for k in range(26)}  # full-width letters
_FOLD |= dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD])
_APART = re.compile(r"[\W_]+")


def folded(text: str) -> str:
    """The text's folded words with a space before, between and after them."""
    return f" {_APART.sub(' ', text.lower().translate(_FOLD)).strip()} "


@dataclass
class Lexicon:
    """Weights of entries, exception phrases and the coefficients of the score."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    coefficients: tuple[float, float, float] = (0.0, 0.0, 0.0)
    base: float = 0.0

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.weights:
            return None
        out = ahocorasick.Automaton()
        for e, w in self.weights.items():
            out.add_word(e, (len(e), w))
        for e in self.exceptions:
            out.add_word(e, (len(e), None))
        out.make_automaton()
        return out


def matched(text: str, automaton: ahocorasick.Automaton | None) -> dict[int, float]:
    """Weight by the place of each word that is hit, without those in exception phrases. `text` is folded."""
    hits: dict[int, float] = {}
    spans = []
    for end, (size, weight) in automaton.iter(text) if automaton else ():
        start = end + 1 - size
        if weight is None:
            spans.append((start, end))
        elif weight > hits.get(start, -math.inf):
            hits[start] = weight
    if spans and hits:
        starts, past = sorted(hits), 0  # a phrase that begins before the last one's end goes on from there
        for a, b in sorted(spans):
            k = max(past, bisect_left(starts, a))
            while k < len(starts) and starts[k] < b:
                del hits[starts[k]]
                k += 1
            past = k
    return hits


def _features(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(total), np.log1p(total), np.log1p(100 * total / (words + 20))], axis=1)


def _entries(text: str) -> set[str]:
    out: set[str] = set()
    for w in set(folded(text).split()):
        if len(w) >= 3 and not w.isdigit():
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in range(LEAST_STEM, min(MOST_STEM, len(w)) + 1))
    return out


def _sample(docs: DataFrame, labels: DataFrame, train: Column, max_toxic: int, max_clean: int) -> DataFrame:
    """At most so many training rows of each label with their texts, by a hash of the id."""
    one = labels.where(train & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    part = lambda y, n: one.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    ids = part(1, max_toxic).unionByName(part(0, max_clean))
    # Of bounded size by the two limits, so it may be broadcast; one text for each id bounds what comes of the join.
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return checkpointed(texts.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "y"))


def _counted(sample: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
    """Documents of the sample with each entry, counted in every partition first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter[str] = Counter()
        for b in batches:
            for t in b["text"]:
                found = _entries(t)
                n.update(found if wanted is None else found & wanted)
                if len(n) >= COUNTED:  # what has been counted so far is summed outside
                    yield _frame(n)
                    n.clear()
        yield _frame(n)

    return sample.mapInPandas(count, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))


def _frame(n: Counter[str]) -> pd.DataFrame:
    return pd.DataFrame({"entry": list(n), "n": list(n.values())}).astype({"entry": "object", "n": "int64"})


def learn(docs: DataFrame, labels: DataFrame, train: Column, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Lexicon:
    """The lexicon from `labels` rows for which `train` holds."""
    sample = _sample(docs, labels, train, max_toxic, max_clean)
    size = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)
    base = n_toxic / (n_toxic + n_clean) if n_toxic else 0.0
    if not n_toxic or not n_clean:
        return Lexicon(base=base)
    least = max(LEAST_DOCS, n_toxic // 500)
    often = _counted(sample.where("y = 1"), None).where(F.col("n") >= least)
    toxic = {r["entry"]: r["n"] for r in often.collect()}
    clean = {r["entry"]: r["n"] for r in _counted(sample.where("y = 0"), frozenset(toxic)).collect()}
    odds = lambda e: math.log((toxic[e] + 0.5) / (n_toxic + 1)) - math.log((clean.get(e, 0) + 0.5) / (n_clean + 1))
    pure = sorted((e for e in toxic if toxic[e] / n_toxic >= LEAST_RATIO * clean.get(e, 0) / n_clean and odds(e) > 1), key=lambda e: (-toxic[e] * odds(e), e))
    number = {e: k for k, e in enumerate(pure)}

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "has": [sorted(number[e] for e in _entries(t) if e in number) for t in b["text"]]})

    rows = [(r["y"], r["has"]) for r in sample.select("text", "y").mapInPandas(present, "y int, has array<int>").where(F.size("has") > 0).collect()]
    chosen = [pure[k] for k in _cover(rows, pure)]
    common = ENTRY_SHARE * max((toxic[e] for e in chosen), default=0)
    for e in sorted(pure, key=lambda e: (-toxic[e], -len(e), e)):  # words that stand beside others in every toxic document
        if toxic[e] >= max(common, 2 * LEAST_DOCS) and not any(e.startswith(c.rstrip()) or c.startswith(e.rstrip()) for c in chosen):
            chosen.append(e)
    weights = {e: odds(e) for e in chosen}
    exceptions = _exceptions(sample, weights)
    lexicon = Lexicon(weights, exceptions, base=base)

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = lexicon.automaton()
        for b in batches:
            yield pd.DataFrame([(y, sum(matched(f, a).values()), f.count(" ") - 1) for y, f in ((y, folded(t)) for y, t in zip(b["y"], b["text"], strict=True))], columns=["y", "total", "words"])

    x = sample.select("text", "y").mapInPandas(totals, "y int, total double, words long").toPandas()
    lexicon.coefficients = _logistic(_features(x["total"].to_numpy(), x["words"].to_numpy(dtype=float)), x["y"].to_numpy(dtype=float))
    return lexicon


def _cover(rows: Iterable[tuple[int, list[int]]], names: list[str]) -> list[int]:
    """Greedy: the entry that explains most toxic rows not yet explained, less three times the clean rows it adds; of equals the longest."""
    where: dict[int, list[set[int]]] = {}
    for i, (y, has) in enumerate(rows):
        for k in has:
            where.setdefault(k, [set(), set()])[y].add(i)
    chosen: list[int] = []
    while where:
        best = max(where, key=lambda k: (len(where[k][1]) - 3 * len(where[k][0]), not names[k].endswith(" "), len(names[k]), names[k]))
        clean, toxic = where.pop(best)
        if len(toxic) - 3 * len(clean) < 2:
            break
        chosen.append(best)
        for k in list(where):
            where[k] = [where[k][0] - clean, where[k][1] - toxic]
            if not where[k][1]:
                del where[k]
    return chosen


def _exceptions(sample: DataFrame, weights: dict[str, float]) -> tuple[str, ...]:
    """Two-word phrases around an entry that stand in clean documents at least three times, and there as often as in toxic ones."""
    lexicon = Lexicon(weights)

    def phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, n = lexicon.automaton(), Counter()
        for b in batches:
            for y, t in zip(b["y"], b["text"], strict=True):
                f = folded(t)
                for at in matched(f, a):
                    end = f.index(" ", at + 1)
                    n[f[f.rindex(" ", 0, at) : end + 1] if at else "", y] += 1
                    n[f[at : f.index(" ", end + 1) + 1] if end + 1 < len(f) else "", y] += 1
        yield pd.DataFrame([(p, y, c) for (p, y), c in n.items() if p], columns=["phrase", "y", "n"]).astype({"phrase": "object", "y": "int32", "n": "int64"})

    if not weights:
        return ()
    both = sample.select("text", "y").mapInPandas(phrases, "phrase string, y int, n long").groupBy("phrase").agg(*[F.sum(F.when(F.col("y") == v, F.col("n")).otherwise(0)).alias(c) for v, c in ((0, "clean"), (1, "toxic"))])
    return tuple(r["phrase"] for r in both.where("clean >= 3 AND clean >= toxic").orderBy(F.desc("clean"), "phrase").collect())


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    """Newton steps on the penalised likelihood; the intercept is not penalised."""
    w, pen = np.zeros(x.shape[1]), np.diag([1e-6, ridge, ridge])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + pen, x.T @ (y - p) - pen @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _totals(batches: Iterator[pa.Array], lexicon: Lexicon) -> Iterator[pa.Array]:
    a = lexicon.automaton()
    for batch in batches:
        totals, words = [], []
        for _, texts in portions(batch):
            for f in map(folded, texts):
                totals.append(float(sum(matched(f, a).values())))
                words.append(f.count(" ") - 1)
        yield pa.StructArray.from_arrays([pa.array(totals, pa.float64()), pa.array(words, pa.int32())], ["total", "words"])


RESULTS = ["toxic_total", "toxic_words", "toxic_score"]


def _scored(names: Aside, lexicon: Lexicon, text: str) -> DataFrame:
    if not lexicon.weights:
        return names.rows.withColumns(dict(zip(RESULTS, (F.lit(0.0), F.lit(0), F.lit(float(lexicon.base))), strict=True)))
    small_batches(names.rows.sparkSession)

    @F.arrow_udf("struct<total:double,words:int>")
    def totals(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return trimmed(_totals(batches, lexicon))

    out = names.rows.withColumn("toxic", totals(F.coalesce(F.col(names(text)), F.lit(""))))
    out = out.withColumns({"toxic_total": F.col("toxic.total"), "toxic_words": F.col("toxic.words")})
    c, total, words = lexicon.coefficients, F.col("toxic_total"), F.col("toxic_words")
    z = F.lit(c[0]) + F.lit(c[1]) * F.log1p(total) + F.lit(c[2]) * F.log1p(100 * total / (words + 20))
    return out.withColumn("toxic_score", 1 / (1 + F.exp(-z)))


def scored(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """`docs` with `toxic_total` (summed weight), `toxic_words` (words seen) and `toxic_score` (0 to 1)."""
    names = Aside(docs)
    return names.back(_scored(names, lexicon, text), RESULTS)


def accepted(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """The rows of `docs` that the lexicon doesn't reject."""
    names = Aside(docs)
    return names.back(_scored(names, lexicon, text).where(rejected(F.col("toxic_score")) == 0))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def rejected(score: Column) -> Column:
    return (score >= 0.5).cast("int")
