"""Operator 8: quality classifier by co-training.

Two views of a document are learned apart: its text content (character classes, word statistics) and its page
metadata (language, source, size, line layout). Both start from the labelled rows; in each round, either view
scores all unlabelled documents and labels the `A_ROUND` of which it is surest, in the classes' proportion, and hands
them to the other view. Documents of equal features count once there. Each view is then calibrated on labelled rows kept apart (Platt scaling), and the calibrated views
are combined by a logistic function fitted on the same rows.

Features are Spark expressions over each whole text; they are computed once, into a table of numbers in the shared
folder, from which the views score the unlabelled documents of every round and, at last, all documents. Only what the
views are fitted on comes to the driver, as numbers: `MAX_LABELLED` labelled rows (by a hash of the id), and the
`A_ROUND` pseudo-labels of each view and round.

Cases: a null or empty text has all-zero content features and is scored by them; a null language or source is
a value of its own; without labelled rows of both classes every score is the share of good rows (0.5 without
any row); repeated label rows count once, the larger label holding; of documents with one id the one of the smallest
features is learned from; repeated documents get a row each; an empty table gives an empty result; extra columns pass
through, those named like a result as `<name>_input`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, Aside, spread, stored

MAX_LABELLED, ROUNDS, SURE, A_ROUND, BUCKETS, SEED = 20_000, 5, 0.95, 1_000, 16, 11
CONTENT = ["c_symbols", "c_marks", "c_upper", "c_digits", "c_bars", "c_distinct", "c_word_length", "c_words", "c_stops"]
METADATA = ["m_chars", "m_lines", "m_line_length", "m_no_text"]
HASHED = ["m_lang", "m_source"]
FEATURES = [*CONTENT, *METADATA, *HASHED]


def features(docs: DataFrame, text: str = "text") -> tuple[Aside, DataFrame]:
    """`docs` under names aside, with the features of both views; hashed language and source are `m_lang` and `m_source`."""
    names = Aside(docs)
    body = F.col(names(text))
    t = F.coalesce(body, F.lit(""))
    kept = lambda regex: F.length(F.regexp_replace(t, regex, "")).cast("double")
    words = F.filter(F.split(t, f"[{WS}]+"), lambda w: w != "")
    counts = F.get(F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("double").alias("n"), F.size(F.array_distinct(w)).cast("double").alias("distinct"))), F.lit(0))
    out = names.rows.withColumns({"w": counts, "chars": kept(f"[{WS}]+")})
    n, chars = F.greatest(F.col("w.n"), F.lit(1.0)), F.greatest(F.col("chars"), F.lit(1.0))
    lines = (F.length(t) - F.length(F.translate(t, "\n", "")) + 1).cast("double")
    bucket = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(names(c)).cast("string"), F.lit("\x00none"))), F.lit(BUCKETS)).cast("double") if c in names else F.lit(0.0)
    return names, out.withColumns({
        "c_symbols": F.log1p(10 * kept("[^#*$%&<>]+") / n), "c_marks": F.log1p(10 * kept("[^!]+") / n), "c_upper": kept(r"[^\p{Lu}]+") / chars,
        "c_digits": kept("[^0-9]+") / chars, "c_bars": F.log1p(10 * kept("[^|]+") / n), "c_distinct": F.col("w.distinct") / n,
        "c_word_length": F.log1p(F.col("chars") / n), "c_words": F.log1p(F.col("w.n")), "c_stops": F.log1p(10 * kept("[^.]+") / n),
        "m_chars": F.log1p(F.length(t).cast("double")), "m_lines": F.log1p(lines), "m_line_length": F.log1p(F.length(t) / lines),
        "m_no_text": body.isNull().cast("double"), "m_lang": bucket("lang"), "m_source": bucket("source"),
    }).drop("w", "chars")


@dataclass
class View:
    """Standardised linear weights of one view, with its calibration."""

    names: list[str]
    hashed: list[str]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    calibration: tuple[float, float] = (0.0, 1.0)

    def matrix(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        x = (np.stack([rows[c] for c in self.names], axis=1) - self.mean) / self.scale
        hot = [np.eye(BUCKETS)[rows[c].astype(int)] for c in self.hashed]
        return np.concatenate([np.ones((len(x), 1)), x, *hot], axis=1)

    def logit(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        return self.matrix(rows) @ self.weights

    def column(self) -> Column:
        """The calibrated log-odds as a Spark expression."""
        z = F.lit(float(self.weights[0]))
        for k, c in enumerate(self.names):
            z = z + F.lit(float(self.weights[1 + k] / self.scale[k])) * (F.col(c) - F.lit(float(self.mean[k])))
        at = 1 + len(self.names)
        for c in self.hashed:
            z = z + F.element_at(F.array(*[F.lit(float(w)) for w in self.weights[at : at + BUCKETS]]), (F.col(c) + 1).cast("int"))
            at += BUCKETS
        return F.lit(self.calibration[0]) + F.lit(self.calibration[1]) * z


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps on the penalised likelihood; the first column is an intercept without penalty."""
    w, pen = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    pen[0, 0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + pen, x.T @ (y - p) - pen @ w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-7:
            break
    return w


@dataclass
class Model:
    views: tuple[View, View] | None
    combined: tuple[float, float, float]
    share: float


def _arrays(rows: DataFrame, columns: list[str]) -> dict[str, np.ndarray]:
    table = rows.select(*columns).toArrow()
    return {c: table.column(c).to_numpy().astype(float) for c in columns}


class Pool:
    """The unlabelled documents: (key, features), of any number; and what was taken from them for each view."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows
        self.given: list[dict[int, tuple[list[float], float]]] = [{}, {}]

    def hand_over(self, k: int, view: View, good: int, bad: int) -> None:
        """The rows of which view k is surest, and that the other one doesn't have, become labelled for the other one."""
        other = self.given[1 - k]
        p = (1 / (1 + F.exp(-view.column()))).alias("p")
        free = self.rows.select("key", *FEATURES, p)
        if other:  # of bounded number by rounds and rows a round
            free = free.join(F.broadcast(self.rows.sparkSession.createDataFrame([(x,) for x in other], "key long")), "key", "left_anti")
        top = free.where(F.col("p") >= SURE).orderBy(F.desc("p"), "key").limit(good).withColumn("y", F.lit(1.0))
        low = free.where(F.col("p") <= 1 - SURE).orderBy("p", "key").limit(bad).withColumn("y", F.lit(0.0))
        for r in top.unionByName(low).collect():
            other[r["key"]] = ([r[c] for c in FEATURES], r["y"])

    def labelled_for(self, k: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
        rows = [self.given[k][x] for x in sorted(self.given[k])]
        x = np.array([r[0] for r in rows], dtype=float).reshape(-1, len(FEATURES))
        return {c: x[:, i] for i, c in enumerate(FEATURES)}, np.array([r[1] for r in rows], dtype=float)


def cotrain(labelled: dict[str, np.ndarray], y: np.ndarray, pool: Pool | None = None, rounds: int = ROUNDS) -> Model:
    """The model from numeric rows and a pool; a third of the labelled rows is kept for calibration."""
    rng = np.random.default_rng(SEED)
    if len(np.unique(y)) < 2:
        return Model(None, (0.0, 0.0, 0.0), float(y.mean()) if len(y) else 0.5)
    apart = np.zeros(len(y), dtype=bool)
    for v in (0, 1):
        of = np.flatnonzero(y == v)
        apart[rng.permutation(of)[: len(of) // 3]] = True
    names = [(CONTENT, []), (METADATA, HASHED)]
    mean = lambda c: labelled[c].mean()
    views = tuple(View(n, h, np.array([mean(c) for c in n]), np.array([labelled[c].std() or 1.0 for c in n])) for n, h in names)
    base = {c: v[~apart] for c, v in labelled.items()}
    share = y.mean()
    for r in range(rounds + 1):
        for k, view in enumerate(views):
            more, theirs = pool.labelled_for(k) if pool else ({c: np.zeros(0) for c in FEATURES}, np.zeros(0))
            view.weights = logistic(np.concatenate([view.matrix(base), view.matrix(more)]), np.concatenate([y[~apart], theirs]))
        if r == rounds or pool is None:
            break
        for k, view in enumerate(views):
            pool.hand_over(k, view, int(A_ROUND * share), int(A_ROUND * (1 - share)))
    check = {c: v[apart] for c, v in labelled.items()}
    ones = np.ones(int(apart.sum()))
    for view in views:
        a, b = logistic(np.stack([ones, view.logit(check)], axis=1), y[apart], 0.1)
        view.calibration = (float(a), float(b))
    z = [view.calibration[0] + view.calibration[1] * view.logit(check) for view in views]
    return Model(views, tuple(float(v) for v in logistic(np.stack([ones, *z], axis=1), y[apart], 0.1)), float(share))


def measured(docs: DataFrame, text: str = "text") -> tuple[Aside, DataFrame]:
    """`docs` without the text under names aside, with all features, as a table: the texts are read once."""
    slim = Aside(docs.drop(text))
    names, rows = features(docs, text)
    kept = [names(c) for c in slim.columns]
    return slim, stored(rows.select(*[F.col(c).alias(slim(name)) for c, name in zip(kept, slim.columns, strict=True)], *FEATURES), "features")


def learn_from(rows: DataFrame, doc_id: str, labels: DataFrame, train: Column) -> Model:
    """The model from a table of features whose ids are in column `doc_id`."""
    one = labels.where(train & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("labelled_id")).agg(F.max("quality").alias("y"))
    ids = one.orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(MAX_LABELLED)  # of bounded size, so it may be broadcast
    some = rows.join(F.broadcast(ids), F.col(doc_id) == F.col("labelled_id"))
    some = some.groupBy("labelled_id").agg(F.min(F.struct(*FEATURES)).alias("f"), F.max("y").cast("double").alias("y")).orderBy("labelled_id")
    found = _arrays(some.select("f.*", "y"), [*FEATURES, "y"])
    y = found.pop("y")
    if len(np.unique(y)) < 2:
        return cotrain(found, y)
    known = labels.select(F.col("doc_id").alias("labelled_id")).distinct()
    rest = rows.join(spread(known), F.col(doc_id) == F.col("labelled_id"), "left_anti")
    pool = rest.withColumn("key", F.xxhash64(*FEATURES)).groupBy("key").agg(*[F.min(c).alias(c) for c in FEATURES])
    return cotrain(found, y, Pool(stored(pool, "pool")))


def learn(docs: DataFrame, labels: DataFrame, train: Column, text: str = "text", doc_id: str = "doc_id") -> Model:
    """The model from `labels` rows for which `train` holds and from all other documents."""
    names, rows = measured(docs, text)
    return learn_from(rows, names(doc_id), labels, train)


RESULTS = ["content_score", "metadata_score", "quality_score"]


def _scores(rows: DataFrame, model: Model) -> DataFrame:
    """Rows of features with the three scores."""
    if model.views is None:
        return rows.withColumns({c: F.lit(float(model.share)) for c in RESULTS})
    rows = rows.withColumns({"z0": model.views[0].column(), "z1": model.views[1].column()})
    a, b, c = (F.lit(x) for x in model.combined)
    squash = lambda z: 1 / (1 + F.exp(-z))
    return rows.withColumns({"content_score": squash(F.col("z0")), "metadata_score": squash(F.col("z1")), "quality_score": squash(a + b * F.col("z0") + c * F.col("z1"))})


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with `content_score`, `metadata_score` and the combined `quality_score`, all from 0 to 1."""
    names, rows = features(docs, text)
    return names.back(_scores(rows, model), RESULTS)


def learned_and_scored(docs: DataFrame, labels: DataFrame, train: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`docs` without the text, with the scores of a model learned from them; each text is read once."""
    names, rows = measured(docs, text)
    return names.back(_scores(rows, learn_from(rows, names(doc_id), labels, train)), RESULTS)
