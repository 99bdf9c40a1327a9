"""Operator 6: embedding near-duplicates by dual traversal of cover trees.

Vectors of one label are compared by cosine; on the unit sphere a cosine of t is a chord of sqrt(2 - 2t), so
links are the pairs within that radius of a metric. A cover tree holds nested levels of centres: the root covers all
within 2, the largest chord, and the radii halve from level to level; a centre of a level is one of the level below.
A node pair whose centres are further apart than the radius plus both covering radii holds no link and is dropped, else
it is opened into the pairs of its children.

The upper levels are shared by the whole cluster: a tree over a bounded sample (`SAMPLE` vectors) is cut at the lowest
level that has no more nodes than a label needs, one for about `CELL` vectors. Every vector goes to the nearest of these
nodes, the nodes' covering radii are taken over all vectors that they got, and dual traversal of the upper levels tells
which pairs of cells are left. The lower levels are local: a cell is cut into blocks of `SPREAD` vectors, so that a
label or cell of any size spreads over tasks, and for each pair of blocks left a task builds trees over parts of `BLOCK`
vectors once and traverses each two of them together. Pairs that reach the leaves are verified in double precision. The
sample decides where cells lie, never which pairs are found.

How much the bounds prune depends on the vectors: where most are nearly orthogonal, as random ones of many dimensions
are, no centre covers anything but copies, and nearly all pairs of centres are measured, by products of matrices.

Cases: a vector that is null, zero, or holds a null or non-finite component, and one without a label, links
with nothing; vectors of other lengths are never linked; components of any size are scaled first, so that no norm
overflows; equal vectors of a label are one item with copies; repeated vec_ids are separate rows of the same name; an
empty table gives an empty result; extra columns are dropped, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import neardup
from .common import checkpointed, mapped, spread
from .components import components

COSINE, SAMPLE, CELL, SPREAD, BLOCK = 0.98, 4096, 2000, 8192, 2048
#: The radii of the levels, from the finest; the root's, 2, covers whatever there is.
RADII = tuple(2.0 ** -k for k in range(4, -1, -1))


def unit(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, dtype=np.float64)
    v = v / np.abs(v).max(axis=-1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=-1, keepdims=True))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chords between unit vectors."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


class CoverTree:
    """Levels of (centres, parent of each centre, covering radius of each centre), the points first and the root last."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        n = len(points)
        nets, parents = [np.arange(n)], []
        least = self._closest()
        for r in RADII:
            if r >= least and len(nets[-1]) > 1:  # below, no point covers another
                own, up = self._net(nets[-1], r)
                if len(own) < len(nets[-1]):
                    nets.append(own)
                    parents.append(up)
        nets.append(nets[-1][:1])  # the root
        parents.append(np.zeros(len(nets[-2]), dtype=np.int64))
        self.nets, self.parents = nets, parents
        #: Over all points below a centre.
        self.radii, leaf = [np.zeros(n)], np.arange(n)
        for level, up in enumerate(parents):
            leaf = up[leaf]
            d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (points * points[nets[level + 1][leaf]]).sum(axis=1)))
            out = np.zeros(len(nets[level + 1]))
            np.maximum.at(out, leaf, d)
            self.radii.append(out + 1e-9)

    def _closest(self) -> float:
        """The smallest distance of two points."""
        least = 2.0
        for at in range(0, len(self.points), 512):
            d = distances(self.points[at : at + 512], self.points)
            d[np.arange(len(d)), at + np.arange(len(d))] = 2.0
            least = min(least, float(d.min()))
        return least

    def _net(self, ids: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
        """A greedy net: each point is covered by an earlier centre within r, or becomes one."""
        x = self.points[ids]
        centres: list[int] = []
        up = np.full(len(ids), -1, dtype=np.int64)
        left = np.arange(len(ids))
        while len(left):
            head = left[:128]
            close = distances(x[head], x[head]) <= r
            fresh: list[int] = []
            covered = np.zeros(len(head), dtype=bool)
            for k in range(len(head)):
                if not covered[k]:
                    fresh.append(k)
                    covered |= close[k]
            base = len(centres)
            centres += head[fresh].tolist()
            up[head[fresh]] = base + np.arange(len(fresh))
            left = left[up[left] < 0]
            d = distances(x[left], x[head[fresh]])
            near = d.argmin(axis=1)
            inside = d[np.arange(len(left)), near] <= r
            up[left[inside]] = base + near[inside]
            left = left[~inside]
        return ids[np.array(centres)], up

    def above(self, level: int, radii: np.ndarray) -> CoverTree:
        """The levels from `level` up, whose nodes there cover whatever lies within `radii` of them."""
        out = object.__new__(CoverTree)
        out.points, out.nets, out.parents = self.points, self.nets[level:], self.parents[level:]
        out.radii = [radii]
        for k, up in enumerate(out.parents):
            d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (self.points[out.nets[k]] * self.points[out.nets[k + 1][up]]).sum(axis=1)))
            wide = np.zeros(len(out.nets[k + 1]))
            np.maximum.at(wide, up, d + out.radii[k])
            out.radii.append(wide + 1e-9)
        return out


def near_pairs(a: CoverTree, b: CoverTree, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Dual traversal: all (i, j) of lowest nodes that may hold points within the radius of each other.

    Both trees are opened level by level. The node pairs of a level are a matrix of what is still open; only rows
    and columns with an open pair are measured, as a product of matrices, or pair by pair where few are open.
    """
    la, lb = len(a.nets) - 1, len(b.nets) - 1
    p, q = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)  # nodes with an open pair
    still = np.ones((1, 1), dtype=bool)
    while True:
        ca, cb = a.points[a.nets[la][p]], b.points[b.nets[lb][q]]
        bound = radius + 1e-7 + a.radii[la][p][:, None] + b.radii[lb][q][None, :]
        if still.mean() > 0.02:
            still &= distances(ca, cb) <= bound
        else:
            x, y = np.nonzero(still)
            far = np.concatenate([np.zeros(0, dtype=bool), *[np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.einsum("ij,ij->i", ca[x[k : k + 8192]], cb[y[k : k + 8192]]))) > bound[x[k : k + 8192], y[k : k + 8192]] for k in range(0, len(x), 8192)]])
            still[x[far], y[far]] = False
        rows, columns = still.any(axis=1), still.any(axis=0)
        p, q, still = p[rows], q[columns], still[rows][:, columns]
        if not len(p) or (la == 0 and lb == 0):
            x, y = np.nonzero(still)
            return p[x], q[y]
        at, ids = _below(a, la, p)
        bt, jds = _below(b, lb, q)
        p, q, still = ids, jds, still[at][:, bt]
        la, lb = max(0, la - 1), max(0, lb - 1)


def _below(tree: CoverTree, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of nodes: the place of each one's parent among them, and its own number a level down."""
    if level == 0:
        return np.arange(len(nodes)), nodes
    place = np.full(len(tree.nets[level]), -1, dtype=np.int64)
    place[nodes] = np.arange(len(nodes))
    parent = place[tree.parents[level - 1]]
    ids = np.flatnonzero(parent >= 0)
    return parent[ids], ids


def _valid(v: F.Column) -> F.Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0)


def _tops(items: DataFrame, n: int, sample: int, cell: int) -> dict[tuple[object, int], tuple[CoverTree, int]]:
    """For labels of the sample that are to have several cells: a tree over it, and the level whose nodes the cells are."""
    rows = items.orderBy(F.xxhash64("item"), "item").limit(sample).select("label", "vector").collect()
    held: dict[tuple[object, int], list] = {}
    for r in rows:
        held.setdefault((r["label"], len(r["vector"])), []).append(r["vector"])
    out = {}
    for key, vs in held.items():
        want = math.ceil(n * len(vs) / len(rows) / cell)
        if want > 1:
            tree = CoverTree(unit(np.array(vs)))
            level = next(k for k, net in enumerate(tree.nets) if len(net) <= want)
            if len(tree.nets[level]) > 1:
                out[key] = (tree, level)
    return out


def links(items: DataFrame, label_type: str, cosine: float = COSINE, sample: int = SAMPLE, cell: int = CELL, block: int = BLOCK, wide: int = SPREAD) -> DataFrame:
    """Edges and link counts (as `neardup.verified`) of items (item, copies, label, vector)."""
    radius = math.sqrt(2 - 2 * cosine)
    tops = _tops(items, items.count(), sample, cell)
    pivots = {key: tree.points[tree.nets[level]] for key, (tree, level) in tops.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, vectors = batch.column(2).to_pylist(), batch.column(3)
            ends, values = vectors.offsets.to_numpy(), vectors.values.to_numpy()
            width = np.diff(ends)
            where: dict = {}
            for k, key in enumerate(zip(labels, width.tolist(), strict=True)):
                where.setdefault(key, []).append(k)
            chosen, far = np.zeros(len(labels), dtype=np.int32), np.full(len(labels), 2.0)
            for key, ks in where.items():
                if key in pivots:
                    d = distances(unit(np.stack([values[ends[k] : ends[k + 1]] for k in ks])), pivots[key])
                    best = d.argmin(axis=1)
                    chosen[ks], far[ks] = best, d[np.arange(len(ks)), best]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(width, pa.int32()), pa.array(chosen), pa.array(far)], ["item", "copies", "label", "vector", "width", "cell", "far"])

    placed = checkpointed(mapped(items.select("item", "copies", "label", "vector"), assign, f"item long, copies long, label {label_type}, vector array<double>, width int, cell int, far double"))
    cells = checkpointed(placed.groupBy("label", "width", "cell").agg(F.max("far").alias("r"), F.count("*").alias("n")))
    # Cells of labels with several of them are bounded in number by the sample; other labels have the single cell 0.
    radii: dict[tuple[object, int], np.ndarray] = {key: np.full(len(x), -4.0) for key, x in pivots.items()}  # what has no vector is near nothing
    several = cells.join(F.broadcast(items.sparkSession.createDataFrame([*pivots], f"label {label_type}, width int")), ["label", "width"], "left_semi").collect() if pivots else []
    for r in several:
        radii[r["label"], r["width"]][r["cell"]] = r["r"] + 1e-9
    left: list[tuple] = []
    for key, (tree, level) in tops.items():
        upper = tree.above(level, radii[key])
        left += [(*key, i, j) for i, j in zip(*(x.tolist() for x in near_pairs(upper, upper, radius)), strict=True)]
    near = items.sparkSession.createDataFrame(left, f"label {label_type}, width int, cell int, other int")
    sizes = cells.select("label", "width", F.col("cell").alias("other"), F.ceil(F.col("n") / wide).cast("int").alias("other_k"))
    pairs = cells.join(F.broadcast(near), ["label", "width", "cell"], "left").withColumn("other", F.coalesce("other", "cell")).join(sizes, ["label", "width", "other"])
    pairs = checkpointed(pairs.select("label", "width", "cell", "other", F.ceil(F.col("n") / wide).cast("int").alias("k"), "other_k"))
    rows = placed.join(spread(pairs), ["label", "width", "cell"])
    mine = F.pmod(F.xxhash64("item"), F.col("k")).cast("int")
    rows = rows.withColumn("mine", F.struct(F.col("cell").alias("c"), mine.alias("b"))).withColumn("b2", F.explode(F.sequence(F.lit(0), F.col("other_k") - 1)))
    rows = rows.withColumn("theirs", F.struct(F.col("other").alias("c"), F.col("b2").alias("b")))
    i, j = F.least("mine", "theirs"), F.greatest("mine", "theirs")
    key = ("label", "width", "ic", "ib", "jc", "jb")
    flat = rows.select("label", "width", i["c"].alias("ic"), i["b"].alias("ib"), j["c"].alias("jc"), j["b"].alias("jb"), (F.col("mine") <= F.col("theirs")).alias("left"), "item", "copies", "vector")
    flat = flat.repartition(*key).sortWithinPartitions(*key)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in neardup.whole_groups(batches, key):
            starts = [*np.flatnonzero(neardup._changes(part, key)).tolist(), part.num_rows]
            for at, end in zip(starts, starts[1:], strict=False):
                yield from _compare(part.slice(at, end - at), cosine, radius, block)

    return mapped(flat, work, "a long, b long, links long")


def _compare(group: pa.RecordBatch, cosine: float, radius: float, block: int) -> Iterator[pa.RecordBatch]:
    """Links of one pair of blocks: trees over parts of either, and each two parts together."""
    ids, copies, side = group.column("item").to_numpy(), group.column("copies").to_numpy(), group.column("left").to_numpy(zero_copy_only=False)
    same = group.column("ic")[0] == group.column("jc")[0] and group.column("ib")[0] == group.column("jb")[0]
    vectors = group.column("vector")
    ends = vectors.offsets.to_numpy()
    x = unit(vectors.values.to_numpy()[ends[0] : ends[-1]].reshape(len(ids), -1))
    parts = [rows[at : at + block] for rows in ((np.arange(len(ids)),) if same else (np.flatnonzero(side), np.flatnonzero(~side))) for at in range(0, len(rows), block)]
    trees = [CoverTree(x[rows]) for rows in parts]
    found = neardup.Found(ids, copies)
    for i, a in enumerate(trees):
        for j in range(i, len(trees)):
            if not same and side[parts[i][0]] == side[parts[j][0]]:
                continue
            b = trees[j]
            p, q = near_pairs(a, b, radius)
            for k in range(0, len(p), 8192):  # verified in double precision
                u, v = p[k : k + 8192], q[k : k + 8192]
                ok = np.einsum("ij,ij->i", a.points[u], b.points[v]) >= cosine
                if i == j:
                    ok &= u < v
                found.pairs(parts[i][u[ok]], parts[j][v[ok]])
    yield from found.rows()


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, sample: int = SAMPLE, cell: int = CELL, block: int = BLOCK, wide: int = SPREAD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.withColumn("item", F.when(F.col("label").isNotNull() & _valid(F.col("vector")), F.xxhash64("label", "vector")))
    full = rows.where("item IS NOT NULL")
    items = checkpointed(full.groupBy("item").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector")))
    found = checkpointed(links(items, dict(rows.dtypes)["label"], cosine, sample, cell, block, wide))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("item")).agg(F.sum("links").alias("links"))
    roots = components(found.where("b IS NOT NULL")).select(F.col("node").alias("item"), "root")
    rooted = checkpointed(items.select("item", "first_id").join(roots, "item"))
    best = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    better = rooted.join(spread(best), "root").select("item", "component_id")
    per = items.select("item", "first_id", "copies").join(counts, "item", "left").join(better, "item", "left")
    per = checkpointed(per.select(F.col("item").alias("key"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first_id").alias("component_id")))
    out = rows.select("vec_id", "item").join(spread(per), F.col("item") == F.col("key"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
