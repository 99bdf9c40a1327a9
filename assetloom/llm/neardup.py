"""Candidate buckets and exact verification for near-duplicate items, without ever emitting the pairs of a bucket.

An item stands for all rows of equal content (a 64-bit hash of it), with its number of copies. Items that share
a band key form a bucket. A bucket is cut into blocks, bounded in rows and in bytes, and every pair of blocks is one
group of rows, so that a bucket of any size spreads over tasks. Each pair of a group is compared, in two ways that give
the same: pair by pair in groups of a few rows, and by products of matrices in larger ones. What leaves a group is
linear in its items: edges that join what verified links connect, and each item's number of links. A pair in several
buckets is verified in the first of them only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import minhash
from .common import checkpointed, mapped, spread

#: Rows and bytes of a block. Rows of a group that is compared pair by pair. Items whose bands are looked at together.
BLOCK, BLOCK_BYTES, FEW_ROWS, TOGETHER = 512, 16 << 20, 16, 16_384
#: Items of a bucket beyond which all of them are weighed.
WEIGHED = 32
#: Bits a wanted key and the most bitmaps of a filter; places over which the rows of a band are dealt.
SLOTS, MOST_BITMAPS, PLACES = 16, 8192, 1024

BANDED = "item long, band long, place long"


class Bands:
    """Gathers items with their band keys, and gives rows (item, band, place) for some thousand items at a time.

    A band that several of them hold is known to be shared: their rows get places of their own, spread over the cluster,
    and only one of them also stands at the band's own place, to meet items from elsewhere. So however many items
    hold a band, few of its rows come together.
    """

    def __init__(self) -> None:
        self.items: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.n = 0

    def add(self, items: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.items.append(np.repeat(items, keys.shape[1]))
        self.keys.append(keys.ravel())
        self.n += len(items)
        if self.n >= TOGETHER:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        item, band = np.concatenate(self.items), np.concatenate(self.keys)
        self.items, self.keys, self.n = [], [], 0
        order = np.argsort(band)
        item, band = item[order], band[order]
        first = np.ones(len(band), dtype=bool)
        first[1:] = band[1:] != band[:-1]
        run = np.cumsum(first) - 1
        several = np.bincount(run)[run] > 1
        mine, shared = item[several], band[several]
        place = minhash.mixed(shared.view(np.uint64) ^ (mine.view(np.uint64) % np.uint64(PLACES) + np.uint64(1))).view(np.int64)
        columns = [np.concatenate([item[first], mine]), np.concatenate([band[first], shared]), np.concatenate([band[first], place])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["item", "band", "place"])


def buckets(banded: DataFrame) -> DataFrame:
    """(item, bucket, n) from rows of `Bands`: bands of two items or more, once where several hold the same items.

    Rows may repeat; only bands that are left after the first step are made distinct.
    """
    own = W.partitionBy("place")
    several = banded.withColumns({"lo": F.min("item").over(own), "hi": F.max("item").over(own)}).where("place <> band OR lo <> hi")
    shared = checkpointed(several.select("item", "band").distinct())
    h = F.xxhash64("item")
    held = shared.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s"))
    kept = held.where("n > 1").groupBy("n", "x", "s").agg(F.min("band").alias("band")).select("band", "n")
    return checkpointed(shared.join(kept, "band").select("item", F.col("band").alias("bucket"), "n"))


def maybe_wanted(rows: DataFrame, wanted: DataFrame, key: str, flag: str) -> DataFrame:
    """`rows` with a boolean `flag`: false only where `key` isn't among `wanted` (a distinct column of that name).

    A Bloom filter of one hash in bitmaps of 4 KB: `SLOTS` bits for each wanted key, until there are `MOST_BITMAPS`
    of them (32 MB, the bound of what is broadcast). With more keys more rows pass, never fewer than must.
    """
    k = min(MOST_BITMAPS, wanted.count() * SLOTS // 32768 + 1)
    h = F.xxhash64(F.lit("wanted"), F.col(key))
    at, bit = F.pmod(h, F.lit(k)), F.pmod(F.shiftrightunsigned(h, 24), F.lit(32768))
    maps = wanted.select(at.alias(f"{flag}_at"), bit.alias("bit")).groupBy(f"{flag}_at").agg(F.bitmap_construct_agg("bit").alias("bits"))
    # 32 bits an element, byte by byte as the bitmap has them, so that a row is tested by one access to an array.
    byte = lambda w, j: F.conv(F.hex(F.substring("bits", w * 4 + j + 1, F.lit(1))), 16, 10).cast("long")
    word = lambda w: (byte(w, 0) + byte(w, 1) * 256 + byte(w, 2) * 65536 + byte(w, 3) * 16777216).cast("decimal(20,0)")
    signed = lambda x: F.when(x >= 2147483648, x - 4294967296).otherwise(x).cast("int")
    words = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda w: signed(word(w)))
    maps = maps.select(f"{flag}_at", words.alias(f"{flag}_words"))
    rows = rows.withColumns({f"{flag}_at": at, f"{flag}_bit": bit.cast("int")}).join(F.broadcast(maps), f"{flag}_at", "left")
    word = F.get(f"{flag}_words", F.call_function("shiftright", F.col(f"{flag}_bit"), F.lit(5)))
    hit = F.getbit(word, F.col(f"{flag}_bit") % 32) == 1
    return rows.withColumn(flag, F.coalesce(hit, F.lit(False))).drop(f"{flag}_at", f"{flag}_bit", f"{flag}_words")


def _blocks(members: DataFrame, payload: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """Members with payload, once for each pair of blocks (i <= j) that their block is in."""
    owned = members.groupBy("item").agg(F.sort_array(F.collect_set("bucket")).alias("own"))  # at most one a band
    sizes = payload.select("item", F.length("shingles").alias("size"))
    # Of buckets of a few items only the large ones are weighed: the rest of such a bucket is a block at most.
    some = members.where(f"n > {WEIGHED}").join(sizes, "item").unionByName(members.where(f"n <= {WEIGHED}").join(sizes.where(f"size > {block_bytes // WEIGHED}"), "item"))
    heavy = some.groupBy("bucket").agg(F.sum("size").alias("total"))
    rest = F.when((F.col("n") <= WEIGHED) & F.col("total").isNotNull(), F.lit(block_bytes)).otherwise(F.lit(0))
    k = F.greatest(F.ceil(F.col("n") / block), F.ceil((F.coalesce("total", F.lit(0)) + rest) / block_bytes)).cast("int")
    cut = members.join(spread(heavy), "bucket", "left").select("item", "bucket", k.alias("k"))
    rows = cut.join(payload.join(owned, "item"), "item")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("item"), F.col("k")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return rows.select("bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "item", "copies", "own", "shingles", *[c for c in payload.columns if c == "signature"])


def verified(members: DataFrame, payload: DataFrame, threshold: float, sets: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], prune: Callable | None = None, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Edges (a, b) that join what links connect in each group, and rows (item, null, links) with linked copies.

    payload: (item, copies, shingles[, signature]). `sets` makes of a column of shingles the sorted distinct 64-bit
    hashes of each row, flat, and their numbers. `prune` takes a matrix of signatures and pairs of rows of it, and tells
    which of those pairs may reach the threshold.
    """
    key = ("bucket", "i", "j")
    rows = _blocks(members, payload, block, block_bytes).repartition(*key).sortWithinPartitions(*key)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, key):
            found = Found(part.column("item").to_numpy(), part.column("copies").to_numpy())
            _compare(part, key, threshold, sets, prune, found)
            yield from found.rows()

    return mapped(rows, work, "a long, b long, links long")


class Found:
    """Links between the rows of a batch: who is connected, and how many copies each item is linked to."""

    def __init__(self, item: np.ndarray, copies: np.ndarray) -> None:
        self.item, self.copies = item, copies
        self.links = np.zeros(len(item), dtype=np.int64)
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Connect items a and b."""
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)

    def pairs(self, x: np.ndarray, y: np.ndarray) -> None:
        """Links between rows x and y."""
        np.add.at(self.links, x, self.copies[y])
        np.add.at(self.links, y, self.copies[x])
        # The smallest row that each one is connected to, so that few edges are left to be joined one by one.
        rows, place = np.unique(np.concatenate([x, y]), return_inverse=True)
        a, b = place[: len(x)], place[len(x) :]
        least = np.arange(len(rows))
        while len(a):
            low = np.minimum(least[a], least[b])
            np.minimum.at(least, a, low)
            np.minimum.at(least, b, low)
            least = least[least]
            a, b = a[least[a] != least[b]], b[least[a] != least[b]]
        tied = np.flatnonzero(least != np.arange(len(rows)))
        self.join(self.item[rows[least[tied]]], self.item[rows[tied]])

    def matrix(self, at: int, linked: np.ndarray) -> None:
        """Links among the rows from `at`, as a symmetric matrix."""
        n = len(linked)
        self.links[at : at + n] += linked @ self.copies[at : at + n]
        done = np.zeros(n, dtype=bool)
        for start in np.flatnonzero(linked.any(axis=1)).tolist():
            if done[start]:
                continue
            done[start] = True
            front, reached = [start], [start]
            while front:
                fresh = np.flatnonzero(linked[front.pop()] & ~done)
                done[fresh] = True
                reached += fresh.tolist()
                front += fresh.tolist()
            ids = self.item[at + np.array(reached)]
            self.join(np.full(len(ids) - 1, ids[0]), ids[1:])

    def rows(self) -> Iterator[pa.RecordBatch]:
        some = np.flatnonzero(self.links)
        if not len(some):
            return
        below = [x for x in self.up if self.root(x) != x]
        a = np.concatenate([np.array([self.root(x) for x in below], dtype=np.int64), self.item[some]])
        b = pa.concat_arrays([pa.array(below, pa.int64()), pa.nulls(len(some), pa.int64())])
        links = pa.concat_arrays([pa.nulls(len(below), pa.int64()), pa.array(self.links[some])])
        yield pa.RecordBatch.from_arrays([pa.array(a), b, links], ["a", "b", "links"])


def whole_groups(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Batches that hold all rows of each of their groups of equal key, of batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = int(np.flatnonzero(_changes(batch, key))[-1])
        begins = bool(held) and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in key)
        if cut or begins:
            if begins:
                yield pa.concat_batches(held)
                held = []
            if cut:
                yield pa.concat_batches([*held, batch.slice(0, cut)])
                held = []
            batch = batch.slice(cut)
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


def _changes(part: pa.RecordBatch, key: tuple[str, ...]) -> np.ndarray:
    """Which rows begin a group."""
    first = np.zeros(part.num_rows, dtype=bool)
    first[0] = True
    for c in key:
        x = part.column(c).to_numpy(zero_copy_only=False)
        first[1:] |= x[1:] != x[:-1]
    return first


def _compare(part: pa.RecordBatch, key: tuple[str, ...], threshold: float, sets: Callable, prune: Callable | None, found: Found) -> None:
    starts = np.flatnonzero(_changes(part, key))
    sizes = np.diff(np.append(starts, part.num_rows))
    bucket, mine = part.column("bucket").to_numpy(), part.column("mine").to_numpy()
    cross = part.column("i").to_numpy() != part.column("j").to_numpy()
    own = part.column("own")
    ends, bands = own.offsets.to_numpy(), own.values.to_numpy()
    signature = None
    if prune is not None:
        packed = part.column("signature")
        signature = _words(packed, np.uint32).reshape(part.num_rows, -1)
    # Pairs of all small groups, size by size.
    xs, ys = [], []
    for n in range(2, FEW_ROWS + 1):
        at = starts[sizes == n]
        if len(at):
            a, b = np.triu_indices(n, 1)
            xs.append((at[:, None] + a).ravel())
            ys.append((at[:, None] + b).ravel())
    if xs:
        x, y = np.concatenate(xs), np.concatenate(ys)
        keep = ~(cross[x] & (mine[x] == mine[y]))
        x, y = x[keep], y[keep]
        keep = _first_shared(ends, bands, x, y) == bucket[x]
        x, y = x[keep], y[keep]
        if prune is not None and len(x):
            keep = prune(signature, x, y)
            x, y = x[keep], y[keep]
        if len(x):
            some, place = np.unique(np.concatenate([x, y]), return_inverse=True)
            held = _split(*sets(part.column("shingles").take(pa.array(some))))
            near = np.fromiter((_near(held[i], held[j], threshold) for i, j in zip(place[: len(x)].tolist(), place[len(x) :].tolist(), strict=True)), dtype=bool, count=len(x))
            found.pairs(x[near], y[near])
    for at, n in zip(starts[sizes > FEW_ROWS].tolist(), sizes[sizes > FEW_ROWS].tolist(), strict=True):
        pairs = np.triu(np.ones((n, n), dtype=bool), 1)
        if cross[at]:
            side = mine[at : at + n]
            pairs &= side[:, None] != side[None, :]
        # A pair that shares an earlier bucket is verified there.
        lo, hi = ends[at], ends[at + n]
        row, band = np.repeat(np.arange(n), np.diff(ends[at : at + n + 1])), bands[lo:hi]
        before = band < bucket[at]
        row, band = row[before], band[before]
        order = np.argsort(band, kind="stable")
        row, band = row[order], band[order]
        edges = np.flatnonzero(np.diff(band)) + 1
        for ks in np.split(row, edges):
            if len(ks) > 1:
                pairs[np.ix_(ks, ks)] = False
        if prune is not None:
            x, y = np.nonzero(pairs)
            keep = prune(signature[at : at + n], x, y)
            pairs[x[~keep], y[~keep]] = False
        some = np.flatnonzero(pairs.any(axis=0) | pairs.any(axis=1))
        if not len(some):
            continue
        held = _split(*sets(part.column("shingles").take(pa.array(at + some))))
        size = np.array([len(s) for s in held], dtype=np.float64)
        both = _shared(held).astype(np.float64)
        linked = np.zeros((n, n), dtype=bool)
        linked[np.ix_(some, some)] = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
        linked &= pairs
        if linked.any():
            found.matrix(at, linked | linked.T)


def _words(packed: pa.Array, kind: type) -> np.ndarray:
    """A column of binary values as one flat array."""
    offsets = np.frombuffer(packed.buffers()[1], dtype=np.int32)[packed.offset : packed.offset + len(packed) + 1]
    data = np.frombuffer(packed.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(data.tobytes(), dtype=kind)


def stored_sets(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sets that are stored as bytes."""
    return _words(packed, np.uint64), np.diff(np.frombuffer(packed.buffers()[1], dtype=np.int32)[packed.offset : packed.offset + len(packed) + 1]) // 8


def _split(values: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    ends = np.cumsum(sizes).tolist()
    return [values[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _near(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets reaches the threshold."""
    n, m = len(a), len(b)
    if min(n, m) < threshold * max(n, m) - 1e-9:
        return False
    c = np.concatenate((a, b))
    c.sort()
    both = int(np.count_nonzero(c[1:] == c[:-1]))
    return both >= threshold * (n + m - both) - 1e-9


def _first_shared(ends: np.ndarray, bands: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest bucket that rows x and y have in common, for each pair; their own ones are sorted."""
    size = np.diff(ends)
    width = int(size.max(initial=1))
    own = np.zeros((len(size), width), dtype=np.int64)
    has = np.arange(width) < size[:, None]
    own[has] = bands[ends[0] : ends[-1]]
    out = np.zeros(len(x), dtype=np.int64)
    for lo in range(0, len(x), 1 << 15):
        a, b = x[lo : lo + (1 << 15)], y[lo : lo + (1 << 15)]
        open_ = np.arange(len(a))
        for w in range(width):
            hit = has[a[open_], w] & ((own[a[open_], w, None] == own[b[open_]]) & has[b[open_]]).any(axis=1)
            out[lo + open_[hit]] = own[a[open_[hit]], w]
            open_ = open_[~hit]
            if not len(open_):
                break
    return out


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, from a matrix over the values that two sets or more hold."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat)
    flat, owner = flat[order], owner[order]
    same = flat[1:] == flat[:-1]
    keep = np.zeros(len(flat), dtype=bool)
    keep[1:] |= same
    keep[:-1] |= same
    flat, owner = flat[keep], owner[keep]
    first = np.ones(len(flat), dtype=bool)
    first[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(first) - 1
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, width, 2048):  # a bounded slice of the matrix
        lo, hi = np.searchsorted(column, [start, start + 2048])
        m = np.zeros((len(sets), min(2048, width - start)), dtype=np.float32)
        m[owner[lo:hi], column[lo:hi] - start] = 1
        out += m @ m.T
    return out
