"""Operator 13: phrase collocations mined level by level (Apriori), scored at their weakest cut.

Pass k reads all texts and counts phrases of k words. A phrase is emitted only where both its overlapping parts of k - 1
words may be frequent: their hashes are looked up in a sieve (a Bloom filter) made of the table of level k - 1 and
broadcast. A frequent phrase has frequent parts only, so the sieve never loses one, and what passes it by chance is
dropped by the exact counts. The sieve has 16 bits for each frequent phrase and at most `SIEVE_BITS` (64 MB), the bound
of what is broadcast; beyond some 30 million frequent phrases a level more passes than must, which costs shuffle and
changes nothing else. Each stretch of text (`words.py`) counts its own phrases, by exact places in its vocabulary, before
any row leaves Python; sums are Spark's, by language and phrase.

Cuts are scored from the tables of levels alone: each candidate with each cut meets the counts of its two parts by
equi-joins that Spark splits where a part is hot. Phrases that a longer candidate nearly always surrounds go. A language's
best phrases come from a window with a group limit, so that no task sorts more of a language than the limit from each.

Cases: a null text is empty, a null language is `und`; phrases never span breaks or texts; ties of scores are ordered by
count and then by bytes; texts and words of any length are read in parts; products of counts are decimals of 38 digits;
repeated rows count as often as they come; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import mapped, stored
from .minhash import mixed
from .words import Stretch, kinds, stretches

LEAST, LONGEST, COVER, SCALE, BEST = 30, 4, 80, 2_000_000, 2000
SIEVE_BITS = 1 << 29
_KIND = kinds(b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d")
_PAGE = 32_768  # bits of a bitmap that Spark aggregates


def _hashes(strings: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, strings.cast(pa.binary()).to_pylist()), dtype=np.uint64, count=len(strings))


def _extended(gram: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases that are one word longer."""
    return mixed(gram * np.uint64(0x9E3779B97F4A7C15) + word)


class Sieve:
    """Whether a phrase's hash may be among those of a level: two bits of a power of two of them."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.mask = bits, np.uint64(8 * len(bits) - 1)

    @staticmethod
    def slots(h: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        return h & mask, (h >> np.uint64(32)) & mask

    def passes(self, h: np.ndarray) -> np.ndarray:
        a, b = (((self.bits[s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8)) & 1).astype(bool) for s in self.slots(h, self.mask))
        return a & b


def _sieve(level: DataFrame) -> Sieve:
    """The sieve of a table (lang, phrase); its bitmaps are joined by pages of 4 KB, of which the driver gets a bounded number."""
    n, size = level.count(), _PAGE
    while size < 16 * n and size < SIEVE_BITS:
        size *= 2
    mask = np.uint64(size - 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pc.split_pattern(batch.column(1), " ")
            parts = _hashes(words.flatten())
            ends = words.offsets.to_numpy() - words.offsets[0].as_py()
            gram, sizes = mixed(_hashes(batch.column(0))), np.diff(ends)
            for k in range(int(sizes.max(initial=0))):
                here = sizes > k
                gram[here] = _extended(gram[here], parts[ends[:-1][here] + k])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(Sieve.slots(gram, mask)).astype(np.int64))], ["slot"])

    slots = mapped(level.select("lang", "phrase"), work, "slot long")
    pages = slots.groupBy((F.col("slot") / _PAGE).cast("long").alias("page")).agg(F.bitmap_construct_agg(F.col("slot") % _PAGE).alias("bits")).collect()
    bits = np.zeros(size // 8, dtype=np.uint8)
    for r in pages:
        bits[r["page"] * _PAGE // 8 : (r["page"] + 1) * _PAGE // 8] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return Sieve(bits)


def _counted(s: Stretch, k: int, lang: np.ndarray, langs: pa.Array, sieve: Sieve | None) -> pa.RecordBatch:
    """Phrases of k words of a stretch that end in new words, with their numbers; lang: each row's place in `langs`."""
    spoken = lang[s.row]
    at = np.arange(max(0, s.again - k + 1), len(s.word) - k + 1)
    at = at[s.piece[at] == s.piece[at + k - 1]]
    if sieve is not None and len(at):
        vocabulary = _hashes(s.vocabulary)[s.word]
        tongue = mixed(_hashes(langs))[spoken]

        def part(begin: np.ndarray) -> np.ndarray:
            gram = tongue[begin]
            for j in range(k - 1):
                gram = _extended(gram, vocabulary[begin + j])
            return gram

        at = at[sieve.passes(part(at))]
        at = at[sieve.passes(part(at + 1))]
    # Exact numbers of phrases; where one more word wouldn't fit into 63 bits, those so far are numbered anew.
    size, key, most = len(s.vocabulary), spoken[at].astype(np.int64), len(langs)
    for j in range(k):
        if most > (1 << 62) // max(size, 1):
            values, key = np.unique(key, return_inverse=True)
            most = len(values)
        key, most = key * size + s.word[at + j], most * size
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    words = [s.vocabulary.take(pa.array(s.word[at[first] + j])) for j in range(k)]
    phrase = pc.binary_join_element_wise(*words, " ") if k > 1 else words[0]
    return pa.RecordBatch.from_arrays([langs.take(pa.array(spoken[at[first]])), phrase, pa.array(n)], ["lang", "phrase", "n"])


def _pass(rows: DataFrame, k: int, sieve: Sieve | None) -> DataFrame:
    """(lang, phrase, f) of all phrases of k words that pass the sieve; of one word also a row with null for all words."""
    shared = rows.sparkSession.sparkContext.broadcast(sieve)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            lang, langs = coded.indices.to_numpy(), coded.dictionary
            for s in stretches(batch.column(1), _KIND, lead=k - 1):
                yield _counted(s, k, lang, langs, shared.value)
                if k == 1:
                    n = np.bincount(lang[s.row], minlength=len(langs))
                    yield pa.RecordBatch.from_arrays([langs, pa.nulls(len(langs), pa.string()), pa.array(n)], ["lang", "phrase", "n"])

    return mapped(rows, work, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))


def levels(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(level, lang, phrase, f) of all phrases of up to `longest` words that occur `least` times or more in a language.

    Level 0 has one row for each language, with a null phrase and the number of all its words.
    """
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found, sieve = [], None
    for k in range(1, longest + 1):
        level = _pass(rows, k, sieve).where((F.col("f") >= least) | F.col("phrase").isNull())
        level = stored(level, f"phrases-{k}").select(F.when(F.col("phrase").isNull(), 0).otherwise(k).alias("level"), "lang", "phrase", "f")
        found.append(level)
        if k < longest:
            sieve = _sieve(level.where("level > 0"))
    out = found[0]
    for level in found[1:]:
        out = out.unionByName(level)
    return out


def _words(phrase: str, first: object, n: object) -> str:
    return f"array_join(slice(split({phrase}, ' ', -1), {first}, {n}), ' ')"


def collocations(counts: DataFrame, cover: int = COVER, scale: int = SCALE) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates of `levels` that no longer one nearly always surrounds."""
    candidates = counts.where("level > 1")
    # Each candidate's parts of two words and more, and the most frequent phrase that holds each.
    spans = F.expr("flatten(transform(sequence(2, greatest(level - 1, 2)), m -> transform(sequence(1, level - m + 1), i -> struct(i, m))))")
    inside = candidates.where("level > 2").select("lang", "phrase", "f", F.explode(spans).alias("at"))
    inside = inside.select("lang", F.expr(_words("phrase", "at.i", "at.m")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    free = candidates.join(inside, ["lang", "phrase"], "left").where(F.expr(f"around IS NULL OR 100 * CAST(around AS DECIMAL(20,0)) < {int(cover)} * CAST(f AS DECIMAL(20,0))"))
    cuts = free.select("lang", "phrase", F.col("f").alias("a"), "level", F.explode(F.expr("sequence(1, level - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr(_words("phrase", 1, "k")).alias("left"), F.expr(_words("phrase", "k + 1", "level - k")).alias("right"))
    parts = counts.where("level > 0").select("lang", "phrase", "f")
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    score = F.expr(f"CAST({int(scale)} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0)) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    worst = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    words = counts.where("level = 0").select("lang", F.col("f").alias("n"))
    return worst.join(words, "lang").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def best(scored: DataFrame, limit: int = BEST) -> DataFrame:
    """Each language's first `limit` rows with their `rank`."""
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)


def mined(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, cover: int = COVER, limit: int = BEST) -> DataFrame:
    """The best collocations of each language."""
    return best(collocations(levels(docs, text, lang, least, longest), cover), limit)
