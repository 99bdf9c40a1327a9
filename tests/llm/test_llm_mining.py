"""Operators 11 to 13: odd inputs, long texts in parts, and brute force; the field on long texts."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from assetloom.llm import importance, jaccard_join, line_dedup, mixing, phrases, pieces, pii, prefix_counts, queries, words

LONG = "alpha beta gamma delta " * 30_000
TEXTS = [None, "", " \n\t", "One two three four five", "One two three four five", "ÄÖ ß, 中文 中文! x" * 9, LONG, "y" * 30_000, "a b c d e f g h i j k l m n o p q r s t u v w x y z"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k if k != 4 else None, t, None if k % 3 == 0 else "en", "own", "k", 1, "p", 9) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[3], rows[3]], "doc_id long, text string, lang string, score string, key string, rank long, steps string, row long")


def test_stretches_tell_the_same_words_in_parts():
    dice = random.Random(2)
    texts = ["".join(dice.choice("ab Ä\t.,\n中") for _ in range(dice.choice([0, 3, 40, 900]))) for _ in range(40)] + ["w" * 700 + " x y", "a b " * 300]
    kind = words.kinds(b" \t", b".,\n")
    for most in (16, 64, 1 << 20):
        got, pairs = defaultdict(list), []
        for s in words.stretches(pa.array(texts), kind, lead=1, most=most):
            said = s.vocabulary.to_pylist()
            for k in range(s.again, len(s.word)):
                got[int(s.row[k])].append(said[s.word[k]])
                if k and s.piece[k] == s.piece[k - 1]:
                    pairs.append((int(s.row[k]), said[s.word[k - 1]], said[s.word[k]]))
        wanted, couples = defaultdict(list), []
        for r, t in enumerate(texts):
            for piece in re.split("[.,\n]", t):
                w = [x for x in re.split("[ \t]", piece.replace("A", "a")) if x]
                wanted[r] += w
                couples += [(r, a, b) for a, b in zip(w, w[1:], strict=False)]
        assert {r: w for r, w in got.items() if w} == {r: w for r, w in wanted.items() if w} and sorted(pairs) == sorted(couples)
    assert not list(words.stretches(pa.array([], pa.string()), kind, 1))


def resampled(rows, target, share=25, least=20, buckets=10_000):
    """The contract, text by text."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        return len(w), [zlib.crc32(x.encode()) % buckets for x in [*w, *map(" ".join, zip(w, w[1:], strict=False))]]

    source, aim = Counter(), Counter()
    for counter, texts in ((source, [t for _, t in rows]), (aim, target)):
        for t in texts:
            counter.update(features(t)[1])
    s_all, t_all = sum(source.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (s_all + buckets) / ((source[b] + 1) * (t_all + buckets))))
    out = []
    for k, (i, t) in enumerate(rows):
        n, f = features(t)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n, k])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: share * len(able) // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in out]


def test_importance_equals_brute_force(spark, docs):
    target = ["one two three", None, "alpha gamma zz", "Ä ß"]
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resampled(docs, aim, share=60)
    assert {"score_input", "rank_input", "key", "row", "steps"} <= set(got.columns)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    found = sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=key)
    assert found == sorted(resampled(rows, target, share=60), key=key)
    assert importance.resampled(docs.limit(0), aim).count() == 0 and importance.resampled(docs, aim.limit(0)).count() == len(rows)


def test_joined_checksums():
    dice = random.Random(1)
    for _ in range(200):
        a, b = dice.randbytes(dice.randint(0, 9)), dice.randbytes(dice.randint(0, importance._TABLED))
        got = importance._joined(np.array([zlib.crc32(a)], dtype=np.uint32), np.array([zlib.crc32(b)], dtype=np.uint32), np.array([len(b)]))
        assert int(got[0]) == zlib.crc32(a + b)


def test_prefix_counts_equal_the_library():
    import sentencepiece
    from public_tokenizers import path

    sp, dice = sentencepiece.SentencePieceProcessor(model_file=path(pieces.MODEL)), random.Random(3)
    made = prefix_counts.Prefixes(pieces.load())
    texts = ["".join(dice.choice("abcdehilmnorst ABC.,'\n\t  ▁éüß中文🙂\x00<s>0123456789ﬁ́²") for _ in range(dice.randint(0, 40))) for _ in range(150)] + ["<unk></s><0x41>", "internationalization, e.g. U.S.A..."]
    for t in texts:
        counts = np.cumsum(np.frombuffer(made.steps(t), dtype=np.int8), dtype=np.int64).tolist()
        assert counts == [len(sp.encode(t[:k])) for k in range(1, len(t) + 1)], t


def test_token_counts_of_the_query(spark):
    import sentencepiece
    from public_tokenizers import path

    sp = sentencepiece.SentencePieceProcessor(model_file=path(pieces.MODEL))
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in queries.queries()["op12_token_counts"](spark, DATA).collect():
        t = texts[r["doc_id"]]
        n = len(sp.encode(t))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 4096)
        cut = r["chars_within"]
        assert cut == len(t) if n <= 4096 else len(sp.encode(t[:cut])) <= 4096 < min(len(sp.encode(t[:k])) for k in range(cut + 1, min(len(t), cut + 6) + 1))


def test_answers_without_encoding(spark, docs):
    rows = prefix_counts.prefixes(docs)
    assert "steps_input" in rows.columns and rows.where("doc_id = 0").first()["n_tokens"] == 0
    model = pieces.load()
    at = prefix_counts.counts_at(rows, F.lit(7)).where("text IS NOT NULL").select("text", "tokens_at").collect()
    assert all(r["tokens_at"] == len(model.encode(r["text"][:7])) for r in at)
    for r in prefix_counts.longest_within(rows, F.lit(10)).where("text IS NOT NULL").select("text", "chars_within").collect():
        t, k = r["text"], r["chars_within"]
        assert len(model.encode(t[:k])) <= 10 and (k == len(t) or len(t) > 1000 or all(len(model.encode(t[:j])) > 10 for j in range(k + 1, len(t) + 1)))
    assert prefix_counts.longest_within(rows, F.lit(None)).where("chars_within IS NOT NULL").count() == 0
    small = spark.createDataFrame([(k, "word " * 5) for k in range(6)], "doc_id long, text string")
    counted = prefix_counts.prefixes(small)
    n = counted.first()["n_tokens"]
    paid = {r["doc_id"]: r["chars_paid"] for r in prefix_counts.within_budget(counted, 2 * n + 3, ["doc_id"]).collect()}
    assert [paid[k] for k in (0, 1, 3, 4, 5)] == [25, 25, 0, 0, 0] and 0 < paid[2] < 25
    assert prefix_counts.prefixes(docs.limit(0)).count() == 0


def mined(rows, least, longest, cover, limit):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, total = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            total[lang or "und"] += len(w)
            f.update((lang or "und", w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    f = {k: n for k, n in f.items() if n >= least}
    around = Counter()
    for (lang, p), n in f.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                around[lang, p[i : i + m]] = max(around[lang, p[i : i + m]], n)
    out = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) > 1 and not ((lang, p) in around and 100 * around[lang, p] >= cover * a):
            score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, k, p.decode(), -a, left, right, total[lang], -s) for lang, found in out.items() for k, (s, a, p, left, right) in enumerate(sorted(found)[:limit], 1)}


def test_phrases_equal_brute_force(spark, docs):
    dice = random.Random(8)
    rows = [(dice.choice(["en", "de", None, "und"]), " ".join(dice.choice(["New York", "the", "a", "ünit", "x.y", "big", "dog;", "中 文", "b\tb"]) for _ in range(dice.randint(0, 60)))) for _ in range(60)]
    rows += [(r["lang"], r["text"]) for r in docs.select("lang", "text").collect()]
    df = spark.createDataFrame(rows, "lang string, text string")
    got = phrases.mined(df, least=5, limit=40).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    wanted = mined(rows, 5, 4, 80, 40)
    assert len(got) == len(wanted) and {tuple(r) for r in got} == wanted and len(wanted) > 60
    assert phrases.mined(df.limit(0)).count() == 0


def test_phrases_with_a_full_sieve_and_small_stretches(spark, monkeypatch):
    """A sieve that lets everything through, and texts in many parts, change nothing."""
    rows = [("en", "to be or not to be that is the question " * 30 + "x")] * 3 + [("de", "sein oder nicht sein " * 40)]
    df = spark.createDataFrame(rows, "lang string, text string")
    wanted = mined(rows, 30, 4, 80, 2000)
    assert {tuple(r) for r in phrases.mined(df).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()} == wanted
    sieve = phrases.Sieve(np.full(4096, 255, dtype=np.uint8))
    assert sieve.passes(np.arange(100, dtype=np.uint64)).all()
    kind = phrases._KIND
    for most in (40, 1 << 20):
        found = Counter()
        for s in words.stretches(pa.array([t for _, t in rows]), kind, lead=3, most=most):
            batch = phrases._counted(s, 4, np.zeros(len(rows), dtype=np.int64), pa.array(["en"]), sieve)
            found.update({p: n for p, n in zip(batch.column("phrase").to_pylist(), batch.column("n").to_pylist(), strict=True)} if batch.num_rows else {})
            assert batch.num_rows or len(s.word) - s.again < 4
        if most == 40:
            first = found
    assert found == first


def numbers(n, seed):
    dice, out, size = random.Random(seed), [], 0
    while size < n:
        x = dice.choice([f"{dice.randint(0, 10**6)}", f"{dice.randint(1, 28)}.{dice.randint(1, 12)}.{dice.randint(1900, 2030)}", f"{dice.random():.4f}", f"a{dice.randint(0, 9)} (at) b (dot) com", f"+{dice.randint(1, 9)} {dice.randint(100, 999)} {dice.randint(1000, 9999)}"])
        out.append(x)
        size += len(x) + 1
    return ",".join(out)


@pytest.fixture(scope="module")
def field():
    return pii.learn_from(["mail a.b@c.org now, 10.0.0.1", "call +1 (489) 555-8508 soon", "token: abcd1234EFGH next", "card 4111 1111 1111 1111 ok"] * 3)


def test_one_zone_of_any_length_takes_little_memory(field):
    text = numbers(60_000, 1)
    assert len(pii.zones(text)) == 1
    tracemalloc.start()
    found = pii.extra_spans(text, field, pii.base_spans(text))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 << 20 and len(found) > 100


def test_giving_out_early_changes_nothing(field, monkeypatch):
    text = numbers(8_000, 2)
    base, got = pii.base_spans(text), []
    for flush in (3, 64, 512, 1 << 40):
        monkeypatch.setattr(pii, "FLUSH", flush)
        got.append(pii.extra_spans(text, field, base))
    assert got[0] and all(x == got[0] for x in got)
    assert pii.extra_spans("9" * 200_000 + " " + "a1" * 100_000, field, []) == []


def test_rows_with_nulls_are_told_apart(spark):
    rows = spark.createDataFrame([("x", None), (None, "x"), (None, None)], "doc_id string, text string")
    got = {r["doc_id"]: r["n_lines"] for r in line_dedup.report(rows.where("doc_id IS NOT NULL OR text IS NOT NULL")).collect()}
    assert got == {"x": 0, None: 1}


def test_a_mix_depends_on_rows_alone(spark):
    """Rows of one id and size: what is drawn doesn't follow the layout."""
    rows = [(1, f"w{k} " * 3, "a") for k in range(40)] + [(2, "x " * 50, "b")] * 3
    random.Random(4).shuffle(rows)
    schema, drawn = "doc_id long, text string, source string", []
    for n in (1, 5):
        drawn.append(sorted(r["text"] for r in mixing.emitted(spark.createDataFrame(rows, schema).repartition(n)).collect()))
        rows.reverse()
    assert drawn[0] == drawn[1] and 0 < len(drawn[0])


def test_few_long_texts_are_cut_into_blocks(spark):
    """A bucket of a few items that are large together is compared in parts, and no link is lost."""
    from assetloom.llm import neardup

    dice = random.Random(6)
    said = [f"w{dice.randint(0, 10**6)}" for _ in range(3000)]
    docs = spark.createDataFrame([(k, " ".join([*said, f"own{k}"])) for k in range(6)], "doc_id long, text string")
    assert {r["n_links"] for r in jaccard_join.report(docs).collect()} == {5}
    members = spark.createDataFrame([(k, 7, 6) for k in range(6)], "item long, bucket long, n long")
    payload = spark.createDataFrame([(k, 1, bytearray(8000)) for k in range(6)], "item long, copies long, shingles binary")
    cut = neardup._blocks(members, payload, 512, 16_000).collect()
    assert max(sum(1 for r in cut if (r["i"], r["j"]) == at and r["mine"] == side) * 8000 for at in {(r["i"], r["j"]) for r in cut} for side in range(9)) < 48_000 and len(cut) > 6
