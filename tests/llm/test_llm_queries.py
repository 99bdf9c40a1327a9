"""Each query over whole small tables, against SQL or brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from conftest import DATA, same_rows

import corpus_pipeline
from assetloom.llm import pii, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
Q = queries.queries()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, duck, name):
    same_rows(Q[name](spark, DATA), duck, queries.ORACLE[name])


def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


def classes(sets, threshold):
    """Links and smallest member of the component of each key, by counting shared elements."""
    holders, shared, root = defaultdict(list), Counter(), {k: k for k in sets}
    for k, s in sets.items():
        for x in s:
            holders[x].append(k)
    for ks in holders.values():
        shared.update((a, b) for i, a in enumerate(ks) for b in ks[i + 1 :])

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for (a, b), n in shared.items():
        if n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: (links[k], find(k)) for k in sets}


def test_jaccard_join_equals_brute_force(spark):
    sets = {}
    for k, t in documents(spark).items():
        w = WORD.findall(t or "")
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    wanted = classes(sets, 0.8)
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in Q["op2_ngram_jaccard"](spark, DATA).collect()}
    assert got == wanted and any(n for n, _ in wanted.values())


def test_line_dedup_equals_brute_force(spark):
    docs, first = documents(spark), {}
    for k in sorted(docs):
        for i, line in enumerate((docs[k] or "").split("\n")):
            if norm := line.strip(" \t\n\v\f\r").lower():
                first.setdefault(norm, (k, i))
    sets = {first[n]: {n[i : i + 8] for i in range(max(1, len(n) - 7))} for n in first}
    stays = {n: classes_[1] for n, classes_ in ((n, c) for c_ in [classes(sets, 0.8)] for n, c in ((n, c_[first[n]]) for n in first))}
    for r in Q["op1_line_dedup"](spark, DATA).collect():
        gone, n = [], 0
        for i, line in enumerate((docs[r["doc_id"]] or "").split("\n")):
            if norm := line.strip(" \t\n\v\f\r").lower():
                n += 1
                if stays[norm] != (r["doc_id"], i):
                    gone.append((i, *stays[norm]))
        assert (r["n_lines"], [tuple(x) for x in r["removed"]]) == (n, gone)


def test_encoding_equals_the_library(spark):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = documents(spark)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in Q["op4_sentencepiece"](spark, DATA).collect():
        ids = sp.encode(docs[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))


def test_base_spans_equal_the_patterns(spark):
    docs = documents(spark)
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for r in Q["op7_pii"](spark, DATA).collect():
        spans = []
        for kind, p in patterns.items():
            for m in re.finditer(p, docs[r["doc_id"]] or ""):
                digits = re.sub(r"[^0-9]", "", m.group())
                ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
                if ok:
                    spans.append(f"{kind}:{m.start()}:{m.end()}")
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r["spans"].split(",")) | {""}


def accuracy(rows, truth, score):
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    return sum((r[score] >= 0.5) == bool(truth[r["doc_id"]]) for r in held) / len(held)


@pytest.mark.parametrize(("name", "label", "least"), [("op9_toxicity", "toxic", 0.85), ("op8_quality_classifier", "quality", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    sf = DATA.replace("sf0.001", "sf0.01")
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = Q[name](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert accuracy(rows, truth, "score") >= least


def test_mix_meets_targets(spark):
    rows = Q["op10_mixing"](spark, DATA.replace("sf0.001", "sf0.01")).toPandas()
    per = rows.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum"), largest=("size", "max"))
    assert ((per["target"] - per["taken"]).abs() <= 3 * per["largest"]).all()
    assert (rows["taken"] <= 2 * rows["size"]).all()


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 0 and {"doc_id", "ids", "n_tokens"} <= set(out.columns)


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Five stages over a small corpus with copies, shared lines, toxic rows, nulls and several sources, row by row."""
    import public_tokenizers
    import sentencepiece
    from pyspark.sql import functions as F

    from assetloom.llm import toxicity

    dice = random.Random(8)
    line = lambda n: " ".join("".join(dice.choice("abcdefghijklmno") for _ in range(dice.randint(2, 8))) for _ in range(n))
    shared, long = [line(9) for _ in range(4)], line(60)
    texts = [None, "", " \n ", *["\n".join([line(dice.randint(4, 14)) for _ in range(3)]) for _ in range(24)]]
    texts += [f"{line(6)}\n{dice.choice(shared)}\n{line(7)}" for _ in range(12)] + [f"{line(5)} you idiot {line(4)}" for _ in range(12)]
    words = long.split()
    for k in range(6):  # near copies of one line: some above, some below the threshold of either stage
        texts.append(" ".join([*words[: 60 - 2 * k], *line(k).split()]))
    texts += [texts[5], texts[30].upper(), f"{texts[5]} {line(1)}"]
    rows = [(k, t, "en", None if k % 11 == 0 else f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    marks = [(k, 1, int("idiot" in (t or ""))) for k, t in enumerate(texts)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    lexicon = toxicity.learn(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet")), ~toxicity.held_out(F.col("doc_id")))
    automaton, now = lexicon.automaton(), []
    for k, t, _, source, _ in rows:
        f = toxicity.folded(t or "")
        total, n = sum(toxicity.matched(f, automaton).values()), f.count(" ") - 1
        z = lexicon.coefficients[0] + lexicon.coefficients[1] * math.log1p(total) + lexicon.coefficients[2] * math.log1p(100 * total / (n + 20))
        if z < 0:
            now.append((k, t, source))
    assert 0 < len(now) < len(rows)

    first = {}
    for k, t, _ in now:
        for i, raw in enumerate((t or "").split("\n")):
            if norm := raw.strip(" \t\n\v\f\r").lower():
                first.setdefault(norm, (k, i))
    sets = {first[n]: {n[i : i + 8] for i in range(max(1, len(n) - 7))} for n in first}
    stays = {n: root for n in first for root in [classes(sets, 0.8)[first[n]][1]]}
    after = []
    for k, t, source in now:
        lines = (t or "").split("\n")
        norms = [x.strip(" \t\n\v\f\r").lower() for x in lines]
        left = [x for i, (x, n) in enumerate(zip(lines, norms, strict=True)) if not n or stays[n] == (k, i)]
        if len(left) == len(lines):
            after.append((k, t, source))
        elif any(x.strip(" \t\n\v\f\r") for x in left):
            after.append((k, "\n".join(left), source))
    assert len(after) < len(now)

    shingles = {}
    for k, t, _ in after:
        w = WORD.findall(t or "")
        shingles[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    found = classes(shingles, 0.8)
    unique = [x for x in after if found[x[0]][1] == x[0]]

    size = {k: len(WORD.findall(t or "")) for k, t, _ in unique}
    h = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16)
    sources = sorted({s for _, _, s in unique}, key=lambda s: (s is None, s or ""))
    per = {s: sum(size[k] for k, _, z in unique if z == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, open_, left = {}, set(sources), 1.5 * sum(per.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * per[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 2.0 * per[s] for s in full}
        left -= sum(2.0 * per[s] for s in full)
        open_ -= full
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    wanted = []
    for s in sources:
        e = min(2.0, target[s] / per[s]) if per[s] else 0.0
        u = h(f"mix-1:{int(s is None)}:{s or ''}") / 4294967296
        for r, (k, t, _) in enumerate(sorted((x for x in unique if x[2] == s), key=lambda x: (size[x[0]], h(str(x[0])), x[0]))):
            wanted += [(k, tuple(sp.encode(t or "")))] * (math.floor(e * (r + 1) + u) - math.floor(e * r + u))
    got = [(r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(wanted) and len(wanted) > 20
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).columns == docs.columns, name
