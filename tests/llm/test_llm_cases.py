"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns, operator by operator."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetloom.llm import cotraining, cover_tree, jaccard_join, line_dedup, minhash, mixing, pieces, pii, quality_rules, quotes, toxicity
from assetloom.llm.common import running
from assetloom.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, item long, spans string, band long, key string, n_words string"
LONG = "word " * 60_000
TEXTS = [None, "", "  \n\t", "one two three four five six seven", "one two three four five six seven", "a\nb\na\n\na", LONG, "mail x@y.org, +1 (489) 555-8508 end", "idiot 1d10t", "x" * 20_000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, None if k % 3 == 0 else "en", None if k == 1 else f"s{k % 2}", None, 1, "x", 2, "k", "n") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[3]], SCHEMA)  # the last one repeats a row


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def test_quality_rules(docs, nothing):
    out = {r["doc_id"]: r for r in quality_rules.ledger(quality_rules.measured(docs.drop("n_words"))).collect()}
    assert [out[k]["n_words"] for k in range(4)] == [0, 0, 0, 7]
    assert (out[5]["n_dup_lines"], out[5]["n_repeat_words"]) == (2, 0) and out[6]["n_repeat_words"] == 60_000
    assert quality_rules.ablations(quality_rules.ledger(quality_rules.measured(nothing))).count() == 0


def test_stored_ledgers_under_new_policies(spark, docs, nothing):
    entries = quality_rules.ledger(quality_rules.measured(docs.drop("n_words")))
    policies = quality_rules.policy_table(spark, 1).unionByName(quality_rules.policy_table(spark, 2, {"v1": ("symbols",)}))
    out = quality_rules.verdicts(entries, policies).where("doc_id = 3 AND policy = 'v1'").collect()
    assert {r["policy_version"]: r["kept"] for r in out} == {1: False, 2: True}
    older = entries.withColumn("rule_set", F.lit(0))
    assert quality_rules.verdicts(older, policies).where("kept IS NOT NULL").count() == 0
    assert quality_rules.verdicts(nothing.drop("n_words").withColumns({"fail_bits": F.lit(0), "rule_set": F.lit(1)}), policies.limit(0)).count() == 0
    with pytest.raises(ValueError, match="unknown rule"):
        quality_rules.verdicts(entries, quality_rules.policy_table(spark, 1, {"x": ("none such",)}))


def test_running_sums(spark):
    rows = [(k % 3 if k % 7 else None, k // 2, k) for k in range(200)]
    df = spark.createDataFrame(rows, "g int, o int, v long")
    got = {(r["g"], r["v"]): r["s"] for r in running(df, ["g"], ["o", "v"], F.col("v"), "s").collect()}
    assert got == {(g, v): sum(w for h, p, w in rows if h == g and (p, w) < (o, v)) for g, o, v in rows}
    assert running(df.limit(0), [], ["v"], F.col("v"), "s").count() == 0


def test_mixing(docs, nothing):
    out = mixing.mix(docs, F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != ""))).collect()
    assert len(out) == 11 and all(r["mix_copies"] <= 2 for r in out)
    assert mixing.emitted(docs).columns == docs.columns and mixing.emitted(nothing).count() == 0


def test_hot_source_is_met(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("source"), F.lit(7).alias("n"))
    per = {r["source"]: r for r in mixing.mix(rows, F.col("n")).groupBy("source").agg(F.sum(F.col("mix_copies") * 7).alias("taken"), F.first("mix_target").alias("target")).collect()}
    assert all(abs(r["taken"] - r["target"]) <= 7 for r in per.values())


def test_pieces(docs, nothing):
    out = pieces.digests(pieces.encoded(docs)).collect()
    assert len(out) == 11 and all(r["decoded"] == (r["text"] or "") for r in out) and out[0]["n_tokens"] == 0
    assert pieces.encoded(nothing).count() == 0


def test_pieces_equal_the_library_on_odd_texts():
    import public_tokenizers
    import sentencepiece

    sp, own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL)), pieces.load()
    dice, parts = random.Random(3), [*"aab  ethrsion▁\n\t\x00é😀中.,'\"", "the", "    ", "aaaa", "<s>", "<0x41>"]
    for _ in range(3000):
        text = "".join(dice.choice(parts) for _ in range(dice.randint(0, 40)))
        assert own.encode(text) == sp.encode(text)
        ids = [dice.choice([dice.randrange(32000), dice.randrange(262)]) for _ in range(dice.randint(0, 9))]
        assert own.decode(ids) == sp.decode(ids)
    for text in ("a" * 30_000, " " * 5_000, "qzj" * 9_000):
        assert own.encode(text) == sp.encode(text)


def test_line_dedup(docs, nothing):
    out = {r["doc_id"]: r for r in line_dedup.report(docs.drop("item")).collect()}
    assert len(out) == 10 and out[0]["n_lines"] == 0 and [tuple(x) for x in out[5]["removed"]] == [(2, 5, 0), (4, 5, 0)]
    assert [tuple(x) for x in out[4]["removed"]] == [(0, 3, 0)]
    kept = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(docs).collect()}
    assert kept[5] == "a\nb\n" and kept[0] is None and 4 not in kept
    assert line_dedup.report(nothing).count() == 0 and line_dedup.deduplicated(nothing).columns == docs.columns


def test_line_dedup_finds_short_lines(spark):
    dice = random.Random(5)
    whole = lambda n: "".join(chr(dice.randrange(97, 123)) for _ in range(n))
    pairs = []
    for k in range(3000):
        n = 5 + k % 120  # shingles; of the copy a fifth fewer, for a similarity of 0.8 or little more
        line = whole(n + 7)
        pairs.append((line, line[: len(line) - n // 5]))
    rows = [(2 * k + j, line) for k, pair in enumerate(pairs) for j, line in enumerate(pair)]
    out = {r["doc_id"]: [tuple(x) for x in r["removed"]] for r in line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for lo, hi in ((5, 25), (25, 60), (60, 125)):
        found = [out[2 * k + 1] == [(0, 2 * k, 0)] for k in range(3000) if lo <= 5 + k % 120 < hi]
        assert sum(found) >= 0.99 * len(found), (lo, sum(found), len(found))


def test_line_dedup_of_repeated_rows(spark):
    rows = [(1, "some line here\nother words", "a"), (1, "some line here\nother words", "b"), (2, "SOME line here\nits own", "c"), (3, None, "d"), (3, None, "e"), (4, " \n", "f"), (4, " \n", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r["doc_id"]: (r["n_lines"], r["n_kept"], [tuple(x) for x in r["removed"]]) for r in line_dedup.report(df).collect()}
    assert out == {1: (2, 2, []), 2: (2, 1, [(0, 1, 0)]), 3: (0, 0, []), 4: (0, 0, [])}
    kept = line_dedup.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == [(1, rows[0][1]), (2, "its own"), (3, ""), (3, ""), (4, " \n"), (4, " \n")]


def test_lines_of_rows_with_one_id_are_kept_apart(spark):
    rows = [(0, "A"), (1, "a unique first line\nA"), (1, "keep me, I am a unique line\nkeep me too, I am the second one"), (None, "w\nA"), (None, "x\ny")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in line_dedup.deduplicated(df).collect())
    assert kept == [(-1, "w\nA"), (-1, "x\ny"), (1, "a unique first line"), (1, rows[2][1])]
    texts = spark.createDataFrame([("b", "same line here"), ("a", "Same line here")], "doc_id string, text string")
    out = {r["doc_id"]: [tuple(x) for x in r["removed"]] for r in line_dedup.report(texts).collect()}
    assert out == {"a": [], "b": [(0, "a", 0)]}


def test_few_distinct_shingles():
    values, sizes = line_dedup.shingle_hashes(["x" * 500, "ab" * 300, "".join(chr(200 + k) for k in range(107)), "".join(chr(200 + k) for k in range(106)), "short"])
    assert line_dedup.fewer_distinct(values, sizes, 100).tolist() == [True, True, False, True, True]


def test_jaccard_join(docs, nothing):
    out = sorted((r["doc_id"], r["class_id"], r["n_links"], r["kept"]) for r in jaccard_join.report(docs).collect())
    assert out[:6] == [(0, 0, 0, True), (1, 1, 0, True), (2, 2, 0, True), (3, 3, 2, True), (3, 3, 2, True), (4, 3, 2, False)]
    kept = jaccard_join.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 5, 6, 7, 8, 9]
    assert jaccard_join.report(nothing).count() == 0 and jaccard_join.deduplicated(nothing).count() == 0


def test_hot_group_of_near_copies_loses_no_link(spark):
    dice = random.Random(1)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(600):
        words = list(base)
        words[dice.randrange(120)] = f"x{k}"
        rows.append((k, " ".join(words)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for _, t in rows]
    wanted = [sum(len(a & b) >= 0.8 * (len(a) + len(b) - len(a & b)) for b in sets) - 1 for a in sets]
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in jaccard_join.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = sum(wanted) - sum(got[k][0] for k in range(600))
    assert {c for _, c in got.values()} == {0} and 0 <= missed <= 0.001 * sum(wanted)


def test_pruning_bound():
    assert jaccard_join.least_matches(16, 0.8, 0.0) == 0 and jaccard_join.least_matches(128) > 0.5 * 128
    exact = sum(math.comb(17, m) * 0.8**m * 0.2 ** (17 - m) for m in range(jaccard_join.least_matches(16)))
    assert exact < jaccard_join.TOLERANCE


def test_signatures_estimate_similarity():
    a, b = np.arange(1000, dtype=np.uint64), np.arange(100, 1100, dtype=np.uint64)
    s = minhash.signatures(minhash.mixed(np.concatenate([a, b])), np.array([1000, 1000]), 256, 1)
    assert abs((s[0] == s[1]).mean() - 900 / 1100) < 0.1


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (5, 5), (4, 3)], "a long, b long")
    assert {r["node"]: r["root"] for r in components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components(chain).agg(F.max("root"), F.count("*")).first()[:] == (0, 201)


def test_cover_tree(spark):
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [2.0, 0.01]), (3, 1, [1.0, 0.0]), (4, None, [1.0, 0.0]), (5, 0, None), (6, 0, [0.0, 0.0]), (7, 0, [float("nan"), 1.0]), (8, 0, [1.0, None]), (9, 0, [1.0, 0.0]), (9, 0, [1.0, 0.0]), (10, 0, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in cover_tree.near_duplicates(df).collect())
    assert got == [(1, 3, 1, True), (2, 3, 1, False), *[(k, 0, k, True) for k in range(3, 9)], (9, 3, 1, False), (9, 3, 1, False), (10, 0, 10, True)]
    assert cover_tree.near_duplicates(df.limit(0)).count() == 0


def test_cover_tree_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(150, 16)), rng.normal(size=(1, 16)) + 0.04 * rng.normal(size=(150, 16))]).astype(np.float32)
    df = spark.createDataFrame([(k, 0, v.tolist()) for k, v in enumerate(x)], "vec_id long, label int, embedding array<float>")
    unit = cover_tree.unit(x.astype(np.float64))
    wanted = ((unit @ unit.T) >= 0.98).sum(axis=1) - 1
    for options in ({"sample": 40, "block": 16, "wide": 32}, {"sample": 300, "cell": 10, "block": 16, "wide": 32}):
        got = {r["vec_id"]: r["n_links"] for r in cover_tree.near_duplicates(df, **options).collect()}
        assert [got[k] for k in range(300)] == wanted.tolist() and wanted.max() > 50


def test_cover_tree_of_clusters_prunes(spark):
    """Upper levels tell clusters apart: cells of far clusters never meet, and no link is lost."""
    rng = np.random.default_rng(7)
    centres = cover_tree.unit(rng.normal(size=(12, 32)))
    x = np.concatenate([c + 0.02 * rng.normal(size=(40, 32)) for c in centres])
    df = spark.createDataFrame([(k, "a", v.tolist()) for k, v in enumerate(x)], "vec_id long, label string, embedding array<double>")
    unit = cover_tree.unit(x)
    wanted = ((unit @ unit.T) >= 0.98).sum(axis=1) - 1
    tree = cover_tree.CoverTree(unit)
    assert [len(n) for n in tree.nets][-1] == 1 and 12 in [len(n) for n in tree.nets]
    p, q = cover_tree.near_pairs(tree, tree, 0.2)
    assert len(p) < 0.2 * len(x) ** 2
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in cover_tree.near_duplicates(df, sample=200, cell=40).collect()}
    assert [got[k][0] for k in range(len(x))] == wanted.tolist()


def test_cover_tree_of_any_size_of_numbers(spark):
    rows = [(1, 0, [1e200, 1e200]), (2, 0, [1e-200, 1e-200]), (3, 0, [1e300, -1e300]), (4, 0, [5e-324, 0.0]), (5, 0, [1.0, 1.0]), (5, 0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in cover_tree.near_duplicates(df).collect())
    assert got == [(1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 1, 4), (5, 1, 4), (5, 2, 1)]


def test_pii(docs, nothing):
    field = pii.learn(docs)
    out = {r["doc_id"]: r for r in pii.tagged(docs.drop("spans"), field).collect()}
    assert [(s["kind"], s["base"]) for s in out[7]["spans"]] == [("email", True), ("phone", True)] and out[0]["spans"] == []
    assert pii.redacted(TEXTS[7], [tuple(s)[:3] for s in out[7]["spans"]]) == "mail [email], [phone] end"
    assert pii.tagged(nothing.drop("spans"), field).count() == 0


def test_best_segments_equal_brute_force():
    """The dynamic program against all choices of segments and kinds of a short zone."""
    dice = random.Random(11)
    for _ in range(60):
        n = dice.randint(1, 5)
        spans = [(i, j) for i in range(n) for j in range(i + 1, min(n, i + 3) + 1) if dice.random() < 0.6]
        weights = {f"{i}-{j}": [dice.uniform(-3, 3) for _ in pii.KINDS] for i, j in spans}
        weights |= {f"after:{s}": [dice.uniform(-2, 2) for _ in pii.KINDS] for s in pii._STATES}
        field = pii.Field(weights)

        def total(chosen, weights=weights):
            score, state, at = 0.0, 0, 0
            for i, j, k in chosen:
                for _ in range(i - at):
                    state = pii._AFTER[state]
                score += weights[f"{i}-{j}"][k] - pii.LEAST_SCORE + weights[f"after:{pii._STATES[state]}"][k]
                state, at = pii._TO[k], j
            return score

        def choices(at, spans=spans):
            yield []
            for i, j in spans:
                if i >= at:
                    for k in range(len(pii.KINDS)):
                        for rest in choices(j):
                            yield [(i, j, k), *rest]

        got = field.best(n, [(i, j, [f"{i}-{j}"]) for i, j in spans])
        assert abs(total(got) - max(total(c) for c in choices(0))) < 1e-9


def test_learning_raises_the_likelihood_of_the_gold_segments():
    candidates, gold = [(0, 1, ["a"]), (2, 3, ["b"]), (1, 3, ["c"])], [(0, 1, 2), (2, 3, 4)]
    field = pii.trained([(4, candidates, gold)] * 10, 6, 0.5, random.Random(1))
    assert field.best(4, candidates) == gold
    assert field.transitions()[pii._STATES.index("card:1"), 4] > 0  # a secret right after a card


def test_gradients_equal_differences_of_the_likelihood():
    """Forward-backward against sums over all choices of segments."""
    dice, n = random.Random(4), 4
    candidates = [(i, j, [f"{i}-{j}"]) for i in range(n) for j in range(i + 1, n + 1) if dice.random() < 0.7]
    index = {}
    gold = [(*candidates[1][:2], 3)]
    zone = pii._Zone(n, candidates, gold, index)
    scores = np.array([[dice.uniform(-1, 1) for _ in pii.KINDS] for _ in candidates])
    into = np.array([[dice.uniform(-1, 1) for _ in pii.KINDS] for _ in pii._STATES])

    def choices(at):
        yield []
        for x, (i, j, _) in enumerate(candidates):
            if i >= at:
                for k in range(len(pii.KINDS)):
                    for rest in choices(j):
                        yield [(x, k), *rest]

    def parts(chosen):
        state, at, out = 0, 0, []
        for x, k in chosen:
            i, j, _ = candidates[x]
            for _ in range(i - at):
                state = pii._AFTER[state]
            out.append((x, k, state))
            state, at = pii._TO[k], j
        return out

    every = [parts(c) for c in choices(0)]
    weight = np.array([math.exp(sum(scores[x, k] + into[s, k] for x, k, s in c)) for c in every])
    seen, states = np.zeros_like(scores), np.zeros_like(into)
    for c, w in zip(every, weight / weight.sum(), strict=True):
        for x, k, s in c:
            seen[x, k] += w
            states[s, k] += w
    g, t = zone.gradients(scores, into)
    assert np.allclose(g, zone.gold - seen) and np.allclose(t, zone.before - states)


def test_field_finds_forms_it_has_not_seen():
    """Precision and recall on planted spans, with one form of each kind held out of learning."""
    dice = random.Random(3)
    held = {"email": " [at] ", "ip": "(.)", "card": "/", "phone": "3.3.4", "secret": "upper"}
    words = lambda n: " ".join(dice.choice(["of", "the", "lorem", "ipsum", "in", "und"]) for _ in range(n))

    def card():
        while not pii.luhn(d := "".join(dice.choice("0123456789") for _ in range(16))):
            pass
        return d

    spans = [lambda: f"{dice.choice(['an', 'bo'])}.{dice.randint(1, 99)}@mail{dice.randint(1, 9)}.example.com", lambda: ".".join(str(dice.randint(0, 255)) for _ in range(4)), card, lambda: f"+1 ({dice.randint(200, 999)}) 555-{dice.randint(1000, 9999)}", lambda: f'token = "{"".join(dice.choice("0123456789abcdef") for _ in range(40))}"']
    text = lambda: f"{words(6)} {dice.choice(spans)()} {words(5)} {dice.choice(pii.DECOYS)(dice)} {words(4)}"
    field = pii.learn_from([text() for _ in range(150)], forms={k: {n: f for n, f in v.items() if n != held[k]} for k, v in pii.FORMS.items()})
    hit = planted = wrong = 0
    for _ in range(150):
        body, gold = (x := text()) and pii.rewritten(x, pii.annotated(x), dice, {k: {held[k]: pii.FORMS[k][held[k]]} for k in held})
        base = pii.base_spans(body)
        found = {*pii.extra_spans(body, field, base), *base}
        planted += len(gold)
        hit += sum(g in found for g in gold)
        wrong += len(found - set(gold) - set(base))
    assert planted > 100 and hit >= 0.8 * planted and wrong <= 0.1 * planted, (hit, planted, wrong)
    clean = [f"{words(8)} {dice.choice(pii.DECOYS)(dice)} {words(8)}" for _ in range(150)]
    assert sum(bool(pii.extra_spans(t, field, pii.base_spans(t))) for t in clean) <= 5


def test_field_finds_unseen_secrets():
    dice = random.Random(2)
    code = lambda n: "".join(dice.choice("0123456789abcdef") for _ in range(n))
    plain = lambda n: " ".join(dice.choice(["of", "the", "lorem", "2 ipsum", "in 1999"]) for _ in range(n))
    train = [f"{plain(9)} password={code(18)} {plain(9)} x@y.org {plain(5)} 10.0.0.{k}" for k in range(80)]
    field = pii.learn_from(train)
    text = f"{plain(7)} password={code(18)} {plain(9)}"
    found = pii.extra_spans(text, field, [])
    assert [text[a:b] for k, a, b in found if k == "secret"] == [text.split("password=")[1][:18]]
    assert pii.extra_spans(plain(50), field, []) == []


def test_toxicity(spark, docs, nothing):
    assert toxicity.folded("ІD10T! loser") == " idiot loser "
    rows = [(k, f"good words here {k}" if k % 2 else f"you idiot number {k}", k % 2 == 0) for k in range(60)]
    train = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(y)) for k, _, y in rows], "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn(train, labels, F.lit(True))
    out = {r["doc_id"]: r["toxic_score"] for r in toxicity.scored(docs, lexicon).collect()}
    assert out[8] > 0.5 > max(out[k] for k in (0, 1, 2, 3))
    assert toxicity.scored(nothing, lexicon).count() == 0
    empty = toxicity.learn(train, labels.limit(0), F.lit(True))
    assert empty.weights == {} and toxicity.scored(docs, empty).first()["toxic_score"] == 0.0


def test_exception_phrases_cancel_hits():
    lexicon = toxicity.Lexicon({" trash": 2.0}, (" trash can ",))
    a = lexicon.automaton()
    assert toxicity.matched(toxicity.folded("the trash can"), a) == {} and len(toxicity.matched(toxicity.folded("trash talk, trash can"), a)) == 1


def test_cotraining(spark, docs, nothing):
    rows = [(k, ("fine words make a line of text " * 3) if k % 2 else ("#### " * 20), "en", f"s{k % 2}") for k in range(80)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    model = cotraining.learn(train, labels, F.lit(True))
    got = {r["doc_id"]: r["quality_score"] for r in cotraining.scored(train, model).collect()}
    assert all((got[k] >= 0.5) == bool(k % 2) for k in got)
    assert cotraining.scored(docs, model).count() == 11 and cotraining.scored(nothing, model).count() == 0
    assert cotraining.scored(docs, cotraining.learn(train, labels.limit(0), F.lit(True))).first()["quality_score"] == 0.5


def test_quotes_of_parts(spark):
    long = "one\ntwo here\nthree here\nfour\n\nsecond part\nof two lines\n\nthird part\n\nlast words"
    texts = [
        "two here\nsecond part",
        long,
        long,
        "> two here\n> three here\nlines 2 and 3 of a paragraph",
        "> Second part of\n> two lines\n>\n> third   part\ntwo paragraphs, one cut anew",
        "> one\n>\n> last words\n> never said\nnot all of it",
        "> of two lines\n\nmine\n> four\n>\n> later words\nsaid in two messages only",
        "later words\nfour\nof two lines",
        ">> two here\n>> second part\n> lines 2 and 3 of a paragraph\n> never said\nnested",
        "> later words\n> of two lines\nx",
    ]
    got = {r["turn"]: r for r in quotes.linked(spark.createDataFrame([(c, k, "user", t) for c in (1, 2) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")).where("conv_id = 2").collect()}
    assert [got[k]["reply_to"] for k in range(10)] == [None, None, None, 1, 1, None, 1, None, 0, 7]
    assert [(got[k]["n_quoted"], got[k]["n_linked"]) for k in range(3, 10)] == [(1, 1), (1, 1), (1, 0), (2, 1), (0, 0), (2, 1), (1, 1)]
    assert got[3]["thread"] == 1 and got[3]["body"] == "lines 2 and 3 of a paragraph"


def test_quotes(spark):
    rows = [(1, 0, "user", "Hello there\nHow are you?"), (1, 1, "assistant", "> hello   THERE\n> How are you?\nFine, thanks.\n\nAnd you?"), (1, 2, "user", "Unrelated"), (1, 3, "user", "> And you?\nGood."), (1, 4, "assistant", ">> Hello there\n> Good.\n\n> Unrelated\nNice"), (1, 5, "user", "> nothing such\nx"), (2, 0, None, None), (2, 0, None, None), (None, 1, "user", "a"), (3, None, "user", "> b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("c", F.lit(1)).withColumn("h", F.lit(2))
    got = {(r["conv_id"], r["turn"]): r for r in quotes.linked(df).collect()}
    assert [got[1, k]["reply_to"] for k in range(6)] == [None, 0, None, 1, 3, None]
    assert sorted(range(6), key=lambda k: got[1, k]["position"]) == [0, 1, 3, 4, 2, 5]
    assert got[1, 1]["body"] == "Fine, thanks.\n\nAnd you?" and got[1, 4]["n_linked"] == 3 and got[3, None]["body"] == ""
    assert quotes.linked(df).count() == 10 and quotes.linked(df.limit(0)).count() == 0


def test_conversations_in_blocks(spark):
    texts = ["start", *[f"> start\nreply {k}" for k in range(40)]]
    df = spark.createDataFrame([(1, k, "user", t) for k, t in enumerate(texts)] + [(None, 3, "user", "alone")], "conv_id long, turn long, role string, text string")
    rows = quotes.linked(df)
    assert sorted(r["position"] for r in rows.where("conv_id = 1 AND thread = 0").collect()) == list(range(41))
    out = quotes.conversations(rows, block=16).orderBy("conv_id", "block").collect()
    assert [len(r["messages"]) for r in out] == [16, 16, 9]
    assert [m["body"] for r in out for m in r["messages"]] == ["start", *[f"reply {k}" for k in range(40)]]
