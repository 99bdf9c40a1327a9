"""Extra columns named like results or like the operators' own helper columns change nothing."""

import pytest
from pyspark.sql import functions as F

from assetloom.llm import common, cotraining, cover_tree, jaccard_join, line_dedup, mixing, pieces, pii, quality_rules, quotes, toxicity

HELPERS = "w chars row doc item gone new body spans first root n copies size none key h before part place place_part e u c t p q band bucket links label vector cell mine other words lines toxic one case in_0 in_1 Text_ page".split()
RESULTS = "n_words fail_bits rule_set kept policy mix_size mix_copies ids decoded n_tokens spans toxic_total toxic_score content_score quality_score c_words m_lang reply_to thread position n_linked".split()
TEXTS = ["one two three four five six seven\nmail x@y.org", "one two three four five six seven\nMAIL x@y.org\nits own line", "you idiot\n> one", None, "#### some words here"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame([(k, t, "en", f"s{k % 2}") for k, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string")
    return rows.select("*", *[F.lit(f"own {c}").alias(c) for c in dict.fromkeys([*HELPERS, *RESULTS])])


def unharmed(out, docs):
    """All columns of the input are there with their values, those named like a result under another name."""
    own = [(c, f"{c}_input" if c not in docs.columns or f"{c}_input" in out.columns else c) for c in docs.columns[4:]]
    found = out.agg(*[F.collect_set(name).alias(f"x{k}") for k, (_, name) in enumerate(own)]).first()
    for k, (c, _) in enumerate(own):
        assert found[f"x{k}"] in ([f"own {c}"], []), c
    return out


def test_helpers(docs):
    names = common.Aside(docs)
    assert names.back(names.rows).columns == docs.columns
    out = common.with_results(docs, {"N_words": F.length("text"), "fresh": F.lit(1)})
    assert out.columns[-2:] == ["N_words", "fresh"] and "n_words_input" in out.columns
    unharmed(out.withColumnRenamed("N_words", "n_words"), docs)


def test_every_operator(spark, docs):
    got = unharmed(quality_rules.ledger(quality_rules.measured(docs)), docs)
    assert [r["n_words"] for r in got.orderBy("doc_id").collect()] == [9, 12, 4, 0, 4]
    unharmed(quality_rules.verdicts(got, quality_rules.policy_table(spark)), got.drop(*[c for c in got.columns if c.endswith("_input")]).select(*[c for c in docs.columns if c not in ("n_words", "fail_bits", "rule_set")]))
    assert unharmed(mixing.mix(docs, F.lit(3)), docs).count() == 5 and unharmed(mixing.emitted(docs), docs).columns == docs.columns
    assert unharmed(pieces.digests(pieces.encoded(docs)), docs).where("decoded <=> coalesce(text, '')").count() == 5
    field = pii.learn_from(["mail a.b@c.org now, 10.0.0.1"] * 3)
    assert unharmed(pii.tagged(docs, field), docs).where("size(spans) > 0").count() == 2
    lexicon = toxicity.Lexicon({" idiot": 5.0}, (), (-3.0, 2.0, 0.1))
    assert unharmed(toxicity.scored(docs, lexicon), docs).where("toxic_score > 0.5").count() == 1
    assert unharmed(toxicity.accepted(docs, lexicon), docs).columns == docs.columns and toxicity.accepted(docs, lexicon).count() == 4
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(5)], "doc_id long, quality int, toxic int")
    model = cotraining.learn(docs, labels, F.lit(True))
    assert unharmed(cotraining.scored(docs, model), docs).count() == 5
    assert cotraining.learned_and_scored(docs, labels, F.lit(True)).count() == 5


def test_near_duplicates(docs):
    out = unharmed(line_dedup.deduplicated(docs), docs)
    assert out.columns == docs.columns and {r["doc_id"]: r["text"] for r in out.collect()}[1] == "its own line"
    out = unharmed(jaccard_join.deduplicated(docs), docs)
    assert out.columns == docs.columns and out.count() == 5
    assert line_dedup.report(docs).count() == 5 and jaccard_join.report(docs).count() == 5


def test_messages_and_vectors(spark, docs):
    messages = docs.withColumns({"conv_id": F.lit(1), "turn": F.col("doc_id")})
    out = unharmed(quotes.linked(messages), docs)
    assert sorted(r["position"] for r in out.collect()) == [0, 1, 2, 3, 4]
    vectors = docs.drop("label").withColumns({"vec_id": F.col("doc_id"), "label": F.lit(1), "embedding": F.array(F.lit(1.0), F.lit(0.0))})
    assert [r["n_links"] for r in cover_tree.near_duplicates(vectors).collect()] == [4] * 5
