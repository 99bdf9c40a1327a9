"""Queries on families: bounds on long documents, fingerprints that plain numbers decide and such that they don't."""

import random

import duckdb
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from assetloom.functions import bits, media
from assetloom.operators import families
from assetloom.plans import registry


@pytest.mark.parametrize("name", ["fingerprint_unique_match", "matched_families"])
def test_long_documents_equal_sql(spark, tmp_path, name):
    """Of 20,000 characters and 18 more: a thousandth of the length would allow for it, the SQL doesn't."""
    dice = random.Random(2)
    text = "".join(dice.choice("etaoin shrdlu cmfwyp") for _ in range(20_000))
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate([text, text + "e" * 18, text + "e" * 9, text, "short " * 40])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same_rows(registry.QUERIES[name](spark, str(tmp_path)), c, registry.ORACLE[name])


def test_cleanup_allows_whatever_matches(spark, tmp_path):
    """The best family that is whole isn't linked to one that matches it by 100 ms: not comfortably, which the SQL doesn't ask for."""
    text = "".join(c * (90 - 3 * k) for k, c in enumerate("etaoinshrdlucmfwypvbgk"))
    text = "".join(random.Random(3).sample(text, len(text)))[:1000] + "e" * 15
    rows = [(k, text[:n], "fr", "s", n) for k, n in [(19, 1015), (2, 1010), (3, 1000)]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = registry.QUERIES["cleanup_groups"](spark, str(tmp_path)).cache()
    assert [(r["n_candidates"], r["safe_to_apply"]) for r in found.collect()] == [(3, True)]
    same_rows(found, c, registry.ORACLE["cleanup_groups"])


@pytest.mark.parametrize("name", ["matched_families", "cleanup_groups"])
def test_names_are_taken_as_they_are(spark, tmp_path, name):
    """Equal names of a generic kind link, names that differ in case don't; brightness differs too much for a match without a name."""
    dice = random.Random(5)
    body = "".join(dice.choices("etaoinshrdlucmfwypvbgk", range(44, 0, -2), k=990))
    at = [k for fifth in (range(180), range(200, 380)) for k in dice.sample([k for k in fifth if body[k] != "e"], 24)]
    brighter = "".join("e" if k in at else c for k, c in enumerate(body))
    heads = [("media one ", body), ("media one ", brighter), ("Media one ", brighter), ("a name (1)", body), ("a name (2)", brighter)]
    rows = [(k, h + b, "en", "s", 1000) for k, (h, b) in enumerate(heads, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert ("name",) in c.execute(f"SELECT DISTINCT why FROM ({registry.ORACLE['matched_families']})").fetchall()
    same_rows(registry.QUERIES[name](spark, str(tmp_path)), c, registry.ORACLE[name])


PRINTS = "id long, fp struct<duration_ms: long, aspect_ppm: long, frames: array<string>, luma: array<int>, has_audio: boolean, audio_hash: string>"


def test_earlier_matches_equal_pairs(spark, monkeypatch):
    """Four to six frames, sound, unknown brightness and broken prints, copies in several lots, steps of lengths in several blocks."""
    monkeypatch.setattr(families, "COPIES", 3)
    monkeypatch.setattr(families, "BLOCK", 8)
    dice, rows = random.Random(6), []
    for k in range(400):
        n = 4 + k % 3
        base = random.Random(k % 5)
        frames = [base.getrandbits(64) ^ sum(1 << b for b in dice.sample(range(64), dice.choice([0, 0, 2, 4, 5]))) for _ in range(n)]
        if k % 7 == 0:
            frames[-1] = dice.getrandbits(64)
        luma = [50 + dice.randint(0, 11) for _ in range(n)]
        hexes = [f"{f:016x}" for f in frames]
        sound = dice.choice([None, None, False, True])
        voice = None if k % 29 == 0 else f"{sum(1 << b for b in dice.sample(range(64), dice.randint(0, 9))):016x}"
        rows.append((k * 7 % 1000 - 300, (300_000 + dice.choice([0, 140, 200, 249, 251]), 1_777_778 + dice.choice([0, 20_000, 30_000]), hexes if k % 31 else ["zz", *hexes[1:]], luma if k % 11 else [None, *luma[1:]], sound, voice)))
        if k % 9 == 0:
            rows += [(2000 + k * 20 - 100 * (j % 2) + j, rows[-1][1]) for j in range(10)]
    df = spark.createDataFrame(rows, PRINTS)
    every = df.select(F.col("id").alias("a"), F.col("fp").alias("x")).join(df.select(F.col("id").alias("b"), F.col("fp").alias("y")), F.col("a") < F.col("b"))
    for most in (150, 250):
        wanted = {}
        for r in every.where(bits.fingerprints_match(F.col("x"), F.col("y"), most)).select("a", "b").collect():
            wanted.setdefault(r["b"], []).append(r["a"])
        found = {r["id"]: (r["n_candidates"], r["match"]) for r in families.earlier_matches(df, most).collect()}
        assert wanted and found == {b: (len(a), a[0] if len(a) == 1 else None) for b, a in wanted.items()}


def test_earlier_matches_make_no_pairs(spark):
    """60,000 copies and one near copy after them: 1.8 billion pairs, of which only sums are needed."""
    fp = lambda frame: F.struct(F.lit(20_000).cast("long").alias("duration_ms"), F.lit(1_777_778).cast("long").alias("aspect_ppm"), F.array(frame, *[F.lit("00000000000000ff")] * 4).alias("frames"), F.array(*[F.lit(50)] * 5).alias("luma"), F.lit(None).cast("boolean").alias("has_audio"), F.lit(None).cast("string").alias("audio_hash"))
    found = families.earlier_matches(spark.range(60_001).select("id", fp(F.when(F.col("id") == 60_000, "00000000000000fe").otherwise("00000000000000ff")).alias("fp")))
    assert found.where("n_candidates <> id OR (match IS NULL) = (id = 1)").isEmpty() and found.count() == 60_000


def test_long_of_hex(spark):
    rows = spark.createDataFrame([("ffffffffffffffff",), ("8000000000000001",), ("00000000000000Ff",), ("zz",), (None,)], "x string")
    assert [r["y"] for r in rows.select(bits.long_of_hex(F.col("x")).alias("y")).collect()] == [-1, -(2**63) + 1, 255, None, None]


def test_candidates_tell_decided_pairs(spark):
    """Four, five and six frames, gaps in brightness: what is decided matches, and nothing that matches is missing."""
    dice = random.Random(4)
    rows = []
    for k in range(150):
        n = 4 + k % 3
        base = random.Random(k % 6)
        frames = [base.getrandbits(64) ^ sum(1 << b for b in dice.sample(range(64), dice.choice([0, 1, 3, 5]))) for _ in range(n)]
        if k % 7 == 0:
            frames[-1] = dice.getrandbits(64)
        luma = [50 + dice.randint(0, 11) for _ in range(n)]
        rows.append((k, (300_000 + dice.choice([0, 140, 200, 249]), 1_777_778, [f"{f:016x}" for f in frames], luma if k % 11 else [None, *luma[1:]], None, None)))
    df = spark.createDataFrame(rows, "id long, fp struct<duration_ms: long, aspect_ppm: long, frames: array<string>, luma: array<int>, has_audio: boolean, audio_hash: string>")
    every = df.select(F.col("id").alias("a"), F.col("fp").alias("x")).join(df.select(F.col("id").alias("b"), F.col("fp").alias("y")), F.col("a") < F.col("b"))
    wanted = {(r["a"], r["b"]) for r in every.where(media.confidence(F.col("x"), F.col("y"))["matched"]).select("a", "b").collect()}
    found = {(r["a"], r["b"]): r["decided"] for r in families.fingerprint_candidates(df).collect()}
    assert wanted and wanted <= set(found) and {p for p, d in found.items() if d} <= wanted
