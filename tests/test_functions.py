import random

import pytest
from pyspark.sql import functions as F

from assetloom.functions import bits, media, names, numbers
from assetloom.operators import budget, catalog, health, identity


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "wanted"), [("  Clip.MP4.mov ", "clip"), ("a.b.webm", "a.b"), ("plain", "plain")])
def test_media_name(spark, raw, wanted):
    assert one(spark, names.media_name(F.lit(raw))) == wanted


@pytest.mark.parametrize(("raw", "wanted"), [("Clip copy.mp4", "clip"), ("clip (2).mp4", "clip"), ("clip_3", "clip"), ("clip 副本", "clip"), ("clip", "clip")])
def test_cleanup_name(spark, raw, wanted):
    assert one(spark, names.cleanup_name(F.lit(raw))) == wanted


def test_safe_names_and_categories(spark):
    assert one(spark, names.safe_name(F.lit("..视频 a/b__"))) == "视频_a_b"
    assert one(spark, names.safe_name(F.lit("///"))) == "video"
    assert one(spark, names.category(F.lit("a\\b c/"))) == "a/b_c"
    for bad in ("/a", "C:x", "a/../b", "a//b"):
        assert one(spark, names.category(F.lit(bad))) is None
    assert one(spark, names.resolved(F.lit("ppt/slides/../media\\x.png"))) == "ppt/media/x.png"


def test_numbers(spark):
    assert one(spark, numbers.frame_rate(F.lit("30000/1001"))) == pytest.approx(29.97, abs=0.01)
    assert one(spark, numbers.frame_rate(F.lit("x/0"))) == 0
    assert one(spark, numbers.package_reserve(F.lit(10_000_000), F.lit(2_000_000))) == 64_000
    assert one(spark, numbers.package_reserve(F.lit(1_000_000_000), F.lit(100_000_000))) == 1_000_000
    assert one(spark, numbers.height_bucket(F.lit(700), F.lit(480), F.lit(1080))) == 720
    assert one(spark, numbers.bucket_below(F.lit(1080), F.lit(720))) == 720
    assert [one(spark, x) for x in numbers.scaled(F.lit(1080), F.lit(3840))] == [540, 1920]


def test_hamming_of_unsigned_halves(spark):
    assert one(spark, bits.hamming_hex(F.lit("f" * 16), F.lit("0" * 16))) == 64
    assert one(spark, bits.hamming_hex(F.lit("xyz"), F.lit("0" * 16))) is None


def frame(d):
    return format((1 << d) - 1, "016x")


@pytest.mark.parametrize(
    ("change", "wanted"),
    [
        ({}, True), ({"aspect_ppm": 1_791_045}, True), ({"aspect_ppm": 1_850_000}, False), ({"duration_ms": 5300}, False), ({"frames": [frame(d) for d in (6, 2, 3, 5, 4)]}, True),
        ({"frames": [frame(d) for d in (1, 0, 1, 24, 0)]}, True), ({"frames": [frame(d) for d in (7, 7, 7, 7, 7)]}, False), ({"frames": ["?"] * 5}, False), ({"frames": None}, False), ({"has_audio": True, "audio_hash": frame(13)}, False),
    ],
)
def test_fingerprints(spark, change, wanted):
    schema = "duration_ms long, aspect_ppm long, frames array<string>, luma array<int>, has_audio boolean, audio_hash string"
    base = {"duration_ms": 5000, "aspect_ppm": 1_777_778, "frames": [frame(0)] * 5, "luma": [100] * 5, "has_audio": None, "audio_hash": None}
    rows = spark.createDataFrame([(base, base | change)], f"a struct<{schema.replace(' long', ':long').replace(' array', ':array').replace(' boolean', ':boolean').replace(' string', ':string')}>, b struct<{schema.replace(' long', ':long').replace(' array', ':array').replace(' boolean', ':boolean').replace(' string', ':string')}>")
    assert rows.select(bits.fingerprints_match(F.col("a"), F.col("b")).alias("x")).first()["x"] is wanted


def test_budget_split_sums_to_target(spark):
    rows = spark.createDataFrame([(8_000_000, 2_000_000, 7_500_000), (1, 1, 5)], "v long, i long, t long")
    out = [tuple(r)[3:] for r in budget.split(rows, "v", "i", "t", "balanced", "balanced").collect()]
    assert sum(out[0]) == 7_500_000 and out[1] == (1, 1)
    untouched = budget.split(rows, "v", "i", "t", "balanced", "none").first()
    assert untouched["image_budget"] == 2_000_000


def test_controller(spark):
    step = budget.next_budget(F.lit(800_000), F.lit(1_000_000), F.lit(600_000), F.lit(900_000), F.lit(0), F.lit(False))
    assert one(spark, step)["budget"] == 731_250 and one(spark, step)["kind"] == "quality_giveback"
    tried = list(budget.controlled(lambda b: int(b * 1.3), 100_000, 100_000, 120_000))
    assert len(tried) <= 4 and tried[-1][1] <= 100_000


def test_tags_statuses_reasons(spark):
    assert one(spark, identity.clean_tags(F.array(F.lit(" a"), F.lit(""), F.lit("b"), F.lit("a ")))) == ["a", "b"]
    state = lambda *a: one(spark, health.status(*[F.lit(x) for x in a]))
    assert [state(False, 1, 1, 1, 1), state(True, 2, 1, 1, 1), state(True, 1, 1, 2, 1), state(True, 1, 1, 2, 0)] == ["missing", "modified", "metadata_drift", "available"]
    assert one(spark, health.reasons([(F.lit(True), "a"), (F.lit(None).cast("boolean"), "b"), (F.lit(True), "c")])) == ["a", "c"]


def test_damaged_prefix_and_unique_candidate(spark):
    text = "".join(chr(97 + k * k % 23) for k in range(200))
    known = spark.createDataFrame([("A", text), ("B", "z" * 90 + "1"), ("C", "z" * 90 + "2"), ("D", text[:80] + "other" * 30), ("E", None)], "owner string, text string")
    rest = spark.createDataFrame([(1, text[:150]), (2, text[:80]), (3, "z" * 90), (4, text), (5, text[:63]), (6, text[:70] + "!" * 9), (7, None), (8, text[:64] + "\n" + text[65:90])], "k long, text string")
    got = {r["k"]: (r["n_candidates"], r["match"]) for r in identity.damaged_prefix(rest, known, "k", "text", "owner").collect()}
    assert got == {1: (1, "A"), 2: (2, None), 3: (2, None)}
    pairs = spark.createDataFrame([(1, "A"), (1, "A"), (2, "A"), (2, "B")], "k long, owner string")
    assert {tuple(r) for r in identity.unique_candidate(pairs, "k", "owner").collect()} == {(1, 1, "A"), (2, 2, None)}


def test_prefixes_of_texts_that_begin_alike(spark):
    """Texts of one long header, with copies and wide characters: equal to all pairs, and each known text makes few hashes."""
    dice = random.Random(12)
    head = "".join(dice.choice("aäß漢𝄞 \n") for _ in range(700))
    bodies = [head + "".join(dice.choice("xyé") for _ in range(dice.choice([1, 60, 400, 900]))) for _ in range(30)]
    known = [("ABCD"[k % 4], b) for k, b in enumerate(bodies)] + [("A", bodies[0]), ("B", head[:64] + "!"), ("C", None)]
    rest = [head[:k] for k in (63, 64, 65, 127, 128, 129, 255, 256, 300, 512, 699, 700)] + [b[: len(b) - dice.choice([0, 1, 40])] for b in bodies] + [head[:100] + "?", None, head[:64]]
    wanted = {}
    for k, t in enumerate(rest):
        held = {o for o, b in known if t is not None and b is not None and 64 <= len(t) < len(b) and b.startswith(t)}
        if held:
            wanted[k] = (len(held), min(held) if len(held) == 1 else None)
    a, b = spark.createDataFrame(list(enumerate(rest)), "k long, text string"), spark.createDataFrame(known, "owner string, text string")
    got = [(r["k"], (r["n_candidates"], r["match"])) for r in identity.damaged_prefix(a, b, "k", "text", "owner").collect()]
    assert len(got) == len(wanted) and dict(got) == wanted and {n for n, _ in wanted.values()} >= {1, 4}
    # The marks tell apart what begins alike: texts of 128 characters and more don't meet those that share 64.
    facts = identity.prefix_facts(a, ["k"], "text")
    assert {r["k"]: len(r["marks"]) for r in facts.where("k < 12").collect()} == {1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 2, 7: 3, 8: 3, 9: 4, 10: 4, 11: 4}


def test_recommendation(spark):
    rows = [(1, "o", 0, "original", 1080, 4000, 2_073_600, 10_000, 1.0, True), (1, "h", 1, "high", 1080, 1500, 2_073_600, 4000, 0.99, True), (1, "a", 2, "aggressive", 360, 300, 230_400, 1000, 0.97, True)]
    got = catalog.recommended(spark.createDataFrame(rows, "group_id int, variant_id string, ord int, profile string, height int, kbps int, pixels int, size_bytes int, ssim double, allowed boolean")).first()
    assert (got["keep_best"], got["keep_original"], got["keep_smallest_close"], got["savings"]) == ("o", "o", "h", 5000)


def test_import_outcomes(spark):
    library = spark.createDataFrame([("s1", "p1")], "sha256 string, pixel_sha256 string")
    incoming = spark.createDataFrame([(0, "s1", "p9", 9, 9), (1, "s2", "p1", 9, 9), (2, "s3", "p3", 9, 9), (3, "s3", "p3", 9, 9), (4, "s4", "p4", 1, 9)], "ord int, sha256 string, pixel_sha256 string, width int, height int")
    incoming = incoming.withColumn("least_width", F.lit(5)).withColumn("least_height", F.lit(5))
    assert {r["ord"]: r["outcome"] for r in catalog.imported(library, incoming).collect()} == {0: "reused", 1: "reused_pixels", 2: "added", 3: "repeated", 4: "skipped"}


def test_merge_families(spark):
    variants = spark.createDataFrame([("v1", "A", "s1", 0), ("v2", "B", "s1", 0), ("v3", "B", "s2", 1)], "id string, family_id string, sha256 string, ord int")
    hashes = spark.createDataFrame([("A", "s1"), ("B", "s1"), ("B", "s2")], "family_id string, sha256 string")
    assets = spark.createDataFrame([("d", "B", "v2"), ("d", "B", "v3")], "deck_id string, family_id string, variant_id string")
    v, h, a = catalog.merged_families(variants, hashes, assets, "B", "A")
    assert sorted((r["id"], r["family_id"]) for r in v.collect()) == [("v1", "A"), ("v3", "A")]
    assert h.count() == 2 and sorted((r["family_id"], r["variant_id"]) for r in a.collect()) == [("A", "v1"), ("A", "v3")]


def test_sensitive_paths(spark):
    wanted = {"a/.netrc": True, "x/.npmrc": True, "home/.ollama/model": True, "docs/.env.example": False, "a/.env.local": True, "k/server.PEM": True, ".ssh": False, "src/main.py": False}
    got = spark.createDataFrame([(p,) for p in wanted], "p string").select("p", media.sensitive(F.col("p")).alias("s")).collect()
    assert {r["p"]: r["s"] for r in got} == wanted
