"""Audits, decisions, reports, rules and plans on literal rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from assetloom.functions import media
from assetloom.operators import audit, budget, changes, ordered, reports, similarity
from assetloom.sources import packages


def rows(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


@pytest.fixture(scope="module")
def library(spark):
    family = rows(spark, "id string, name string, source_variant_id string, active_variant_id string", ("f1", "one", "v1", "v2"), ("f2", "two", "v3", "gone"), ("f3", "three", "v5", "v5"))
    variants = rows(
        spark, "family_id string, id string, ord int, path string, sha256 string, size_bytes long, mtime_ns long, source_variant_id string, profile string, probe_error string",
        ("f1", "v1", 0, "/m/a.mp4", "A", 10, 5, None, "original", ""), ("f1", "v2", 1, "/m/b.mp4", "B", 20, 5, "v1", "high", "broken"), ("f2", "v3", 0, "/m/c.mp4", "A", 10, 5, None, "original", ""), ("f2", "v4", 1, "/m/c.mp4", "D", 10, 7, None, "high", "bad"), ("f3", "v5", 0, "/m/none.mp4", "E", 1, 5, None, "original", ""),
    )
    files = rows(spark, "path string, size_bytes long, mtime_ns long, sha256 string", ("/m/a.mp4", 11, 5, "A2"), ("/m/b.mp4", 20, 5, "B"), ("/m/c.mp4", 10, 6, "A"), ("/m/extra.mp4", 1, 1, "Z"), ("/d/alias.pptx", 1, 1, "P"), ("/o/x.pptx", 9, 1, "O"))
    return family, variants, files


def test_library_audit_has_all_codes(spark, library):
    family, variants, files = library
    hashes = rows(spark, "family_id string, sha256 string", ("f1", "K"), ("f2", "K"))
    decks = rows(spark, "id string, source_path string, source_aliases array<string>", ("d1", "/d/gone.pptx", ["/d/alias.pptx"]), ("d2", "/d/lost.pptx", []))
    outputs = rows(spark, "deck_id string, id string, kind string, path string, size_bytes long", ("d1", "o1", "optimized", "/o/x.pptx", 8), ("d1", "o2", "optimized", "/o/y.pptx", 8))
    quarantine = rows(spark, "token string, problem string", ("t1", "still referenced"), (None, "unreadable"), ("t2", None))
    found = {verify: audit.library_issues(family, variants, hashes, decks, outputs, quarantine, files, "/m/", verify) for verify in (False, True)}
    fast = {(r["code"], r["severity"], r["variant_id"] or r["family_id"] or r["deck_id"] or r["path"]) for r in found[False].collect()}
    assert fast == {
        ("invalid_family_pointer", "error", "gone"), ("missing_variant", "error", "v5"), ("modified_variant", "error", "v1"), ("variant_metadata_drift", "warning", "v3"), ("variant_metadata_drift", "warning", "v4"), ("unreadable_variant", "error", "v2"), ("unreadable_variant", "warning", "v4"),
        ("ambiguous_known_hash", "error", "f1"), ("duplicate_variant_hash", "error", "f1"), ("duplicate_variant_path", "error", "v3"), ("deck_primary_missing_alias_available", "warning", "d1"), ("deck_source_missing", "warning", "d2"), ("changed_output_record", "warning", "d1"), ("missing_output_record", "info", "d1"),
        ("untracked_media", "warning", "/m/extra.mp4"), ("cleanup_index_issue", "error", "t1"), ("cleanup_index_invalid", "error", None),
    }
    assert {r["variant_id"] for r in found[True].where("code = 'hash_mismatch'").collect()} == {"v1", "v4"}
    assert {r[0] for r in found[False].select("code").distinct().collect()} | {"hash_mismatch"} == set(audit.CODES)
    report = audit.library_report(found[False], family, variants, decks, rows(spark, "family_id string", ("f1",))).first()
    assert (report["families"], report["variants"], report["unlinked"], report["multi_version"], report["ok"], report["exit_code"]) == (3, 5, 2, 2, False, 1)
    assert audit.image_issues(rows(spark, "id string, path string, sha256 string", ("i", "/m/a.mp4", "A2"), ("j", "/m/x", "q")), files, "/m/").count() == 4


def test_cleanup_decisions(spark, library):
    family, variants, _ = library
    kind = "decision_id string, kind string, family_id string, keep_variant_id string, remove_variant_ids array<string>, force_remove_variant_ids array<string>, merge_family_ids array<string>"
    d = rows(
        spark, kind, ("ok", "within_family", "f1", "v1", ["v2"], [], None), ("foreign", "within_family", "f1", "v1", ["v3"], None, None), ("unverified", "within_family", "f2", "v3", ["v4"], [], None), ("forced", "within_family", "f2", "v3", ["v4"], ["v4"], None), ("stray", "within_family", "f2", "v3", [], ["v4"], None),
        ("cross", "cross_family", "f1", "v1", ["v3"], [], ["f1", "f2"]), ("unlike", "cross_family", "f1", "v1", [], [], ["f1", "f3"]), ("nowhere", "cross_family", "f1", "v1", [], [], ["f2"]), ("what", "other", "f1", "v1", [], [], None), ("who", "within_family", "f9", "v1", [], [], None),
    )
    checked = changes.checked_decisions(d, family, variants, rows(spark, "a string, b string", ("f2", "f1")))
    got = {r["decision_id"]: r["problem"] for r in checked.collect()}
    assert got == {"ok": None, "foreign": "foreign_variant", "unverified": "not_verified", "forced": None, "stray": "forced_but_not_removed", "cross": None, "unlike": "not_identical", "nowhere": "no_target", "what": "unknown_kind", "who": "unknown_family"}
    left, gone = changes.applied_decisions(checked.where("decision_id IN ('ok', 'cross')"), variants)
    assert {(r["family_id"], r["id"]) for r in left.collect()} == {("f1", "v1"), ("f1", "v4"), ("f3", "v5")} and {r["id"] for r in gone.collect()} == {"v2", "v3"}


def test_identity_and_upgrades(spark):
    hashes = rows(spark, "family_id string, sha256 string", ("a", "1"), ("b", "1"), ("c", "2"))
    prints = rows(spark, "a string, b string, has_audio boolean", ("a", "c", True), ("c", "d", False), ("d", "e", True))
    sound = rows(spark, "a string, b string, correlation double", ("a", "c", 0.99), ("d", "e", 0.5))
    got = {(r["a"], r["b"]): r["why"] for r in changes.identical_families(hashes, prints, sound, rows(spark, "a string, b string", ("f", "e"))).collect()}
    assert got == {("a", "b"): "hash", ("a", "c"): "fingerprint", ("c", "d"): "fingerprint", ("e", "f"): "damaged_copy"}
    anchors = "deck_id string, slide_path string, shape_id string, family_id string"
    before, after = rows(spark, anchors, ("d", "s1", "1", "a"), ("d", "s1", "2", "b"), ("d", "s2", "1", "c")), rows(spark, anchors, ("d", "s1", "1", "a"), ("d", "s1", "2", "x"), ("d", "s3", "1", "c"))
    assert {(r["slide_path"], r["problem"]) for r in changes.anchor_problems(before, after).collect()} == {("s1", "other_family"), ("s2", "lost"), ("s3", "new")}
    pairs = rows(spark, "media string, width int, height int, seconds double, has_audio boolean, new_width int, new_height int, new_seconds double, new_has_audio boolean", ("ok", 10, 10, 5.0, True, 20, 20, 5.01, True), ("small", 10, 10, 5.0, True, 8, 10, 5.0, True), ("mute", 10, 10, 5.0, True, 10, 10, 5.0, False), ("none", 10, 10, 5.0, True, None, None, None, None))
    assert {(r["subject"], r["problem"]) for r in changes.upgrade_problems(before, before, pairs).collect()} == {("small", "smaller"), ("mute", "audio"), ("none", "missing")}
    parts = rows(spark, "deck_id string, part string, ord int, sha256 string", ("d", "p1", 0, "x"), ("d", "p2", 1, "y"), ("d", "p3", 2, "z"), ("d", "p4", 3, "m"))
    plan = changes.upgrade_plan(parts, rows(spark, "sha256 string, family_id string, how string", ("x", "f", "exact"), ("y", "f", "fingerprint"), ("m", "f", "exact")), rows(spark, "family_id string, master_sha256 string", ("f", "m")))
    assert {r["part"]: r["action"] for r in plan.collect()} == {"p1": "write", "p2": "point", "p3": "keep", "p4": "same"}


def test_versions_and_restores(spark, library):
    family, variants, files = library
    made = rows(spark, "family_id string, id string, sha256 string, source_variant_id string, profile string", ("f1", "n1", "B", "v1", "high"), ("f3", "n2", "new", "v5", "high"))
    more, heads = changes.with_version(variants, family, made)
    assert more.count() == 6 and {r["id"]: r["active_variant_id"] for r in heads.collect()} == {"f1": "v2", "f2": "gone", "f3": "n2"}
    assert {r["id"]: r["source_variant_id"] for r in changes.activated(family, variants, "f1", "v2", source=True).collect()}["f1"] == "v2"
    assert {r["id"]: r["active_variant_id"] for r in changes.activated(family, variants, "f1", "v5").collect()}["f1"] == "v2"
    held = rows(spark, "token string, family_id string, variant_id string, original_path string, quarantined_path string, sha256 string, state string, size_bytes long", ("t1", "f1", "q", "/m/new.mp4", "/m/extra.mp4", "Z", "quarantined", 5), ("t2", "f1", "q2", "/m/a.mp4", "/m/extra.mp4", "Z", "quarantined", 6), ("t3", "f9", "q3", "/m/x.mp4", "/m/extra.mp4", "Z", "quarantined", 1), ("t4", "f1", "q4", "/m/x.mp4", "/m/b.mp4", "Z", "moving", 1))
    got = {r["token"]: (r["outcome"], r["target"]) for r in changes.restored(held, family, files).collect()}
    assert got == {"t1": ("restored", "/m/new.mp4"), "t2": ("restored", "/m/a_Z.mp4"), "t3": ("no_family", None), "t4": ("changed", None)}
    assert {r["token"]: r["outcome"] for r in changes.restored(held, family, files, free_name=False).collect()}["t2"] == "occupied"
    assert changes.pending_cleanup(held).first()[:] == (3, 12)
    wanted = rows(spark, "family_id string, selected_variant_id string, sha256 string, profile string, source_variant_id string", ("f1", "v2", "B", "high", "v1"), ("f1", "v1", "X", "original", None), ("f1", "q", "Z", "x", None), ("f1", "zz", "Z", "x", None))
    assert {r["selected_variant_id"]: (r["state"], r["token"]) for r in changes.selections(wanted, variants, held).collect()} == {"v2": ("ready", None), "v1": ("changed", None), "q": ("restorable", "t1"), "zz": ("missing", None)}
    need = rows(spark, "family_id string, profile string, source_variant_id string", ("f1", "high", "v1"), ("f3", "high", "v5"), ("f2", "high", "v3"))
    assert {r["family_id"]: (r["variant_id"], r["how"]) for r in changes.reusable(need, rows(spark, "family_id string, profile string, variant_id string", ("f2", "high", "v4"), ("f3", "high", "lost")), variants).collect()} == {"f1": ("v2", "reused"), "f2": ("v4", "reported"), "f3": (None, "to_make")}
    moves = {r["id"]: r["blocked"] for r in changes.moved_paths(variants.where("family_id = 'f1'"), "/m/sub", files).collect()}
    assert moves == {"v1": False, "v2": False} and changes.moved_paths(variants, "/m/sub", files).where("blocked").count() == 5
    renames = rows(spark, "id string, name string, category string", ("f1", " new ", "a/b c"))
    cat = family.withColumn("category", F.lit("x"))
    assert {r["id"]: (r["name"], r["category"]) for r in changes.renamed(cat, renames).collect()}["f1"] == ("new", "a/b_c")
    assert {r["name"] for r in changes.renamed(cat, rows(spark, "id string, name string, category string", ("f1", "n", "../up"))).collect()} == {"one", "two", "three"}


def test_images_and_decks(spark):
    assets = rows(spark, "id string, sha256 string, path string, name string, category string, tags array<string>, summary string", ("i", "A", "p1", "n", "c", ["x"], "s"), ("j", "B", "p2", "m", "c", [], ""))
    out = changes.updated_images(assets, rows(spark, "id string, name string, category string, tags array<string>, summary string", ("i", " new ", "/bad", [" t", "t", ""], None))).where("id = 'i'").first()
    assert (out["name"], out["category"], out["tags"], out["summary"]) == ("new", "c", ["t"], "s")
    left, ignored, paths = changes.removed_images(assets, rows(spark, "pair string", ("A:B",), ("B:C",)), rows(spark, "id string", ("i",)))
    assert [r["id"] for r in left.collect()] == ["j"] and [r["pair"] for r in ignored.collect()] == ["B:C"] and [r["path"] for r in paths.collect()] == ["p1"]
    assert changes.without_ignored_of(ignored, ["C"]).count() == 0 == changes.without_ignored_of(ignored).count()
    decks, more = rows(spark, "id string, name string", ("d", "x")), rows(spark, "id string, name string", ("e", "y"), ("f", "z"))
    kept, out = changes.registered(decks, more, rows(spark, "id string", ("f",)))
    assert {r["id"] for r in kept.collect()} == {"d", "e"} and [r["id"] for r in out.collect()] == ["f"]
    outcomes = rows(spark, "outcome string, sha256 string", ("added", "1"), ("reused", "1"), ("skipped", "2"), ("failed", None))
    assert changes.import_totals(outcomes).first()[:] == (1, 1, 1, 1, 2)


def test_confidence_and_suggestions(spark):
    kind = "struct<duration_ms:bigint,aspect_ppm:bigint,frames:array<string>,luma:array<int>,has_audio:boolean,audio_hash:string>"
    base = {"duration_ms": 5000, "aspect_ppm": 1_777_778, "frames": ["0" * 16] * 5, "luma": [100] * 5, "has_audio": None, "audio_hash": None}
    frame = lambda d: format((1 << d) - 1, "016x")
    cases = {"same": {}, "medium": {"frames": [frame(d) for d in (3, 0, 0, 0, 0)]}, "far": {"frames": [frame(20)] * 5}, "bad": {"frames": None}, "mute": {"has_audio": True, "audio_hash": frame(1)}}
    df = spark.createDataFrame([(k, base, base | v) for k, v in cases.items()], f"k string, a {kind}, b {kind}").withColumn("c", media.confidence(F.col("a"), F.col("b")))
    got = {r["k"]: (r["c"]["level"], r["s"]) for r in df.select("k", "c", media.suggestion_score(F.col("a"), F.col("b"), F.col("c")).alias("s")).collect()}
    assert {k: v[0] for k, v in got.items()} == {"same": "high", "medium": "medium", "far": "low", "bad": "low", "mute": "low"}
    assert got["same"][1] == 95.0 and got["far"][1] == 30.0 and got["bad"][1] == pytest.approx(8.7)
    left, right = bytes(range(256)) * 1000, bytearray(bytes(range(256)) * 900)
    similar = media.aligned_similarity(8, 1000)
    pair = spark.createDataFrame([(left, bytes(right)), (left, bytes(len(left))), (left, None)], "a binary, b binary")
    assert [round(r[0], 3) for r in pair.select(similar("a", "b")).collect()] == [1.0, 0.004, 0.0]


def test_plans_equal_step_by_step_folds():
    """Moves and pours against a plain simulation, one step and one byte's worth of care at a time."""
    dice = random.Random(5)
    for _ in range(150):
        deck = []
        for _ in range(dice.randint(1, 6)):
            hard = dice.choice([480, 720])
            soft = dice.choice([h for h in (480, 720, 1080) if h >= hard])
            deck.append({"height": 1080, "soft": soft, "hard": hard, "video_kbps": dice.randint(1, 6000), "audio_kbps": dice.choice([0, 64, 128]), "seconds": dice.uniform(0.5, 60), "weight": dice.uniform(0.01, 3)})
        target = dice.randint(1, 20_000_000)
        size = lambda r, h: int((budget.rate_bounds(h, r["video_kbps"])[0] + r["audio_kbps"]) * 1000 / 8 * r["seconds"])
        heights = [1080] * len(deck)
        for least in ("soft", "hard"):
            while sum(size(r, h) for r, h in zip(deck, heights, strict=True)) > target:
                able = [k for k, r in enumerate(deck) if heights[k] > r[least]]
                if not able:
                    break
                k = min(able, key=lambda k: deck[k]["weight"])
                heights[k] = max(720 if heights[k] >= 1080 else 480, deck[k][least])
        assert budget.lowered(deck, target) == heights
        room, pool = [dice.randint(0, 900) for _ in deck], dice.randint(0, 3_000_000)
        got, left, rest = [0] * len(deck), list(room), pool
        weights, seconds = [r["weight"] for r in deck], [r["seconds"] for r in deck]
        while rest > 0 and any(left):
            whole, moved = 0.0, False
            some = [k for k in range(len(deck)) if left[k] > 0]
            for k in some:
                whole += weights[k]
            for k in some:
                give = min(int(left[k] * 1000 / 8 * seconds[k]), max(1, int(rest * (weights[k] / whole)))) if rest > 0 else 0
                if give > 0:
                    got[k], rest, moved = got[k] + give, rest - give, True
                    left[k] = max(0, left[k] - int(give * 8 / seconds[k] / 1000))
            if not moved:
                break
        assert budget.poured(pool, room, seconds, weights) == got and sum(got) <= max(pool, 0)


def test_controller_stops_on_an_unchanged_plan():
    assert [k for *_, k in budget.controlled(lambda b: b * 2, 1000, 1000, 2000)] == ["first", "correction"]
    assert [b for b, *_ in budget.controlled(lambda b: 5000, 1000, 1000, 2000, lambda b: "same")] == [1000]
    assert list(budget.controlled(lambda b: 800_000, 1_000_000, 600_000, 900_000))[1][0] == 731_250


def test_reports(spark, tmp_path):
    entry = lambda p, s, x: {"media_path": p, "status": s, "source_ssim": x, "zip_size_bytes": 5}
    (tmp_path / "r.json").write_text(json.dumps({"input_pptx": "a.pptx", "output_pptx": "b.pptx", "attempts": [{"kind": "first"}, {"kind": "correction"}], "videos": [entry("v", "encoded", 0.9), entry("w", "skipped", 1)], "images": [entry("i", "optimize", 0.8)]}))
    report = reports.read_reports(spark, str(tmp_path / "r.json"))
    assert sorted((r["media_path"], r["is_video"]) for r in reports.audited_assets(report).collect()) == [("i", False), ("v", True)]
    assert [r["attempt"] for r in reports.attempts(report).orderBy("attempt").collect()] == [1, 2] and not reports.is_standalone(report).first()["standalone"]
    (tmp_path / "m.json").write_text(json.dumps({"samples": [{"path": "/a", "meta_x": "1", "other": 2}, {"path": "b", "profile": "huge", "target_size_mb": -1}, {"video_ssim_threshold": 2}]}))
    got = {r["ord"]: (r["problems"], r["meta"]) for r in reports.manifest_samples(spark, str(tmp_path / "m.json")).collect()}
    assert got[0] == ([], {"meta_x": "1"}) and got[1][0] == ["path_not_absolute", "target_size_mb", "profile"] and got[2][0] == ["path_missing", "video_ssim_threshold"]
    (tmp_path / "rules.json").write_text(json.dumps({"balanced": [{"area": 0.45, "floor": 1080}, {"floor": 480}]}))
    assert reports.rules(reports.rule_table(spark, str(tmp_path / "rules.json"), "balanced")) == ((0.45, 0.0, 0.0, 1080), (0.0, 0.0, 0.0, 480))
    assert spark.range(1).select(reports.without_empty({"a": F.lit("x"), "b": F.lit(""), "c": F.lit(None)}).alias("m")).first()["m"] == {"a": "x"}
    texts = rows(spark, "key string, language string, text string", ("k", "en", "hello"))
    assert {r["key"]: r["text"] for r in reports.translated(rows(spark, "key string", ("k",), ("q",)), "key", texts, "en").collect()} == {"k": "hello", "q": "q"}
    with pytest.raises(Exception, match="unknown tier"):
        reports.looked_up(rows(spark, "tier string", ("best",), ("odd",)), rows(spark, "tier string, crf int", ("best", 18)), "tier").collect()
    again, left = reports.retried(rows(spark, "id int, profile string", (1, "aggressive"), (2, "high"), (3, "balanced")), rows(spark, "id int", (1,), (2,)), "id", "profile")
    assert [(r["id"], r["profile"]) for r in again.collect()] == [(1, "balanced")] and {r["id"] for r in left.collect()} == {2, 3}


def test_probes_and_pictures(spark):
    probes = [json.dumps({"streams": [{"codec_type": "video", "codec_name": "h264", "width": 10, "height": 20, "duration": "2.5", "avg_frame_rate": "30000/1001"}], "format": {"bit_rate": "812345"}}), "not json", json.dumps({"streams": [{"codec_type": "audio"}]})]
    got = [(r["width"], r["bitrate_kbps"], r["has_audio"], r["probe_error"]) for r in packages.probed(spark.createDataFrame([(p,) for p in probes], "probe string")).collect()]
    assert got == [(10, 812, False, ""), (None, 0, False, "unreadable"), (None, 0, True, "no_video")]
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (7).to_bytes(4, "big") + (9).to_bytes(4, "big")
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + (3).to_bytes(2, "big") + (4).to_bytes(2, "big") + b"\0" * 9
    out = {r["path"]: (r["format"], r["width"], r["height"]) for r in packages.image_headers(spark.createDataFrame([("p", png), ("j", jpeg), ("x", b"?")], "path string, content binary")).collect()}
    assert out == {"p": ("PNG", 7, 9), "j": ("JPEG", 4, 3), "x": (None, None, None)}


def test_ranges_and_multi_index(spark):
    df = spark.createDataFrame([("a" if k % 3 else None, k * 7 % 50, k) for k in range(100)], "g string, x int, k int")
    got = {r["g"]: r["upper_median"] for r in ordered.exact_upper_median(df, "g", "x").collect()}
    for g in ("a", None):
        x = sorted(r["x"] for r in df.collect() if r["g"] == g)
        assert got[g] == x[len(x) // 2]
    dice = random.Random(2)
    hashes = [dice.getrandbits(56) for _ in range(150)]
    hashes += [h ^ sum(1 << b for b in dice.sample(range(56), dice.randint(0, 13))) for h in hashes]
    near = similarity.hamming_pairs(spark.createDataFrame(list(enumerate(hashes)), "k int, h long"), "k", "h", 10)
    wanted = {(i, j): (a ^ b).bit_count() for i, a in enumerate(hashes) for j, b in enumerate(hashes) if i < j and (a ^ b).bit_count() <= 10}
    found = [(r["a"], r["b"], r["distance"]) for r in near.collect()]
    assert len(found) == len(wanted) and {(a, b): d for a, b, d in found} == wanted


def test_versions_and_changes_that_come_twice(spark):
    family = rows(spark, "id string, source_variant_id string, active_variant_id string", ("f", "v1", "v1"))
    variants = rows(spark, "family_id string, id string, ord int, sha256 string", ("f", "v1", 0, "A"))
    made = rows(spark, "family_id string, id string, ord int, sha256 string", ("f", "z", 1, "B"), ("f", "y", 2, "B"), ("f", "c", 3, "C"))
    more, heads = changes.with_version(variants, family, made)
    assert {r["id"] for r in more.collect()} == {"v1", "z", "c"} and heads.first()["active_variant_id"] == "c"
    named = rows(spark, "id string, name string, category string", ("f", "one", ""))
    twice = rows(spark, "id string, name string, category string", ("f", "new", "a"), ("f", "newer", "b"))
    assert [(r["name"], r["category"]) for r in changes.renamed(named, twice).collect()] == [("newer", "b")]
    held = rows(spark, "token string, family_id string, original_path string, quarantined_path string, sha256 string", ("t1", "f", "/m/a.mp4", "/q/1", "S" * 64), ("t2", "f", "/m/a.mp4", "/q/2", "S" * 64))
    files = rows(spark, "path string, sha256 string", ("/q/1", "S" * 64), ("/q/2", "S" * 64), ("/m/a.mp4", "T"))
    assert {r["token"]: r["target"] for r in changes.restored(held, family, files).collect()} == {"t1": "/m/a_SSSSSSSS.mp4", "t2": "/m/a_SSSSSSSS_2.mp4"}
