"""Changes in order: rounds over tables against a walk."""

import random

from assetloom.operators import folds

KINDS = "ord int, decision_id string, kind string, family_id string, keep_variant_id string, remove_variant_ids array<string>, force_remove_variant_ids array<string>, merge_family_ids array<string>"
VARIANTS = "family_id string, id string, ord int, sha256 string, source_variant_id string"


def merged(known, groups):
    """The walk over groups of hashes."""
    known, out = {h: set(f) for h, f in known.items()}, {}
    for k, hashes in enumerate(groups):
        anchors = set().union(*(known.get(h, set()) for h in hashes)) if hashes else set()
        if len(anchors) != 1:
            out[k] = ("conflict" if anchors else "skipped", None, 0)
            continue
        anchor = next(iter(anchors))
        fresh = [h for h in hashes if anchor not in known.get(h, set())]
        for h in fresh:
            known.setdefault(h, set()).add(anchor)
        out[k] = ("matched", anchor, len(fresh))
    return out, {(h, f) for h, fs in known.items() for f in fs}


def run(spark, known, groups):
    a = spark.createDataFrame([(h, f) for h, fs in known.items() for f in fs], "hash string, family string")
    b = spark.createDataFrame([(k, h) for k, hashes in enumerate(groups) for h in (hashes or [None])], "ord int, hash string")
    found, whole = folds.merged_catalog(a, b)
    return {r["ord"]: (r["state"], r["anchor"], r["n_added"]) for r in found.collect()}, {(r["hash"], r["family"]) for r in whole.collect()}


def test_hash_catalog_equals_the_walk(spark):
    dice = random.Random(4)
    assert run(spark, {"h1": {"A"}, "h2": {"B"}}, [{"h1", "n1"}, {"n1", "n2"}, {"zz"}, {"h1", "h2"}, set()]) == merged({"h1": {"A"}, "h2": {"B"}}, [{"h1", "n1"}, {"n1", "n2"}, {"zz"}, {"h1", "h2"}, set()])
    for k in range(3):
        hashes = [f"h{i}" for i in range(14 + 10 * k)]
        known = {h: set(dice.sample("ABC", dice.choice([1, 1, 1, 2]))) for h in dice.sample(hashes, 3)}
        groups = [set(dice.sample(hashes, dice.randint(0, 3))) for _ in range(30)]
        assert run(spark, known, groups) == merged(known, groups)


def test_a_hash_of_all_groups_takes_few_rounds(spark, monkeypatch):
    rounds = []
    known = {"hot": {"A"}, "other": {"B"}}
    groups = [{f"own{k}"} | ({"hot"} if k % 3 else {f"own{k - 1}"}) | ({"other"} if k % 50 == 7 else set()) for k in range(600)]
    plain = folds.F.min_by
    monkeypatch.setattr(folds.F, "min_by", lambda *a: rounds.append(1) or plain(*a))
    assert run(spark, known, groups) == merged(known, groups) and len(rounds) < 12


def walked(decisions, family, variants, identical):
    """The walk over decisions, on dictionaries."""
    family, variants = {f["id"]: dict(f) for f in family}, [dict(v) for v in variants]
    away, told = set(), {}
    of = lambda f: [v for v in variants if v["family_id"] == f]

    def same(a, b):
        return (a, b) in identical or (b, a) in identical or bool({v["sha256"] for v in of(a)} & {v["sha256"] for v in of(b)})

    def verified(f):
        source = next((v for v in of(f) if v["id"] == family[f]["source_variant_id"]), None)
        ids = {v["id"] for v in of(f)}
        return {v["id"] for v in of(f) if source is not None and (v["id"] == source["id"] or v["sha256"] == source["sha256"]) or v["source_variant_id"] in ids}

    for d in sorted(decisions, key=lambda d: d["ord"]):
        f, keep = d["family_id"], d["keep_variant_id"]
        removes, forced, merge = (list(dict.fromkeys(d[c] or [])) for c in ("remove_variant_ids", "force_remove_variant_ids", "merge_family_ids"))
        own = {v["id"] for v in of(f)}
        bad = f not in family
        if not bad and d["kind"] == "within_family":
            bad = keep not in own or not set(removes) <= own or not set(forced) <= set(removes) or (forced and keep not in verified(f)) or not ({keep, *removes} - set(forced)) <= verified(f)
        elif not bad:
            every = own | {v["id"] for m in merge if m in family for v in of(m)}
            bad = bool(forced) or f not in merge or len(merge) < 2 or keep not in own or not set(removes) <= every or any(m not in family or not same(f, m) for m in merge if m != f)
        if bad:
            told[d["decision_id"]] = ("failed", 0)
            continue
        if d["kind"] == "within_family" and not [r for r in removes if r != keep]:
            told[d["decision_id"]] = ("skipped", 0)
            continue
        if d["kind"] == "cross_family":
            for m in [m for m in merge if m != f]:
                hashes = {}
                for v in sorted(of(f), key=lambda v: (v["turn"] if "turn" in v else -1, v["ord"], v["id"])):
                    hashes.setdefault(v["sha256"], v["id"])
                for v in sorted(of(m), key=lambda v: (v["ord"], v["id"])):
                    if v["sha256"] in hashes:
                        away.add((v["id"], d["decision_id"], m, "duplicate"))
                        variants.remove(v)
                        for w in variants:
                            if w["source_variant_id"] == v["id"]:
                                w["source_variant_id"] = hashes[v["sha256"]]
                    else:
                        hashes[v["sha256"]] = v["id"]
                        v["family_id"] = f
                del family[m]
            keep = family[f]["source_variant_id"]
        n = 0
        for r in removes:
            v = next((v for v in variants if v["id"] == r), None)
            if r == keep or v is None:
                continue
            variants.remove(v)
            away.add((r, d["decision_id"], v["family_id"], "removed"))
            n += 1
            for w in variants:
                if w["source_variant_id"] == r:
                    w["source_variant_id"] = None
            for c in ("source_variant_id", "active_variant_id"):
                if family[f][c] == r:
                    family[f][c] = keep
        told[d["decision_id"]] = ("applied", n)
    return {tuple(x.values()) for x in family.values()}, {(v["family_id"], v["id"], v["source_variant_id"]) for v in variants}, away, told


def test_decisions_equal_the_walk(spark):
    dice = random.Random(9)
    for n in (6,):
        family, variants = [], []
        for k in range(n):
            f = f"f{k}"
            ids = [f"{f}v{i}" for i in range(dice.randint(1, 4))]
            for i, v in enumerate(ids):
                variants.append({"family_id": f, "id": v, "ord": i, "sha256": dice.choice("ABCDE") if i else f"S{k}", "source_variant_id": dice.choice([None, ids[0]]) if i else None})
            # A family has each content once.
            seen = set()
            variants = [v for v in variants if v["family_id"] != f or not (v["sha256"] in seen or seen.add(v["sha256"]))]
            family.append({"id": f, "source_variant_id": ids[0], "active_variant_id": dice.choice([v["id"] for v in variants if v["family_id"] == f])})
        identical = {(f"f{a}", f"f{b}") for a in range(n) for b in range(a) if dice.random() < 0.5}
        decisions = []
        for k in range(2 * n):
            f = dice.choice(family)["id"]
            near = [v["id"] for v in variants if v["family_id"] == f]
            if dice.random() < 0.5:
                keep = dice.choice(near)
                d = ("within_family", f, keep, dice.sample(near, dice.randint(0, len(near))), [], None)
                if dice.random() < 0.4:
                    d = (*d[:4], dice.sample(d[3], dice.randint(0, len(d[3]))), None)
            else:
                others = dice.sample([x["id"] for x in family], dice.randint(1, 3))
                every = [v["id"] for v in variants if v["family_id"] in [f, *others]]
                d = ("cross_family", f, dice.choice(near), dice.sample(every, min(len(every), dice.randint(0, 2))), [], list(dict.fromkeys([f, *others])))
            decisions.append(dict(zip(KINDS.replace(",", "").split()[::2], (k, f"d{k}", *d), strict=True)))
        wanted = walked(decisions, family, variants, identical)
        frames = (
            spark.createDataFrame([tuple(d.values()) for d in decisions], KINDS), spark.createDataFrame([tuple(f.values()) for f in family], "id string, source_variant_id string, active_variant_id string"),
            spark.createDataFrame([tuple(v.values()) for v in variants], VARIANTS), spark.createDataFrame(sorted(identical) or [("-", "-")], "a string, b string"),
        )
        left, stay, away, told = folds.sequential_decisions(*frames)
        assert {r["decision_id"]: (r["outcome"], r["n_removed"]) for r in told.collect()} == wanted[3]
        assert {tuple(r) for r in left.select("id", "source_variant_id", "active_variant_id").collect()} == wanted[0]
        assert {(r["family_id"], r["id"], r["source_variant_id"]) for r in stay.collect()} == wanted[1]
        assert {tuple(r) for r in away.select("id", "decision_id", "family_id", "why").collect()} == wanted[2]
        assert {o for o, _ in wanted[3].values()} >= {"applied", "failed"}


def test_merges_follow_each_other(spark):
    """b goes into a, then a into c: nothing is left behind in a family that is gone."""
    family = spark.createDataFrame([(f, f"{f}1", f"{f}1") for f in "abc"], "id string, source_variant_id string, active_variant_id string")
    variants = spark.createDataFrame([(f, f"{f}1", 0, f, None) for f in "abc"], VARIANTS)
    plan = [(0, "d0", "cross_family", "a", "a1", [], [], ["a", "b"]), (1, "d1", "cross_family", "c", "c1", [], [], ["c", "a"]), (2, "d2", "within_family", "b", "b1", [], [], None)]
    left, stay, _, told = folds.sequential_decisions(spark.createDataFrame(plan, KINDS), family, variants, spark.createDataFrame([("a", "b"), ("a", "c")], "a string, b string"))
    assert [r["id"] for r in left.collect()] == ["c"] and {r["family_id"] for r in stay.collect()} == {"c"} and stay.count() == 3
    assert {r["decision_id"]: r["problem"] for r in told.collect()} == {"d0": None, "d1": None, "d2": "unknown_family"}
