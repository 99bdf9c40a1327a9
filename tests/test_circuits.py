"""Streams that are started anew."""

import datetime
import json

from pyspark.sql import functions as F

from assetloom.streaming import circuits

SCHEMA = "app string, at timestamp, failed boolean, reason string"


def test_cooldowns_over_two_restarts(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()

    def run(k, *events):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"app": a, "at": f"2026-01-01T{t}", "failed": f, "reason": r}) for a, t, f, r in events))
        query = circuits.cooldowns(spark.readStream.schema(SCHEMA).json(source), out, state)
        query.awaitTermination()
        return {(r["app"], r["state"], f"{r['at']:%H:%M}", f"{r['until']:%H:%M}", r["reason"]) for r in spark.read.schema(circuits.TRANSITIONS).parquet(out).collect()}

    one = {("p", "open", "10:00", "10:30", "crash")}
    assert run(1, ("p", "10:00:00", True, "crash"), ("w", "10:00:30", False, None)) == one
    assert spark.conf.get(circuits._PROVIDER) != circuits._ROCKSDB
    # Started anew: the circuit is open yet, so the second failure makes it longer and opens nothing.
    two = one | {("w", "open", "10:22", "10:52", "hang")}
    assert run(2, ("p", "10:20:00", True, "again"), ("w", "10:22:00", True, "hang")) == two
    # Started anew once more: event time passes both ends, and a later failure opens the first circuit again.
    three = two | {("p", "closed", "10:50", "10:50", "again"), ("w", "closed", "10:52", "10:52", "hang"), ("p", "open", "11:00", "11:30", "third")}
    assert run(3, ("p", "11:00:00", True, "third"), ("x", "11:10:00", False, None)) == three
    changes = spark.read.parquet(out)
    at = lambda t: {r["app"] for r in circuits.in_cooldown(changes, F.lit(datetime.datetime.fromisoformat(f"2026-01-01T{t}"))).collect()}
    assert at("10:25:00") == {"p", "w"} and at("10:51:00") == {"w"} and at("10:55:00") == set() and at("11:05:00") == {"p"}


def test_a_log_is_cut_and_rotated_by_bytes(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    (tmp_path / "in").mkdir()

    def run(k, keep):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"n": 100 * k + i, "text": "x" * (i % 7)}) for i in range(100)))
        circuits.rotated_log(spark.readStream.schema("n long, text string").json(source), out, state, ["n"], most_bytes=500, keep=keep).awaitTermination()
        segments = sorted((p.parent.name, p) for p in (tmp_path / "log").glob("batch=*/segment=*/part-*"))
        return {name: [json.loads(line)["n"] for line in p.read_text().splitlines()] for name, p in segments}, [p.stat().st_size for _, p in segments]

    found, sizes = run(1, 100)
    assert [n for part in found.values() for n in part] == list(range(100, 200)) and all(s <= 500 + 30 for s in sizes) and len(sizes) > 3
    found, _ = run(2, 100)
    assert [n for part in found.values() for n in part] == list(range(100, 300))
    found, _ = run(3, 4)
    assert len(found) == 4 and [n for part in found.values() for n in part][-1] == 399
