"""Two writers, replays, checkpoints and intents that are read back after a crash."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from assetloom.operators import catalog
from assetloom.sources.commits import CommitLog, Conflict


def rows(spark, *values):
    return spark.createDataFrame(list(values), "id string, name string, n long")


def content(log, version=None):
    return {r["id"]: (r["name"], r["n"]) for r in log.state(version).collect()}


def test_commits_are_replayed(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "t"), ["id"])
    assert log.version() == 0 and log.state() is None
    assert log.commit(0, rows(spark, ("a", "one", 1), ("b", "two", 2))) == 1
    assert log.commit(1, rows(spark, ("a", "uno", 3)), rows(spark, ("b", None, None))) == 2
    assert content(log) == {"a": ("uno", 3)} and content(log, 1) == {"a": ("one", 1), "b": ("two", 2)}
    assert log.checkpoint() == 3 and content(log) == {"a": ("uno", 3)}
    assert log.commit(3, rows(spark, ("b", "new", 4))) == 4 and content(log) == {"a": ("uno", 3), "b": ("new", 4)}
    assert content(CommitLog(spark, str(tmp_path / "t"), ["id"]), 1) == {"a": ("one", 1), "b": ("two", 2)}
    with pytest.raises(ValueError, match="twice"):
        log.commit(4, rows(spark, ("c", "x", 1), ("c", "y", 1)))


def test_of_two_writers_one_loses(spark, tmp_path):
    one, two = (CommitLog(spark, str(tmp_path / "t"), ["id"]) for _ in range(2))
    one.commit(0, rows(spark, ("a", "one", 1), ("b", "two", 2)))
    base = two.version()
    assert one.commit(base, rows(spark, ("a", "first", 1))) == 2
    with pytest.raises(Conflict):
        two.commit(base, rows(spark, ("a", "second", 2)))
    assert two.commit(base, rows(spark, ("b", "other row", 2))) == 3  # what it changes nobody else did
    assert content(one) == {"a": ("first", 1), "b": ("other row", 2)}
    assert two.commit(3, rows(spark, ("a", "second", 2))) == 4


def test_many_writers_at_once(spark, tmp_path):
    """Everyone raises the same counter from the version that it read; each raise is kept or refused, none is lost."""
    root = str(tmp_path / "t")
    CommitLog(spark, root, ["id"]).commit(0, rows(spark, ("n", "count", 0)))

    def work(k):
        log, done = CommitLog(spark, root, ["id"]), 0
        for _ in range(2):
            base = log.version()
            try:
                log.commit(base, rows(spark, ("n", "count", content(log, base)["n"][1] + 1)))
                done += 1
            except Conflict:
                pass
            log.commit(log.version(), rows(spark, (f"own{k}", "mine", k)))
        return done

    with ThreadPoolExecutor(4) as pool:
        done = sum(pool.map(work, range(4)))
    found = content(CommitLog(spark, root, ["id"]))
    assert found["n"] == ("count", done) and done >= 1 and {k for k in found if k != "n"} == {f"own{k}" for k in range(4)}
    numbers = sorted(CommitLog(spark, root, ["id"])._entries())
    assert numbers == list(range(1, len(numbers) + 1))


def test_intents_survive_a_crash(spark, tmp_path):
    """A move is written down before it is made; after a crash the journal and the files tell what became of it."""
    journal = CommitLog(spark, str(tmp_path / "j"), ["token"])
    schema = "token string, original_path string, quarantined_path string, state string"
    moving = [(f"t{k}", f"/m/{k}", f"/q/{k}", "moving") for k in range(3)]
    journal.commit(0, spark.createDataFrame(moving, schema))
    journal.commit(1, spark.createDataFrame([(*moving[0][:3], "quarantined")], schema))
    # The process ends here: the second file has been moved, the third hasn't, and neither is told in the journal.
    found = CommitLog(spark, str(tmp_path / "j"), ["token"])
    files = spark.createDataFrame([("/q/0",), ("/q/1",), ("/m/2",)], "path string")
    after = catalog.recovered(found.state(), files)
    found.commit(found.version(), after.where("state = 'quarantined'"), after.where("state = 'reverted'"))
    assert {r["token"]: r["state"] for r in found.state().collect()} == {"t0": "quarantined", "t1": "quarantined"}
