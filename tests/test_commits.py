"""Batches that are run twice or cut off, streams of several batches, moved files, quiet times."""

import pytest

from tagloom.streaming import commits, ingest

BATCHES = [[("a", "m1"), ("b", "m1"), ("c", None), ("a", "m1")], [("d", "m1"), ("e", "m2"), ("f", "m3")], [], [("g", "m3"), ("h", "m4")]]


def frames(spark):
    return [spark.createDataFrame(b, "path string, md5 string") for b in BATCHES]


def state(ledger):
    return sorted(map(tuple, ledger.items().collect())), sorted(map(tuple, ledger.outcomes().collect()), key=repr)


@pytest.fixture(scope="module")
def want(spark, tmp_path_factory):
    ledger = commits.Ledger(spark, f"file://{tmp_path_factory.mktemp('plain')}")
    for n, b in enumerate(frames(spark)):
        ledger.arrive(b, n)
    found = state(ledger)
    assert found[0] == [("m1", "a"), ("m2", "e"), ("m3", "f"), ("m4", "h")]
    assert dict((p, o) for p, _, o in found[1]) == {"a": "success", "b": "race_condition", "c": "error", "d": "duplicate", "e": "success", "f": "success", "g": "duplicate", "h": "success"}
    return found


class Cut(Exception):
    pass


@pytest.mark.parametrize("stage", ["staged", "published", "marked"])
def test_runs_that_are_cut_off_and_repeated(spark, tmp_path, want, stage):
    ledger = commits.Ledger(spark, f"file://{tmp_path}")

    def cut(at):
        if at == stage:
            raise Cut

    for n, b in enumerate(frames(spark)):
        with pytest.raises(Cut):
            ledger.arrive(b, n, cut)
        seen = state(ledger)
        assert (n in ledger.committed()) == (stage == "marked")
        ledger.arrive(b, n)
        ledger.arrive(b, n)
        assert len(state(ledger)[1]) >= len(seen[1])
    assert state(ledger) == want


def test_a_stream_of_several_batches_that_starts_again(spark, tmp_path):
    for n, b in enumerate(frames(spark)):
        b.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ledger = commits.Ledger(spark, f"file://{tmp_path}/ledger")
        ledger.follow(ingest.event_stream(spark, str(tmp_path / "in"), "path string, md5 string", 1), str(tmp_path / "checkpoint"))
    items, arrivals = state(ledger)
    assert [m for m, _ in items] == ["m1", "m2", "m3", "m4"] and len(arrivals) == 8
    ledger.follow(ingest.event_stream(spark, str(tmp_path / "in"), "path string, md5 string", 1), str(tmp_path / "checkpoint"))
    assert state(ledger) == (items, arrivals)


def test_files_moved_between_listings(spark):
    before = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "3"), ("e", None), ("f", "4"), ("k", "5")], "path string, md5 string")
    after = spark.createDataFrame([("x/a", "1"), ("b", "9"), ("z", "3"), ("g", None), ("f", "4"), ("k", "5"), ("k2", "5")], "path string, md5 string")
    got = {tuple(r) for r in commits.folder_changes(before, after).collect()}
    assert got == {("moved", "x/a", "a"), ("changed", "b", "b"), ("moved", "z", "c"), ("removed", None, "d"), ("removed", None, "e"), ("created", "g", None), ("created", "k2", None)}
    assert commits.folder_changes(before.limit(0), after.limit(0)).count() == 0


def test_quiet_times_over_batches(spark, tmp_path):
    times = [[0, 1, 3, 6], [7, 8.5, 20], [100], [101, 400]]
    for n, part in enumerate(times):
        spark.createDataFrame([("p", 1000.0 + t) for t in part], "path string, s double").selectExpr("path", "timestamp_seconds(s) AS ts").coalesce(1).write.parquet(str(tmp_path / f"{n}"))
    stream = spark.readStream.schema("path string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "*"))
    runs = sorted((r.first.timestamp() - 1000, r["last"].timestamp() - 1000, r.n) for r in ingest.drain(ingest.settled(stream, "path", late="200 seconds")).collect())
    assert runs == [(0, 3, 3), (6, 8.5, 3), (20, 20, 1), (100, 101, 2)]
    passed = sorted(r.ts.timestamp() - 1000 for r in ingest.drain(ingest.throttled(stream, "path", late="200 seconds")).collect())
    assert passed == [0, 3, 6, 8.5, 20, 100, 400]
