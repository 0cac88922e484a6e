"""Keyed states with timers, restarts from a checkpoint, replays, and streams joined in event time."""

import datetime as dt
import json

import pytest

from repolith.operators import detectors
from repolith.streaming import folds, leases

EVENTS = "rule_id string, kind string, at long, expires_at long, ordinal long, grant_id string, session_id string, uses int"


def put(folder, name, rows, schema):
    """One file of JSON lines; fields in the order of the schema."""
    folder.mkdir(exist_ok=True)
    fields = [f.split()[0] for f in schema.split(", ")]
    (folder / name).write_text("".join(json.dumps({k: v for k, v in zip(fields, r) if v is not None}) + "\n" for r in rows))


def run_leases(spark, tmp_path):
    out = []
    stream = leases.lease_stream(folds.log_stream(spark, str(tmp_path / "in"), EVENTS))
    folds.each_batch(stream, lambda b, _: out.extend(map(tuple, b.collect())), str(tmp_path / "cp")).awaitTermination()
    return sorted(out, key=lambda r: r[1])


def state(spark, tmp_path, operator, variable):
    read = spark.read.format("statestore").option("operatorId", operator).option("stateVarName", variable)
    return read.load(str(tmp_path / "cp"))


@pytest.fixture
def two_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_leases_over_restarts(spark, tmp_path, two_partitions):
    put(tmp_path / "in", "1.json", [
        ("r", "grant", 1, 50, 1, "g1", "s", None), ("q", "grant", 1, 500, 2, "g2", "s", None), ("q", "grant", 1, 500, 3, "g3", None, 2),
        ("silent", "grant", 2, 20, 4, "g4", "t", None), ("r", "request", 3, None, 5, None, "s", None), ("r", "request", 3, None, 6, None, "other", None),
    ], EVENTS)
    assert run_leases(spark, tmp_path) == [("r", 5, "g1"), ("r", 6, None)]
    assert state(spark, tmp_path, 0, "grants").select("key").distinct().count() == 3
    # a new run from the checkpoint: grants are still there, and the watermark passes the silent rule's expiry
    put(tmp_path / "in", "2.json", [("r", "request", 30, None, 7, None, "s", None), ("q", "request", 31, None, 8, None, "x", None)], EVENTS)
    assert run_leases(spark, tmp_path) == [("r", 7, "g1"), ("q", 8, "g3")]
    left = {r.key[0] for r in state(spark, tmp_path, 0, "grants").select("key").distinct().collect()}
    assert left == {"r", "q"}
    # one end, of whatever rule, takes the session's grants from all its rules
    put(tmp_path / "in", "3.json", [
        (None, "end", 32, None, 9, None, "s", None), ("r", "request", 33, None, 10, None, "s", None), ("q", "request", 33, None, 11, None, "s", None),
        ("q", "request", 34, None, 12, None, "s", None),
    ], EVENTS)
    assert run_leases(spark, tmp_path) == [("r", 10, None), ("q", 11, "g3"), ("q", 12, None)]
    assert state(spark, tmp_path, 0, "grants").count() == 0


def test_folded_entities(spark, tmp_path, two_partitions):
    schema = "id string, at timestamp, ordinal long, to_state string"
    intake = spark.createDataFrame([(k, "new") for k in "abcd"], "id string, state string")
    first = [("a", "2024-01-02T00:00:00", 1, "open"), ("b", "2024-01-02T00:00:00", 2, "open"), ("zz", "2024-01-02T00:00:00", 3, "open")]
    second = [("a", "2024-01-01T00:00:00", 4, "late"), ("b", "2024-01-02T00:00:00", 5, "done"), ("c", "2024-01-03T00:00:00", 6, "done")]
    batches = []

    def run():
        keep = folds.keep_batch(str(tmp_path / "out"))
        stream = folds.fold_stream(folds.log_stream(spark, str(tmp_path / "in"), schema), intake)
        folds.each_batch(stream, lambda b, n: (keep(b, n), keep(b, n), batches.append(n)), str(tmp_path / "cp"), "update").awaitTermination()

    put(tmp_path / "in", "1.json", first, schema)
    run()
    put(tmp_path / "in", "2.json", second, schema)
    run()
    rows = [(i, dt.datetime.fromisoformat(a), o, s) for i, a, o, s in first + second]
    want = detectors.fold_states(spark.createDataFrame(rows, schema), intake)
    found = folds.kept_states(spark, str(tmp_path / "out"), intake)
    assert len(batches) >= 2 and sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, found.collect())) == [("a", "open", 2), ("b", "done", 2), ("c", "done", 1), ("d", "new", 0)]


def test_claims_and_late_evidence(spark, tmp_path, two_partitions):
    schema = "id int, key string, at timestamp"
    claims = [(1, "k", "2024-01-01T12:00:00"), (2, "k", "2024-01-02T00:30:00"), (3, "other", "2024-01-01T12:00:00"), (4, None, "2024-01-01T12:00:00")]
    evidence = [(7, "k", "2024-01-01T00:00:00"), (8, "k", "2024-01-01T11:00:00"), (9, "k", "2024-01-01T12:00:01"), (9, "k", "2024-01-01T12:30:00")]
    put(tmp_path / "claims", "1.json", claims, schema)
    put(tmp_path / "evidence", "1.json", evidence, schema)
    out = []

    def run():
        streams = [folds.log_stream(spark, str(tmp_path / n), schema) for n in ("claims", "evidence")]
        stream = folds.backed_stream(streams[0], streams[1].select("key", "at"), ["key"], "id")
        folds.each_batch(stream, lambda b, _: out.extend(map(tuple, b.select("id", "backed").collect())), str(tmp_path / "cp")).awaitTermination()

    run()
    # far later rows move both watermarks on; evidence for claim 3 that comes only now is too late
    put(tmp_path / "claims", "2.json", [(5, "k", "2024-02-01T00:00:00")], schema)
    put(tmp_path / "evidence", "2.json", [(9, "k", "2024-02-01T00:00:00")], schema)
    run()
    put(tmp_path / "evidence", "3.json", [(9, "other", "2024-01-01T11:00:00")], schema)
    run()
    assert sorted(out) == [(1, True), (2, True), (3, False), (4, False), (5, True)]
    told = [r for r in out if r[0] == 3]
    assert told == [(3, False)]
