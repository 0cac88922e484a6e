"""Rules, grants, patches and registry checks on small fixtures."""

import datetime as dt

from pyspark.sql import functions as F

import pytest

from repolith.functions.scalars import glob_regex
from repolith.operators import policy
from repolith.plans import registries


def test_rules(spark):
    commands = spark.createDataFrame([(1, "rm -rf x && git push"), (2, "echo 'rm -rf x'"), (3, "ls")], "id int, command string")
    rules = spark.createDataFrame(
        [
            ("rm", r"\brm\b", False, "fs", "deny", 1), ("rf", "-rf", False, "fs", "ask", 2),
            ("push", "push", False, "git", "ask", 3), ("echo", "rm", True, "raw", "warn", 4)
        ],
        "rule string, pattern string, raw boolean, grp string, decision string, ordinal int"
    )
    hits = policy.evaluate(commands, rules, ["fs"])
    assert sorted((r["id"], r["rule"]) for r in hits.collect()) == [(1, "echo"), (1, "push"), (1, "rm"), (2, "echo")]
    assert {r["id"]: r["decision"] for r in policy.strongest(hits).collect()} == {1: "deny", 2: "warn"}
    assert spark.range(1).select(policy.floor_irreversible(F.lit("allow"), F.lit(True)).alias("x")).first()["x"] == "ask"


def test_grants(spark):
    requests = spark.createDataFrame(
        [
            (1, "r", "s", "git push", ["src/a.py"]), (2, "r", "s", "git push; rm", ["src/a.py"]),
            (3, "r", "t", "git push", []), (4, "r", "t", "git push", ["src/a", "lib/b"])
        ],
        "request int, rule string, session string, command string, paths array<string>"
    )
    grants = spark.createDataFrame(
        [("any", "r", None, None, None), ("mine", "r", "s", "^git push", glob_regex("src/*"))],
        "grant string, rule string, session string, pattern string, path_regex string"
    )
    got = sorted((r["request"], r["grant"]) for r in policy.grants_for(requests, grants).collect())
    assert got == [(1, "any"), (1, "mine"), (2, "any"), (3, "any"), (4, "any")]


def test_patches_and_markers(spark):
    patch = "--- a/x.py\n+++ b/x.py\n@@\n+one\n-two\n+++ b/y.py\n+three"
    rows = policy.patch_additions(spark.createDataFrame([(1, patch)], "id int, patch string")).collect()
    assert [(r["path"], r["text"]) for r in rows] == [("x.py", "one"), ("y.py", "three")]
    told = [
        (1, "+before\n*** Add File: a b.py \n+in\n+++ c d.py\n+++ b/e\n++plus\nIndex: q\n+e", None, None, None), (2, "", "p.py", "x\ny\n", "whole"),
        (3, None, None, "n", "no path"), (4, "+only", "g.py", "", None),
    ]
    got = policy.patch_additions(spark.createDataFrame(told, "id int, patch string, path string, new_string string, content string"))
    assert sorted((r.id, r.path, r.text) for r in got.collect()) == [
        (1, "", "before"), (1, "a b.py", "in"), (1, "e", "+plus"), (1, "e", "e"), (2, "p.py", "whole"), (2, "p.py", "x"), (2, "p.py", "y"), (3, "", "n"),
        (4, "g.py", "only"),
    ]
    findings = spark.createDataFrame(
        [("x", "r", 1, 3), ("x", "r", 5, 5), ("y", "r", 1, 3)], "path string, rule string, start int, `end` int"
    )
    markers = spark.createDataFrame([("x", "r", 3), ("y", "other", 2)], "path string, rule string, line int")
    assert sorted((r["path"], r["start"]) for r in policy.suppress(findings, markers).collect()) == [("x", 5), ("y", 1)]


def test_tools_and_divergence(spark):
    tools = spark.createDataFrame(
        [("py", "a", "3.11", "3.9"), ("py", "b", None, "1"), ("js", "c", "1.9", "1.10"), ("go", "d", "2", "1.99")],
        "capability string, tool string, version string, least string"
    )
    calls = spark.createDataFrame(
        [("f", f"s{k}", ["timeout"] if k else []) for k in range(5)] + [("g", "s", ["x"])],
        "callee string, site string, options array<string>"
    )
    r = policy.divergence(calls).collect()
    assert [(x["callee"], x["option"], x["present"], x["stragglers"]) for x in r] == [("f", "timeout", 4, ["s0"])]


def test_registries(spark):
    paths = spark.createDataFrame([("a/b",), ("c",), ("d",), ("e/f",)], "path string")
    registry = spark.createDataFrame([("one", "a/", 1), ("two", "e/", 2), ("three", "e/", 3)], "owner string, prefix string, ordinal int")
    exempt = spark.createDataFrame([("c",), ("gone",)], "path string")
    assert {
        r["path"]: r["state"] for r in registries.dispositions(paths, registry, exempt).collect()
    } == {"a/b": "registered", "c": "exempt", "d": "uncovered", "e/f": "ambiguous"}
    assert [r["path"] for r in registries.stale_exemptions(exempt, paths).collect()] == ["gone"]


def test_decisions(spark):
    rows = [
        ("1", "accepted", "2024-01-01", None, [], [], "2"),
        ("2", "accepted", "2024-01-01", None, ["x"], ["1", "9", "3"], None),
        ("3", "odd", "24-1", None, ["x"], [], None), ("4", "proposed", "2024-01-01", None, [], [], None),
        ("5", "proposed", "2024-01-31", None, [], [], None)
    ]
    got = registries.decision_drift(
        spark.createDataFrame(
            rows,
            "id string, status string, date string, revisit string, embodied_by array<string>, supersedes array<string>, superseded_by string"
        ),
        "2024-03-01"
    )
    assert sorted((r["id"], r["message"]) for r in got.collect()) == [
        ("1", "accepted without embodiment"), ("2", "not superseded back by 3"), ("2", "supersedes unknown 9"),
        ("3", "bad status"), ("3", "malformed date"), ("4", "proposed too long")
    ]


def test_freshness_reviews_perimeter_ratchet(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    artifacts = spark.createDataFrame(
        [("x", t(5), ["a"]), ("y", t(5), ["b/c"]), ("z", t(5), ["none"])],
        "artifact string, written_at timestamp, scope array<string>"
    )
    commits = spark.createDataFrame([("a/q", t(6)), ("b/c/d", t(5)), ("b/x", t(9))], "path string, ts timestamp")
    assert {r["artifact"]: r["stale"] for r in registries.freshness(artifacts, commits).collect()} == {"x": True, "y": False, "z": False}
    findings = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "subject string, fingerprint string")
    decisions = spark.createDataFrame(
        [
            ("a", "1", "accepted", "2024", 1), ("b", "1", "accepted", "2024", 2), ("c", "3", "accepted", "2023", 3),
            ("c", "3", "fixed", "2024", 4)
        ],
        "subject string, fingerprint string, disposition string, recorded_at string, ordinal int"
    )
    assert {
        r["subject"]: r["state"] for r in registries.reviewed(findings, decisions).collect()
    } == {"a": "hidden", "b": "resurfaced", "c": "regression", "d": "new"}
    files = spark.createDataFrame(
        [("r", "py", 100), ("r", "go", 100), ("r", "js", 5), ("q", "go", 200)], "root string, language string, loc int"
    )
    cover = spark.createDataFrame([("py", "d1"), ("any", "d2")], "language string, detector string")
    accepted = spark.createDataFrame([("q", "go")], "root string, language string")
    assert {
        (r["root"], r["language"]): r["state"] for r in registries.perimeter(files, cover, accepted, 50).collect()
    } == {("r", "py"): "covered", ("r", "go"): "gap", ("r", "js"): "small", ("q", "go"): "accepted"}
    a, b = spark.createDataFrame(
        [("x", 3), ("y", 9), ("n", 1)], "id string, metric int"
    ), spark.createDataFrame([("x", 5), ("y", 8), ("g", 2)], "id string, metric int")
    assert {
        r["id"]: (r["state"], r["allowed"]) for r in registries.ratchet(a, b).collect()
    } == {"x": ("held", 3), "y": ("grown", 8), "n": ("new", 1), "g": ("gone", 2)}
    need, man = spark.createDataFrame([("t1",), ("t2",), ("t3",)], "token string"), spark.createDataFrame(
        [("t1", "p"), ("t2", "no")], "token string, path string"
    )
    assert {
        r["token"]: r["state"]
        for r in registries.tokens_present(need, man, spark.createDataFrame([("p",)], "path string")).collect()
    } == {"t1": "ok", "t2": "missing_file", "t3": "missing_token"}


def test_clone_clusters(spark):
    pairs = spark.createDataFrame([(k, k + 1) for k in range(1, 12)] + [(30, 31)], "a int, b int")
    got = {r["member"]: (r["cluster"], r["multiplicity"]) for r in registries.clone_clusters(pairs).collect()}
    assert got == {**{k: (1, 12) for k in range(1, 13)}, 30: (30, 2), 31: (30, 2)}


def test_clone_clusters_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501)], "a long, b long")
    got = registries.clone_clusters(pairs).collect()
    assert {(r["cluster"], r["multiplicity"]) for r in got} == {(0, 201), (500, 2)} and len(got) == 203


def test_dealt_parts_grow_with_the_input(spark, tmp_path):
    from repolith.session import PART_BYTES, dealt

    few = spark.range(10).withColumn("k", F.col("id") % 3)
    assert dealt(few, "k").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = spark.range(40 * PART_BYTES // 8)
    assert dealt(many, "id").rdd.getNumPartitions() >= 40


def test_divergence_of_calls_in_several_rows(spark):
    rows = [("f", 1, ["a"]), ("f", 1, ["b"]), ("f", 2, ["a"]), ("f", 3, None), ("f", 3, []), ("g", 1, ["a"]), ("g", 2, ["a"])]
    got = policy.divergence(spark.createDataFrame(rows, "callee string, site int, options array<string>"), 0.5).collect()
    assert [(x.callee, x.option, x.present, x.size, x.stragglers) for x in got] == [("f", "a", 2, 3, [3])]
