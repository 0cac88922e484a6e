"""Readers, sinks, gates, leases and facts of sources that no query covers."""

import json
import os

import pytest
from pyspark.sql import functions as F

from repolith.operators import facts, intervals, policy, symbols
from repolith.operators import relational as rel
from repolith.plans import audits, reports
from repolith.sources import logs, metadata, registries, sinks
from repolith.streaming import folds, leases


def test_file_tree_lists_before_it_reads(spark, tmp_path):
    (tmp_path / "a" / "skip").mkdir(parents=True)
    (tmp_path / "a" / "b c").mkdir()
    for name, text in (("a/x.py", "one\ntwo"), ("a/skip/y.py", "no"), ("a/b c/z+1.py", "three"), ("a/n.md", "no")):
        (tmp_path / name).write_text(text)
    os.symlink(tmp_path / "a" / "x.py", tmp_path / "a" / "link.py")
    os.symlink(tmp_path / "a" / "skip", tmp_path / "a" / "folder")
    got = {r.path: r.text for r in logs.file_tree(spark, str(tmp_path), "*.py", ["skip"]).collect()}
    assert got == {"a/x.py": "one\ntwo", "a/b c/z+1.py": "three"}
    assert {
        r.path for r in logs.file_tree(spark, str(tmp_path), "*.py", ["skip"], text=False, links=True).collect()
    } == {*got, "a/link.py", "a/folder/y.py"}
    assert logs.file_tree(spark, str(tmp_path), "*.none").count() == 0


def test_replace_json_and_write_valid(spark, tmp_path):
    path = str(tmp_path / "doc")
    for n in (1, 2):
        sinks.replace_json(spark.range(n), path)
        assert sinks.read_current(spark, path, "id long").count() == n
    assert sinks.read_current(spark, str(tmp_path / "none"), "id long").count() == 0
    # a write that fails before its rename, or comes to a number that is there, changes nothing for readers
    spark.range(9).write.json(f"{path}/.staged")
    assert sinks.read_current(spark, path, "id long").count() == 2
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.publish(spark, f"{path}/.staged", f"{path}/{sinks.versions(spark, path)[-1]}")
    assert sinks.read_current(spark, path, "id long").count() == 2
    sinks.replace_json(spark.range(3), path)
    assert sinks.versions(spark, path) == ["v000000000002", "v000000000003"] and sinks.read_current(spark, path, "id long").count() == 3
    rows = spark.createDataFrame([(1, "a"), (2, None)], "ordinal int, name string")
    errors = sinks.write_valid(rows, [("name", F.col("name").isNotNull(), "missing")], str(tmp_path / "log"))
    assert [tuple(r) for r in errors.collect()] == [(2, "name", "missing")] and spark.read.json(str(tmp_path / "log")).count() == 2


def test_reports_say_what_they_leave_out(spark):
    rows = spark.range(7).withColumn("t", F.lit("a|<b>"))
    assert sinks.markdown(rows, 5).endswith(
        "\n\n2 more rows.\n"
    ) and "more" not in sinks.markdown(rows, 7) and "a\\|<b>" in sinks.markdown(rows)
    assert "<p>2 more rows.</p>" in metadata.html_table(rows, "x", 5) and "more" not in metadata.html_table(rows, "x", 7)
    counts = metadata.attestation(rows.withColumn("k", F.col("id") % 3), ["k"])
    assert metadata.attestation_yaml(counts, "runs", 2) == "runs:\n  - k: 0\n    rows: 3\n  - k: 1\n    rows: 2\nomitted: 1\n"


def test_exit_status(spark):
    rows = spark.createDataFrame([("a", "unaccounted"), ("b", "grace")], "skill string, state string")
    assert audits.report(lambda: rows) == (1, "skill=a, state=unaccounted\n1 unaccounted")
    assert audits.report(lambda: rows, "nothing", "json") == (0, json.dumps({"status": 0, "rows": [], "omitted": 0}))
    status, text = audits.report(lambda: spark.table("no_such_table"))
    assert status == 2 and text.startswith("error: AnalysisException")
    assert audits.gate(rows) == 1 and audits.gate(rows, "none") == 0


def test_sections_stand_alone(spark):
    got = {r.section: (r.present, r.rows) for r in reports.sections(spark, {"a": lambda: spark.range(3), "b": lambda: 1 / 0}).collect()}
    assert got == {"a": (True, 3), "b": (False, None)}


def test_leases_look_at_commands_and_paths(spark, tmp_path):
    schema = "rule_id string, kind string, at long, expires_at long, ordinal long, grant_id string, session_id string, uses int, command_pattern string, path_regex string, command string, paths array<string>"
    rows = [
        ("r", "grant", 1, 90, 1, "g", "s", 1, "^git ", "^src/", None, None),
        ("r", "request", 2, None, 2, None, "s", None, None, None, "git push; rm x", ["src/a"]),
        ("r", "request", 3, None, 3, None, "s", None, None, None, "git push", ["src/a", "doc/b"]),
        ("r", "request", 4, None, 4, None, "s", None, None, None, "git push", []),
        ("r", "request", 5, None, 5, None, "other", None, None, None, "git push", ["src/a"]),
        ("r", "request", 6, None, 6, None, "s", None, None, None, "git push", ["src/a"]),
        ("r", "request", 7, None, 7, None, "s", None, None, None, "git push", ["src/a"]),
    ]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    got = []
    out = leases.lease_stream(folds.log_stream(spark, str(tmp_path / "in"), schema))
    folds.each_batch(out, lambda b, _: got.extend(map(tuple, b.collect())), str(tmp_path / "cp")).awaitTermination()
    assert sorted((o, g) for _, o, g in got) == [(2, None), (3, None), (4, None), (5, None), (6, "g"), (7, None)]


def test_equal_items_stay_apart(spark):
    items = spark.createDataFrame([("f", 2, 3)] * 2 + [("f", 9, 9)], "path string, start int, end int")
    spans = spark.createDataFrame(
        [("f", 1, 5, "outer"), ("f", 2, 4, "inner"), ("f", 9, 8, "none")],
        "path string, start int, end int, name string"
    )
    assert sorted(
        (r.start, r.name) for r in intervals.containing(items, spans, ["path"], "name").collect()
    ) == sorted([(2, "inner")] * 2 + [(9, None)], key=str)


def test_rules_are_counted(spark):
    rules = spark.range(5).select(F.col("id").cast("string").alias("rule"))
    assert rel.small(rules, 5).count() == 5
    with pytest.raises(ValueError):
        rel.small(rules, 4)


def test_unreadable_documents(spark):
    files = spark.createDataFrame(
        [("a", "---\nx: 1\n---\n"), ("b", "---\n no\n---\n"), ("c", None), ("d", "---\n---\nbody")],
        "path string, text string"
    )
    got = {r.path: (r.metadata, r.has_frontmatter, r.error is None) for r in registries.documents(files).collect()}
    assert got["a"] == ('{"x": 1}', True, True) and not got["b"][2] and got["c"] == ("{}", False, True)
    with pytest.raises(ValueError, match="unreadable: b, c"):
        registries.catalog(files.filter("path <> 'd'"), ["x"])


def test_facts_of_no_or_broken_source(spark):
    files = spark.createDataFrame(
        [("a.py", None), ("b.py", ""), ("c.py", "def ("), ("d.py", "class A:\n    def __init__(self): pass\n    def m(self): self.n()\n")],
        "path string, text string"
    )
    assert [(r.path, r.qualified_name) for r in facts.definitions(files).orderBy("line").collect()] == [("d.py", "A"), ("d.py", "A.m")]
    assert [(r.caller, r.callee_name, r.call_style) for r in facts.call_edges(files).collect()] == [("d.py::A.m", "n", "self")]
    assert facts.handler_blocks(files).count() == facts.patterns(files).count() == 0


def test_own_predicates_take_the_place_of_others(spark):
    lines = spark.createDataFrame(
        [("p", "a.py", 1, "breakpoint()"), ("p", "a.txt", 2, "x")], "id string, path string, line int, text string"
    )
    assert [r.predicate for r in policy.patch_findings(lines).collect()] == ["debugger"]
    assert [
        (r.line, r.predicate)
        for r in policy.patch_findings(lines, {"debugger": lambda: F.col("text") == "x"}).collect()
    ] == [(2, "debugger")]


def test_sources_of_one_part_come_to_many_tasks(spark):
    files = spark.range(200).selectExpr("concat('m', id, '.py') AS path", "concat('def f', id, '(): pass') AS text").coalesce(1)
    plan = facts.definitions(files)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    script = symbols.extract_script(files)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in script and facts.definitions(files).count() == 200
