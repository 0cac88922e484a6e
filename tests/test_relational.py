"""Operators of the audits on small fixtures, with ties, boundaries and nulls."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from repolith.functions import scalars
from repolith.operators import calls, graph, intervals, matching, relational as rel, symbols
from repolith.plans import audits
from repolith.sources import logs, sinks
from repolith.streaming import folds, leases


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scalars(spark):
    assert one(
        spark, F.lit("a/b/c.py").rlike(scalars.glob_regex("a/*.py"))
    ) and not one(spark, F.lit("A/b.py").rlike(scalars.glob_regex("a/*")))
    assert one(spark, F.lit("src/x").rlike(scalars.glob_regex("src/")))
    assert one(spark, scalars.version_key(F.lit("3.11"))) == [3, 11, 0, 0]
    assert one(spark, scalars.version_key(F.lit("v3.9")) < scalars.version_key(F.lit("3.11.0")))
    now = F.to_timestamp(F.lit("2024-03-10 12:00:00"))
    assert one(spark, scalars.elapsed_days(scalars.iso_timestamp(F.lit("2024-03-08T13:00:00Z")), now)) == 1
    assert one(spark, scalars.elapsed_days(scalars.iso_timestamp(F.lit("2024-03-11T13:00:00Z")), now)) == -1
    assert one(spark, scalars.floored_days(scalars.iso_timestamp(F.lit("2024-03-11T13:00:00Z")), now)) == 0
    assert one(spark, scalars.iso_timestamp(F.lit("nonsense"))) is None
    assert one(
        spark, scalars.calendar_days(F.lit(None).cast("string"), now)
    ) == 10**6 and one(spark, scalars.calendar_days(F.lit("bad"), now)) == 0
    assert [
        one(spark, scalars.duration_seconds(F.lit(x))) for x in ("14d", "12h", "30m", "0d", "5w", "99d")
    ] == [14 * 86400, 43200, 1800, None, None, None]
    assert one(spark, scalars.percentage(F.lit(1), F.lit(0))) is None
    assert one(spark, scalars.normal_path(F.lit("a/./b/../c"))) == "a/c" and one(spark, scalars.normal_path(F.lit("../x"))) is None
    assert one(spark, scalars.ancestors(F.lit("a/b/c"))) == ["a/b/c", "a/b", "a"]
    assert one(spark, scalars.redact(F.lit("token=abc  rest"), ["token=\\S+"])) == "[redacted] rest"


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "ts": "x"}\n\nnot json\n[1]\n{"id": 2}\n')
    rows = logs.read_jsonl(spark, str(tmp_path), "id long, ts string").orderBy("ordinal").collect()
    assert [(r["ordinal"], r["bad"], r["id"]) for r in rows] == [(1, False, 1), (3, True, None), (4, True, None), (5, False, 2)]
    copies = [
        spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "ordinal int, k string, v int"),
        spark.createDataFrame([(1, "a", 9)], "ordinal int, k string, v int")
    ]
    assert sorted((r["k"], r["v"]) for r in logs.union_copies(copies, ["k"]).collect()) == [("a", 1), ("b", 2)]
    errors = logs.validate(spark.createDataFrame([(1, None), (2, 5), (3, 50)], "ordinal int, n int"), [("n", F.col("n") < 10, "too large")])
    assert sorted(r["ordinal"] for r in errors.collect()) == [1, 3]
    (tmp_path / "doc.json").write_text(json.dumps({"entries": {"p": {"loc": 3}}}))
    assert logs.read_keyed(spark, str(tmp_path / "doc.json"), "loc int").first()["loc"] == 3


def test_front_matter_and_tree(spark, tmp_path):
    (tmp_path / "skip").mkdir()
    (tmp_path / "a.md").write_bytes("\ufeff---\r\ntitle: \"T: x\"\r\ntags: [a, 'b']\r\n---\r\nbody\r\n".encode())
    (tmp_path / "skip" / "b.md").write_text("no")
    (tmp_path / "c.md").write_text("plain")
    files = logs.file_tree(spark, str(tmp_path), "*.md", ["skip"])
    got = {r["path"]: r for r in logs.front_matter(files).collect()}
    assert set(got) == {"a.md", "c.md"}
    assert got["a.md"]["metadata"]["title"] == "T: x" and got["a.md"]["lists"]["tags"] == ["a", "b"] and got["a.md"]["body"] == "body\n"
    assert not got["c.md"]["has_frontmatter"] and got["c.md"]["body"] == "plain"


def test_owner_ties(spark):
    items = spark.createDataFrame([("a/b/c",), ("a/x",), ("ab",), ("z",)], "path string")
    registry = spark.createDataFrame(
        [("one", "a/", 1), ("two", "a/b", 2), ("three", "a/b/", 3)], "owner string, prefix string, ordinal int"
    )
    assert {r["path"]: r["owner"] for r in rel.owner(items, registry).collect()} == {"a/b/c": "three", "a/x": "one", "ab": None, "z": None}
    again = registry.union(spark.createDataFrame([("four", "./a/b/", 4)], registry.schema))
    assert {r["path"]: r["owner"] for r in rel.owner(items, again, ties="all").collect()}["a/b/c"] == ["four", "three"]


def test_latest_keeps_first_of_equal_times(spark):
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame(
        [("k", t, 2, "b"), ("k", t, 1, "a"), ("k", None, 0, "n"), ("m", None, 3, "only")],
        "key string, ts timestamp, ordinal int, v string"
    )
    assert sorted((r["v"], r["superseded"]) for r in rel.latest(rows, ["key"], "ts", "ordinal").collect()) == [("a", 2), ("only", 0)]


def test_intervals(spark):
    spans = spark.createDataFrame([("f", 1, 10, "outer"), ("f", 4, 6, "inner")], "path string, start int, `end` int, owner string")
    hits = spark.createDataFrame([("f", 5, 5), ("f", 9, 9), ("f", 11, 11), ("g", 5, 5)], "path string, start int, `end` int")
    assert {
        (r["path"], r["start"]): r["owner"] for r in intervals.containing(hits, spans, ["path"], "owner").collect()
    } == {("f", 5): "inner", ("f", 9): "outer", ("f", 11): None, ("g", 5): None}
    assert sorted(r["start"] for r in intervals.overlapping(hits, spans, ["path"]).collect()) == [5, 9]
    parts = spark.createDataFrame([("f", 1, 3), ("f", 2, 2), ("f", 4, 5), ("f", 8, 9)], "path string, start int, `end` int")
    assert [(r["gap_start"], r["gap_end"]) for r in intervals.gaps(parts, ["path"]).collect()] == [(6, 7)]


def test_calls_and_imports(spark):
    defs = spark.createDataFrame(
        [("A.run", "run", "a.py", "A"), ("B.run", "run", "b.py", "B"), ("help", "help", "a.py", None)],
        "qualified_name string, name string, file string, parent_class string"
    )
    edges = spark.createDataFrame(
        [
            ("a.py::A.go", "run", "self", "a.py", "A"), ("a.py::main", "x.help", None, "a.py", None),
            ("a.py::help", "help", None, "a.py", None), ("c.py::main", "run", None, "c.py", None)
        ],
        "caller string, callee_name string, call_style string, caller_file string, caller_class string"
    )
    assert sorted(tuple(r) for r in calls.resolve_calls(edges, defs).collect()) == [
        ("a.py::A.go", "a.py::A.run"), ("a.py::main", "a.py::help"), ("c.py::main", "a.py::A.run"), ("c.py::main", "b.py::B.run")
    ]
    specs = spark.createDataFrame(
        [("m.py", "x", ["x.py", "x/i.py"]), ("m.py", "y", ["no.py"]), ("m.py", "z", ["no.py"])],
        "importer string, spec string, candidates array<string>"
    )
    files = spark.createDataFrame([("x/i.py",), ("x.py",)], "path string")
    aliases = spark.createDataFrame([("y", "y1.py"), ("z", "z1.py"), ("z", "z2.py")], "spec string, path string")
    assert sorted(tuple(r) for r in rel.resolve_imports(specs, files, aliases).collect()) == [("m.py", "x", "x.py"), ("m.py", "y", "y1.py")]


def test_depths(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(10)] + [(3, 0), (0, 2), (5, 5)], "src long, dst long")
    got = {r["node"]: r["depth"] for r in graph.shortest_depths(edges, spark.range(1).select(F.col("id").alias("node")), 8).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3, 5: 4, 6: 5, 7: 6, 8: 7, 9: 8}


def test_diff_census_grade_ties(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "id string"), spark.createDataFrame([("y",), ("z",)], "id string")
    assert {r["id"]: r["state"] for r in rel.manifest_diff(a, b, ["id"]).collect()} == {"x": "fixed", "y": "persisting", "z": "new"}
    rows = spark.createDataFrame([("g", "b"), ("g", "a"), ("g", None)], "grp string, v string")
    assert sorted(
        (r["v"], r["share"], r["majority"]) for r in rel.census(rows, ["grp"], "v").collect()
    ) == [("a", 0.5, True), ("b", 0.5, False)]
    planted = spark.createDataFrame(
        [("p1", "f", 1, 1), ("p2", "f", 1, 2), ("p3", "f", 3, 3)], "id string, file string, line int, ordinal int"
    )
    found = spark.createDataFrame([("a", "f", 1, 1), ("b", "f", 4, 2)], "id string, file string, line int, ordinal int")
    r = matching.grade(planted, found).first()
    assert (r["tp"], r["fp"], r["fn"], r["precision"], r["verdict"]) == (1, 1, 2, 0.5, "fail")
    assert {(r["finding"], r["instance"]) for r in matching.match_findings(planted, found, 3).collect()} == {("a", "p1"), ("b", "p2")}
    assert matching.grade(planted, found, 3).first()["recall"] == 2 / 3
    assert matching.grade(planted.limit(0), found.limit(0)).first()["recall"] == 1.0
    s = spark.createDataFrame([(1,), (2,), (2,), (3,)], "n int")
    assert sorted(r["n"] for r in rel.top_ties(s, "n", 2).collect()) == [2, 2, 3]


def test_symbols(spark):
    src = "class A:\n    @property\n    def p(self): return 1\n    def run(self, x):\n        return x + 1\n\ndef run(y, z):\n    return y\n"
    other = "def run(a):\n    return a + 2\n"
    files = spark.createDataFrame([("a.py", src), ("b.py", other), ("bad.py", "def (")], "path string, text string")
    found = symbols.extract_python(files)
    rows = {(r["path"], r["qualified_name"]): r for r in found.collect()}
    assert rows["a.py", "A.run"]["has_self"] and rows["a.py", "A.run"]["arity"] == 2 and rows["bad.py", None]["kind"] == "unparsed"
    assert rows["a.py", "A.run"]["digest"] == rows["b.py", "run"]["digest"] != rows["a.py", "run"]["digest"]
    assert [(r["name"], r["definitions"], r["verdict"]) for r in symbols.name_audit(found).collect()] == [("run", 3, "shadow")]
    text = "import a\nfunction f() {\n}\nclass C {}\nconst k = 3\nconst g = (a, b) => a\nlet h = async x => x\n  function no() {}\nwindow.N = {}\ntype T = 1\n"
    js = spark.createDataFrame([("x.ts", text)], "path string, text string")
    got = [(r["name"], r["kind"], r["line"], r["end_line"], r["loc"]) for r in symbols.extract_script(js).orderBy("line").collect()]
    assert got == [
        ("f", "function", 2, 3, 2), ("C", "class", 4, 5, 2), ("g", "function", 6, 6, 1), ("h", "function", 7, 8, 2),
        ("N", "function", 9, 10, 2)
    ]


def test_triage(spark):
    scans = spark.createDataFrame(
        [
            ("s1", "i1", "2024-01-01T00:00:00Z", "t", 3, 1), ("s1", "i2", "2024-02-01T00:00:00Z", "t", 0, 2),
            ("s2", "i3", "2024-03-03T12:00:00Z", "t", 1, 3), ("s3", "i4", "bad", "t", 2, 4),
            ("s4", "i5", "2024-01-01T00:00:00Z", "t", 1, 5)
        ],
        "skill string, scan_id string, ts string, target string, findings_total int, ordinal int",
    )
    findings = spark.createDataFrame([("i5", "s4", "2023-01-01T00:00:00Z")], "source_scan string, source_skill string, created_at string")
    dismissals = spark.createDataFrame([(None, None, "s9", None)], "source_scan string, scan_id string, skill string, ts string")
    got = audits.triage(scans, findings, dismissals, "2024-03-10 12:00:00")
    assert {r["skill"]: r["state"] for r in got.collect()} == {
        "s1": "unaccounted", "s2": "grace", "s3": "unaccounted", "s4": "acknowledged"
    }
    assert audits.gate(got) == 1 and audits.gate(got.filter("state = 'grace'")) == 0


def test_ledger_and_coverage(spark):
    schema = "path string, last_reviewed string, loc int, decision string, after_days int, after_loc_delta int"
    ledger = spark.createDataFrame([("a", "2024-01-01", 10, "keep", None, None), ("b", "2024-03-01", 10, "keep", None, 5)], schema)
    metrics = spark.createDataFrame([("b", 15), ("d", 500)], "path string, loc int")
    assert [r["path"] for r in audits.drift_scan(metrics, ledger, 100).collect()] == ["d"]
    items = spark.createDataFrame([("s", "1", "done"), ("s", "2", "done"), ("s", "3", "open")], "spec string, item string, status string")
    refs = spark.createDataFrame([("s", "1", "x"), ("s", "3", "y"), ("s", "9", "z")], "spec string, item string, path string")
    assert {
        r["item"]: r["buckets"] for r in audits.coverage(items, refs).collect()
    } == {"1": ["covered"], "2": ["unproven"], "3": ["ahead"], "9": ["orphan"]}
    events = spark.createDataFrame(
        [("2024-03-01T00:00:00Z", "r", "deny"), ("2023-03-01T00:00:00Z", "r", "allow")],
        "timestamp string, rule_id string, decision string"
    )
    assert {r["decision"]: r["n"] for r in audits.friction(events, "2024-03-15 00:00:00").collect()} == {"allow": 0, "ask": 0, "deny": 1}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("k", 1, 1, "a"), ("k", 2, 2, "b")], "key string, at int, ordinal int, v string")
    got = sinks.latest_with_history(rows, ["key"], "at").first()
    assert got["v"] == "b" and [h["v"] for h in got["history"]] == ["a"]
    sinks.append_jsonl(rows, str(tmp_path / "log"))
    sinks.append_jsonl(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    assert sinks.drift(rows, rows).count() == 0 and sinks.drift(rows, rows.limit(1)).count() == 1
    assert sinks.markdown(rows.orderBy("at")).splitlines()[2] == "| k | 1 | 1 | a |"
    many = spark.range(10).select(F.lit("f").alias("source_file"), F.col("id").alias("ordinal"))
    assert sorted(r["ordinal"] for r in sinks.trim_log(many, 5, 3).collect()) == [7, 8, 9] and sinks.trim_log(many, 10, 3).count() == 10


def test_leases(spark, tmp_path):
    rows = [
        ("r", "grant", 1, 1, "g1", 100, "s", 1), (
            "r", "request", 2, 2, None, None, "s", None
        ), ("r", "request", 3, 3, None, None, "s", None),
        ("q", "grant", 1, 4, "g2", 5, None, None), (
            "q", "request", 5, 5, None, None, "t", None
        ), ("q", "request", 6, 6, None, None, "t", None),
        ("p", "grant", 1, 7, "g3", 100, "s", None), ("p", "end", 2, 8, None, None, "s", None), (
            "p", "request", 3, 9, None, None, "s", None
        ),
    ]
    schema = "rule_id string, kind string, at long, ordinal long, grant_id string, expires_at long, session_id string, uses int"
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    out = leases.lease_stream(folds.log_stream(spark, str(tmp_path / "in"), schema))
    got = []
    folds.each_batch(out, lambda b, _: got.extend(map(tuple, b.collect())), str(tmp_path / "cp")).awaitTermination()
    assert sorted(got, key=lambda r: r[1]) == [("r", 2, "g1"), ("r", 3, None), ("q", 5, "g2"), ("q", 6, None), ("p", 9, None)]


@pytest.mark.parametrize("n", [0, 3])
def test_flags_and_mentions(spark, n):
    rows = spark.range(3).select(F.col("id").alias("k"))
    got = rel.flags(rows, {"odd": (rows.filter("k % 2 = 1"), ["k"])}).filter("odd").collect()
    assert [r["k"] for r in got] == [1]
    texts = spark.createDataFrame([(1, "Aa bb aa"), (2, "aa")], "id int, t string")
    terms = spark.createDataFrame([("aa",), ("zz",)], "term string")
    assert {r["term"]: (r["n"], r["hits"]) for r in rel.mentions(texts, terms, "id", "t").collect()} == {"aa": (2, 3), "zz": (0, 0)}


def test_bounded_reach_over_all_line_items(spark):
    from repolith import catalog

    line = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_partkey", "l_suppkey").collect()
    steps, depth, front = {}, {1: 0}, [1]
    for p, s in line:
        steps.setdefault(p, set()).add(-s)
        steps.setdefault(-s, set()).add(p)
    for k in range(1, 9):
        front = sorted({y for x in front for y in steps.get(x, ())} - depth.keys())
        depth |= dict.fromkeys(front, k)
    got = {(r["node"], r["depth"]) for r in catalog.QUERIES["bounded_reach"](spark, "/root/testdata/sf0.001").collect()}
    assert got == set(depth.items())


def test_term_mentions_of_all_items(spark):
    import re
    from collections import Counter

    from repolith import catalog

    d = "/root/testdata/sf0.001"
    find = lambda text: re.findall("[a-z]+", (text or "").lower())
    terms = {t for r in spark.read.parquet(f"{d}/benchmark.parquet").select("text").collect() for t in find(r["text"])}
    n, hits = Counter(), Counter()
    for r in spark.read.parquet(f"{d}/documents.parquet").select("text").collect():
        words = find(r["text"])
        hits.update(words)
        n.update(set(words))
    got = sorted(tuple(r) for r in catalog.QUERIES["term_mentions"](spark, d).collect())
    assert got == sorted((t, n[t], hits[t]) for t in terms)
