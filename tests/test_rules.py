"""Rules stated row by row: expected rows come from the rules, not from the code; random input is compared with plain loops."""

import os
import random
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from repolith import session
from repolith.operators import calls, chunks, facts, intervals, ledgers, matching, policy
from repolith.operators import relational as rel
from repolith.plans import audits, reports


def got(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# review of a ledger


def test_review_bounds(spark):
    schema = "path string, last_reviewed string, decision string, loc int, after_days int, after_loc_delta int"
    ledger = spark.createDataFrame(
        [
            ("old", "2024-01-01", "keep", 10, None, None), ("own_age", "2024-03-21", "keep", 10, 10, None),
            ("never", None, "keep", 10, None, None), ("unreadable", "soon", "keep", 10, 1, None),
            ("grown", "2024-03-30", "keep", 100, None, 50), ("no_prior", "2024-03-30", None, None, None, 30),
            ("queued", None, "split_queued", 9999, 1, 1), ("large", "2024-03-30", "keep", 1000, None, None),
            ("shrunk", "2024-03-30", "keep", 100, None, -60), ("quiet", "2024-03-30", "keep", 10, 400, 400),
        ],
        schema,
    )
    metrics = spark.createDataFrame([("grown", 150), ("no_prior", 30), ("shrunk", 41), ("quiet", 12)], "path string, loc int")
    rows = audits.needs_review(ledger, metrics, "2024-03-31", days=90, least=1000, growth=50).collect()
    assert [(r.path, r.current_loc, r.prior_loc, r.loc_delta, r.reasons) for r in rows] == [
        ("large", 1000, 1000, 0, ["loc=1000>=1000"]),
        ("grown", 150, 100, 50, ["per-entry delta=50>=50", "growth=50%>=50%"]),
        ("shrunk", 41, 100, -59, ["per-entry delta=-59>=-60"]),
        ("no_prior", 30, 0, 30, ["per-entry delta=30>=30"]),
        ("never", 10, 10, 0, ["age=1000000d>=90d"]),
        ("old", 10, 10, 0, ["age=90d>=90d"]),
        ("own_age", 10, 10, 0, ["per-entry age=10d>=10d"]),
    ]
    none = audits.needs_review(ledger, metrics, "2024-03-31")
    assert {r.path for r in none.collect()} == {"own_age", "grown", "no_prior", "shrunk"}  # without a bound of the caller, only their own


# capabilities, commands, violations, owners


def test_capabilities(spark):
    tools = spark.createDataFrame(
        [
            ("all", "a", "3.11", "3.9"), ("all", "b", "2", "2"), ("old", "a", "1.9", "1.10"), ("gone", "a", None, "1"),
            ("mixed", "a", "3.9", "3.9"), ("mixed", "b", "1", "2"), ("absent", "a", "2", "1"), ("both", "a", None, "1"), ("both", "b", "0", "1"),
        ],
        "capability string, tool string, version string, least string",
    )
    projects = spark.createDataFrame([(x,) for x in ("all", "all", "old", "mixed", "none")], "capability string")
    assert got(policy.tool_status(tools, projects), "capability", "status", "reasons") == [
        ("absent", "limited", ["project-metadata-unavailable"]),
        ("all", "available", []),
        ("both", "limited", ["partial-toolchain", "project-metadata-unavailable"]),
        ("gone", "unavailable", ["toolchain-unavailable", "project-metadata-unavailable"]),
        ("mixed", "limited", ["partial-toolchain"]),
        ("old", "too-old", ["toolchain-too-old"]),
    ]


def test_command_classes(spark):
    rows = [
        ("list-all", "yes", "action"), ("list", "no", "query"), ("mystery", "no", "query"), ("mystery", "flag-gated", "query"),
        ("prune", "no", "action"), ("Prune-x", "flag-gated", "action"), ("list", "unknown", "query"), ("mystery", "unknown", "unclassified"),
        ("mystery", None, "unclassified"), ("show-run", None, "query"), ("run-show", None, "action"),
    ]
    frame = spark.createDataFrame(rows, "name string, effect string, want string")
    assert all(r.kind == r.want for r in frame.withColumn("kind", ledgers.verb_class(F.col("name"), F.col("effect"))).collect())


def test_violation_lines(spark):
    texts = [
        "a.py:1:2: bare-delay: told", "a.py:9:0: bare-delay: see # noqa: silent: x", "b.py:1:2: bare-delay", "b.py:1: bare-delay: no column",
        "a:b.py:1:2: bare-delay: three colons", "no colon at all", "c.py:1:2: bare-delay-more: x", "", None,
    ]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    assert got(reports.tag_hits(frame, ["bare-delay", "silent"]), "tag", "hits", "files") == [("bare-delay", 3, 2), ("silent", 0, 0)]
    assert got(reports.violations(frame), "path", "tag")[-1] == ("c.py", "bare-delay-more")


def test_prefix_owners(spark):
    registry = spark.createDataFrame(
        [("dir", "src/", 1), ("deep", "./src/a/", 2), ("file", "src/a/x.py", 3), ("bare", "lib", 4), ("again", "src/a/", 5)],
        "owner string, prefix string, ordinal int",
    )
    paths = ["src/b.py", "./src/a/y.py", "src/a/x.py", "lib/z.py", "lib", "srcs/b.py", "src", None]
    rows = rel.owner(spark.createDataFrame([(p,) for p in paths], "path string"), registry)
    assert {r.path: r.owner for r in rows.collect()} == {
        "src/b.py": "dir", "./src/a/y.py": "deep", "src/a/x.py": "file", "lib/z.py": None, "lib": "bare", "srcs/b.py": None, "src": None, None: None,
    }
    both = rel.owner(spark.createDataFrame([("src/a/y.py",)], "path string"), registry, ties="all")
    assert both.first().owner == ["again", "deep"]


# calls


def test_call_graph_by_file(spark):
    module = "def run():\n    pass\n\ndef main():\n    {}()\n"
    files = {"a.py": "def run():\n    other()\n", "b.py": "def run():\n    pass\ndef other():\n    pass\n", "c.py": module.format("run"), "d.py": module.format("other")}
    frame = spark.createDataFrame(list(files.items()), "path string, text string")
    edges = facts.call_edges(frame).withColumn("caller_file", F.col("path"))
    defs = facts.definitions(frame).withColumnRenamed("path", "file")
    assert got(calls.resolve_calls(edges, defs), "caller", "callee") == [
        ("a.py::run", "b.py::other"), ("c.py::main", "a.py::run"), ("c.py::main", "b.py::run"), ("c.py::main", "c.py::run"),
        ("c.py::main", "d.py::run"), ("d.py::main", "b.py::other"),
    ]


def test_own_methods_come_first(spark):
    defs = spark.createDataFrame(
        [("C.go", "go", "a.py", "C"), ("C.go", "go", "b.py", "C"), ("C.far", "far", "b.py", "C"), ("D.only", "only", "a.py", "D"), ("x.y", "y", "z.py", "x"), ("y", "y", "w.py", None)],
        "qualified_name string, name string, file string, parent_class string",
    )
    asked = [
        ("a.py::C.m", "go", "self", "a.py", "C"), ("a.py::C.m", "far", "self", "a.py", "C"), ("a.py::C.m", "only", "self", "a.py", "C"),
        ("a.py::f", "go", "self", "a.py", None), ("a.py::g", "x.y", "attribute", "a.py", None), ("a.py::h", "q.y", "attribute", "a.py", None),
        ("a.py::i", "y", "name", "a.py", None), ("a.py::j", "q.nothing", None, "a.py", None),
    ]
    edges = spark.createDataFrame(asked, "caller string, callee_name string, call_style string, caller_file string, caller_class string")
    assert got(calls.resolve_calls(edges, defs), "caller", "callee") == [
        ("a.py::C.m", "a.py::C.go"), ("a.py::C.m", "b.py::C.far"), ("a.py::g", "z.py::x.y"), ("a.py::h", "w.py::y"), ("a.py::h", "z.py::x.y"),
        ("a.py::i", "w.py::y"), ("a.py::i", "z.py::x.y"),
    ]


def queue_order(edges, start, most):
    out, seen, queue = [], set(), [(start, 0)]
    while queue:
        node, depth = queue.pop(0)
        if node in seen or depth > most:
            continue
        seen.add(node)
        out.append((node, depth))
        queue += [(dst, depth + 1) for _, dst in sorted(edges.get(node, []))]
    return out


def test_chains_by_a_plain_queue(spark):
    r = random.Random(8)
    edges, rows = {}, []
    for src in range(120):
        for k, dst in enumerate(r.sample(range(120), r.choice([0, 1, 1, 2, 3]))):
            edges.setdefault(src, []).append((10 - k, dst))
            rows.append((src, dst, 10 - k))
    starts = list(range(0, 120, 7))
    found = calls.chains(spark.createDataFrame(rows, "src long, dst long, ordinal int"), spark.createDataFrame([(s,) for s in starts], "node long"), 8).collect()
    for s in starts:
        want = queue_order(edges, s, 8)
        mine = sorted((x.place, x.node, x.depth) for x in found if x.start == s)
        assert mine == ([(k, n, d) for k, (n, d) in enumerate(want)] if len(want) > 1 else [])
        assert all((x.nodes, x.deepest) == (len(want), max(d for _, d in want)) for x in found if x.start == s)


# intervals


def plain_innermost(item, spans):
    held = [(s, -e, n) for p, s, e, n in spans if p == item[0] and s <= item[1] and e >= item[2]]
    return max(held)[2] if held else None


@pytest.mark.parametrize("most", [12, 300, 100_000])
def test_innermost_spans_by_plain_loops(spark, most):
    r = random.Random(most)
    pick = lambda: sorted((r.randrange(most), r.randrange(most)))
    spans = [(f"f{r.randrange(3)}", *pick(), f"n{k:03d}") for k in range(250)]
    items = [(f"f{r.randrange(4)}", *pick(), k) for k in range(250)] + [("f0", None, 3, 999), (None, 1, 2, 998)]
    a = spark.createDataFrame(items, "path string, start int, end int, id int")
    b = spark.createDataFrame(spans + [("f1", 5, 4, "empty"), (None, 1, 2, "none")], "path string, start int, end int, name string")
    want = {i[3]: plain_innermost(i, spans) if None not in i else None for i in items}
    met = {i[3] for i in items if None not in i and any(p == i[0] and s <= i[2] and e >= i[1] for p, s, e, _ in spans)}
    rows = intervals.placed(a, b, ["path"], "name").collect()
    assert len(rows) == len(items) and {x.id: x.name for x in rows} == want
    assert all(x.reason == (None if want[x.id] else "crosses" if x.id in met else "outside") for x in rows)
    assert {x.id for x in intervals.overlapping(a, b.filter("end >= start"), ["path"]).collect()} == met


def test_many_spans_of_one_file_are_not_paired(spark):
    n = 30_000  # all spans lie over each other: pairs would be 9 x 10^8
    spans = spark.range(n).select(F.lit("f").alias("path"), F.col("id").alias("start"), (2 * n - F.col("id")).alias("end"), F.col("id").alias("name"))
    items = spark.range(n).select(F.lit("f").alias("path"), F.col("id").alias("start"), (F.col("id") + 1).alias("end"))
    assert intervals.containing(items, spans, ["path"], "name").filter("name = start").count() == n


def test_spans_and_items_are_shuffled_once(spark):
    spans = spark.createDataFrame([("f", 1, 9, "a"), ("f", 4, 5, "b"), ("f", 7, 6, "empty"), ("g", 3, 3, None)], "path string, start int, end int, name string")
    items = spark.createDataFrame([("f", 4, 5), ("f", 4, 6), ("f", 0, 1), ("f", 10, 12), ("g", 3, 3), ("g", 2, 4), ("h", 1, 1)], "path string, start int, end int")
    placed = intervals.placed(items, spans, ["path"], "name")
    assert placed._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1
    assert got(placed, "path", "start", "end", "name", "reason") == sorted([
        ("f", 4, 5, "b", None), ("f", 4, 6, "a", None), ("f", 0, 1, None, "crosses"), ("f", 10, 12, None, "outside"),
        ("g", 3, 3, None, None), ("g", 2, 4, None, "crosses"), ("h", 1, 1, None, "outside"),
    ], key=repr)


def test_gaps_and_edges(spark):
    spans = spark.createDataFrame([("f", 3, 5), ("f", 4, 9), ("f", 12, 12), ("g", 1, 20), ("i", 2, 30)], "path string, start int, end int")
    totals = spark.createDataFrame([("f", 15), ("g", 20), ("h", 4), ("e", 0), ("i", 7)], "path string, total int")
    assert got(intervals.gaps(spans, ["path"], totals), "path", "gap_start", "gap_end") == [
        ("f", 1, 2), ("f", 10, 11), ("f", 13, 15), ("h", 1, 4), ("i", 1, 1)
    ]
    assert got(intervals.gaps(spans, ["path"]), "path", "gap_start", "gap_end") == [("f", 10, 11)]


# one to one matching


def plain_match(planted, found, tolerance):
    left, out = dict((p[0], p) for p in planted), []
    for f in found:
        hit = next((i for i, p in left.items() if p[1] == f[1] and abs(p[2] - f[2]) <= tolerance), None)
        if hit is not None:
            out.append((f[1], f[0], hit))
            del left[hit]
    return sorted(out)


@pytest.mark.parametrize("tolerance", [0, 1, 3, 10])
def test_matching_by_the_plain_loop(spark, tolerance):
    r = random.Random(tolerance)
    make = lambda c, n, lines: [(f"{c}{k}", f"f{r.randrange(4)}", r.randrange(lines), k) for k in range(n)]
    planted, found = make("p", 150, 90) + [("p999", "q", 5, 999)], make("f", 150, 90) + [("f999", "r", 5, 999)]
    frame = lambda rows: spark.createDataFrame(rows, "id string, file string, line int, ordinal int")
    assert got(matching.match_findings(frame(planted), frame(found), tolerance), "file", "finding", "instance") == plain_match(planted, found, tolerance)


def test_repeated_instances_count_once(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id string, file string, line int, ordinal int")
    planted = frame([("p1", "f", 5, 1), ("p1", "f", 5, 1), ("p2", "f", 6, 2)])
    found = frame([("a", "f", 5, 1), ("b", "f", 6, 2), ("c", "f", 5, 3)])
    assert got(matching.match_findings(planted, found, 1), "file", "finding", "instance") == [("f", "a", "p1"), ("f", "b", "p2")]
    assert matching.grade(planted, found, 1).first()["fn"] == 1  # a row is missed, though its instance is met


def test_files_are_cut_into_runs(spark):
    rows = spark.createDataFrame([("f", k) for k in (1, 2, 4, 9, 9, 12)] + [("g", 3)], "file string, line int")
    assert got(matching.runs(rows, 2), "file", "line", "run") == [("f", 1, 1), ("f", 12, 3), ("f", 2, 1), ("f", 4, 1), ("f", 9, 2), ("f", 9, 2), ("g", 3, 1)]


# packing


def plain_pack(items, tokens, lines):
    out, chunk, a, b, fresh = [], 0, 0, 0, True
    for n, m, closes in items:
        if fresh or a + n > tokens or b + m > lines:
            chunk, a, b = chunk + 1, 0, 0
        a, b, fresh = a + n, b + m, bool(closes)
        out.append(chunk)
    return out


def test_packing_by_the_plain_loop(spark):
    r = random.Random(3)
    rows, want = [], []
    for p in range(30):
        items = [(r.randrange(30), r.randrange(12), r.choice([True, False, False, False, None])) for _ in range(r.choice([1, 2, 7, 60, 200]))]
        rows += [(f"f{p}", k, *x) for k, x in enumerate(items)]
        want += [(f"f{p}", k, c) for k, c in enumerate(plain_pack(items, 40, 25))]
    frame = spark.createDataFrame(rows, "path string, at int, n int, m int, brk boolean").repartition(5)
    assert got(chunks.pack(frame, ["path"], "at", "n", "m", F.col("brk"), 40, 25), "path", "at", "chunk") == sorted(want, key=repr)
    assert chunks.pack(frame.limit(0), ["path"], "at", "n", "m", F.col("brk"), 40, 25).count() == 0


def test_packing_closes_after_a_hint_and_before_a_budget(spark):
    rows = [(1, 5, 1, False), (2, 4, 1, True), (3, 4, 1, False), (4, 1, 9, False), (5, 50, 1, False), (6, 1, 1, False), (7, 0, 0, True), (8, 1, 1, None)]
    frame = spark.createDataFrame([("f", *x) for x in rows], "path string, at int, n int, m int, brk boolean")
    packed = chunks.pack(frame, ["path"], "at", "n", "m", F.col("brk"), 10, 9)
    assert got(packed, "at", "chunk") == [(1, 1), (2, 1), (3, 2), (4, 3), (5, 4), (6, 5), (7, 5), (8, 6)]


def test_packing_shuffles_once(spark):
    rows = [("f", k, k % 7, 1, k % 50 == 9) for k in range(3000)] + [("g", 1, 3, 1, False)]
    frame = spark.createDataFrame(rows, "path string, at int, n int, m int, brk boolean")
    packed = chunks.pack(frame, ["path"], "at", "n", "m", F.col("brk"), 200, 90)
    assert packed._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1
    want = [("f", k, c) for k, c in enumerate(plain_pack([x[2:] for x in rows[:-1]], 200, 90))] + [("g", 1, 1)]
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")  # a key over many batches
    try:
        assert got(packed, "path", "at", "chunk") == sorted(want, key=repr)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


# the session


def test_workers_find_the_package_from_any_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from repolith.operators import facts, symbols
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
files = s.createDataFrame([("a.py", "def f(x):\\n    return g(x)\\n")], "path string, text string")
assert facts.definitions(files).count() == 1 and symbols.extract_python(files).count() == 1
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120, stderr=subprocess.DEVNULL)


# parts that grow with the input


def widths(df):
    """Parts of the shuffles that the plan asks for by number."""
    return [int(n) for n in re.findall(r"hashpartitioning\([^()]*, (\d+)\), REPARTITION_BY_NUM", df._jdf.queryExecution().executedPlan().toString())]


def test_calls_and_chains_are_dealt_by_input_size(spark, tmp_path, monkeypatch):
    edges = [(f"f{k % 5}.py::C.m{k}", f"m{k % 9}", "self" if k % 3 else "name", f"f{k % 5}.py", "C") for k in range(40)]
    defs = [(f"C.m{k}", f"m{k}", f"f{k % 5}.py", "C") for k in range(12)]
    frames = {
        "edges": spark.createDataFrame(edges, "caller string, callee_name string, call_style string, caller_file string, caller_class string"),
        "defs": spark.createDataFrame(defs, "qualified_name string, name string, file string, parent_class string"),
        "steps": spark.createDataFrame([(k, k + 1 + k % 3, k % 2) for k in range(30)], "src long, dst long, ordinal long"),
        "starts": spark.range(30).withColumnRenamed("id", "node"),
    }
    for name, frame in frames.items():
        frame.coalesce(1).write.parquet(f"{tmp_path}/{name}")
    t = {name: spark.read.parquet(f"{tmp_path}/{name}") for name in frames}
    few = sorted(map(tuple, calls.resolve_calls(t["edges"], t["defs"]).collect())), sorted(map(tuple, calls.chains(t["steps"], t["starts"], 3).collect()))
    monkeypatch.setattr(session.parts_of, "__kwdefaults__", {"each": 128})
    monkeypatch.setattr(calls, "PART_BYTES", 128 * 16)
    found, chained = calls.resolve_calls(t["edges"], t["defs"]), calls.chains(t["steps"], t["starts"], 3)
    assert len(widths(found)) >= 3 and min(widths(found)) > 10 and len(widths(chained)) >= 4 and min(widths(chained)) > 10
    assert (sorted(map(tuple, found.collect())), sorted(map(tuple, chained.collect()))) == few and all(few)
