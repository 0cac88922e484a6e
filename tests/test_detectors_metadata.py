"""Detectors, chunks, metadata sources and matrices on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from repolith.operators import chunks, detectors
from repolith.plans import matrix
from repolith.sources import metadata


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_dormant(spark):
    defs = spark.createDataFrame(
        [("a.py", 1, "unused", []), ("a.py", 4, "used", []), ("a.py", 7, "named", None), ("a.py", 9, "hook", ["receiver"])],
        "path string, line int, name string, decorators array<string>"
    )
    got = detectors.dormant(
        defs, spark.createDataFrame([("used",)], "name string"),
        spark.createDataFrame([("named",), ("named",)], "name string")
    )
    assert rows(got, "name", "state") == [("named", "uncertain"), ("unused", "unreferenced")]


def test_clusters(spark):
    files = spark.createDataFrame(
        [
            ("src/b/billing-types.ts",), ("src/b/billing-validator.ts",), ("src/b/billing_parser.ts",),
            ("src/b/other.ts",), ("billing_x.ts",)
        ],
        "path string"
    )
    assert rows(detectors.prefix_clusters(files), "folder", "prefix") == [("src/b", "billing")]
    names = spark.createDataFrame(
        [
            ("o.py", n) for n in ("load_invoice", "saveShipment", "get_customer", "list_inventory")
        ] + [("c.py", "load_invoice"), ("c.py", "save_invoice"), ("c.py", None)],
        "path string, name string"
    )
    got = detectors.domain_clusters(names).collect()
    assert [(r["path"], r["clusters"], r["and_count"]) for r in got] == [("o.py", ["customer", "inventory", "invoice", "shipment"], 3)]


def test_terms_and_states(spark):
    texts = spark.createDataFrame(
        [("a", "A basket and a Cart"), ("b", "order, trolley"), ("c", "cart pram"), ("d", None)],
        "path string, text string"
    )
    glossary = spark.createDataFrame(
        [("cart", "cart", "canonical"), ("cart", "basket", "competing"), ("cart", "trolley", "avoid"), ("cart", "pram", "superseded")],
        "concept string, term string, standing string"
    )
    assert rows(detectors.term_bands(texts, glossary, "path", "text"), "path", "band") == [
        ("a", "competing_term_coexistence"), ("b", "avoid_term_hit"), ("c", "superseded_co_occurrence")
    ]
    ops = spark.createDataFrame(
        [
            ("Job", "State", "string", "queued", "assignment"), ("Job", "State", "string", "done", "comparison"),
            ("One", "State", "string", "x", "assignment"), ("D", "Phase", "DeliveryPhase", "x", "comparison")
        ],
        "carrier_type string, field string, field_type string, literal string, operation string"
    )
    assert rows(detectors.implicit_states(ops), "carrier_type", "classification") == [
        ("D", "typed_state_authority"), ("Job", "first_party_state_operation"),
        ("One", "insufficient_closed_state_evidence")
    ]


def test_calls_and_triage(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", None), ("b", "c"), ("c", None)], "caller string, callee string")
    assert rows(detectors.call_completeness(edges), "caller", "state") == [("a", "partial"), ("b", "complete"), ("c", "unresolved")]
    pairs = spark.createDataFrame(
        [("a", "b", 0.1, 0), ("a", "c", 0.95, 0), ("a", "d", 0.1, 2), ("a", "e", 0.1, 0)],
        "a string, b string, similarity double, unresolved int"
    )
    got = detectors.triage_pairs(pairs, spark.createDataFrame([("b", "a")], "caller string, callee string"), 0.9)
    assert rows(got, "b", "verdict", "reason") == [
        ("b", "rejected", "caller_callee"), ("c", "rejected", "token_similar"),
        ("d", "uncertain", "direct_call_unresolved_or_dynamic"), ("e", "confirmed", None)
    ]


def test_selection_keeps_ties_and_reports_omissions(spark):
    seams = spark.createDataFrame([("alpha", 0.9), ("beta", 0.8), ("gamma", 0.8), ("delta", 0.4)], "id string, score double")
    assert rows(
        detectors.select_with_omissions(seams, "score", 2), "id", "selected"
    ) == [("alpha", True), ("beta", True), ("delta", False), ("gamma", True)]


def test_layers_and_routes(spark):
    layers = spark.createDataFrame([("ui.py", "ui"), ("core.py", "core"), ("db.py", "db")], "path string, layer string")
    edges = spark.createDataFrame([("ui.py", "core.py"), ("ui.py", "db.py"), ("core.py", "x.py")], "importer string, imported string")
    allowed = spark.createDataFrame([("ui", "core")], "from_layer string, to_layer string")
    assert rows(detectors.layer_violations(edges, layers, allowed), "importer", "imported") == [("ui.py", "db.py")]
    routes = ["sites/<int:site_id>/setup/", "api/sites/<int:site_id>/status/", "api/health/", "sites/", "about/"]
    r = spark.createDataFrame([(x,) for x in routes], "route string")
    got = r.select(
        "route", detectors.route_family(F.col("route"), "sites", "api", "site_id").alias("f"),
        detectors.route_family(F.col("route")).alias("none"), detectors.normal_route(F.col("route")).alias("n")
    ).collect()
    assert [x["f"] for x in got] == ["site_page", "site_scoped_api", "global_api", "other", "other"]
    assert {x["none"] for x in got} == {"other"} and got[0]["n"] == "/sites/{site_id}/setup"


def test_plans_states_and_evidence(spark):
    now = F.lit("2026-03-01").cast("timestamp")
    plans = spark.sql("SELECT * FROM VALUES ('old', 'scoped', timestamp'2026-01-01'), ('fresh', 'draft', timestamp'2026-02-27'), ('gone', 'promoted', timestamp'2026-01-01'), ('busy', 'draft', timestamp'2026-01-01') t(slug, status, modified_at)")
    ledger = spark.createDataFrame(
        [("old", 1, "proposed"), ("busy", 1, "proposed"), ("busy", 2, "in-flight")],
        "id string, ordinal int, state string"
    )
    assert rows(detectors.stale_plans(plans, ledger, now), "slug") == [("old",)]
    ev = spark.createDataFrame([("a", 1, 1, "open"), ("a", 1, 2, "closed")], "id string, at int, ordinal int, to_state string")
    assert rows(
        detectors.fold_states(ev, spark.createDataFrame([("a", "new"), ("b", "new")], "id string, state string")), "id",
        "state", "transitions"
    ) == [("a", "closed", 2), ("b", "new", 0)]
    claims = spark.sql("SELECT * FROM VALUES (1, 'k', timestamp'2026-01-01 12:00:00'), (2, 'k', timestamp'2026-01-01 12:00:01'), (3, 'j', timestamp'2026-01-01 00:00:00') t(id, k, at)")
    evidence = spark.sql("SELECT 'k' AS k, timestamp'2026-01-01 00:00:00' AS at")
    assert rows(detectors.recent_evidence(claims, evidence, ["k"]), "id", "backed") == [(1, True), (2, False), (3, False)]


def test_requests_importance_and_posture(spark):
    contracts = spark.createDataFrame(
        [("dup", ["full", "diff"], ["python"])], "detector string, modes array<string>, languages array<string>"
    )
    req = spark.createDataFrame(
        [(1, "dup", "full", "python"), (2, "dup", "lines", "python"), (3, "x", "full", "python"), (4, "dup", "diff", "go")],
        "request int, detector string, mode string, language string"
    )
    assert rows(detectors.scan_requests(req, contracts), "request", "reason") == [
        (1, None), (2, "unsupported_mode"), (3, "unknown_detector"), (4, "unsupported_language")
    ]
    f = spark.createDataFrame(
        [("src/pay/a.py", "r1"), ("src/b.py", "r2"), ("doc/x.md", "r3"), ("doc/x.md", "r3")], "path string, rule string"
    )
    loc = spark.createDataFrame([("src", "B"), ("src/pay", "A")], "prefix string, tier string")
    assert rows(detectors.importance(f, loc, ("A", "B")), "path", "tier_rank") == [
        ("doc/x.md", 3), ("doc/x.md", 3), ("src/b.py", 2), ("src/pay/a.py", 1)
    ]
    rules = spark.createDataFrame([("r1", "recoverable", True), ("r2", "irreversible", True)], "rule string, tier string, covered boolean")
    off = spark.createDataFrame([("r1", False), ("r2", False), ("r3", False)], "rule string, enabled boolean")
    assert rows(detectors.posture(f.distinct(), rules, off), "rule", "kept") == [("r1", False), ("r2", True), ("r3", True)]


def test_chunks_and_chains(spark):
    starts = spark.createDataFrame([("f", 3), ("f", 10)], "path string, line int")
    assert rows(chunks.tile(starts, ["path"], "line", F.lit(20)), "chunk", "first", "last") == [("C-01", 1, 9), ("C-02", 10, 20)]
    edges = spark.createDataFrame(
        [("a", "b", False), ("b", "w", True), ("c", "w", False), ("d", "d", False)],
        "src string, dst string, gated boolean"
    )
    entries = spark.createDataFrame([("a",), ("c",), ("d",)], "node string")
    assert rows(
        chunks.effects(edges, spark.createDataFrame([("w",)], "node string"), entries), "start", "writes", "gated"
    ) == [("a", True, True), ("c", True, False), ("d", False, False)]


def test_metadata(spark):
    docs = spark.createDataFrame(
        [("p", '{"id": "py", "suffixes": [".py", ".x"]}'), ("q", '{"id": "q", "suffixes": [".x"]}')],
        "path string, text string"
    )
    assert rows(metadata.contested_suffixes(metadata.profiles(docs)), "suffix") == [(".x",)]
    items = spark.createDataFrame(
        [("a", '{"title": "T", "status": "open"}'), ("b", "nonsense"), ("c", '{"title": "U"}'), ("d", "[1]"), ("e", None)],
        "path string, text string"
    )
    assert rows(metadata.queue_items(items, "title string"), "path", "status") == [
        ("a", "open"), ("b", "unreadable"), ("c", "unknown"), ("d", "unreadable"), ("e", "unreadable")
    ]
    files = spark.createDataFrame([("x/plan.md", "\n---\n# The plan\nmore"), ("y.py", "#!/bin/x\n")], "path string, text string")
    assert rows(
        metadata.artifacts(files, [("plan", r"plan\.md$"), ("doc", r"\.md$")]), "kind", "summary"
    ) == [("doc", "The plan"), ("plan", "The plan")]
    ev = spark.createDataFrame(
        [("r", 1, "usage", "10"), ("r", 3, "usage", "30"), ("r", 2, "command", "ls")],
        "run string, ordinal int, kind string, value string"
    )
    assert [tuple(r) for r in metadata.usage(ev).collect()] == [("r", "30", ["ls"])]
    m = spark.createDataFrame([("a", "s"), ("b", "t")], "name string, slice string")
    assert rows(metadata.select_corpus(m, ["a", "b"], "t"), "name") == [("b",)]
    with pytest.raises(ValueError, match="unknown names: z"):
        metadata.select_corpus(m, ["a", "z"])


def test_xml_projects(spark):
    good = '<Project Sdk="x"><PropertyGroup><TargetFrameworks>net8.0;net9.0</TargetFrameworks></PropertyGroup><ItemGroup><PackageReference Include="P" Version="1"/><ProjectReference Include="../b.csproj"/></ItemGroup></Project>'
    got = {
        r["path"]: r
        for r in metadata.xml_projects(
            spark.createDataFrame([("a", good), ("b", "<Project"), ("c", None)], "path string, text string")
        ).collect()
    }
    assert got["a"]["frameworks"] == ["net8.0", "net9.0"] and got["a"]["packages"] == ["P@1"] and got["a"]["references"] == ["../b.csproj"]
    assert [got[k]["readable"] for k in "abc"] == [True, False, False]


def test_compile_databases(spark):
    def db(root, directory=None, std="c++20", file=None, extra=None):
        f = file or f"{root}/a.cpp"
        return json.dumps([{"directory": directory or root, "file": f, "arguments": ["c++", f"-std={std}", "-c", f]} | (extra or {})])

    data = [
        ("/ok", db("/ok"), 5), ("/none", None, 5), ("/bad", "{", 5), ("/dir", db("/dir", "/x"), 5),
        ("/std", db("/std", std="c++17"), 5), ("/lang", db("/lang", file="/lang/a.py"), 5),
        ("/extra", db("/extra", extra={"output": "o"}), 5), ("/less", db("/less"), 5), ("/old", db("/old"), 1)
    ]
    d = spark.createDataFrame(data, "root string, text string, modified_at int")
    expected = spark.createDataFrame([(r, f"{r}/a.cpp") for r, *_ in data] + [("/less", "/less/b.cpp")], "root string, file string")
    inputs = spark.createDataFrame([(r, 2) for r, *_ in data], "root string, modified_at int")
    assert dict(rows(metadata.compile_databases(d, expected, inputs), "root", "state")) == {
        "/ok": "valid", "/none": "missing", "/bad": "malformed", "/dir": "mismatched-directory", "/std": "wrong-mode",
        "/lang": "wrong-language", "/extra": "malformed", "/less": "incomplete", "/old": "stale"
    }


def test_matrix_and_scores(spark):
    catalog = spark.createDataFrame([("a",), ("b",)], "skill string")
    full = spark.createDataFrame([("a", "x"), ("b", "y")], "skill string, value string")
    assert rows(
        matrix.coverage_matrix(catalog, {"docs": full, "tests": full}), "skill", "docs", "tests"
    ) == [("a", "x", "x"), ("b", "y", "y")]
    with pytest.raises(ValueError, match="tests: missing b"):
        matrix.coverage_matrix(catalog, {"docs": full, "tests": full.filter("skill = 'a'")})
    checks = spark.createDataFrame(
        [("a", True, True), ("b", False, False), ("c", False, True), ("c", None, False)],
        "run string, passed boolean, consequential boolean"
    )
    assert rows(
        matrix.scorecard(checks, ["run"]), "run", "failures", "verdict"
    ) == [("a", 0, "pass"), ("b", 1, "pass-with-notes"), ("c", 2, "fail")]
    trials = spark.createDataFrame([("l", 200, 100), ("l", 400, 100), ("l", 100, 90)], "lens string, before int, after int")
    assert rows(
        matrix.paired_trials(trials, ["lens"], 20, 100, 3), "median_saving", "median_pct", "wins", "passed"
    ) == [(100.0, 50.0, 3, True)]
    runs = spark.createDataFrame([("full", 100, 100), ("small", 60, 120)], "condition string, context int, tokens int")
    assert rows(matrix.conditions(runs, "full"), "condition", "passed") == [("full", False), ("small", False)]
    files = spark.createDataFrame([("tests/a.py",), ("b.zz",), ("c",)], "path string")
    inv = matrix.inventory(
        files, [("test", F.col("path").startswith("tests/"))],
        spark.createDataFrame([(".py", "python")], "suffix string, language string")
    )
    assert rows(inv, "path", "role", "language") == [("b.zz", "source", None), ("c", "source", None), ("tests/a.py", "test", "python")]
    assert matrix.inventory_counts(inv).filter("facet = 'role' AND value = 'source'").first()["n"] == 2
    sym = spark.createDataFrame(
        [("d1", "f", "A", 3), ("d1", "g", "B", 9), ("d2", "h", "A", 5)],
        "domain string, name string, tier string, size int"
    )
    assert rows(matrix.prompt_groups(sym, most=1), "domain", "n", "members", "omitted") == [("d1", 2, ["f"], 1)]
    assert [r["name"] for r in matrix.cross_domain(sym, ["A", "B"], 2).collect()] == ["h", "f"]


def test_reports(spark, tmp_path):
    assert "<td>&lt;b&gt;</td>" in metadata.html_table(spark.createDataFrame([("<b>",)], "x string"), "T")
    metadata.write_scope(spark, str(tmp_path / "a"), ["src"], "2026-01-01")
    assert metadata.read_scope(spark, str(tmp_path / "a")).first()["scope"] == ["src"]
    c = spark.createDataFrame([("a", "modified"), ("b", "deleted")], "path string, change_type string")
    assert rows(metadata.changed_paths(c, c), "path") == [("a",)]
