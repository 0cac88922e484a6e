"""Clone pairs from source against a plain matcher."""

import random

from repolith.operators import clones
from repolith.plans import registries


def plain_pairs(files, least):
    told = {p: [(n, t) for n, line in enumerate((x or "").split("\n"), 1) for t in clones.TOKEN.findall(line)] for p, x in files}
    grams = {}
    for p in sorted(told):
        for at in range(len(told[p]) - least + 1):
            grams.setdefault(tuple(t for _, t in told[p][at : at + least]), []).append((p, at))
    met = {}
    for places in grams.values():
        a, a_at = min(places)
        for p, at in places:
            if (p, at) != (a, a_at):
                met[p, at] = (a, a_at)
    out, done = [], set()
    for p, at in sorted(met):
        if (p, at) in done:
            continue
        a, a_at = met[p, at]
        n = 0
        while met.get((p, at + n)) == (a, a_at + n):
            done.add((p, at + n))
            n += 1
        end = n + least - 2
        out.append((a, told[a][a_at][0], told[a][a_at + end][0], p, told[p][at][0], told[p][at + end][0], n + least - 1))
    return sorted(out)


def test_pairs_by_a_plain_matcher(spark):
    r = random.Random(5)
    line = lambda: " ".join(r.choice("abcdefgh(){}=+") for _ in range(r.randrange(1, 9)))
    blocks = [[line() for _ in range(6)] for _ in range(5)]
    files = []
    for k in range(40):
        text = []
        for _ in range(r.randrange(6)):
            text += r.choice(blocks) if r.random() < 0.5 else [line() for _ in range(r.randrange(1, 6))]
            text += [""] * r.randrange(2)
        files.append((f"f{k:02d}", "\n".join(x.replace(" ", r.choice([" ", "  ", " "])) for x in text)))
    files += [("e", ""), ("n", None), ("same", "x y z\n" * 30)]
    frame = spark.createDataFrame(files, "path string, text string").repartition(5)
    pairs = clones.clone_pairs(frame, 8)
    got = sorted(tuple(x) for x in pairs.collect())
    assert got == plain_pairs(files, 8) and len(got) > 20
    assert clones.clone_pairs(frame.limit(0), 8).count() == 0
    clusters = {x.member: x.cluster for x in registries.clone_clusters(pairs.select("a", "b")).collect()}
    assert all(clusters[a] == clusters[b] for a, *_, b, _, _, _ in got)


def test_clones_lie_in_spans(spark):
    text = "def one():\n    a = f(1) + g(2)\n    return a * 3\n\ndef two():\n    a = f(1) + g(2)\n    return a * 3\n"
    files = spark.createDataFrame([("m.py", text)], "path string, text string")
    spans = spark.createDataFrame([("m.py", 1, 3, "one"), ("m.py", 5, 7, "two")], "path string, start int, end int, name string")
    got = clones.duplication(files, spans, 12).collect()
    assert [(x.a_start, x.a_end, x.b_start, x.b_end, x.tokens, x.owner, x.reason) for x in got] == [(1, 3, 5, 7, 19, "two", None)]


def test_runs_are_shuffled_once_in_stretches(spark):
    """Few rows for many runs, batches of two stretches, and stretches longer than one holds."""
    r = random.Random(6)
    common = " ".join(r.choice("abcdefgh") + str(r.randrange(50)) for _ in range(60))
    files = [(k, f"{' '.join(str(r.randrange(10**6)) for _ in range(40))}\n{common}\n" * (k % 3 + 1)) for k in range(30)]
    files += [(50, "u v\n" * 900), (51, "u v " * 700)]
    frame = spark.createDataFrame(files, "path long, text string").repartition(3)
    stretches = clones.token_runs(frame, 12)
    runs = sum(max(0, len(clones.TOKEN.findall(t)) - 11) for _, t in files)
    assert stretches.selectExpr("sum(length(hashes)) / 8").first()[0] == runs and stretches.count() < runs / 2
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        pairs = clones.clone_pairs(frame, 12)
        assert pairs._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 2
        assert sorted(tuple(x) for x in pairs.collect()) == plain_pairs(files, 12)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
