"""Fill-in-the-middle, product codes and document fingerprints against plain versions."""

import base64
import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash

from repolith.llm import codes, middle, queries, sketches

SF = "/root/testdata/sf0.001"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


# fill-in-the-middle


def plain_cut(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = digest(f"7:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return len(units), "plain", None, None, digest(text), digest(text)
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    a, b, c = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h4 % 100 < 50:
        return len(units), "spm", len(a), len(b), digest(f"<S>{c}<P>{a}<M>{b}"), digest(text)
    return len(units), "psm", len(a), len(b), digest(f"<P>{a}<S>{c}<M>{b}"), digest(text)


ODD = [
    (1, None), (2, ""), (3, "\n"), (4, "\n\n\n"), (5, "no newline"), (6, "a\nb"), (7, "a\r\nb\r\n"), (8, "x<P>y\nz"), (9, "<M>"),
    (10, "<P\nS>\n<S"), (11, "日本語\n🙂🙂\nß" * 30), (12, "word " * 60_000), (13, "l\n" * 50_000), (None, "no\nid"), (None, "no\nid"), (6, "a\nb"),
    (-5, "neg\native\nid"), (2**62, "big\nid\n"),
]


def test_middle_by_plain_rules(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in ODD], "doc_id long, text string, form string, output int")
    found = middle.transform(docs)
    back = middle.restored(found.output, found.form)
    got = found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", back.text_sha256.alias("r"), back.text.alias("t")).collect()
    assert sorted(map(repr, (tuple(x)[:-1] for x in got))) == sorted(repr((i, *plain_cut(i, t))) for i, t in ODD)
    assert sorted(x.t for x in got) == sorted(t or "" for _, t in ODD)


def test_middle_of_an_empty_table_and_other_settings(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert middle.transform(none).count() == 0
    docs = spark.createDataFrame([(k, f"some words of text {k}") for k in range(400)], "doc_id long, text string")
    rows = middle.transform(docs, unit=r"\S+\s*", salt="z", rate=50, spm=0, marks=("[a", "]b", "|c"), keep=("doc_id", "text")).collect()
    assert {x.form for x in rows} == {"plain", "psm"} and 120 < sum(x.form == "plain" for x in rows) < 280
    assert all(middle.rebuild(x.output, x.form, ("[a", "]b", "|c")) == x.text for x in rows)
    for marks in (("aa", "b", "c"), ("ab", "ba", "c"), ("a", "a", "b"), ("ab", "b", "c"), ("", "b", "c")):
        with pytest.raises(ValueError):
            middle.transform(docs, marks=marks)


# product codes


def plain_codes(rows, parts=8, entries=16, number=6, scale=4096):
    """rows of (name, vector, label), all loops; the integers of Python have no bounds."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    if not kept:
        return []
    w = len(kept[0][1]) // parts
    ints = [[max(-(2**27), min(2**27, math.floor(scale * x))) for x in r[1]] for r in kept]
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in ints]
    books = [[list(cut[k][p]) for k in range(min(entries, len(cut)))] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))
    for _ in range(number):
        at = [[near(v[p], books[p])[1] for p in range(parts)] for v in cut]
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [v[p] for v, a in zip(cut, at) if a[p] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    final = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    h = digest(",".join(str(x) for b in books for e in b for x in e))
    errors = [sum(d for d, _ in f) for f in final]
    by = {}
    for r, e in zip(kept, errors):
        by[r[2]] = by.get(r[2], 0) + e
    return [(r[0], "".join(f"{k:02x}" for _, k in f), e, by[r[2]], h) for r, f, e in zip(kept, final, errors)]


SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def coded(spark, rows, **more):
    return [tuple(r) for r in codes.compress(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3), **more).collect()]


def test_codes_by_plain_loops(spark):
    r = np.random.default_rng(5)
    rows = [(int(k), [float(np.float32(x)) for x in r.normal(size=16)], int(r.integers(3))) for k in r.permutation(300)]
    rows += [(400, None, 1), (401, rows[0][1][:15] + [None], 1), (402, rows[0][1][:15] + [math.inf], 1), (403, rows[0][1][:15] + [math.nan], 2)]
    rows += [(404, [], 1), (405, [1.0] * 8, 1), (406, [1.0] * 15, 2), (407, [0.0] * 16, None), (408, rows[1][1], None), (None, rows[2][1], 0)]
    rows += [rows[3]] * 40 + [rows[4]] * 3
    assert sorted(map(repr, coded(spark, rows))) == sorted(map(repr, plain_codes(rows)))


def test_codes_of_few_large_or_no_vectors(spark):
    assert coded(spark, []) == [] and coded(spark, [(1, None, 1), (2, [math.nan] * 8, 1)]) == []
    quick = {"number": 2}
    few = [(k, [float(k * j % 7) - 3 for j in range(8)], k % 2) for k in range(5)]
    assert sorted(coded(spark, few, **quick)) == sorted(plain_codes(few, **quick))
    large = [(k, [float(np.float32((-1) ** j * 3e37 / (k + 1))) if k % 3 else float(k * j) for j in range(8)], 0) for k in range(40)]
    assert sorted(coded(spark, large, **quick)) == sorted(plain_codes(large, **quick))
    with pytest.raises(ValueError):
        coded(spark, few, entries=256)


def test_codes_of_other_numbers_of_parts(spark):
    r = np.random.default_rng(6)
    rows = [(k, [float(np.float32(x)) for x in r.normal(size=12)], k % 4) for k in range(120)]
    assert sorted(coded(spark, rows, parts=3, entries=5, number=3, scale=100)) == sorted(plain_codes(rows, 3, 5, 3, 100))


def test_code_rounds_shuffle_changes_only(spark):
    old = np.array([[0, 1], [2, 2]], np.uint8)
    x = np.arange(8).reshape(2, 4)
    assert codes.changes(x, old, old, 2) == []
    moved = codes.changes(x, old, np.array([[0, 1], [2, 0]], np.uint8), 2)
    assert moved == [{"part": 1, "entry": 0, "n": 1, "total": [6, 7]}, {"part": 1, "entry": 2, "n": -1, "total": [-6, -7]}]


# document fingerprints


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def paragraphs(text):
    return {xxhash.xxh64(p.encode(), seed=42).intdigest() for p in text.split("\n") if p.strip(" ")}


def plain_sketch(text):
    cells = [[0, 0, 0] for _ in range(24)]
    for d in paragraphs(text):
        c = xxhash.xxh64(d.to_bytes(8, "little"), seed=42).intdigest() >> 32
        for k in range(3):
            at = cells[8 * k + (d >> (10 * k)) % 8]
            at[0] += 1
            at[1] ^= d
            at[2] ^= c
    return base64.b64encode(b"".join(n.to_bytes(4, "big") + d.to_bytes(8, "big") + c.to_bytes(4, "big") for n, d, c in cells)).decode()


def plain_likeness(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_fingerprints(rows):
    h = lambda t: (
        signed(xxhash.xxh64(t.encode(), seed=42).intdigest()),
        signed(xxhash.xxh64(t.encode(), seed=xxhash.xxh64((1).to_bytes(4, "little"), seed=42).intdigest()).intdigest()),
    )
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (2**63 - 1 if r[0] is None else r[0], h(r[1])))
    out = []
    for k, (i, t) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        e = t[: len(t) - half] + after[:half]
        out.append((i, len(t), digest(e), plain_sketch(t), plain_sketch(e), round(plain_likeness(t, e), 12), round(plain_likeness(t, after), 12)))
    return sorted(map(repr, out))


def printed(rows):
    return sorted(repr((*tuple(x)[:5], round(x.near_edited, 12), round(x.near_next, 12))) for x in rows)


def test_fingerprint_query_by_plain_loops(spark):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert printed(queries.QUERIES["op13_document_fingerprints"](spark, SF).collect()) == plain_fingerprints(rows)


def test_fingerprints_of_odd_documents(spark):
    r = random.Random(4)
    line = lambda: " ".join(str(r.randrange(1000)) for _ in range(3))
    long = "\n".join(line() for _ in range(4000))
    rows = [*ODD, (20, long), (21, long[: len(long) // 3] + long[len(long) // 2 :]), (22, "\n".join(sorted(long.split("\n")))), (23, " \n  \n")]
    rows += [(30 + k, "\n".join(line() for _ in range(r.randrange(60)))) for k in range(60)]
    rows += [(40, "same id"), (40, "same\nid"), (40, "other\ntext\nof\nthat id"), *[(41, "a copy\nof\na row\n")] * 50]
    docs = spark.createDataFrame([(*x, 1, "c") for x in rows], "doc_id long, text string, found int, bucket string")
    assert printed(sketches.fingerprints(docs.repartition(5)).collect()) == plain_fingerprints(rows)


def test_fingerprints_of_few_documents(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert sketches.fingerprints(make([])).count() == 0
    for rows in ([(1, "one\ndocument")], [(None, None), (None, None), (1, "a\nb\nc")]):
        assert printed(sketches.fingerprints(make(rows)).collect()) == plain_fingerprints(rows)


def test_fingerprints_run_no_python(spark):
    plan = sketches.followed(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan
