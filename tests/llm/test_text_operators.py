"""Operators on texts against brute force, and their edge cases."""

import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from repolith.llm import bpe, graph, langid, licenses, lines, mixing, queries, simhash, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, tie string, body string, node string, size string"
RND = random.Random(5)
WORDS = ["".join(RND.choice("abcdeéß") for _ in range(RND.randint(1, 9))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


LONG = prose(30_000, 1)
EDGES = [
    (1, None), (2, ""), (3, "  \t\n "), (4, "x"), (5, prose(80, 2)), (6, prose(80, 2)), (
        7, prose(80, 2) + " tail"
    ), (8, "ab" * 300), (9, "Ab ab " * 90),
    (10, LONG), (11, LONG[5000:9000] + prose(60, 3)), (12, prose(60, 3)[5:150]), (12, prose(60, 3)[5:150]), (
        13, "line one of the text here\nline one of the text hera\n\nx\nx"
    ),
    (None, "null id " + prose(50, 4)), (14, "1234 5678"), (15, "日本語テキスト " * 40),
]


def docs(spark, rows=EDGES):
    rows = [
        (i, t, "en" if (i or 0) % 2 else "de", None if i == 5 else f"s{(i or 0) % 3}", len(t or ""), "a", "b", "c", "d", "e")
        for i, t in rows
    ]
    return spark.createDataFrame(rows, SCHEMA)


def distinct(rows):
    return sorted(set(rows), key=lambda r: (-(2**63) if r[0] is None else r[0], r[1] or ""))


def brute_substrings(rows, length):
    seen, out = set(), {}
    for i, t in distinct(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(w)
        out[i] = bytes(x for x, g in zip(b, gone) if not g), sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
    return out


@pytest.mark.parametrize("length", [40, 100])
def test_substrings(spark, length):
    want = brute_substrings(EDGES, length)
    got = substrings.remove_repeats(docs(spark), length).collect()
    assert len(got) == len(EDGES)
    for r in got:
        assert (bytes(r["kept"]), len(r["spans"])) == want[r["doc_id"]], r["doc_id"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=60).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=6))
def test_window_classes(texts):
    piece, start, new = substrings.window_classes(texts, 5)
    got, seen = {}, -1
    for p, s, n in zip(piece, start, new):
        seen += bool(n)
        got[int(p), int(s)] = seen
    want = {(p, s): t[s : s + 5] for p, t in enumerate(texts) for s in range(len(t) - 4)}
    assert set(got) == set(want)
    assert len(set(got.values())) == len(set(want.values())) == len({(got[k], want[k]) for k in want})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=80))
def test_suffix_array(codes):
    import numpy as np

    order = substrings.suffix_array(np.array(codes, np.int64))
    assert order.tolist() == sorted(range(len(codes)), key=lambda i: codes[i:])


def thue_morse(n, letters):
    return "".join(letters[bin(k).count("1") % 2] for k in range(n))


def test_lines_that_polynomials_take_for_equal(spark):
    rows = [(1, thue_morse(1024, "ab")), (2, thue_morse(1024, "ba")), (3, thue_morse(4096, "ab") + "x"), (4, thue_morse(4096, "ba") + "x")]
    assert sorted((r["doc_id"], r["text"]) for r in lines.dedup(docs(spark, rows)).collect()) == rows


def test_lines_with_a_common_half(spark, monkeypatch):
    r = random.Random(12)
    start = "2024-01-01 00:00:00 request served by host one; "
    rows = [
        (k, "\n".join(start + "".join(r.choice("0123456789abcdef") for _ in range(r.choice([2, 3, 12, 13]))) for _ in range(6)))
        for k in range(60)
    ]
    rows.append((61, "\n".join([rows[3][1].split("\n")[2], "", "short", rows[9][1].split("\n")[1] + "!", "short"])))
    monkeypatch.setattr(lines, "LINES", 50)
    got = {(x["doc_id"], x["text"]) for x in lines.dedup(docs(spark, rows).repartition(5)).collect()}
    assert got == set(brute_lines(rows, 20).items())


def test_parts_are_reduced_one_at_a_time(spark, monkeypatch):
    from repolith.llm import _common

    monkeypatch.setattr(_common, "SLICE", 2000)
    frame = docs(spark)
    assert _common.parts_for(frame) > _common.reducers(spark)
    want = brute_substrings(EDGES, 40)
    assert all((bytes(x["kept"]), len(x["spans"])) == want[x["doc_id"]] for x in substrings.remove_repeats(frame, 40).collect())
    assert {(x["doc_id"], x["text"]) for x in lines.dedup(frame).collect()} == set(brute_lines(EDGES, 20).items())


def test_extra_columns_of_any_name_stay(spark):
    frame = docs(spark).withColumns({n: F.lit("mine") for n in ("gone", "n_removed", "__doc", "__tie")})
    got = lines.dedup(frame, counts=False)
    assert got.columns == frame.columns and got.count() == len(EDGES)
    assert all(x["gone"] == x["n_removed"] == x["__doc"] == "mine" for x in got.collect())


def brute_fingerprint(text, width=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), text.encode()))
    grams = [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if grams else 0


def test_simhash(spark, monkeypatch):
    near = [(100 + k, " ".join(w if j != 7 * k else "changed" for j, w in enumerate(prose(400, 9).split()))) for k in range(40)]
    rows = EDGES + near
    for tile in (2048, 4):
        monkeypatch.setattr(simhash, "TILE", tile)
        got = simhash.near_duplicates(docs(spark, rows)).collect()
        fps = {t: brute_fingerprint(t or "") for _, t in rows}
        assert sorted(
            (r["doc_id"] is None, r["doc_id"] or 0, r["fp"] % 2**64) for r in got
        ) == sorted((i is None, i or 0, fps[t]) for i, t in rows)
        values = sorted(set(fps.values()))
        label = {v: v for v in values}
        for _ in values:
            for a in values:
                for b in values:
                    if (a ^ b).bit_count() <= 4:
                        label[b] = label[a] = min(label[a], label[b])
        least = {}
        for i, t in rows:
            if i is not None:
                least[label[fps[t]]] = min(i, least.get(label[fps[t]], i))
        want = {(i, least.get(label[fps[t]])) for i, t in rows}
        assert {(r["doc_id"], r["component_id"]) for r in got} == want
    assert len({c for i, c in want if (i or 0) >= 100}) < 40


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4), st.sampled_from([1, 1000, 10**6, 10**9]))
def test_block_masks(x, flips, count):
    y = x
    for b in flips:
        y ^= 1 << b
    masks = simhash.block_masks(4, count)
    assert any((x ^ y) & (m % 2**64) == 0 for m in masks)


def brute_lines(rows, near):
    first, out = [], {}
    known = set()
    for i, t in distinct(rows):
        gone = []
        for k, x in enumerate((t or "").split("\n") if t is not None else []):
            if not x.strip():
                continue
            if x in known:
                gone.append(k)
                continue
            if len(x) >= near and any(len(y) >= near and lines.within_one(x, y) for y in first):
                gone.append(k)
            known.add(x)
            first.append(x)
        out[i] = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
    return out


def test_lines(spark):
    base = prose(12, 20)
    variants = [
        base, base[:5] + "Z" + base[6:], base[:5] + base[6:], base + "q", "q" + base, base[:9] + "é" + base[9:],
        base[:1] + "yy" + base[1:], "z" * 30, "z" * 31, "z" * 33
    ]
    rows = EDGES + [
        (200, "\n".join(variants)), (201, "\n".join(reversed(variants))), (199, "short\n" + base[:5] + "Z" + base[6:]),
        (202, "shorT\nshort")
    ]
    got = lines.dedup(docs(spark, rows)).collect()
    want = brute_lines(rows, 20)
    assert len(got) == len(rows)
    for r in got:
        assert r["text"] == want[r["doc_id"]], r["doc_id"]
    left = {r["doc_id"] for r in lines.dedup(docs(spark, rows), drop_emptied=True).collect()}
    assert 6 not in left and {1, 2, 3, 5, None} <= left


@settings(max_examples=200, deadline=None)
@given(st.text("ab", max_size=8), st.text("ab", max_size=8))
def test_within_one(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            d[i][j] = i or j if not (i and j) else min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if not i:
                d[i][j] = j
            elif not j:
                d[i][j] = i
    assert lines.within_one(a, b) == (d[-1][-1] <= 1)


def test_licenses(spark):
    rows = EDGES + [
        (300, prose(50, 31) + "\nLicensed under the Apache License, Version 2.0.\n" + prose(50, 32)),
        (301, "RELEASED under the  mit license! " + prose(9, 33) + " Released under the MIT License."),
        (
            302,
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without any restriction"
        ),
        (303, "Permission is hereby granted, free of charge, to nobody"),
    ]
    got = {(r["doc_id"], r["license"]): r for r in licenses.scan(docs(spark, rows)).collect()}
    assert set(got) == {(300, "Apache-2.0"), (301, "MIT"), (302, "MIT text")}
    assert got[301, "MIT"]["matches"] == 2 and got[
        300, "Apache-2.0"
    ]["containment"] == 1.0 and 0.8 <= got[302, "MIT text"]["containment"] < 1
    # against containment over every window of the template's size
    scanner = licenses.Scanner(licenses.NOTICES)
    r = random.Random(8)
    for name, notice in licenses.NOTICES.items():
        words = licenses.WORD.findall(notice)
        for _ in range(10):
            text = prose(r.randint(0, 90), r.random()) + " " + " ".join(words) + " " + prose(40, r.random())
            assert name in {x[0] for x in scanner.scan(text)}, name
    assert licenses.scan(docs(spark, rows), {}).count() == 0


def test_mixing(spark):
    r = random.Random(3)
    rows = [(k, prose(r.randint(0, 300), k)) for k in range(900)] + [(5, "again and again"), (5, "again and again"), (901, None)]
    frame = docs(spark, rows).withColumn(
        "source",
        F.expr("CASE WHEN doc_id % 10 < 6 THEN 'a' WHEN doc_id % 10 < 8 THEN 'b' WHEN doc_id % 10 = 8 THEN 'c' ELSE NULL END")
    )
    got = mixing.each_row(mixing.mix(frame, chunk=64)).collect()
    assert sorted((x.doc_id, x.size) for x in got) == sorted((i, len((t or "").split())) for i, t in rows)
    sizes = {}
    for x in got:
        sizes[x.source] = sizes.get(x.source, 0) + x.size
    want = brute_targets(sizes, {"a": 1, "b": 2, "c": 3, None: 1})
    for s in sizes:
        mine = [x for x in got if x.source == s]
        assert math.isclose(mine[0].target, want[s], rel_tol=1e-9) and mine[0].source_size == sizes[s]
        assert all(0 <= x.copies <= 3 for x in mine)
        assert abs(sum(x.size * x.copies for x in mine) - want[s]) <= 40
    assert sorted(got) == sorted(mixing.each_row(mixing.mix(frame, chunk=64)).collect())
    taken = mixing.apply(frame, chunk=64)
    assert taken.columns == frame.columns and taken.count() == sum(x.copies for x in got)
    assert {x.doc_id for x in mixing.mix(docs(spark)).collect()} == {i for i, _ in EDGES}


def brute_targets(sizes, weights):
    total, open_ = sum(sizes.values()), set(sizes)
    while True:
        left = total - sum(3 * sizes[s] for s in sizes if s not in open_)
        shares = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
        over = {s for s in open_ if shares[s] > 3 * sizes[s]}
        if not over:
            return {s: shares.get(s, 3.0 * sizes[s]) for s in sizes}
        open_ -= over


@pytest.mark.parametrize("share", [0.3, 1.0, 2.5, 9.0])
def test_targets_of_many_sources(spark, share):
    r = random.Random(4)
    names = sorted({"".join(r.choice("abcdeé") for _ in range(6)) for _ in range(300)})
    sizes = {n: r.choice([0, 1, 5, 50, 5000]) for n in names} | {None: 77}
    rows = [(k, n, s, 1) for k, (n, s) in enumerate(sizes.items())]
    got = mixing.targets(spark.createDataFrame(rows, "doc_id long, source string, size long, rows long"), (1, 2, 3), share, 3.0).collect()
    weights = {n: (1, 2, 3)[k % 3] for k, n in enumerate([*names, None])}
    want, open_, total = {}, set(sizes), share * sum(sizes.values())
    while open_:
        left = total - sum(want.values())
        over = {n for n in open_ if left * weights[n] / sum(weights[o] for o in open_) >= 3 * sizes[n]}
        if not over:
            want |= {n: left * weights[n] / sum(weights[o] for o in open_) for n in open_}
            break
        want |= {n: 3.0 * sizes[n] for n in over}
        open_ -= over
    assert {x.its_source for x in got} == set(sizes)
    assert all(math.isclose(x.target, want[x.its_source], rel_tol=1e-9, abs_tol=1e-9) for x in got)


def test_mixing_repeated_rows(spark):
    text = prose(53, 3)
    rows = [(1, text)] * 400 + [(2, text)] * 3 + [(10 + k, prose(30, k)) for k in range(200)] + [
        (None, prose(20 + k, 300 + k)) for k in range(30)
    ]
    frame = docs(
        spark, rows
    ).withColumns({"source": F.expr("CASE WHEN doc_id = 1 THEN 'a' WHEN doc_id <= 100 THEN 'b' END"), "copies": F.lit(9), "row": F.lit("mine"), "doc_id_": F.lit(0)})
    sizes = {"a": 400 * 53, "b": 3 * 53 + 91 * 30, None: 109 * 30 + sum(20 + k for k in range(30))}
    want = brute_targets(sizes, {"a": 1, "b": 2, None: 3})
    got = mixing.each_row(mixing.mix(frame)).collect()
    assert len(got) == len(rows)
    for s in sizes:
        assert abs(sum(x.size * x.copies for x in got if x.source == s) - want[s]) <= 53, s
    taken = mixing.apply(frame)
    assert taken.columns == frame.columns
    out = taken.collect()
    assert sum(r["doc_id"] == 1 for r in out) == sum(x.copies for x in got if x.doc_id == 1)
    assert len(out) == sum(x.copies for x in got) and all(r["row"] == "mine" and r["copies"] == 9 for r in out)


def test_bpe(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    c = bpe.BytePairCodec(bpe.read_ranks(path), public_tokenizers.PATTERN)
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    r = random.Random(2)
    texts = [t or "" for _, t in EDGES] + [
        "".join(chr(r.choice([r.randrange(32, 127), r.randrange(161, 0x2FF), r.randrange(0x4E00, 0x9FFF)])) for _ in range(300))
        for _ in range(50)
    ] + ["a" * 3000, "<|endoftext|>"]
    for t in texts:
        assert c.encode(t) == e.encode_ordinary(t)
    got = bpe.encode_decode(docs(spark), path, public_tokenizers.PATTERN, ids=True).collect()
    assert sorted(r["ids"] for r in got) == sorted(e.encode_ordinary(t or "") for _, t in EDGES)
    for r in got:
        assert r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()
    want = sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in EDGES)
    assert sorted(r["decoded_sha256"] for r in got) == want


def test_language(spark):
    r = random.Random(1)
    kinds = {"aa": "abcdef", "bb": "ghijkl", "cc": "éüßñöä"}
    rows = [
        (k, " ".join("".join(r.choice(kinds[name]) for _ in range(5)) for _ in range(30)), name) for k in range(240)
        for name in [list(kinds)[k % 3]]
    ]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 ...", "bb"), (1003, "abc def fed", None), (None, "ghi jkl ghi", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {x.doc_id: x for x in langid.identify(frame).collect()}
    assert len(got) == len(rows)
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (1000, 1001, 1002))
    held = [x for x in got.values() if x.held_out and x.doc_id is not None and x.doc_id < 1000]
    assert len(held) > 40 and sum(x.lang_pred == rows[x.doc_id][2] for x in held) >= 0.95 * len(held)
    assert all(0 <= x.score <= 1 for x in got.values())


def test_gradients():
    import numpy as np

    net = langid.ByteGru(["x", "y"], hidden=3, seed=2)
    codes, labels = np.random.default_rng(0).integers(0, 5, (6, 4)), np.array([0, 1, 0, 1])
    _, grads = net.gradients(codes, labels)
    for p, g in zip([net.x, net.u, net.v, net.c], grads):
        for at in [tuple(i) for i in np.argwhere(np.abs(g) > 1e-3)[:6]]:
            kept, losses = p[at], []
            for step in (1e-2, -1e-2):
                p[at] = kept + step
                losses.append(net.gradients(codes, labels)[0])
            p[at] = kept
            assert abs((losses[0] - losses[1]) / 2e-2 - g[at]) < 5e-3 + 0.1 * abs(g[at])


@pytest.mark.parametrize("run", [lambda d: substrings.remove_repeats(d), lambda d: simhash.near_duplicates(d), lambda d: lines.dedup(d), lambda d: licenses.scan(d), lambda d: mixing.mix(d), lambda d: langid.identify(d), lambda d: bpe.encode_decode(d, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN), lambda d: simhash.keep_one(d), lambda d: mixing.apply(d)])
def test_empty_table(spark, run):
    assert run(docs(spark).limit(0)).count() == 0


def test_keep_one(spark):
    kept = simhash.keep_one(docs(spark))
    assert kept.columns == docs(spark).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 5 in ids and 6 not in ids and ids.count(12) <= 1


@pytest.mark.parametrize("keep", [simhash.keep_one, simhash.keep_one_similar])
def test_keep_one_with_null_and_repeated_ids(spark, keep):
    texts = [prose(80, 70 + k) for k in range(6)]
    rows = [
        (None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (None, texts[4]), (9, texts[4]),
        (8, texts[5]), (8, texts[5]), (None, texts[5])
    ]
    got = sorted((r["doc_id"] or 0, r["text"]) for r in keep(docs(spark, rows)).collect())
    assert got == sorted([(0, texts[0]), (0, texts[1]), (7, texts[2]), (7, texts[3]), (9, texts[4]), (8, texts[5])])


def shingles(text, width=5):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    return {b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)} or ({b" ".join(w)} if w else set())


def groups_by_similarity(rows, least=0.8):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= least * len(a | b) > 0:
                root[top(i)] = top(j)
    return [top(i) for i in range(len(rows))]


def near_copies():
    r, rows = random.Random(8), []
    for base in range(40):
        words = prose(r.randint(60, 200), 1000 + base).split()
        for copy in range(r.randint(1, 5)):
            for _ in range(r.randint(0, 4)):
                words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("tile", [1024, 2])
def test_near_dedup_finds_all_similar_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "SETS", tile)
    rows = near_copies() + [(300, ""), (301, None), (302, "  "), (303, "one two"), (304, "One  two")]
    tops = groups_by_similarity(rows)
    least = {}
    for (i, _), t in zip(rows, tops):
        least[t] = min(i, least.get(t, i))
    kept = corpus_pipeline.near_dedup(spark, docs(spark, rows), None)
    assert kept.columns == docs(spark).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())


def test_bands_miss_few_pairs():
    r, met, n = random.Random(9), 0, 400
    number = simhash.band_plan(0.8, 0.0005)
    for k in range(n):
        both = [r.getrandbits(64) for _ in range(80)]
        a, b = (np.unique(np.array(both + [r.getrandbits(64) for _ in range(10)], np.uint64)) for _ in (0, 1))
        met += bool((simhash.bands(a, number) == simhash.bands(b, number)).any())
    assert met >= n - 3


def test_near_dedup_compares_blocks_of_simhash():
    r, number, bits = random.Random(10), 12, 7
    x = np.unique(np.array([r.getrandbits(64) for _ in range(301)], np.uint64))
    step, low = 0x9E3779B97F4A7C15, (1 << 64) - 1

    def drawn(h, k):  # splitmix64
        h = (h + (k + 1) * step) & low
        h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & low
        h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & low
        return h ^ (h >> 31)

    width = simhash.SKETCH + number * bits
    up = [sum(drawn(int(h), k // 64) >> k % 64 & 1 for h in x) * 2 > len(x) for k in range(width)]
    head, keys = simhash.wide_fingerprint(x, number, bits)
    assert [int(w) >> k & 1 for w in head.view(np.uint64) for k in range(64)] == up[: simhash.SKETCH]
    blocks = [up[at : at + bits] for at in range(simhash.SKETCH, width, bits)]
    assert keys.tolist() == [(k << bits) + sum(b << i for i, b in enumerate(x)) for k, x in enumerate(blocks)]
    assert (simhash.bands(x, number, bits) == keys).all()


@pytest.mark.parametrize("common, a, b", [(4, 0, 1), (12, 0, 3), (12, 1, 2), (16, 2, 2), (80, 10, 10), (80, 0, 20)])
def test_blocks_and_hamming_bound_miss_few_pairs(common, a, b):
    r, missed, n = random.Random(11), 0, 400
    number, most = simhash.band_plan(0.8, 0.0005 * 0.9, 9), simhash.hamming_bound(0.8, 0.0005 * 0.1)
    for _ in range(n):
        both = [r.getrandbits(64) for _ in range(common)]
        x, y = (np.array(both + [r.getrandbits(64) for _ in range(k)], np.uint64) for k in (a, b))
        (s, k), (t, m) = (simhash.wide_fingerprint(z, number, 9) for z in (x, y))
        missed += not (k == m).any() or int(np.bitwise_count(s.view(np.uint64) ^ t.view(np.uint64)).sum()) > most
    assert missed <= 2


def test_unrelated_sets_differ_in_more_bits():
    r, most = np.random.default_rng(12), simhash.hamming_bound(0.8, 0.00005)
    heads = [simhash.wide_fingerprint(r.integers(0, 1 << 63, 100, np.uint64), 1, 4)[0] for _ in range(300)]
    a, b = simhash.near_forest(np.arange(302), np.stack([*heads, heads[7], heads[7]]).view(np.uint64).T, most)
    assert sorted(zip(a.tolist(), b.tolist())) == [(300, 7), (301, 7)]


@pytest.mark.parametrize("tile, bucket", [(2, 1024), (8, 1024), (2048, 1)])
def test_near_dedup_splits_large_buckets(spark, monkeypatch, tile, bucket):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rows = near_copies()
    least = {}
    for (i, _), t in zip(rows, groups_by_similarity(rows)):
        least[t] = min(i, least.get(t, i))
    kept = corpus_pipeline.near_dedup(spark, docs(spark, rows), None)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())


def test_pieces_of_runs():
    r, sizes = random.Random(13), [1, 5, 3, 40, 2, 11, 7, 1]
    keys = [k for k, n in enumerate(sizes) for _ in range(n)]
    batches, at = [], 0
    while at < len(keys):
        n = r.randint(0, 6)
        batches.append(pa.record_batch([pa.array(keys[at : at + n], pa.int64()), pa.array(range(at, at + len(keys[at : at + n])), pa.int64())], names=["key", "row"]))
        at += n
    got = list(graph.pieces(batches, ["key"], 10))
    assert [x for t, _ in got for x in t.column("row").to_pylist()] == list(range(len(keys)))
    assert all(len(set(t.column("key").to_pylist())) == 1 and t.num_rows <= 16 for t, _ in got)
    assert all(large == (sizes[t.column("key")[0].as_py()] > 10) for t, large in got)
    assert [t.num_rows for t, large in got if not large] == [n for n in sizes if n <= 10]


def test_queries_are_named():
    assert len(queries.QUERIES) == 10 and all(re.match(r"op\d+_", n) for n in queries.QUERIES)


def test_no_join_gathers_a_growing_table_in_the_driver(spark, monkeypatch):
    """Exploded keys count as small as the table they come from, so Spark would broadcast them."""
    plans, cut = [], simhash.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString())
        return cut(df)

    monkeypatch.setattr(simhash, "cut", seen)
    monkeypatch.setattr("repolith.llm.graph.cut", seen)
    found = simhash.near_duplicates(docs(spark, near_copies()))
    plans.append(found._jdf.queryExecution().sparkPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 3 and not any("BroadcastHashJoin" in p for p in plans)
