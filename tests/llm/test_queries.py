"""The registered queries themselves, against their SQL or a plain version, on the smallest tables and on planted rows."""

import math
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from repolith.llm import bpe, langid, licenses, queries

SF = "/root/testdata/sf0.001"


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


def compare(spark, name, folder):
    found = queries.QUERIES[name](spark, folder)
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(
            f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'/*.parquet' if folder != SF else ''}')"
        ) if t == "documents" or folder == SF else None
    run = con.execute(queries.ORACLE[name])
    named = [c[0] for c in run.description]
    assert sorted(named) == sorted(found.columns)
    want = sorted((tuple(plain(r[named.index(c)]) for c in found.columns) for r in run.fetchall()), key=repr)
    got = sorted((tuple(plain(v) for v in r) for r in found.collect()), key=repr)
    assert got == want
    return got


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_and_sql_agree(spark, name):
    compare(spark, name, SF)


def test_license_scan_on_near_misses(spark, tmp_path):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    rows = [(0, ""), (1, "mit"), (2, " ".join(word() for _ in range(4000)))]
    for name, notice in sorted(licenses.NOTICES.items()):
        words = notice.split()
        for gap in (0, 1, 3):
            told = list(words)
            for _ in range(gap):
                told[r.randrange(len(told))] = word()
            rows.append((len(rows), " ".join([word() for _ in range(r.randrange(300))] + told + [word() for _ in range(r.randrange(300))])))
        rows.append((len(rows), " ".join([*words, *[word() for _ in range(500)], *words, words[0]])))
    rows += [rows[-1], (None, rows[5][1])]
    spark.createDataFrame(rows[:-2], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = compare(spark, "op5_license_scan", str(tmp_path))
    assert len(got) > 20 and any(x[2] < 1 for x in got) and any(x[3] == 2 for x in got)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert licenses.scan(frame).count() == len(got) + sum(x[0] == rows[-2][0] for x in got) + sum(x[0] == 5 for x in got)


def loop_states(net, codes, d):
    """Hidden states after each byte, one unit at a time."""
    h, state, out = net.hidden, [0.0] * net.hidden, {}
    for t in range(len(codes)) if d == 0 else range(len(codes) - 1, -1, -1):
        x = net.x[d][:, codes[t]].astype(float)
        g = [sum(float(net.u[d][k][j]) * state[j] for j in range(h)) for k in range(3 * h)]
        clip = lambda v, low: min(1.0, max(low, v))
        z, r = ([clip(x[o + k] + g[o + k] + 0.5, 0.0) for k in range(h)] for o in (0, h))
        n = [clip(x[2 * h + k] + r[k] * g[2 * h + k], -1.0) for k in range(h)]
        state = [z[k] * (state[k] - n[k]) + n[k] for k in range(h)]
        out[t] = state
    return out


def loop_pooled(net, text):
    """Every position's probabilities, read in overlapping lanes one byte after the other."""
    lane, side = langid.LANE, langid.CONTEXT
    codes = text if len(text) >= lane else text.ljust(lane)
    starts = list(range(0, max(1, len(codes) - lane + 1), lane - 2 * side))
    if starts[-1] + lane < len(codes):
        starts.append(len(codes) - lane)
    total, at = np.zeros(len(net.languages)), 0
    for i, s in enumerate(starts):
        part = codes[s : s + lane]
        ends = len(text) if i + 1 == len(starts) else s + lane - side
        both = [loop_states(net, part, d) for d in (0, 1)]
        for t in range(at, ends):
            v = net.v.astype(float) @ np.array(both[0][t - s] + both[1][t - s]) + net.c[:, 0]
            e = np.exp(v - v.max())
            total += e / e.sum()
        at = ends
    assert at == len(text)
    return total / len(text)


def test_language_network_by_plain_loops():
    net = langid.ByteGru(["aa", "bb", "cc"], hidden=3, seed=4)
    r = random.Random(2)
    texts = [bytes(r.randrange(256) for _ in range(n)) for n in (1, 5, 127, 128, 129, 239, 240, 241, 500, 1000)]
    got = net.pooled([*texts, b""])
    assert (got[-1] == 0).all()
    for t, p in zip(texts, got):
        assert np.allclose(p, loop_pooled(net, t), atol=1e-4), len(t)


def test_every_label_is_learned(spark):
    r = random.Random(1)
    rows = [(k, "".join(chr(0x4E00 + 40 * (k % 80) + r.randrange(40)) for _ in range(60)), f"l{k % 80:02d}") for k in range(320)]
    model = langid.train(spark.createDataFrame(rows * 2, "doc_id long, text string, lang string"), rows_per_language=3)
    assert model.languages == [f"l{k:02d}" for k in range(80)]
    again = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7), rows_per_language=3)
    assert all((a == b).all() for a, b in zip((model.x, model.u, model.v), (again.x, again.u, again.v)))


def test_numbers_are_no_letters(spark):
    frame = spark.createDataFrame([(1, "½ ② 12"), (2, "é"), (3, "中"), (4, None)], "doc_id long, text string")
    got = {x.doc_id: x.lang_pred for x in langid.predict(frame, langid.ByteGru(["aa", "bb"]), ["doc_id"]).collect()}
    assert got[1] == got[4] == "und" and "und" not in (got[2], got[3])


def test_held_out_accuracy(spark):
    rows = queries.QUERIES["op9_language_id"](spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id"
    )
    held = [x for x in rows.filter("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()]
    assert len(held) > 100 and sum(x.lang == x.lang_pred for x in held) >= 0.97 * len(held)


def test_codec_query_equals_the_library(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.BytePairCodec(bpe.read_ranks(path), public_tokenizers.PATTERN).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op10_bpe_codec"](spark, SF).collect()
    assert len(got) == len(docs) and all(x.n_tokens == len(library.encode_ordinary(docs[x.doc_id])) for x in got)


def test_mix_query_adds_up(spark):
    got = queries.QUERIES["op6_source_mix"](spark, SF).collect()
    docs = {x.doc_id: x for x in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(x.doc_id for x in got) == sorted(docs) and all(x.taken <= 3 * x.size for x in got)
    by = {}
    for x in got:
        by.setdefault(docs[x.doc_id].source, []).append(x)
    for rows in by.values():
        assert sum(x.size for x in rows) == rows[0].source_size and abs(
            sum(x.taken for x in rows) - rows[0].target
        ) <= max(x.size for x in rows)
    assert math.isclose(sum(r[0].target for r in by.values()), sum(r[0].source_size for r in by.values()), rel_tol=1e-9)
