"""Removal of long substrings that occur earlier, by suffix arrays (bucket-pointer refinement).

A repeated string can only be found where all its copies meet, so strings of
``length`` bytes ("windows") are first dealt to initial buckets by one of their
q-grams, the first of the least hash.  Neighbouring windows that chose the same
q-gram travel as one run, named by its bucket and a fingerprint of its text; a
run that occurs earlier is repeated as a whole.  Buckets with runs of different
text are refined by longer q-grams, and what these leave is refined to the end:
each task builds a suffix array of its texts by bucket-pointer refinement, in
which equal windows are neighbours, and the first of every distinct window of a
task meets those of other tasks by fingerprint.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.llm._common import BLOCKS, U64, block_batch, cut, deal, first_flags, gather, mix, parts_for, prepare, release, unpack, with_keys

#: Bytes of text worked on at a time, runs and windows held by a task before they are dealt out.
TEXT, RUNS, WINDOWS = 1 << 20, 500_000, 400_000
#: Bits for a place in such a text.
PLACE = 23
RUN = ["u8", "u8", "i8", "i8", "i8", "i4"]  # bucket, fingerprint, doc, tie, start, windows
SPAN = ["i8", "i8", "i8", "i8"]  # doc, tie, start, windows
WINDOW = ["u8", "u8", "i8", "i8", "i8"]  # two fingerprints, doc, tie, start
FOUND = "what int, doc long, tie long, start long, n long"


class Grams:
    """Polynomial hashes modulo 2^64 of all substrings of a length, from those of powers of two."""

    def __init__(self, data: np.ndarray, base: int = 0x9E3779B97F4A7C15):
        self.base, self.steps, k = base, [data.astype(U64) + U64(1)], 1
        self.n = len(data)

    def step(self, level: int) -> np.ndarray:
        while len(self.steps) <= level:
            k, h = 1 << (len(self.steps) - 1), self.steps[-1]
            self.steps.append(h[: len(h) - k] * U64(pow(self.base, k, 1 << 64)) + h[k:])
        return self.steps[level]

    def of(self, k: int, at: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the k-grams at the given positions (else at all)."""
        count = max(0, self.n - k + 1)
        out, offset = None, 0
        for level in range(k.bit_length() - 1, -1, -1):
            if k >> level & 1:
                h = self.step(level)
                part = h[offset : offset + count] if at is None else h[at + offset]
                out = part if out is None else out * U64(pow(self.base, 1 << level, 1 << 64)) + part
                offset += 1 << level
        return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    m, k = x, 1
    while 2 * k <= width:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    return np.minimum(m[: len(m) - (width - k)], m[width - k :]) if width > k else m


def bucket_runs(text: bytes, starts: np.ndarray, ends: np.ndarray, length: int, q: int):
    """(bucket, fingerprint, document index, start in text, windows) of the runs of a text made of documents [start, end)."""
    data = np.frombuffer(text, np.uint8)
    if len(data) < length:
        return None
    grams = Grams(data)
    bucket = mix(grams.of(q))
    place = U64((1 << PLACE) - 1)
    least = sliding_min((bucket & ~place) | np.arange(len(bucket), dtype=U64), length - q + 1)
    n = len(least)
    doc = np.repeat(np.arange(len(starts)), ends - starts)[:n]
    valid = np.arange(n) + length <= ends[doc]
    begins = valid.copy()
    begins[1:] &= (least[1:] != least[:-1]) | ~valid[:-1] | (doc[1:] != doc[:-1])
    at = np.flatnonzero(begins)
    if not len(at):
        return None
    # windows of a run hold the same first least q-gram at different offsets, so they differ from each other
    stops = np.append(np.flatnonzero(begins | ~valid), n)
    sizes = stops[np.searchsorted(stops, at, "right")] - at
    name = mix(mix(grams.of(length, at)) * U64(3) + grams.of(length, at + sizes - 1) + sizes.astype(U64))
    return bucket[(least[at] & place).astype(np.int64)], name, doc[at], at, sizes


def merged(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Join spans of one document that touch or overlap."""
    order = np.lexsort([start, tie, doc])
    doc, tie, start, end = doc[order], tie[order], start[order], (start + n)[order]
    if not len(doc):
        return [doc, tie, start, end]
    other = np.ones(len(doc), bool)
    other[1:] = (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])
    # ends may only grow within a document; an offset for each document keeps them apart
    reach = np.maximum.accumulate(end + np.cumsum(other) * (end.max() + 1)) - np.cumsum(other) * (end.max() + 1)
    new = other.copy()
    new[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return [doc[at], tie[at], start[at], reach[np.append(at[1:], len(doc)) - 1] - start[at]]


def suffix_array(codes: np.ndarray, q: int = 3, shards: int = 8) -> np.ndarray:
    """Suffixes in order, by bucket-pointer refinement.

    Initial buckets hold suffixes of equal q-gram, and a suffix's pointer is its
    bucket's first place.  Buckets whose suffixes agree on h symbols are sorted by
    the pointers of the suffixes h symbols later; the pointers of the new buckets
    are used at once by the buckets refined next, which so become finer than 2h.
    """
    n = len(codes)
    if not n:
        return np.empty(0, np.int64)
    bits = max(1, int(codes.max(initial=0)) + 2).bit_length()
    q = min(q, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(q):
        key <<= bits
        key[: n - k] |= codes[k:] + 1
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    place = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    pointer = np.full(n + 1, -1, np.int64)
    pointer[order] = place
    depth = q
    while True:
        single = new & np.append(new[1:], True)
        slots = np.flatnonzero(~single)
        if not len(slots):
            return order
        heads = np.flatnonzero(new[slots])
        for part in np.array_split(heads, min(shards, len(heads))):
            last = heads[np.searchsorted(heads, part[-1]) + 1] if part[-1] != heads[-1] else len(slots)
            here = slots[part[0] : last]
            members = order[here]
            bucket, later = pointer[members], pointer[np.minimum(members + depth, n)]
            by = np.lexsort([later, bucket])
            members, bucket, later = members[by], bucket[by], later[by]
            order[here] = members
            fresh = np.ones(len(here), bool)
            fresh[1:] = (bucket[1:] != bucket[:-1]) | (later[1:] != later[:-1])
            new[here] = fresh
            pointer[members] = here[np.maximum.accumulate(np.where(fresh, np.arange(len(here)), 0))]
        depth *= 2


def window_classes(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of some texts: (piece, start) in suffix order and whether a window begins a class of equal ones."""
    sizes = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    borders = np.cumsum(sizes + 1) - 1
    codes = data.astype(np.int64) + len(pieces)
    codes[borders] = np.arange(len(pieces))  # every text ends with a symbol of its own
    piece = np.repeat(np.arange(len(pieces)), sizes + 1)
    order = suffix_array(codes)
    order = order[order + length <= borders[piece[order]]]
    if not len(order):
        return order, order, np.ones(0, bool)
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    new = np.ones(len(order), bool)
    for s in range(1, len(order), 1 << 15):
        e = min(s + (1 << 15), len(order))
        new[s:e] = (view[order[s:e]] != view[order[s - 1 : e - 1]]).any(axis=1)
    return piece[order], order - (borders - sizes)[piece[order]], new


def _rows(what: int, cols: list[np.ndarray]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(cols[0]), what, np.int32)), *[pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(cols, kinds)]],
        names=["what", "doc", "tie", "start", "n"]
    )


def _spread(doc: np.ndarray, n: int) -> np.ndarray:
    return (mix(doc.astype(np.int64).view(U64)) % U64(n)).astype(np.int64)


def stretches(runs) -> list[tuple[int, int]]:
    """(start, windows) of runs, those that touch joined."""
    out: list[tuple[int, int]] = []
    for s, n in sorted((r["start"], r["n"]) for r in runs):
        if out and s <= sum(out[-1]):
            out[-1] = out[-1][0], max(out[-1][1], s + n - out[-1][0])
        else:
            out.append((s, n))
    return out


def only(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """The texts, with the runs that are left to refine."""
    wanted = found.filter("what = 1").groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    return wanted.join(keyed, ["doc", "tie"]).select("doc", "tie", "body", "runs")


def find_runs(rows: DataFrame, length: int, q: int, parts: int) -> DataFrame:
    """Repeated spans (what 0) and the runs whose bucket holds runs of other text (what 1), of whole texts or of their ``runs``."""

    def scatter(batches):
        held, texts, size = [[] for _ in RUN], [], 0

        def work():
            nonlocal texts, size
            ends = np.cumsum([len(t[3]) for t in texts])
            starts = ends - [len(t[3]) for t in texts]
            found = bucket_runs(b"".join(t[3] for t in texts), starts, ends, length, q)
            if found:
                bucket, name, doc, at, n = found
                ids, ties, base = (np.array([t[k] for t in texts], np.int64) for k in (0, 1, 2))
                for h, c in zip(held, (bucket, name, ids[doc], ties[doc], at - starts[doc] + base[doc], n.astype("i4"))):
                    h.append(c)
            texts, size = [], 0

        def flush():
            cols = [np.concatenate(h) if h else np.empty(0, k) for h, k in zip(held, RUN)]
            for h in held:
                h.clear()
            order, new, first = first_flags(cols[:2], cols[2:5])
            cols = [c[order] for c in cols]
            again = merged(*[c[~first] for c in cols[2:]])
            firsts = [c[new] for c in cols]
            rows = [(p, 1, b) for p, b in deal(_spread(again[0], parts), [c.astype(k) for c, k in zip(again, SPAN)])]
            rows += [(p, 0, b) for p, b in deal((firsts[0] % U64(parts)).astype(np.int64), firsts)]
            return block_batch(rows)

        for b in batches:
            runs = b.column(3).to_pylist() if b.num_columns > 3 else [None] * b.num_rows
            for doc, tie, body, some in zip(*(b.column(k).to_pylist() for k in range(3)), runs):
                whole = [(0, len(body) - length + 1)] if some is None else stretches(some)
                for base, n in ((at, min(TEXT, s + w - at)) for s, w in whole for at in range(s, s + w, TEXT)):
                    part = body[base : base + n + length - 1]
                    if len(part) < length:
                        continue
                    texts.append((doc, tie, base, part))
                    size += len(part)
                    if size >= TEXT:
                        work()
            if sum(map(len, held[0])) >= RUNS:
                yield flush()
        if texts:
            work()
        yield flush()
        release()

    def reduce(kinds):
        cols = unpack(kinds.get(0, []), RUN)
        order, new, first = first_flags(cols[:2], cols[2:5])
        cols = [c[order] for c in cols]
        again, known = [c[~first] for c in cols[2:]], unpack(kinds.get(1, []), SPAN)
        yield _rows(0, merged(*[np.concatenate(x) for x in zip(again, known)]))
        heads = [c[new] for c in cols]
        bucket = heads[0]
        shared = np.zeros(len(bucket), bool)
        if len(bucket):
            same = bucket[1:] == bucket[:-1]
            shared[1:] |= same
            shared[:-1] |= same
        yield _rows(1, [c[shared] for c in heads[2:]])

    return gather(rows.mapInArrow(scatter, BLOCKS), reduce, FOUND)


def find_windows(rows: DataFrame, length: int, parts: int) -> DataFrame:
    """Repeated windows among runs whose text differs."""

    def scatter(batches):
        pieces, places, size = [], [], 0

        def flush():
            nonlocal pieces, places, size
            piece, start, new = window_classes(pieces, length)
            doc, tie, base = (np.array([p[k] for p in places], np.int64)[piece] for k in range(3))
            place = [doc, tie, base + start]
            order, head, first = first_flags([np.cumsum(new)], place)
            again = merged(*[c[order][~first] for c in place], np.ones((~first).sum(), np.int64))
            at = order[head]
            text = np.frombuffer(b"".join(pieces), np.uint8)
            offset = np.cumsum([0, *map(len, pieces[:-1])])
            where = offset[piece[at]] + start[at]
            firsts = [mix(Grams(text).of(length, where)), mix(Grams(text, 0xD6E8FEB86659FD93).of(length, where)), *[c[at] for c in place]]
            rows = [(p, 1, b) for p, b in deal(_spread(again[0], parts), [c.astype(k) for c, k in zip(again, SPAN)])]
            rows += [(p, 0, b) for p, b in deal((firsts[0] % U64(parts)).astype(np.int64), [c.astype(k) for c, k in zip(firsts, WINDOW)])]
            pieces, places, size = [], [], 0
            return block_batch(rows)

        for b in batches:
            for doc, tie, body, runs in zip(*(b.column(k).to_pylist() for k in range(4))):
                for s, n in stretches(runs):
                    pieces.append(body[s : s + n + length - 1])
                    places.append((doc, tie, s))
                    size += n
                    if size >= WINDOWS:
                        yield flush()
        if pieces:
            yield flush()

    def reduce(kinds):
        cols = unpack(kinds.get(0, []), WINDOW)
        order, _, first = first_flags(cols[:2], cols[2:])
        again = [c[order][~first] for c in cols[2:]] + [np.ones((~first).sum(), np.int64)]
        yield _rows(0, merged(*[np.concatenate(x) for x in zip(again, unpack(kinds.get(1, []), SPAN))]))

    return gather(rows.mapInArrow(scatter, BLOCKS), reduce, FOUND)


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, kept (the remaining bytes), n_bytes, spans (removed [start, end) byte ranges, maximal).

    A byte goes if a ``length``-byte string that covers it also starts earlier, in
    a document of smaller doc_id or earlier in the same one, as the input stands.
    Texts are whole UTF-8; null texts are empty.  A null doc_id is the smallest;
    rows that repeat doc_id and text are one document and all get its result;
    different texts under one doc_id are ordered by a hash.  An empty table gives
    no rows.  Texts shorter than ``length`` stay as they are.
    """
    prepare(docs.sparkSession)
    # the texts are dealt by document once, and that exchange serves the refinements and the result
    keyed = with_keys(docs).select("doc", "tie", "body")
    parts = parts_for(docs)
    found = cut(find_runs(keyed, length, max(1, min(20, length // 2)), parts))
    finer = find_runs(only(keyed, found), length, max(1, length * 4 // 5), parts)
    last = find_windows(only(keyed, finer), length, parts)
    repeats = found.filter("what = 0").union(finer.filter("what = 0")).union(last)
    spans = repeats.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    doc_id = F.when(F.col("doc") != -(2**63), F.col("doc")).alias("doc_id")
    rows = keyed.join(spans, ["doc", "tie"], "left").select(doc_id, "body", "runs")
    out_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut_out(batches):
        for b in batches:
            kept, spans_ = [], []
            for body, runs_ in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                joined: list[dict] = []
                for r in sorted(runs_ or [], key=lambda r: r["start"]):
                    s, e = r["start"], r["start"] + r["n"] + length - 1
                    if joined and s <= joined[-1]["end"]:
                        joined[-1]["end"] = max(joined[-1]["end"], e)
                    else:
                        joined.append({"start": s, "end": e})
                at, left = 0, []
                for r in joined:
                    left.append(body[at : r["start"]])
                    at = r["end"]
                kept.append(b"".join([*left, body[at:]]))
                spans_.append(joined)
            sizes = pa.array([len(x) for x in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(kept, pa.binary()), sizes, pa.array(spans_, out_type)],
                names=["doc_id", "kept", "n_bytes", "spans"]
            )

    return rows.mapInArrow(cut_out, "doc_id long, kept binary, n_bytes long, spans array<struct<start: long, end: long>>")
