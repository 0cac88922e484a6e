"""Line dedup by a deletion-neighbourhood join.

A line goes if an earlier line (smaller doc_id, or the same document and above)
is equal or within one edit (a character put in, left out or replaced).  Lines
within one edit agree on their first or on their last half, so a first pass deals
hashes of both halves and keeps, of all distinct lines, those that share a half
with another; a map task settles a half that several of its own lines share, and
sends one line for each half on, so a half that very many lines share loads no
reducer.  The lines kept emit their deletion neighbourhood as hashed keys: the line
itself and each variant with one character left out, and again each variant with
its place.  Equal keys join: a variant with a line for a deletion, two variants
of one place for a replacement.  Joined pairs are verified on their text.

Lines are equal if 128 bits of XXH3 of their UTF-8 bytes agree.  Keys of variants are
polynomials, one modulo 2^64 and two modulo the prime 2^31 - 1, so that no family of
texts collides whatever the base.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolith.llm._common import BLOCKS, U64, block_batch, cut, deal, first_flags, gather, mix, parts_for, prepare, release, unpack, unused, with_keys

#: Characters worked on at a time; lines and variants that a task holds before it deals them out.
TEXT, LINES, VARIANTS = 1 << 19, 200_000, 1_000_000
EQUAL = ["u8", "u8", "i8", "i8", "i4", "i1"]  # two hashes, doc, tie, line, whether it shares a half
HALF = ["u8", "u8", "i8", "i8", "i4", "i1"]  # half's key, line's hash, doc, tie, line, whether other lines of its task share it
GONE = ["i8", "i8", "i4"]  # doc, tie, line
VARIANT = ["u8", "u8", "i8", "i8", "i4", "i1"]  # two keys, doc, tie, line, kind
BASE, BASES, PRIME = 0x9E3779B97F4A7C15, (1_103_515_245, 1_566_083_941), (1 << 31) - 1
#: Characters that make no line: code points of white space below 0x3001.
BLANK = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288], np.uint32)


class Prefixes:
    """Hashes of any stretch of a text, from prefix sums: modulo 2^64, or modulo the prime 2^31 - 1."""

    powers: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, codes: np.ndarray, base: int, prime: bool = False):
        n, self.prime = len(codes), prime
        up, down = self.powers.get((base, prime), (np.empty(0, U64),) * 2)
        if len(up) <= n:
            size = max(n + 1, TEXT + 1)
            up, down = (self._row(b, size) for b in (base, pow(base, -1, PRIME if prime else 1 << 64)))
            if size <= 4 * TEXT:
                self.powers[base, prime] = up, down
        self.up, self.down = up, down
        self.sums = np.zeros(n + 1, U64)
        terms = self._low((codes.astype(U64) + U64(1)) * up[:n])  # in the prime field below 2^31, so that sums don't overflow
        np.cumsum(terms, out=self.sums[1:])
        if prime:
            self.sums = self._low(self.sums)

    def _low(self, x: np.ndarray) -> np.ndarray:
        if not self.prime:
            return x
        p, s = U64(PRIME), U64(31)
        x = (x & p) + (x >> s)
        x = (x & p) + (x >> s)
        return np.where(x >= p, x - p, x)

    def _row(self, base: int, size: int) -> np.ndarray:
        """base ** 0, 1, 2, ... by doubling."""
        out = np.ones(size, U64)
        n = 1
        while n < size:
            top = U64(pow(base, n, PRIME if self.prime else 1 << 64))
            out[n : 2 * n] = self._low(out[: min(n, size - n)] * top)
            n *= 2
        return out

    def _less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a + U64(PRIME) - b if self.prime else a - b

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._low(self._low(self._less(self.sums[end], self.sums[start])) * self.down[start])

    def without(self, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
        """[start, end) with the character at ``at`` left out."""
        after = self._low(self._low(self._less(self.sums[end], self.sums[at + 1])) * self.down[1])
        return self._low(self._low(self._less(self.sums[at], self.sums[start]) + after) * self.down[start])


def within_one(a: str, b: str) -> bool:
    """Whether at most one edit leads from one line to the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _rows(what: int, cols) -> pa.RecordBatch:
    names, kinds = ["what", "doc", "tie", "line", "doc2", "tie2", "line2"], [pa.int64(), pa.int64(), pa.int32()] * 2
    cols = [*cols, *[np.zeros(len(cols[0]))] * (6 - len(cols))]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(cols[0]), what, np.int32)), *[pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(cols, kinds)]],
        names=names
    )


FOUND = "what int, doc long, tie long, line int, doc2 long, tie2 long, line2 int"


def find_lines(keyed: DataFrame, near: int, parts: int) -> DataFrame:
    """Lines that an equal line precedes (what 0), and first lines that share a half with another line (what 1; some come twice)."""

    def scatter(batches):
        texts, size = [], 0
        held: list[list[np.ndarray]] = [[] for _ in range(9)]  # two hashes, four half keys, doc, tie, line

        def work():
            nonlocal texts, size
            whole = "\n".join(t[2] for t in texts)
            codes = _codes(whole + "\n")
            ends = np.flatnonzero(codes == 10)
            starts = np.r_[0, ends[:-1] + 1]
            counts = np.array([t[2].count("\n") + 1 for t in texts])
            doc = np.repeat(np.arange(len(texts)), counts)
            line = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
            solid = np.r_[0, np.cumsum(~((codes <= 12288) & np.isin(codes, BLANK)))]
            some = solid[ends] > solid[starts]
            digests = [xxhash.xxh3_128_digest(x) for x, s in zip(whole.encode("utf-8", "surrogatepass").split(b"\n"), some) if s]
            h1, h2 = np.frombuffer(b"".join(digests), U64).reshape(-1, 2).T
            starts, ends, doc, line = starts[some], ends[some], doc[some], line[some]
            one, n = Prefixes(codes, BASE), ends - starts
            halves = []
            for m in (n - 1, n):
                half = np.maximum(m, 0) // 2
                salt = m.astype(np.int64).view(U64) * U64(0xC2B2AE3D27D4EB4F)
                halves += [mix(one.of(starts, starts + half) + salt), mix(one.of(ends - (m - half), ends) + salt + U64(1))]
            for k in halves:
                k[n < near] = 0
            ids, ties = (np.array([t[k] for t in texts], np.int64) for k in (0, 1))
            for h, c in zip(held, [h1, h2, *halves, ids[doc], ties[doc], line.astype("i4")]):
                h.append(c)
            texts, size = [], 0

        def flush():
            cols = [np.concatenate(h) if h else np.empty(0, np.int64) for h in held]
            for h in held:
                h.clear()
            order, new, first = first_flags(cols[:2], cols[6:])
            cols = [c[order] for c in cols]
            gone = [c[~first] for c in cols[6:]]
            cols = [c[new] for c in cols]
            h1, h2, *halves = cols[:6]
            place = cols[6:]
            rows = [(p, 1, b) for p, b in deal((mix(gone[0].view(U64)) % U64(parts)).astype(np.int64), gone)] if len(gone[0]) else []
            if len(h1):
                # the lines are distinct here: where two have a half, all of its lines share it, and the first of them goes on
                key, at = np.concatenate(halves), np.tile(np.arange(len(h1)), 4)
                key, at = key[key != 0], at[key != 0]
                by = np.argsort(key, kind="stable")
                key, at = key[by], at[by]
                head = np.ones(len(key), bool)
                head[1:] = key[1:] != key[:-1]
                several = ~(head & np.append(head[1:], True)) if len(key) else head
                flag = np.zeros(len(h1), "i1")
                flag[at[several]] = 1
                rows += [(p, 0, b) for p, b in deal((h1 % U64(parts)).astype(np.int64), [h1, h2, *place, flag])]
                key, at, several = key[head], at[head], several[head]
                rows += [
                    (p, 2, b) for p,
                    b in deal((key % U64(parts)).astype(np.int64), [key, h1[at], *[c[at] for c in place], several.astype("i1")])
                ]
            return block_batch(rows)

        for b in batches:
            for doc, tie, body in zip(*(b.column(k).to_pylist() for k in range(3))):
                texts.append((doc, tie, body.decode("utf-8", "replace")))
                size += len(texts[-1][2]) + 1
                if size >= TEXT:
                    work()
            if sum(map(len, held[0])) >= LINES:
                yield flush()
        if texts:
            work()
        yield flush()
        release()

    def reduce(kinds):
        cols = unpack(kinds.get(0, []), EQUAL)
        order, new, first = first_flags(cols[:2], cols[2:5])
        cols = [c[order] for c in cols]
        yield _rows(0, [np.concatenate(x) for x in zip([c[~first] for c in cols[2:5]], unpack(kinds.get(1, []), GONE))])
        if len(order):
            yield _rows(1, [c[new][np.logical_or.reduceat(cols[5] > 0, np.flatnonzero(new))] for c in cols[2:5]])
        cols = unpack(kinds.get(2, []), HALF)
        order, new, _ = first_flags(cols[:2], cols[2:5])
        key, flag = cols[0][order], cols[5][order] > 0
        if len(key):
            # a half is shared if two lines have it, in one task or in several
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            shared = np.logical_or.reduceat(flag, start) | (np.add.reduceat(new.astype(np.int64), start) > 1)
            shared = np.repeat(shared, np.diff(np.r_[start, len(key)])) & new
            yield _rows(1, [c[order][shared] for c in cols[2:5]])

    return gather(keyed.select("doc", "tie", "body").mapInArrow(scatter, BLOCKS), reduce, FOUND)


def near_lines(keyed: DataFrame, wanted: DataFrame, parts: int) -> DataFrame:
    """(doc, tie, line) of the wanted lines that an earlier wanted line precedes within one edit."""
    lines = wanted.groupBy("doc", "tie").agg(F.collect_set("line").alias("lines")).join(
        keyed.select("doc", "tie", "body").dropDuplicates(["doc", "tie"]), ["doc", "tie"]
    )

    def pick(batches):
        for b in batches:
            out = []
            for doc, tie, at, body in zip(*(b.column(k).to_pylist() for k in range(4))):
                every = body.decode("utf-8", "replace").split("\n")
                out += [(doc, tie, i, every[i]) for i in at]
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int64(), pa.int32(), pa.string()])],
                names=["doc", "tie", "line", "text"]
            )

    texts = cut(lines.select("doc", "tie", "lines", "body").mapInArrow(pick, "doc long, tie long, line int, text string"))

    def scatter(batches):
        held, size = [[] for _ in VARIANT], 0

        def work(rows):
            nonlocal size
            codes = _codes("".join(r[3] for r in rows))
            ends = np.cumsum([len(r[3]) for r in rows])
            n = np.diff(np.r_[0, ends])
            row, at = np.repeat(np.arange(len(rows)), n), np.arange(len(codes))
            starts, ends_ = (ends - n)[row], ends[row]
            hashes = [Prefixes(codes, BASE), *[Prefixes(codes, b, True) for b in BASES]]
            out = [h.without(starts, ends_, at) for h in hashes]
            whole = [h.of(ends - n, ends) for h in hashes]
            out, whole = ([x[0], (x[1] << U64(32)) | x[2]] for x in (out, whole))
            place = (at - starts + 1).astype(U64) * U64(0xC2B2AE3D27D4EB4F)
            keys = [np.concatenate([mix(out[0] + place), mix(out[0]), mix(whole[0])]), np.concatenate([out[1] + place, out[1], whole[1]])]
            which = np.concatenate([row, row, np.arange(len(rows))])
            ids = [np.array([r[k] for r in rows], np.int64)[which] for k in range(3)]
            kind = np.repeat(np.array([0, 1, 2], "i1"), [len(row), len(row), len(rows)])
            for h, c, k in zip(held, [*keys, *ids, kind], VARIANT):
                h.append(c.astype(k))
            size += len(which)

        def flush():
            nonlocal size
            cols = [np.concatenate(h) if h else np.empty(0, k) for h, k in zip(held, VARIANT)]
            for h in held:
                h.clear()
            size = 0
            return block_batch([(p, 0, b) for p, b in deal((cols[0] % U64(parts)).astype(np.int64), cols)])

        for b in batches:
            rows, chars = [], 0
            for r in zip(*(b.column(k).to_pylist() for k in range(4))):
                rows.append(r)
                chars += len(r[3])
                if chars > TEXT:
                    work(rows)
                    rows, chars = [], 0
                    if size >= VARIANTS:
                        yield flush()
            if rows:
                work(rows)
            if size >= VARIANTS:
                yield flush()
        yield flush()

    def reduce(kinds):
        cols = unpack(kinds.get(0, []), VARIANT)
        order = np.lexsort([cols[4], cols[3], cols[2], cols[1], cols[0]])
        cols = [c[order] for c in cols]
        n = len(order)
        if not n:
            return
        new = np.ones(n, bool)
        new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
        group, at, kind = np.cumsum(new) - 1, np.arange(n), cols[5]
        first = {}
        for k in (0, 1, 2):
            first[k] = np.full(group[-1] + 1, n, np.int64)
            np.minimum.at(first[k], group[kind == k], at[kind == k])
        # a place-keyed variant joins its group's first; a variant joins the line it equals, and a line the first variant
        partner = np.select([kind == 0, kind == 1, kind == 2], [first[0][group], first[2][group], first[1][group]])
        pair = np.flatnonzero(partner < at)
        other = partner[pair]
        differs = (cols[2][pair] != cols[2][other]) | (cols[3][pair] != cols[3][other]) | (cols[4][pair] != cols[4][other])
        pair, other = pair[differs], other[differs]
        yield _rows(2, [*[c[pair] for c in cols[2:5]], *[c[other] for c in cols[2:5]]])

    pairs = gather(texts.mapInArrow(scatter, BLOCKS), reduce, FOUND).select("doc", "tie", "line", "doc2", "tie2", "line2").distinct()
    named = texts.select(F.col("doc").alias("doc2"), F.col("tie").alias("tie2"), F.col("line").alias("line2"), F.col("text").alias("text2"))
    both = pairs.join(texts, ["doc", "tie", "line"]).join(named, ["doc2", "tie2", "line2"]).select("doc", "tie", "line", "text", "text2")

    def verify(batches):
        for b in batches:
            ok = [within_one(x, y) for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in b.columns[:3]], names=["doc", "tie", "line"])

    return both.mapInArrow(verify, "doc long, tie long, line int")


def duplicate_lines(keyed: DataFrame, near: int, parts: int) -> DataFrame:
    """doc, tie and the numbers of the lines to remove."""
    found = cut(find_lines(keyed, near, parts))
    wanted = found.filter("what = 1").select("doc", "tie", "line").distinct()
    gone = found.filter("what = 0").select("doc", "tie", "line").union(near_lines(keyed, wanted, parts))
    return gone.groupBy("doc", "tie").agg(F.collect_set("line").alias("gone"))


def dedup(docs: DataFrame, near: int = 20, drop_emptied: bool = False, counts: bool = True) -> DataFrame:
    """The rows of ``docs`` with text reduced, and (with ``counts``) n_lines, n_removed (longs).

    Lines are separated by LF and numbered from 0; a line of white space only is
    never removed.  Lines of under ``near`` characters go only if an equal line
    precedes, longer ones also if one within one edit does, as the input stands.
    A null text stays null and has no lines; a null doc_id is the smallest; rows
    that repeat doc_id and text are one document and all get its result; different
    texts under one doc_id are ordered by a hash; other columns, of whatever name,
    are kept.  With ``drop_emptied``, rows of which every line but blank ones was
    removed go too.  An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    gone = duplicate_lines(with_keys(docs), near, parts_for(docs))
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = docs.columns
    doc, tie, lost = unused(kept, "doc", "tie", "gone")
    rows = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), tie: F.xxhash64(body)})
    rows = rows.join(gone.select(F.col("doc").alias(doc), F.col("tie").alias(tie), F.col("gone").alias(lost)), [doc, tie], "left")
    at = kept.index("text")
    fields = [*docs.schema.fields, *[T.StructField(n, T.LongType()) for n in ("n_lines", "n_removed") if counts]]
    names = [f.name for f in fields]

    def reduce(batches):
        for b in batches:
            texts, lines, removed, left = [], [], [], []
            for t, g in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                every = [] if t is None else t.split("\n")
                lines.append(len(every))
                removed.append(len(g or []))
                if g:
                    g = set(g)
                    every = [x for i, x in enumerate(every) if i not in g]
                    t = "\n".join(every)
                texts.append(t)
                left.append(not g or any(x.strip() for x in every))
            cols = [*b.columns[:-1], *[pa.array(x, pa.int64()) for x in (lines, removed) if counts]]
            cols[at] = pa.array(texts, pa.string())
            out = pa.RecordBatch.from_arrays(cols, names=names)
            yield out.filter(pa.array(left, pa.bool_())) if drop_emptied else out

    return rows.select(*[F.col(f"`{c}`") for c in kept], lost).mapInArrow(reduce, T.StructType(fields))
