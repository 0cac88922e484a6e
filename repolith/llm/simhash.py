"""Near-duplicates by SimHash, blocks of fingerprints and Hamming verification; for shingle similarity the fingerprints are wider, and exact verification follows."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.llm._common import U64, cut, mix, prepare, release
from repolith.llm.graph import components, least_labels, pieces, runs, tiles

#: Rows of a bucket that one tile's side holds; larger buckets are split.
TILE = 2048
#: Bytes of a text whose words are taken at a time.
BLOCK = 1 << 21
#: Documents that one side of a tile holds where shingle sets are compared.
SETS = 1024
#: Bits of a wide fingerprint by which two documents are compared, and documents of unrelated texts that one block's bucket is meant to hold.
SKETCH, BUCKET = 192, 1024
#: What tells rows apart whose doc_id repeats or is null; rows that agree in these are copies of each other.
ROW = ["__none", "__doc", "__h1", "__h2"]


def _word_blocks(text: bytes):
    """The words of a text in blocks, so that a very long text needs no list of all its words."""
    at = 0
    while at < len(text):
        end = min(at + BLOCK, len(text))
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield text[at:end].split()
        at = end


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash over all ``width``-word shingles of an A-Z lower-cased text, repeats included; 0 without words."""
    digest, ones, total, carry = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    for words in _word_blocks(text.lower()):
        words = carry + words
        carry = words[1 - width :] if width > 1 else []
        if len(words) < width:
            carry = words
            continue
        joined = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: len(words) - width + 1].tolist()
        hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends[width - 1 :].tolist())], np.uint64)
        for s in range(0, len(hashes), 1 << 16):
            part = hashes[s : s + (1 << 16)]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    if not total:
        if not carry:
            return 0
        return digest(b" ".join(carry), seed)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` and fp (the fingerprint as a signed long) of every whole text; null texts count as empty."""
    prepare(docs.sparkSession)
    kept = docs.select(*columns)

    def run(batches):
        for b in batches:
            at = b.num_columns - 1
            fps = np.array([fingerprint(t, width) for t in b.column(at).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(fps, pa.int64())], names=[*b.schema.names[:at], "fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + ", fp long"
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("__text")
    return docs.select(*columns, text).mapInArrow(run, schema)


def block_masks(bits: int, distinct: int) -> list[int]:
    """Masks of which two fingerprints at ``bits`` or fewer differing bits agree on one at least.

    64 bits are split into bits + s blocks, and every choice of s blocks is a mask:
    the differing bits touch ``bits`` blocks at most, so s stay equal.  s grows
    with the number of distinct fingerprints, so that a mask's buckets stay small;
    links are the same for any s.
    """
    s = 1
    while s < 5 and 64 * s / (bits + s) < np.log2(max(distinct, 2)) + 4:
        s += 1
    borders = np.linspace(0, 64, bits + s + 1).round().astype(int)
    blocks = [((1 << int(e)) - 1) ^ ((1 << int(b)) - 1) for b, e in zip(borders, borders[1:])]
    masks = [sum(c) for c in combinations(blocks, s)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, bits: int, count: int) -> DataFrame:
    """(a, b): a spanning forest of the links (``bits`` or fewer differing bits) of each bucket, from column fp."""
    masks = block_masks(bits, count)
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("mask", "key"))

    def run(batches):
        a, b, n = [], [], 0
        for t in runs(batches, ["mask", "key", "t0", "t1"]):
            fp = t.column("fp").to_numpy()
            x = fp.view(np.uint64)
            if len(x) > 1:
                label = least_labels(np.bitwise_count(x[:, None] ^ x[None, :]) <= bits)
                moved = np.flatnonzero(label != np.arange(len(x)))
                a.append(fp[moved])
                b.append(fp[label[moved]])
                n += len(moved)
            if n > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                a, b, n = [], [], 0
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return tiles(keyed, ["mask", "key"], "fp", TILE).select("mask", "key", "t0", "t1", "fp").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, bits: int = 4, width: int = 4) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links, itself included) of each row.

    Equal fingerprints are one node, so copies cost nothing; texts without words
    have fingerprint zero and are linked like any other.  Null texts count as
    empty; a null doc_id is never a component's id unless the component has no
    other; repeated rows give repeated results; an empty table gives no rows.  All
    joins are sort-merge joins, so the driver holds no table that grows with the input.
    """
    rows = cut(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(cut(links(nodes.select("fp"), bits, nodes.count())))
    member = nodes.join(found.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = member.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(
        member.select("fp", "root").join(ids.hint("merge"), "root").select("fp", "component_id").hint("merge"), "fp", "left"
    ).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, bits: int = 4, width: int = 4) -> DataFrame:
    """One row of each component: the least by doc_id (null last), ties by a 128-bit hash of the text, so null or repeated ids lose nothing."""
    prepare(docs.sparkSession)
    rows = cut(fingerprints(_with_row(docs).withColumnRenamed("__text", "text"), width, tuple(ROW)))
    nodes = cut(rows.select("fp").distinct())
    found = components(cut(links(nodes, bits, nodes.count()))).withColumnRenamed("node", "fp")
    groups = rows.join(found.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return _take(docs, _firsts(groups.select(*ROW, "root"), "root"))


def _with_row(docs: DataFrame) -> DataFrame:
    """The columns of ROW (whether doc_id is null, doc_id as a long, 128 bits of hash of the text), __text (null: empty) and __all, a struct of all columns."""
    doc, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = [doc.isNull(), F.coalesce(doc, F.lit(0)), F.xxhash64(text), F.xxhash64(F.lit(1), text)]
    return docs.select(
        *[c.alias(n) for c, n in zip(row, ROW)], text.cast("binary").alias("__text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__all")
    )


def _firsts(rows: DataFrame, group: str) -> DataFrame:
    """The least row of each group: the smallest doc_id, null ids last, ties by the text's hash."""
    return rows.groupBy(group).agg(F.min(F.struct(*ROW)).alias("__row")).select("__row.*", group)


def _take(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row of ``docs`` for each of the ``wanted``, whose ROW are distinct; rows that repeat come once.  A sort-merge join whatever the size."""
    rows = _with_row(docs).select(*ROW, "__all").join(wanted.select(*ROW).hint("merge"), ROW)
    return rows.dropDuplicates(ROW).select("__all.*")


def shingle_set(text: bytes, width: int, seed: int = 42) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all ``width``-word shingles of an A-Z lower-cased text; of fewer words, the hash of them all."""
    digest, parts, carry, some = xxhash.xxh64_intdigest, [], [], False
    for words in _word_blocks(text.lower()):
        words = carry + words
        carry = words[1 - width :] if width > 1 else []
        if len(words) < width:
            carry = words
            continue
        some = True
        hashes = [digest(b" ".join(words[i : i + width]), seed) for i in range(len(words) - width + 1)]
        parts.append(np.unique(np.array(hashes, np.uint64)))
    if not some:
        return np.array([digest(b" ".join(carry), seed)] if carry else [], np.uint64)
    return np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]


def differing(similarity: float) -> float:
    """The probability, at most, that a SimHash bit differs between two shingle sets at ``similarity`` or more.

    The cosine of such sets is 2s / (1 + s) at least, which gives the angle by pi for
    long sums of signs.  In short ones the middle weighs more: n against n + 1
    shingles differ up to sqrt(pi / 2) times as often.
    """
    return min(0.5, math.sqrt(math.pi / 2) * math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi)


def band_bits(count: int) -> int:
    """Bits of a block, so that a bucket of ``count`` unrelated documents has about BUCKET of them."""
    return max(4, math.ceil(math.log2(count / BUCKET + 1)))


def band_plan(similarity: float, miss: float, bits: int = 6) -> int:
    """Blocks of ``bits`` bits each, so that a pair at ``similarity`` agrees on none with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log1p(-((1 - differing(similarity)) ** bits))) if similarity < 1 else 1


def hamming_bound(similarity: float, miss: float) -> int:
    """Differing bits of SKETCH that a pair at ``similarity`` passes with probability ``miss`` at most."""
    p, left = differing(similarity), 1.0
    for d in range(SKETCH + 1):
        left -= math.comb(SKETCH, d) * p**d * (1 - p) ** (SKETCH - d)
        if left <= miss:
            return d
    return SKETCH


def signs(shingles: np.ndarray, width: int) -> np.ndarray:
    """SimHash of a shingle set in ``width`` bits: each is 1 if set in over half of the shingles' hashes, which are drawn out to that length."""
    salt = np.arange(1, -(-width // 64) + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)
    ones = np.zeros(64 * len(salt), np.int64)
    for at in range(0, len(shingles), 255):  # as many as a byte counts
        h = mix(shingles[at : at + 255, None] + salt)
        ones += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return (2 * ones > len(shingles))[:width]


def wide_fingerprint(shingles: np.ndarray, number: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of the first SKETCH bits, and a key for each of ``number`` blocks of ``bits`` bits after them: the block's number and bits."""
    up = signs(shingles, SKETCH + number * bits)
    blocks = up[SKETCH:].reshape(number, bits) @ (1 << np.arange(bits))
    return np.packbits(up[:SKETCH], bitorder="little").view(np.int64), (np.arange(number) << bits) + blocks


def bands(shingles: np.ndarray, number: int, bits: int = 6) -> np.ndarray:
    """The keys of a set's blocks; sets that share one are compared."""
    return wide_fingerprint(shingles, number, bits)[1]


def near_forest(node: np.ndarray, sketch: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): a spanning forest of the nodes whose sketches (a row for each word) differ in ``most`` bits or fewer."""
    near = np.zeros((len(node), len(node)), bool)
    for at in range(0, len(node), 256):
        far = sum(np.bitwise_count(w[at : at + 256, None] ^ w) for w in sketch)
        near[at : at + 256] = far <= most
    np.fill_diagonal(near, False)
    some = np.flatnonzero(near.any(axis=1))
    label = least_labels(near[np.ix_(some, some)])
    moved = np.flatnonzero(label != np.arange(len(some)))
    return node[some[moved]], node[some[label[moved]]]


def similar_labels(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set, the least index reachable over pairs of Jaccard similarity ``similarity`` or more, all compared exactly."""
    sizes = np.array([len(s) for s in sets], np.int64)
    uniq, flat = np.unique(np.concatenate(sets), return_inverse=True) if sizes.sum() else (np.empty(0), np.empty(0, np.int64))
    ends = np.cumsum(sizes)
    owner, mark = np.repeat(np.arange(len(sets)), sizes), np.zeros(len(uniq), bool)
    label = np.full(len(sets), -1)
    flat_open, owner_open = flat, owner
    for first in range(len(sets)):
        if label[first] >= 0:
            continue
        label[first], reached, stale = first, [first], True
        while reached:
            if stale:  # what is labelled needs no comparison any more
                left = label[owner_open] < 0
                flat_open, owner_open, stale = flat_open[left], owner_open[left], False
            u = reached.pop()
            mine = flat[ends[u] - sizes[u] : ends[u]]
            mark[mine] = True
            common = np.bincount(owner_open[mark[flat_open]], minlength=len(sets))
            mark[mine] = False
            hit = (label < 0) & (common / np.maximum(sizes + sizes[u] - common, 1) >= similarity)
            if hit.any():
                label[hit], stale = first, True
                reached += np.flatnonzero(hit).tolist()
    return label


def keep_one_similar(docs: DataFrame, similarity: float = 0.8, width: int = 5, miss: float = 0.0005) -> DataFrame:
    """One row of each group of documents linked by Jaccard similarity of their sets of ``width``-word shingles.

    Documents whose wide SimHashes agree on a block and differ in no more bits than a
    pair at ``similarity`` does are linked into candidate groups; within a candidate
    group every pair's sets are compared exactly, in tiles.  A pair at ``similarity``
    agrees on no block or differs in more bits with probability ``miss`` at most, a
    more similar one more rarely.  Texts of equal sets are one node, those without
    words too.  The row kept is the least of its group by doc_id (null last), ties by
    a 128-bit hash of the text; rows are told apart by both, so null or repeated ids
    lose nothing.
    """
    prepare(docs.sparkSession)
    bits = band_bits(docs.count())
    number, most = band_plan(similarity, 0.9 * miss, bits), hamming_bound(similarity, 0.1 * miss)
    words = [f"s{k}" for k in range(SKETCH // 64)]

    def sketch(batches):
        for b in batches:
            node, heads, keys, known = [], [], [], {}
            for t in b.column(len(ROW)).to_pylist():
                if t not in known:
                    s = shingle_set(t, width)
                    known[t] = xxhash.xxh64_intdigest(s.tobytes()), *wide_fingerprint(s, number, bits)
                for x, to in zip(known[t], (node, heads, keys)):
                    to.append(x)
            heads = np.array(heads, np.int64).reshape(-1, len(words))
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns[: len(ROW)], pa.array(np.array(node, np.uint64).view(np.int64)),
                    *[pa.array(np.ascontiguousarray(x)) for x in heads.T], pa.array(keys, pa.list_(pa.int64()))
                ],
                names=[*ROW, "node", *words, "keys"]
            )
        release()

    def forest(t):
        heads = np.stack([t.column(w).to_numpy().view(np.uint64) for w in words])
        return [pa.array(x) for x in near_forest(t.column("node").to_numpy(), heads, most)]

    def meet(batches):
        """Links of a bucket have no key; rows of a large one pass, without b."""
        for t, large in pieces(batches, ["key"], TILE):
            if large:
                a, b, rest = t.column("node"), pa.nulls(t.num_rows, pa.int64()), [t.column(c) for c in ("key", *words)]
            else:
                a, b = forest(t)
                rest = [pa.nulls(len(a), pa.int64())] * (1 + len(words))
            if len(a):
                yield from pa.table([a, b, *rest], names=["a", "b", "key", *words]).to_batches()

    def meet_in_tile(batches):
        for t in runs(batches, ["key", "t0", "t1"]):
            yield pa.RecordBatch.from_arrays(forest(t), names=["a", "b"])

    def sets(batches):
        for b in batches:
            found = [shingle_set(t, width).view(np.int64) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(found, pa.list_(pa.int64()))], names=["node", "near", "shingles"])
        release()

    def verify(batches):
        for t in runs(batches, ["near", "t0", "t1"]):
            node = t.column("node").to_numpy()
            label = similar_labels([np.asarray(x.values.to_numpy(), np.int64) for x in t.column("shingles")], similarity)
            moved = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], names=["a", "b"])
        release()

    kinds = "__none boolean, __doc long, __h1 long, __h2 long"
    longs = ", ".join(f"{w} long" for w in words)
    rows = cut(_with_row(docs).select(*ROW, "__text").mapInArrow(sketch, f"{kinds}, node long, {longs}, keys array<long>"))
    keyed = rows.select("node", *words, "keys").dropDuplicates(["node"]).select(F.explode("keys").alias("key"), "node", *words)
    met = cut(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(meet, f"a long, b long, key long, {longs}"))
    large = tiles(met.filter("b is null").select("key", F.col("a").alias("node"), *words), ["key"], "node", TILE)
    large = large.select("key", "t0", "t1", "node", *words).mapInArrow(meet_in_tile, "a long, b long")
    stars = met.filter("b is not null").select("a", "b").union(large)
    near = components(cut(stars)).withColumnRenamed("root", "near")
    near = near.union(near.select(F.col("near").alias("node"), "near").distinct())
    ones = cut(_firsts(rows.join(near.hint("merge"), "node", "left_semi"), "node").join(near.hint("merge"), "node"))
    texts = _with_row(docs).select(*ROW, "__text").join(ones.hint("merge"), ROW).dropDuplicates(ROW).select("node", "near", "__text")
    held = cut(texts.mapInArrow(sets, "node long, near long, shingles array<long>"))
    tiled = tiles(held, ["near"], "node", SETS).select("near", "t0", "t1", "node", "shingles")
    linked = components(cut(tiled.mapInArrow(verify, "a long, b long")))
    groups = rows.join(linked.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    return _take(docs, _firsts(groups.select(*ROW, "root"), "root"))
