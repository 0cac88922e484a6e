"""Embeddings: near-duplicates by sign hashes, and nearest neighbours by hash-prefix forests."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repolith.llm._common import cut, prepare
from repolith.llm.graph import components, least_labels, runs, tiles

TILE = 1024
#: Bits of a sketch.
SKETCH = 128


def usable(vector: str = "embedding"):
    """Not null, no null or non-finite component, not all zero."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(ok & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column) -> np.ndarray:
    """Rows of equal length as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def planes(dim: int, number: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, number))


def table_plan(largest: int, cosine: float, recall: float) -> tuple[int, int]:
    """Bits of a table's hash, so that a bucket of unrelated vectors has about 512 of them, and tables, so that a pair at ``cosine`` is missed with probability 1 - recall."""
    bits = max(4, math.ceil(math.log2(max(largest, 1) / 512 + 1)))
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def sketch_bound(cosine: float, bits: int = SKETCH) -> int:
    """Differing bits of two sketches that a pair at ``cosine`` passes only in one case of about 10^8 (six standard deviations over the mean)."""
    p = math.acos(min(1.0, max(-1.0, cosine))) / math.pi
    return math.ceil(bits * p + 6 * math.sqrt(bits * p * (1 - p)))


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, recall: float = 0.99999, seed: int = 5) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of (vec_id, embedding, label).

    Vectors are compared only within a label (not null) and a length.  Equal
    vectors of a label are one node with a weight, so a vector that a third of
    all rows share is one row of a bucket.  A table's buckets are first looked
    through with sketches of 128 further sign bits, so that only vectors which have
    a likely partner there are dealt out themselves.  Buckets are split into tiles;
    in each, cosines are taken in double precision, and a pair counts in the first
    table where it meets, so each link counts once.  Unusable vectors, and those
    without a label, link with nothing; rows that repeat a vec_id are vectors of
    their own; an empty table gives no rows.
    """
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = rows.withColumn("ok", usable() & F.col("label").isNotNull())
    nodes = rows.filter("ok").groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"))
    nodes = cut(nodes.withColumn("dim", F.size("embedding")).withColumn("node", F.xxhash64("label", "embedding")))
    largest = nodes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 1
    bits, tables = table_plan(largest, cosine, recall)
    most = sketch_bound(cosine)

    def sign(batches):
        for b in batches:
            emb = b.column(b.schema.get_field_index("embedding"))
            dims = b.column(b.schema.get_field_index("dim")).to_numpy()
            sigs, sketches = np.zeros((b.num_rows, tables), np.int64), np.zeros((b.num_rows, SKETCH // 64), np.int64)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                up = matrix(emb.take(pa.array(at))) @ planes(int(d), bits * tables + SKETCH, seed) > 0
                sigs[at] = up[:, : bits * tables].reshape(len(at), tables, bits) @ (1 << np.arange(bits))
                sketches[at] = np.packbits(up[:, bits * tables :], axis=1).view(np.int64)
            lists = [pa.array(list(x), pa.list_(pa.int64())) for x in (sigs, sketches)]
            yield pa.RecordBatch.from_arrays([*b.columns, *lists], names=[*b.schema.names, "sigs", "sketch"])

    kind = nodes.schema["embedding"].dataType.simpleString()
    keys, bucket = ["table", "key"], F.xxhash64("label", "dim", "sig").alias("key")  # a bucket may hold those of another key; labels are compared again
    signed = nodes.select("node", "label", "dim", "embedding").mapInArrow(sign, f"node long, label long, dim int, embedding {kind}, sigs array<long>, sketch array<long>")
    words = [F.col("sketch")[k].alias(f"s{k}") for k in range(SKETCH // 64)]
    keyed = signed.select("node", "label", "dim", *words, F.posexplode("sigs").alias("table", "sig")).select("table", bucket, "node", *[f"s{k}" for k in range(SKETCH // 64)])

    def likely(batches):
        for t in runs(batches, [*keys, "t0", "t1"]):
            if t.num_rows < 2:
                continue
            s = np.stack([t.column(f"s{k}").to_numpy().view(np.uint64) for k in range(SKETCH // 64)])
            some = np.zeros(t.num_rows, bool)
            for at in range(0, t.num_rows, 256):
                far = np.bitwise_count(s[:, at : at + 256, None] ^ s[:, None, :]).sum(axis=0, dtype=np.int64)
                near = far <= most
                near[np.arange(len(near)), at + np.arange(len(near))] = False
                some[at : at + 256] = near.any(axis=1)
            if some.any():
                yield pa.RecordBatch.from_arrays([t.column(c).combine_chunks().filter(pa.array(some)) for c in (*keys, "node")], names=[*keys, "node"])

    flagged = cut(tiles(keyed, keys, "node", TILE).select(*keys, "t0", "t1", *keyed.columns[2:]).mapInArrow(likely, "table int, key long, node long").distinct())
    held = flagged.join(nodes.select("node", "label", "dim", "weight", "embedding"), "node")
    held = held.mapInArrow(sign, f"node long, table int, key long, label long, dim int, weight long, embedding {kind}, sigs array<long>, sketch array<long>").drop("sketch")

    def verify(batches):
        for t in runs(batches, [*keys, "t0", "t1"]):
            if t.num_rows < 2:
                continue
            label, dim = (t.column(c).to_numpy() for c in ("label", "dim"))
            for part in {(a, d) for a, d in zip(label.tolist(), dim.tolist())}:
                yield from linked_rows(t.take(pa.array(np.flatnonzero((label == part[0]) & (dim == part[1])))))

    def linked_rows(t):
        node, weight, chunk = (t.column(c).to_numpy() for c in ("node", "weight", "chunk"))
        x, sigs = matrix(t.column("embedding")), matrix(t.column("sigs"))
        size = unit(x)
        i, j = np.nonzero(np.triu(x @ x.T / np.outer(size, size) >= cosine, 1))
        now, new = t.column("table")[0].as_py(), np.ones(len(i), bool)
        for at in range(0, len(i), 1 << 16):
            p = slice(at, at + (1 << 16))
            new[p] = ~(sigs[i[p], :now] == sigs[j[p], :now]).any(axis=1)
        if t.column("t0")[0].as_py() != t.column("t1")[0].as_py():
            new &= chunk[i] != chunk[j]
        i, j = i[new], j[new]
        if len(i):
            linked = np.zeros((len(x), len(x)), bool)
            linked[i, j] = linked[j, i] = True
            label = least_labels(linked)
            count = np.bincount(i, weight[j], len(x)) + np.bincount(j, weight[i], len(x))
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[label[some]]), pa.array(count[some].astype(np.int64))], names=["a", "b", "n"])

    found = cut(tiles(held, keys, "node", TILE).mapInArrow(verify, "a long, b long, n long"))
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    member = nodes.join(counts, "node", "left").join(components(found.select("a", "b")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = member.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    known = member.join(ids, "root").select("node", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    at = F.when(F.col("ok"), F.xxhash64("label", "embedding"))
    out = rows.select("vec_id", at.alias("node")).join(known, "node", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


class Forest:
    """Hash-prefix trees over one block of vectors: for each tree, the sorted array of long sign-hash strings.

    A query descends each tree to its longest-prefix matches, then all trees
    ascend together, one prefix bit at a time, until they hold ``enough`` vectors.
    Equal vectors are one entry; of their ids, those that can matter are kept.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, trees: int, keep: int, seed: int):
        raw = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1])))[:, 0]
        _, first, which = np.unique(raw, return_index=True, return_inverse=True)
        by = np.lexsort([ids, which])  # ids ascend within each distinct vector, each once
        by = by[np.r_[True, (which[by][1:] != which[by][:-1]) | (ids[by][1:] != ids[by][:-1])]]
        starts = np.searchsorted(which[by], np.arange(len(first)))
        ends = np.append(starts[1:], len(by))
        self.ids = [ids[by[s : min(e, s + keep)]] for s, e in zip(starts, ends)]
        self.vectors = vectors[first].astype(np.float64)
        self.sizes = unit(self.vectors)
        self.planes = planes(vectors.shape[1], 64 * trees, seed)
        codes = self.codes(self.vectors)
        self.orders = [np.argsort(c, kind="stable") for c in codes]
        self.sorted = [c[o] for c, o in zip(codes, self.orders)]

    def codes(self, vectors: np.ndarray) -> list[np.ndarray]:
        up = (vectors @ self.planes > 0).reshape(len(vectors), -1, 64)
        return list(np.packbits(up, axis=2).view(">u8")[:, :, 0].astype(np.uint64).T)

    def candidates(self, queries: np.ndarray, enough: int) -> list[np.ndarray]:
        """For each query, the distinct vectors that the trees hold once they hold ``enough`` together."""
        codes = self.codes(queries)
        low, high = (np.zeros((len(codes), len(queries)), np.int64) for _ in (0, 1))
        open_ = np.ones(len(queries), bool)
        for depth in range(64, -1, -1):
            below = np.uint64((1 << (64 - depth)) - 1)
            at = np.flatnonzero(open_)
            for t, c in enumerate(codes):
                low[t, at] = np.searchsorted(self.sorted[t], c[at] & ~below, "left")
                high[t, at] = np.searchsorted(self.sorted[t], c[at] | below, "right")
            open_[at[(high[:, at] - low[:, at]).sum(axis=0) >= enough]] = False
            if not open_.any():
                break
        return [np.unique(np.concatenate([o[s:e] for o, s, e in zip(self.orders, low[:, q], high[:, q])])) for q in range(len(queries))]

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int, enough: int):
        """(query id, vec_id, score) of each query's k best candidates, each vec_id by its best score."""
        queries = queries.astype(np.float64)
        sizes = unit(queries)
        for qid, q, size, found in zip(query_ids.tolist(), queries, sizes, self.candidates(queries, enough)):
            best = self.best(qid, q, size, found, k)
            if len(best) < k and len(found) < len(self.vectors):  # the candidates are vectors of too few ids
                best = self.best(qid, q, size, np.arange(len(self.vectors)), k)
            for i, s in best.items():
                yield qid, i, s

    def best(self, qid: int, q: np.ndarray, size: float, found: np.ndarray, k: int) -> dict[int, float]:
        """The k best vec_ids among the ``found`` vectors, without the query's own row; more vectors are read as long as they hold fewer ids."""
        score = self.vectors[found] @ q / (self.sizes[found] * size)
        order, take = np.argsort(-score, kind="stable"), k + 1
        while True:
            top = np.flatnonzero(score >= score[order[:take][-1]])
            best: dict[int, float] = {}
            near = ((-s, i, f) for s, f in zip(score[top].tolist(), found[top].tolist()) for i in self.ids[f].tolist())
            for s, i, _ in sorted(x for x in near if x[1] != qid or (self.vectors[x[2]] != q).any()):
                best.setdefault(i, -s)
            if len(best) >= k or take >= len(order):
                return dict(list(best.items())[:k])
            take *= 4


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, trees: int = 32, share: float = 1.0, block: int = 16384, seed: int = 9) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by ``every``.

    Every usable row is indexed, those that repeat a vec_id and its vector once.  Rows are dealt by hash to blocks of about
    ``block`` rows, each with its own forest; queries visit every block, and each
    trees ascend until they hold ``share`` times the block's vectors together (a
    vector counts in each tree, the query itself in none); each block's k best meet in one ranking by score (cosine in double precision), ties
    to the smaller vec_id.  Blocks hold any mixture of rows, so hot vectors or
    labels make no block larger.  Unusable vectors and rows without a vec_id take
    no part; vectors are compared with those of their own length only; where rows
    repeat a vec_id, its best score counts, and a query's own id is found if another
    vector has it; other columns are ignored; an empty table gives no rows.
    """
    spark = prepare(vectors.sparkSession)
    rows = vectors.filter(usable() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = cut(rows.distinct())
    blocks = max(1, math.ceil(rows.count() / block))
    data = rows.select(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), "vec_id", "embedding")
    asked = rows.filter(F.col("vec_id") % every == 0).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"), "vec_id", "embedding")

    def search(batches):
        held: dict[int, list] = {}
        forests: dict[int, Forest] = {}
        for b in batches:
            asks, ids, emb = b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3)
            dims = np.diff(emb.offsets.to_numpy())
            out = []
            for kind in (0, 1):
                for d in np.unique(dims[asks == kind]).tolist():
                    at = np.flatnonzero((asks == kind) & (dims == d))
                    x = emb.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)
                    if kind == 0:
                        held.setdefault(d, []).append((ids[at], x))
                        continue
                    if d not in forests and d in held:
                        parts = held.pop(d)
                        forests[d] = Forest(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]) + 0.0, trees, k + 1, seed)
                    if d in forests:
                        out += forests[d].nearest(ids[at], x, k, trees + math.ceil(share * len(forests[d].vectors)))
            if out:
                q, v, s = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    found = data.union(asked).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "asks").mapInArrow(search, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
