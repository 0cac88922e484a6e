"""Buckets split into tiles, and connected components, both distributed."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.llm._common import cut


def tiles(rows: DataFrame, keys: list[str], node: str, most: int) -> DataFrame:
    """Rows of every bucket (equal ``keys``) of two rows or more, dealt to tiles t0 <= t1.

    A bucket of over ``most`` rows is split by the node's hash into chunks; each
    chunk meets itself in tile (i, i) and each other chunk in tile (i, j), so that
    no task holds more than about 2 x ``most`` rows at once, whatever the bucket's
    size, and every pair of a bucket still meets in exactly one tile.  Column
    ``chunk`` is the row's own chunk.  Buckets are sized by a partial aggregation and
    met by a sort-merge join: Spark takes exploded rows for as small as the table they
    come from, and would gather them all in the driver to broadcast them.
    """
    sizes = rows.groupBy(*keys).count().filter("count > 1")
    chunks = F.ceil(F.col("count") / F.lit(float(most))).cast("int")
    dealt = rows.join(sizes.hint("merge"), keys).withColumn("chunks", chunks)
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64(node), F.col("chunks")).cast("int"))
    other = F.explode(F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("*", other.alias("other")).withColumns({"t0": F.least("chunk", "other"), "t1": F.greatest("chunk", "other")})
    at = [*keys, "t0", "t1"]
    return dealt.drop("count", "chunks", "other").repartition(*at).sortWithinPartitions(*at, node)


def runs(batches, keys: list[str]):
    """Yield a table for each run of rows with equal keys, over batch borders."""
    for t, _ in pieces(batches, keys, math.inf):
        yield t


def pieces(batches, keys: list[str], most: float):
    """(table, large) for each run of rows with equal keys; one of over ``most`` rows is large and comes in pieces, so that it is never held whole."""
    held: list[pa.RecordBatch] = []
    last, n, large = None, 0, False
    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows, bool)
        for k in keys:
            at = b.schema.get_field_index(k)
            c = b.column(at).to_numpy(zero_copy_only=False)
            new[1:] |= c[1:] != c[:-1]
            if last is not None:
                new[0] |= last.column(at)[last.num_rows - 1].as_py() != c[0].item()
        last = b
        borders = sorted({0, b.num_rows, *np.flatnonzero(new).tolist()})
        for s, e in zip(borders, borders[1:]):
            if new[s]:
                if held:
                    yield pa.Table.from_batches(held), large
                held, n, large = [], 0, False
            held.append(b.slice(s, e - s))
            n += e - s
            if n > most:
                yield pa.Table.from_batches(held), True
                held, n, large = [], 0, True
    if held:
        yield pa.Table.from_batches(held), large


def least_labels(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix, each row's least index reachable."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label))
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node on an edge, root the least node reachable.

    Alternating large and small stars: logarithmically many rounds of joins and
    aggregations, each cut by a table in the shared folder.  A node with very many
    edges is aggregated partially and its join is split by adaptive execution: the
    aggregates are grouped by a further hash of the node, so that both sides of the
    join have exchanges of their own, which that takes.  Nothing but two numbers for
    each round comes to the driver, no table to broadcast either.
    """
    lo, hi = F.least("a", "b").alias("root"), F.greatest("a", "b").alias("node")
    now = cut(edges.select(hi, lo).filter("node != root").distinct())
    before = None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first())
        if state == before or state[0] == 0:
            return now
        before = state
        both = now.select(F.col("node").alias("u"), F.col("root").alias("v")).union(
            now.select(F.col("root").alias("u"), F.col("node").alias("v"))
        )
        least = both.groupBy("u", F.xxhash64("u")).agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.filter("v > u").join(least.hint("merge"), "u").select("v", "m").distinct()
        smaller = large.groupBy("v", F.xxhash64("v")).agg(F.min("m").alias("least")).select("v", "least")
        small = large.join(smaller.hint("merge"), "v").filter("m != least").select(F.col("m").alias("node"), F.col("least").alias("root"))
        now = cut(small.union(smaller.select(F.col("v").alias("node"), F.col("least").alias("root"))).distinct())
