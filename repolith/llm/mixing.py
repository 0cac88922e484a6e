"""Mixing sources to target weights by balanced sampling (the cube method).

A document of a source whose target is f times its size is taken floor(f) times,
and once more with inclusion probability p = f - floor(f).  Of r rows that agree in
everything, floor(r * p) are taken once more for certain and one with probability
r * p - floor(r * p), so that rows which repeat are decided one by one and yet cost
one unit.  The flight phase moves these probabilities through the null space of two constraints, total words and
number of documents, until at most two documents of a chunk are undecided.  Of
that null space it takes the direction that moves the largest undecided document
against all smaller ones of its chunk, so that only the smallest are left over.
The undecided of all chunks of a source fly again together, level by level; the
one small problem left for each source lands by giving up the document count.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.llm._common import cut, prepare, reducers


def words(text: str = "text"):
    """Number of runs of characters other than space and tab to carriage return; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def decide(x: np.ndarray, p: np.ndarray, rnd: random.Random, land: bool) -> np.ndarray:
    """Fly the probabilities p of units of descending sizes x to 0 or 1; with ``land``, none is left undecided.

    Each move keeps sum(p) and sum(p * x), and every p in expectation, and decides a unit at least.
    When landing, a unit that eight moves haven't decided gives up sum(p) for sum(p * x).
    """
    p = np.where(p < 1e-9, 0.0, np.where(p > 1 - 1e-9, 1.0, p))
    head, moves = 0, 0
    while True:
        while head < len(p) and p[head] in (0.0, 1.0):
            head, moves = head + 1, 0
        moves += 1
        if head == len(p):
            return p
        rest = head + 1 + np.flatnonzero((p[head + 1 :] > 0) & (p[head + 1 :] < 1))
        if len(rest) < 2 and not land:
            return p
        if not len(rest):
            p[head] = float(rnd.random() < p[head])
            return p
        xs, n = x[rest], len(rest)
        s1, s2 = xs.sum(), (xs * xs).sum()
        det = n * s2 - s1 * s1
        if n > 1 and det > 1e-9 * n * s2 and (moves <= 8 or not land):
            b = (s1 - n * x[head]) / det
            d = (-1 - b * s1) / n + b * xs
        elif x[head] * n == s1 or s1 == 0:
            d = np.full(n, -1.0 / n)
        else:
            d = np.full(n, -x[head] / s1)
        q, d = np.append(p[rest], p[head]), np.append(d, 1.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            rise = np.where(d > 0, (1 - q) / d, np.where(d < 0, -q / d, np.inf))
            fall = np.where(d > 0, q / d, np.where(d < 0, (q - 1) / d, np.inf))
        up, down = rise.min(), fall.min()
        goes_up = rnd.random() * (up + down) < down
        q += (up if goes_up else -down) * d
        wall = (rise if goes_up else fall).argmin()
        q[wall] = float(q[wall] > 0.5)
        q = np.where(q < 1e-9, 0.0, np.where(q > 1 - 1e-9, 1.0, q))
        p[rest], p[head] = q[:-1], q[-1]


def ranked(by: DataFrame, order: Column) -> DataFrame:
    """The rows with ``rank`` from 1 in an order, ranged over many tasks; the driver gets a count for each of them."""
    n = reducers(by.sparkSession)
    within = F.row_number().over(Window.partitionBy("part").orderBy(order))
    rows = cut(by.repartitionByRange(n, order).withColumn("part", F.spark_partition_id()))  # ranges are sampled, so they are kept
    sizes = sorted(tuple(r) for r in rows.groupBy("part").count().collect())
    before, total = [], 0
    for part, count in sizes:
        before.append((part, total))
        total += count
    known = by.sparkSession.createDataFrame(before, "part int, before long")
    return rows.withColumn("within", within).join(F.broadcast(known), "part").withColumn("rank", F.col("within") + F.col("before")).drop("part", "within", "before")


def targets(units: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """its_source, source_size, n, target.  Sources in code-point order (null last) weigh ``weights`` in turn.

    A source is capped at ``most`` times its size.  Sources whose part by weight is
    over their cap are capped, round by round, and the others share what these leave,
    until none is above; each round is one aggregation, so sources may be many.
    """
    by = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).cast("long").alias("source_size"), F.count("*").alias("n"))
    rows = ranked(by, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    rows = cut(rows.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")))
    total = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    each, open_ = math.inf, None
    while True:  # ``each``: what a weight of 1 gets
        over = F.col("cap") <= F.lit(each) * F.col("weight") if open_ is not None else F.lit(False)
        free = F.when(over, 0).otherwise(1)
        left, spent, shared = rows.agg(F.sum(free), F.sum((1 - free) * F.col("cap")), F.sum(free * F.col("weight"))).first()
        if not left or left == open_:
            break
        open_, each, rest = left, (total - spent) / shared, (total - spent, shared)
    if not left:  # every source is capped, or there is none
        return rows.select(F.col("source").alias("its_source"), "source_size", "n", F.col("cap").alias("target"))
    target = F.when(over, F.col("cap")).otherwise(rest[0] * F.col("weight") / rest[1])
    return rows.select(F.col("source").alias("its_source"), "source_size", "n", target.cast("double").alias("target"))


FIELDS = "source string, doc_id long, size long, row long, rows long, source_size long, target double, base long, sure long, p double"


def fly(units: DataFrame, level: int, seed: int, land: bool) -> DataFrame:
    """One flight for each (source, chunk), large documents first."""
    names, kinds = zip(*(f.split() for f in FIELDS.split(", ")))
    types = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
    schema = pa.schema([(n, types[k]) for n, k in zip(names, kinds)])
    size, last = names.index("size"), len(names) - 1

    def run(batches):
        now, held = None, []

        def flown():
            rnd = random.Random(f"{seed}/{level}/{now[0] is None}/{now[0]}/{now[1]}")
            x = np.array([float(r[size]) for r in held])
            p = decide(x, np.array([r[last] for r in held]), rnd, land)
            cols = [*list(zip(*held))[:last], p]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

        for b in batches:
            cols = [b.column(b.schema.get_field_index(n)).to_pylist() for n in [*names, "chunk"]]
            for *row, chunk in zip(*cols):
                if held and (row[0], chunk) != now:
                    yield flown()
                    held = []
                now = row[0], chunk
                held.append(row)
        if held:
            yield flown()

    return units.repartition("source", "chunk").sortWithinPartitions(
        "source", "chunk", F.desc("size"), "doc_id", "row"
    ).mapInArrow(run, FIELDS)


def row_hash(docs: DataFrame) -> Column:
    """64 bits of hash of all columns that can be hashed."""
    return F.xxhash64(
        *[F.col(f"`{f.name}`") for f in docs.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    )


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most: float = 3.0, chunk: int = 2048,
    seed: int = 13
) -> DataFrame:
    """doc_id, source, size, row, rows, source_size, target, base, extra: a unit for all rows that agree in every column (hash ``row``).

    ``rows`` counts these; each is taken ``base`` times, and ``extra`` of them once
    more.  A source is dealt by hash to chunks of about ``chunk`` units, so a hot
    source is flown by many tasks.  Null texts have size 0; documents of size 0 are
    decided like others and add nothing; a null source is a source of its own; an
    empty table gives no rows.  Everything is seeded by values, so reruns agree.
    """
    prepare(docs.sparkSession)
    units = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        words().alias("size"), row_hash(docs).alias("row")
    )
    units = cut(units.groupBy("doc_id", "source", "size", "row").agg(F.count("*").alias("rows")))
    goal = cut(targets(units, weights, share, most).coalesce(1))
    factor = F.least(F.lit(float(most)), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    flown = units.join(goal, F.col("source").eqNullSafe(F.col("its_source"))).withColumn("f", factor)
    flown = flown.withColumn("base", F.floor(F.col("f") + 1e-9).cast("long"))
    whole = F.col("rows") * F.greatest(F.lit(0.0), F.col("f") - F.col("base"))
    flown = flown.withColumn("whole", whole).withColumn("sure", F.floor(F.col("whole") + 1e-9).cast("long"))
    left = F.col("whole") - F.col("sure")
    flown = flown.withColumn("p", F.when(left < 1e-9, 0.0).otherwise(left))
    most_docs = goal.agg(F.max("n")).first()[0] or 1
    parts = F.ceil(F.col("n") / chunk)
    pieces = math.ceil(most_docs / chunk)

    level, done, now = 0, [], flown.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "row", F.lit(seed)), parts))
    while True:
        last = pieces == 1
        found = cut(fly(now, level, seed, last))
        done.append(found if last else found.filter("p in (0, 1)"))
        if last:
            break
        # two documents of a chunk at most are left
        level, pieces = level + 1, math.ceil(2 * pieces / chunk)
        now = found.filter("p not in (0, 1)").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "row", F.lit(seed + level)), F.lit(pieces)))
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.withColumn("extra", F.col("sure") + F.col("p").cast("long")).select(
        "doc_id", "source", "size", "row", "rows", "source_size", "target", "base", "extra"
    )


def each_row(units: DataFrame) -> DataFrame:
    """The units with a line for each of their rows, and ``copies``, how often it is taken; a unit of very many rows is dealt out before it is unfolded."""
    per = 1 << 16
    some = units.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(per).cast("long"))))
    nth = F.explode(F.sequence(F.col("first") + 1, F.least(F.col("rows"), F.col("first") + per)))
    return some.withColumn("nth", nth).withColumn(
        "copies", F.col("base") + (F.col("nth") <= F.col("extra")).cast("long")
    ).drop("first", "nth")


def apply(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each row as often as the mix takes it; their columns may have any name.

    Rows are joined to their units by hash; that join is a sort-merge join whatever
    the size.  What a unit of several rows takes beyond ``base`` is taken from one
    of them, as they agree in every column.
    """
    named = [F.col(f"`{c}`") for c in docs.columns]
    units = cut(mix(docs, **options))
    one = F.when(F.col("rows") == 1, F.col("base") + F.col("extra")).otherwise(F.col("base"))
    plain = units.select("row", "doc_id", "source", "size", one.alias("copies")).filter("copies > 0")
    keyed = docs.select(
        F.struct(*named).alias("doc"), row_hash(docs).alias("row"), F.col("doc_id").cast("long").alias("its"),
        F.col("source").cast("string").alias("from"), words().alias("words")
    )

    def joined(taken: DataFrame) -> DataFrame:
        same = (keyed["row"] == taken["row"]) & keyed["its"].eqNullSafe(taken["doc_id"]) & keyed["from"].eqNullSafe(taken["source"]) & (
            keyed["words"] == taken["size"]
        )
        return keyed.join(taken.hint("merge"), same).select(keyed["row"], "its", "from", "words", "doc", "copies")

    def copied(rows: DataFrame) -> DataFrame:
        return rows.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")

    out = copied(joined(plain))
    more = units.filter("rows > 1 AND extra > 0").select("row", "doc_id", "source", "size", F.col("extra").alias("copies"))
    if more.limit(1).count():
        out = out.union(copied(joined(more).dropDuplicates(["row", "its", "from", "words"])))
    return out
