"""Intervals of lines: what meets, holds or leaves free what, without pairing the intervals of a file.

Starts and ends are whole numbers, inclusive.  Rows whose key or bounds are null meet nothing.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolith.session import parts_of

#: Places of a chunk, as a power of two: a window within a chunk, then one over the chunks of a key.
CHUNK = 12


def _known(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.filter(reduce(lambda a, c: a & F.col(c).isNotNull(), columns, F.lit(True)))


def highest_until(asked: DataFrame, marks: DataFrame, by: list[str], chunk: int = CHUNK) -> DataFrame:
    """(by, at, best): for every distinct place that is asked for, the greatest ``value`` of the marks of its key at that place or before.

    asked: by, at; marks: by, at, value (numbers or structs).  A scan in two steps: over
    the places of a chunk, and over the chunks' greatest values.  A key with very many
    marks is dealt to many tasks so, and no row is paired with another.
    """
    top = marks.groupBy(*by, "at").agg(F.max("value").alias("value"))
    none = F.lit(None).cast(top.schema["value"].dataType)
    both = top.select(*by, "at", "value", F.lit(0).alias("__kind")).union(asked.select(*by, "at", none, F.lit(1)).distinct())
    both = both.withColumn("__chunk", F.shiftright("at", chunk))
    near = Window.partitionBy(*by, "__chunk").orderBy("at", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = both.withColumn("__here", F.max("value").over(near)).filter("__kind = 1")
    far = Window.partitionBy(*by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = both.groupBy(*by, "__chunk").agg(F.max("value").alias("__most"))
    sums = sums.select(*by, "__chunk", F.max("__most").over(far).alias("__before"))
    return here.join(sums, [*by, "__chunk"]).select(*by, "at", F.greatest("__here", "__before").alias("best"))


def _meets(asked: DataFrame, ranges: DataFrame, on: list[str]) -> DataFrame:
    """The (on, start, end) that meet a range: of the ranges that start no later than an item ends, the furthest end decides."""
    a = _known(asked, [*on, "start", "end"]).select(*on, "start", "end").distinct()
    marks = _known(ranges, [*on, "start", "end"]).select(*on, F.col("start").cast("long").alias("at"), F.col("end").cast("long").alias("value"))
    far = highest_until(a.select(*on, F.col("end").cast("long").alias("at")), marks, on)
    far = far.select(*on, F.col("at").alias("end"), "best")
    return a.join(far, [*on, "end"]).filter(F.col("best") >= F.col("start")).select(*on, "start", "end")


def overlapping(items: DataFrame, ranges: DataFrame, on: list[str]) -> DataFrame:
    """Items [start, end] that meet a range of the same key."""
    return items.join(_meets(items, ranges, on), [*on, "start", "end"], "left_semi")


def _swept(items: DataFrame, spans: DataFrame, on: list[str], name: str) -> DataFrame:
    """Items with the name of the innermost span that holds them, and ``reason`` as ``placed`` has it, by one shuffle and one sweep of each key.

    Spans are taken by their start.  Of those met so far, only the ones that a later
    span doesn't outlast can hold anything better: they lie within each other, the last
    that reaches an item's end is its innermost, and a task holds no more than these.
    What starts after an item, but not after its end, is found from the other side.
    """
    first, last = F.col("start").cast("long"), F.col("end").cast("long")
    kind = spans.select(name).schema[0].dataType
    ranges = _known(spans, [*on, "start", "end"]).select(
        *on, F.least(first, last).alias("__at"), F.lit(0).alias("__kind"), (-last).alias("__far"), F.col(name).alias("__name"),
        first.alias("__start"), last.alias("__end"), F.lit(None).cast(items.schema).alias("__item")
    )
    asks = items.select(
        *on, first.alias("__at"), F.lit(1).alias("__kind"), last.alias("__far"), F.lit(None).cast(kind).alias("__name"),
        first.alias("__start"), last.alias("__end"), F.struct(*[F.col(c) for c in items.columns]).alias("__item")
    )
    key = Window.partitionBy(*on)
    back = key.orderBy(F.desc("__at"), "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ranges.union(asks).repartition(parts_of(items, spans), *on)
    rows = rows.withColumn("__next", F.min(F.when(F.col("__kind") == 0, F.col("__start"))).over(back))
    rows = rows.withColumn("__k", F.row_number().over(key.orderBy("__at", "__kind", "__far", "__name")))

    def run(batches):
        ends, names, furthest = [], [], None  # ends: negative, so that they ascend
        for b in batches:
            took, owners, reasons = [], [], []
            column = lambda c: b.column(b.schema.get_field_index(c)).to_pylist()  # noqa: B023, E731
            known = b.column(b.schema.get_field_index("__name"))
            for i, (k, span, s, e, after) in enumerate(zip(*map(column, ("__k", "__kind", "__start", "__end", "__next")))):
                if k == 1:
                    ends, names, furthest = [], [], None
                if span == 0:
                    if e >= s:
                        at = bisect_left(ends, -e)
                        del ends[at:], names[at:]
                        ends.append(-e)
                        names.append(known[i])
                        furthest = e if furthest is None else max(furthest, e)
                    continue
                took.append(i)
                unknown = s is None or e is None
                at = 0 if unknown else bisect_right(ends, -e)
                owners.append(names[at - 1].as_py() if at else None)
                meets = not unknown and (furthest is not None and furthest >= s or after is not None and after <= e)
                reasons.append(None if at else "crosses" if meets else "outside")
            there = pa.Table.from_batches([b]).select(["__item"]).combine_chunks().column(0).combine_chunks().take(pa.array(took, pa.int64()))
            yield pa.RecordBatch.from_arrays([there, pa.array(owners, known.type), pa.array(reasons, pa.string())], names=["item", "owner", "reason"])

    schema = T.StructType([T.StructField("item", items.schema), T.StructField("owner", kind), T.StructField("reason", T.StringType())])
    return rows.mapInArrow(run, schema).select("item.*", F.col("owner").alias(name), "reason")


def containing(items: DataFrame, spans: DataFrame, on: list[str], name: str) -> DataFrame:
    """The innermost span (latest start, then earliest end, then greatest name) that holds each item [start, end]; null where none."""
    return _swept(items, spans, on, name).drop("reason")


def placed(items: DataFrame, spans: DataFrame, on: list[str], name: str) -> DataFrame:
    """``containing`` with ``reason``: null where a span holds the item, ``crosses`` where one only meets it, else ``outside``."""
    return _swept(items, spans, on, name)


def gaps(spans: DataFrame, by: list[str], totals: DataFrame | None = None, total: str = "total") -> DataFrame:
    """(by, gap_start, gap_end): what no span of a key covers.

    With ``totals`` (by, total), places 1 to the total count: before the first span,
    after the last, and all of a key without spans (none if its total is 0 or null).
    Without, only what lies between two spans.
    """
    w = Window.partitionBy(*by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    first, last = F.col("start").cast("long"), F.col("end").cast("long")
    edges = spans.select(*by, first.alias("start"), last.alias("end"))
    if totals is not None:  # an empty span before all, and one after all
        edge = lambda at: F.struct(at.cast("long").alias("start"), at.cast("long").alias("end"))
        ends = F.inline(F.array(edge(F.lit(0)), edge(F.col(total) + 1)))
        edges = edges.unionByName(totals.filter(F.col(total) > 0).select(*by, ends))
    reach = edges.withColumn("reach", F.max("end").over(w))
    out = reach.filter(F.col("start") > F.col("reach") + 1)
    return out.select(*by, (F.col("reach") + 1).alias("gap_start"), (F.col("start") - 1).alias("gap_end"))
