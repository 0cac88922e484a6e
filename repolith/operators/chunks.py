"""Chunks of files and chains of calls."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolith.operators.graph import shortest_depths
from repolith.session import parts_of


def tile(starts: DataFrame, by: list[str], start: str, total: Column) -> DataFrame:
    """chunk (``C-01``...), first and last line: the first chunk begins at line 1, each ends before the next, the last at ``total``."""
    w = Window.partitionBy(*by).orderBy(start)
    n = F.row_number().over(w)
    # longer numbers keep all their digits
    label = F.concat(F.lit("C-"), F.when(n < 100, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string")))
    return starts.select(
        *by, label.alias("chunk"), F.when(n == 1, 1).otherwise(F.col(start)).alias("first"),
        F.coalesce(F.lead(start).over(w) - 1, total).alias("last")
    )


def pack(rows: DataFrame, by: list[str], order: str, tokens: str, lines: str, closes: Column, token_budget: int, line_budget: int) -> DataFrame:
    """(by, order, chunk): greedy packing in order, chunks from 1.

    A chunk closes before the item that would take it over either budget, and after an
    item for which ``closes`` holds; an item that is over a budget by itself has a chunk
    of its own.  One shuffle deals the keys to parts whose number grows with the input;
    each part is then packed row by row in sorted order, so a task holds three numbers,
    however long a key or a chunk is.  ``order`` differs within a key, counts aren't
    negative (null: 0), keys aren't null.
    """
    n = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    items = rows.select(*by, order, n(tokens).alias("__n"), n(lines).alias("__m"), F.coalesce(closes, F.lit(False)).alias("__close"))
    items = items.repartition(parts_of(rows), *by).withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(order)))

    def run(batches):
        chunk = size = length = 0
        shut = False
        for b in batches:
            out, at = [], b.num_columns - 4
            for x, y, close, k in zip(*(b.column(i).to_pylist() for i in range(at, at + 4))):
                size, length = size + x, length + y
                if k == 1:
                    chunk, size, length = 1, x, y
                elif shut or size > token_budget or length > line_budget:
                    chunk, size, length = chunk + 1, x, y
                shut = close
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(out, pa.int32())], names=[*b.schema.names[:at], "chunk"])

    schema = T.StructType([*items.select(*by, order).schema.fields, T.StructField("chunk", T.IntegerType())])
    return items.mapInArrow(run, schema)


def entry_kind(task: Column, view: Column, method: Column, command: Column) -> Column:
    """What kind of entry point a function is; the first that holds, null for none."""
    return F.when(task, "task").when(view, "view").when(method, "http_method").when(command, "command")


def effects(edges: DataFrame, writers: DataFrame, entries: DataFrame, depth: int = 3) -> DataFrame:
    """(start, writes, gated): whether an entry reaches a writer within ``depth`` calls, and whether only through gated ones.

    edges: src, dst, gated; writers: node.  Ungated and gated reach are looked for
    separately, so a gated path never hides an ungated one.
    """
    w = writers.select("node").distinct()
    reach = shortest_depths(edges.select("src", "dst"), entries, depth).join(w, "node", "left_semi").select("start").distinct()
    free = shortest_depths(
        edges.filter(~F.coalesce("gated", F.lit(False))).select("src", "dst"), entries, depth
    ).join(w, "node", "left_semi").select("start").distinct()
    rows = entries.select(F.col("node").alias("start")).distinct().join(
        reach.withColumn("w", F.lit(True)), "start", "left"
    ).join(free.withColumn("f", F.lit(True)), "start", "left")
    return rows.select(
        "start", F.coalesce("w", F.lit(False)).alias("writes"),
        (F.coalesce("w", F.lit(False)) & F.col("f").isNull()).alias("gated")
    )
