"""Calls between definitions: which definition a call means, and what an entry point reaches, in the order it does.

A definition's key is ``file::qualified_name``, so equal names of two files stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.session import PART_BYTES, parts_of


def definition_key(file: str = "file", qualified_name: str = "qualified_name") -> Column:
    return F.concat(F.col(file), F.lit("::"), F.col(qualified_name))


def _plain_targets(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(callee_name, callee): the definitions with that bare or qualified name, else those with its last part, if it has several.

    Which of the two counts is settled on distinct names, before a call meets any definition.
    """
    tail = F.substring_index("callee_name", ".", -1)
    both = F.when(F.col("callee_name").contains("."), F.array("callee_name", tail)).otherwise(F.array("callee_name"))
    named = known.select(F.explode(F.array_distinct(F.array("qualified_name", "name"))).alias("name"), "callee").distinct()
    tried = asked.select("callee_name").distinct().select("callee_name", F.posexplode(both).alias("nth", "name"))
    there = tried.join(named.select("name").distinct(), "name", "left_semi")
    chosen = there.groupBy("callee_name").agg(F.min_by("name", "nth").alias("name"))
    return chosen.join(named, "name").select("callee_name", "callee")


def _own_targets(asked: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """(caller_file, caller_class, callee_name, callee): the class's method in that file, else methods of that name of an equally named class."""
    where = ["caller_file", "caller_class", "callee_name"]
    wanted = asked.filter("caller_class IS NOT NULL").select(*where).distinct()
    here = known.select(F.col("file").alias("caller_file"), F.col("qualified_name").alias("__q"), "callee").distinct()
    named = wanted.withColumn("__q", F.concat_ws(".", "caller_class", "callee_name")).repartition(n, "caller_file", "__q")
    first = named.join(here, ["caller_file", "__q"]).select(*where, "callee")
    methods = known.select(F.col("parent_class").alias("caller_class"), F.col("name").alias("callee_name"), "callee").distinct()
    rest = named.join(here, ["caller_file", "__q"], "left_anti").select(*where).repartition(n, "caller_class", "callee_name")
    return first.unionByName(rest.join(methods, ["caller_class", "callee_name"]).select(*where, "callee"))


def resolve_calls(edges: DataFrame, defs: DataFrame) -> DataFrame:
    """(caller, callee), both keys, distinct and without calls of itself.

    edges: caller (a key), callee_name, call_style, caller_file, caller_class; defs:
    qualified_name, name, file, parent_class.  Calls of style ``self`` look for the
    class's own methods, all others for the whole name and then its last part.  Calls and
    results are dealt to parts whose number grows with the input.
    """
    known = defs.select("name", "qualified_name", "file", "parent_class", definition_key().alias("callee")).distinct()
    asked = edges.select("caller", "callee_name", "caller_file", "caller_class", F.coalesce(F.col("call_style") == "self", F.lit(False)).alias("own"))
    n, where = parts_of(edges, defs), ["caller_file", "caller_class", "callee_name"]
    plain = asked.filter("NOT own").select("caller", "callee_name").repartition(n, "callee_name").distinct()
    own = asked.filter("own").repartition(n, *where).distinct()
    found = plain.join(_plain_targets(plain, known), "callee_name").select("caller", "callee")
    mine = own.join(_own_targets(own, known, n), where).select("caller", "callee")
    return found.unionByName(mine).filter("caller <> callee").repartition(n, "caller", "callee").distinct()


def arrivals(edges: DataFrame, starts: DataFrame, depth: int = 8) -> DataFrame:
    """(start, node, depth, path) of nodes within ``depth`` steps, each as a queue comes to it first.

    edges: src, dst, ordinal (a number that orders the edges of a source); starts: node.
    A path holds the ordinals of the edges to a node.  Of paths of one length, a queue
    takes the least first, so the least (depth, path) is where it arrives, by one join
    and one aggregation a step.  Rows are dealt to parts whose number grows with the
    input, more than the input's own as a start has many nodes; the result by start.
    """
    parts = parts_of(edges, starts, each=PART_BYTES // 16)
    edges = edges.repartition(parts, "src").groupBy("src", "dst").agg(F.min(F.col("ordinal").cast("long")).alias("ordinal"))
    none = F.array().cast("array<bigint>")
    seen = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth"), none.alias("path")).distinct()
    for d in range(1, depth + 1):
        step = seen.join(edges, (F.col("node") == F.col("src")) & (F.col("depth") == d - 1), "left")
        new = F.struct(F.col("dst").alias("node"), F.lit(d).alias("depth"), F.concat("path", F.array("ordinal")).alias("path"))
        both = F.explode(F.array(F.struct("node", "depth", "path"), F.when(F.col("src").isNotNull(), new))).alias("at")
        step = step.select("start", both).filter("at IS NOT NULL").repartition(parts, "start")
        first = F.min(F.struct("at.depth", "at.path")).alias("at")
        seen = step.groupBy("start", F.col("at.node").alias("node")).agg(first).select("start", "node", "at.*")
    return seen


def chains(edges: DataFrame, entries: DataFrame, depth: int = 8) -> DataFrame:
    """(start, place, node, depth, nodes, deepest) of entry points that reach anything: their nodes in order of arrival, places from 0."""
    found = arrivals(edges, entries, depth)
    one = Window.partitionBy("start")
    place = F.row_number().over(one.orderBy("depth", "path")) - 1
    whole = found.withColumns({"place": place, "nodes": F.count("*").over(one), "deepest": F.max("depth").over(one)})
    return whole.filter("nodes > 1").select("start", "place", "node", "depth", "nodes", "deepest")
