"""Grouped figures for reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.operators.relational import listed, owner, set_digest


def runs_and_findings(scans: DataFrame) -> DataFrame:
    """(skill, runs, findings): an unknown number of findings counts 0."""
    return scans.groupBy("skill").agg(
        F.count("*").alias("runs"), F.sum(F.coalesce("findings_total", F.lit(0))).cast("long").alias("findings")
    )


def counts_in(events: DataFrame, column: str, vocabulary: list[str]) -> DataFrame:
    """(value, n) of a column, zero-filled to the vocabulary; other values stay too."""
    n = events.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    words = events.sparkSession.createDataFrame([(v,) for v in vocabulary], "value string")
    return words.join(n, "value", "full_outer").na.fill(0, ["n"])


def by_subsystem(findings: DataFrame, registry: DataFrame, most: int | None = None) -> DataFrame:
    """(subsystem, n, findings, omitted): all findings (path, id) below each subsystem in order, or with ``most`` the first of them and how many more; those of none under null."""
    rows = owner(findings, registry).withColumnRenamed("owner", "subsystem")
    if most is None:
        by_path = rows.groupBy("subsystem", "path").agg(F.array_sort(F.collect_list(F.struct("path", "id"))).alias("found"))
        paths = F.array_sort(F.collect_list(F.struct("path", "found")))
        whole = by_path.groupBy("subsystem").agg(F.sum(F.size("found").cast("long")).alias("n"), paths.alias("paths"))
        return whole.select("subsystem", "n", F.flatten("paths.found").alias("findings"), F.lit(0).cast("long").alias("omitted"))
    n = rows.groupBy("subsystem").agg(F.count("*").alias("n"))
    first = listed(rows, ["subsystem"], ["path", "id"], "findings", most).withColumnRenamed("subsystem", "__of")
    out = n.join(first, F.col("subsystem").eqNullSafe(F.col("__of")))
    return out.select("subsystem", "n", "findings", (F.col("n") - F.size("findings")).alias("omitted"))


def evidence_rollup(rows: DataFrame, key: str, day: str, number: str, flag: Column, place: str, least: int = 1) -> DataFrame:
    """(key, rows, total, first_day, last_day, any_flag, places) of keys with ``least`` rows or more."""
    out = rows.groupBy(key).agg(
        F.count("*").alias("rows"), F.coalesce(
            F.sum(number), F.lit(0)
        ).alias("total"), F.min(day).alias("first_day"), F.max(day).alias("last_day"),
        F.coalesce(F.bool_or(flag), F.lit(False)).alias("any_flag"), F.countDistinct(place).alias("places"),
    )
    return out.filter(F.col("rows") >= least)


def severities(findings: DataFrame) -> DataFrame:
    """(severity, n, ids_digest): a histogram, with a digest of the distinct ids that doesn't depend on their order, so that two manifests can be compared."""
    each = findings.groupBy("severity", "id").agg(F.count("*").alias("n"))
    return each.groupBy("severity").agg(F.sum("n").alias("n"), set_digest(F.col("id")).alias("ids_digest"))


def type_counts(files: DataFrame, kinds: dict[str, list[str]]) -> DataFrame:
    """Files of each root by type (a list of suffixes), and ``files``, all of them; files: root, path."""
    suffix = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    return files.groupBy("root").agg(*[F.count_if(suffix.isin(v)).alias(k) for k, v in kinds.items()], F.count("*").alias("files"))


def candidates(lanes: DataFrame) -> DataFrame:
    """(lane, complete, found): the distinct (kind, path) that each lane has found; a lane that has an incomplete run isn't complete.

    lanes: lane, complete, kind, path (null for a clean lane).
    """
    pair = F.when(F.col("path").isNotNull(), F.concat_ws(":", "kind", "path"))
    return lanes.groupBy("lane").agg(F.bool_and("complete").alias("complete"), F.array_sort(F.collect_set(pair)).alias("found"))


def violations(texts: DataFrame) -> DataFrame:
    """(path, tag) of lines such as ``path:line:col: tag: text``; other lines give none.

    What stands before the first ``: `` must hold exactly two colons, so a text that
    itself holds ``: name: `` isn't taken for a tag.
    """
    parts = F.split("text", ": ", 3)
    rows = texts.select(parts.alias("p")).filter((F.size("p") > 1) & (F.regexp_count(F.col("p")[0], F.lit(":")) == 2))
    return rows.select(F.substring_index(F.col("p")[0], ":", 1).alias("path"), F.col("p")[1].alias("tag"))


def tag_hits(texts: DataFrame, tags: list[str]) -> DataFrame:
    """(tag, hits, files): how many violations have exactly that tag, and in how many files; tags without any keep 0."""
    n = violations(texts).groupBy("tag").agg(F.count("*").alias("hits"), F.countDistinct("path").alias("files"))
    wanted = texts.sparkSession.createDataFrame([(t,) for t in tags], "tag string")
    return wanted.join(n, "tag", "left").na.fill(0, ["hits", "files"])


def sections(spark: SparkSession, builders: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """(section, present, rows, error): each section is built by itself, and one that fails leaves a row that says so."""
    out = []
    for name, build in builders.items():
        try:
            out.append((name, True, build().count(), None))
        except Exception as e:  # a section's failure is a fact of the report
            out.append((name, False, None, f"{type(e).__name__}: {e}".split("\n")[0][:200]))
    return spark.createDataFrame(out, "section string, present boolean, rows long, error string")
