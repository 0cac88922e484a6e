"""Sinks: append-only logs, keyed upserts with history, replaced documents, checks against stored artifacts, Markdown."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repolith.sources.logs import validate


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_valid(rows: DataFrame, rules: list[tuple[str, Column, str]], path: str, ordinal: str = "ordinal") -> DataFrame:
    """Append the rows as JSON lines and return (ordinal, field, message) for each rule that one breaks; such rows are written too."""
    rows.write.mode("append").json(path)
    return validate(rows, rules, ordinal)


#: A published version's folder; the greatest number is the one that counts.
VERSION = re.compile(r"^v(\d{12})$")


def versions(spark: SparkSession, path: str) -> list[str]:
    """The published versions below ``path``, the oldest first."""
    fs, at = _file_system(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(at(path))] if fs.exists(at(path)) else []
    return sorted(n for n in names if VERSION.match(n))


def replace_json(rows: DataFrame, path: str, keep: int = 2) -> str:
    """Publish the rows as JSON in place of those at ``path``; returns the new version's name.  ``read_current`` reads what counts.

    The rows are written aside and become a version by one rename to a name that isn't
    there yet.  Whenever a write fails, the version before it counts; at any moment a
    reader finds all of the old rows or all of the new ones.  If two writers come to the
    same number, one of them fails.  The last ``keep`` versions stay, for those who read them still.
    """
    spark = rows.sparkSession
    fs, at = _file_system(spark, path)
    staged = f"{path}/.{uuid.uuid4().hex}"
    rows.write.json(staged)
    before = versions(spark, path)
    name = f"v{int(before[-1][1:]) + 1 if before else 1:012d}"
    publish(spark, staged, f"{path}/{name}")
    for old in [*before, name][:-keep]:
        fs.delete(at(f"{path}/{old}"), True)
    return name


def publish(spark: SparkSession, staged: str, path: str) -> None:
    """One rename, which fails if there is something at ``path`` already."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at(path).toUri(), conf).rename(at(staged), at(path), options)


def read_current(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the greatest version; none if nothing was published."""
    found = versions(spark, path)
    return spark.read.schema(schema).json(f"{path}/{found[-1]}") if found else spark.createDataFrame([], schema)


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def upsert(versions: DataFrame, new: DataFrame, key: list[str], at: str) -> DataFrame:
    """All versions with the new ones after them; the store is append-only, ``latest_with_history`` reads it.

    versions: key, at, ordinal, ...; new: key, at, ....  Of a key's new rows the one of
    the latest ``at`` counts, and a new row that is older than the stored one is left out.
    Ordinals go on from the stored ones of its key.
    """
    order = Window.partitionBy(*key).orderBy(F.desc(at))
    one = new.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")
    last = versions.groupBy(*key).agg(F.max(at).alias("stored_at"), F.max("ordinal").alias("stored_ordinal"))
    fresh = one.join(last, key, "left").filter(F.col("stored_at").isNull() | (F.col(at) >= F.col("stored_at")))
    fresh = fresh.withColumn("ordinal", F.coalesce(F.col("stored_ordinal") + 1, F.lit(1)).cast(versions.schema["ordinal"].dataType))
    return versions.unionByName(fresh.drop("stored_at", "stored_ordinal"), allowMissingColumns=True)


def latest_with_history(versions: DataFrame, key: list[str], at: str) -> DataFrame:
    """The latest version of each key (ties to the larger ordinal) and, oldest first, those before it."""
    fields = [c for c in versions.columns if c not in key]
    packed = F.array_sort(F.collect_list(F.struct(at, "ordinal", *[f for f in fields if f not in (at, "ordinal")])))
    rows = versions.groupBy(*key).agg(packed.alias("all"))
    return rows.select(
        *key, F.element_at("all", -1).alias("now"), F.slice("all", 1, F.size("all") - 1).alias("history")
    ).select(*key, "now.*", "history")


def trim_log(rows: DataFrame, floor: int, keep: int) -> DataFrame:
    """The last ``keep`` lines of each log that has over ``floor`` lines, all lines of the others.

    ``ordinal`` is the line number, so a log's last one says how long it is and where to
    cut: one partial aggregation, and no log is sorted.
    """
    last = rows.groupBy(F.col("source_file").alias("__of"), F.xxhash64("source_file")).agg(F.max("ordinal").alias("__last"))
    both = rows.join(last, F.col("source_file").eqNullSafe(F.col("__of")))
    return both.filter((F.col("__last") <= floor) | (F.col("ordinal") > F.col("__last") - keep)).select(*rows.columns)


def drift(now: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows on one side only, with the side; empty if the stored artifact is current."""
    return now.exceptAll(stored).withColumn("side", F.lit("computed")).union(stored.exceptAll(now).withColumn("side", F.lit("stored")))


def shown(rows: DataFrame, limit: int) -> tuple[list, int]:
    """The first ``limit`` rows, and how many more there are."""
    some = rows.limit(limit + 1).collect()
    return some[:limit], rows.count() - limit if len(some) > limit else 0


def markdown(rows: DataFrame, limit: int = 1000) -> str:
    """A Markdown table of a report, cells escaped; what is beyond ``limit`` rows is counted below it."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    some, more = shown(rows, limit)
    lines += ["| " + " | ".join(map(cell, r)) + " |" for r in some]
    return "\n".join(lines + ["", f"{more} more rows."] * bool(more)) + "\n"
