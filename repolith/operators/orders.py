"""Reports in a stated order: what comes first, how ties go, and what is left out.

Where all rows are wanted, they carry their place; only the rows shown are sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.session import cut


def placed(rows: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """All rows with their place in an order, from 1; rows that tie share out places anyhow.

    Rows are dealt by ranges of the order and numbered within each; what the ranges
    before hold is a sum over one row for each range.  No task has all rows.
    """
    spark = rows.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(rows.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # of one row for each range
    sums = dealt.groupBy("__range").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.withColumn("__nth", nth).join(F.broadcast(sums), "__range").select(*rows.columns, (F.col("__before") + F.col("__nth")).alias(name))


def by_size(rows: DataFrame, size: str = "loc", path: str = "path") -> DataFrame:
    """With ``place``: the largest first, ties by path."""
    return placed(rows, F.desc(size), F.col(path))


def by_path(rows: DataFrame, path: str = "path") -> DataFrame:
    """With ``place``: by code point, which UTF-8's byte order is."""
    return placed(rows, F.col(path))


def by_occurrences(groups: DataFrame) -> DataFrame:
    """Clone groups with ``place``: most occurrences first, ties by name."""
    return placed(groups, F.desc("occurrences"), F.col("name"))


def name_groups(groups: DataFrame, n: int = 20) -> DataFrame:
    """Of each verdict, the first ``n`` names with their ``place``: by definitions and lines downwards (``generic`` by lines), ties as they came (``ordinal``)."""
    many = F.when(F.col("verdict") == "generic", 0).otherwise(F.col("definitions"))
    place = F.row_number().over(Window.partitionBy("verdict").orderBy(many.desc(), F.desc("lines"), "ordinal"))
    return groups.withColumn("place", place).filter(F.col("place") <= n)


def most_common(rows: DataFrame, key: str, ordinal: str, n: int = 10) -> DataFrame:
    """(key, n, first): the ``n`` most frequent values, ties to the one seen first."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.min(ordinal).alias("first")).orderBy(F.desc("n"), "first").limit(n)


def most_recent(rows: DataFrame, ts: str, ordinal: str, n: int = 5) -> DataFrame:
    """The last ``n`` by the raw text of their time, ties as they came."""
    return rows.orderBy(F.desc(ts), ordinal).limit(n)


def by_age(rows: DataFrame, age: str = "age_days", ordinal: str = "ordinal") -> DataFrame:
    """With ``place``: the oldest first, an unknown age last, ties as they came."""
    return placed(rows, F.desc_nulls_last(age), F.col(ordinal))


def by_age_or_zero(rows: DataFrame, age: str = "age_days", ordinal: str = "ordinal") -> DataFrame:
    """With ``place``: the oldest first; an unknown age ties with 0, ties as they came."""
    return placed(rows, F.coalesce(age, F.lit(0)).desc(), F.col(ordinal))


def top_of_each(rows: DataFrame, by: list[str], count: str, path: str, n: int = 5) -> DataFrame:
    """The ``n`` worst offenders of each item with their ``place``: by count downwards, then path."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(count), path))
    return rows.withColumn("place", place).filter(F.col("place") <= n)


def bounded(rows: DataFrame, order: list[str], n: int) -> tuple[DataFrame, int]:
    """The first ``n`` rows in an order, and how many rows that leaves out."""
    return rows.orderBy(*order).limit(n), max(0, rows.count() - n)


def tail(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows in an order, still in that order."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def capped(rows: DataFrame, score: str, path: str, most: int) -> DataFrame:
    """All rows with ``place`` and ``overflow``: whether they come after the ``most`` best; ties by path, then the rows' other columns."""
    rest = [c for c in rows.columns if c not in (score, path)]
    best = rows.orderBy(F.desc(score), path, *rest).limit(most)
    place = F.row_number().over(Window.orderBy(F.desc(score), path, *rest))  # of ``most`` rows
    kept = best.withColumn("place", place).withColumn("__nth", F.row_number().over(Window.partitionBy(*rows.columns).orderBy("place")))
    every = rows.withColumn("__nth", F.row_number().over(Window.partitionBy(*rows.columns).orderBy(F.lit(0))))
    same = [every[c].eqNullSafe(kept[c]) for c in every.columns]
    out = every.join(F.broadcast(kept), same, "left").select(*[every[c] for c in rows.columns], "place")  # ``most`` rows
    return out.withColumn("overflow", F.col("place").isNull())
