"""Filters, joins, windows and aggregates that the audits are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.functions.scalars import ancestors, glob_regex


# classification


def classify(rules: list[tuple[str, Column]], default: str) -> Column:
    """The first rule that holds names the class."""
    out = F.lit(default)
    for name, holds in reversed(rules):
        out = F.when(holds, name).otherwise(out)
    return out


def size_tier(n: Column, limits: list[tuple[int, str]], rest: str) -> Column:
    return classify([(name, n <= most) for most, name in limits], rest)


def reasons(triggers: list[tuple[str, Column]]) -> Column:
    """Names of all triggers that hold, in order; an unknown trigger doesn't hold."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in triggers]), lambda x: x.isNotNull())


def matches_any(path: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_regex(g))
    return out


#: Rows of a rule table that may be broadcast; rules are joined by regexes, so every item meets every rule.
MOST_RULES = 10_000


def small(rules: DataFrame, most: int = MOST_RULES) -> DataFrame:
    """The rules marked for broadcast once they are counted; more than ``most`` of them are an error."""
    n = rules.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} rules")
    return F.broadcast(rules)


def route(items: DataFrame, rules: DataFrame, text: str) -> DataFrame:
    """(item columns, rule columns) for include/exclude regexes in ``rules``, a small table whose size is checked."""
    hit = F.regexp_like(F.col(text), F.col("include")) & ~F.coalesce(F.regexp_like(F.col(text), F.col("exclude")), F.lit(False))
    return items.join(small(rules), hit).dropDuplicates([text, "rule"])


# joins


def owner(items: DataFrame, registry: DataFrame, path: str = "path", ties: str = "first") -> DataFrame:
    """Longest-prefix owner of each path, by an equi-join of the names it can be known by; ``owner`` null where none.

    registry: owner, prefix, ordinal.  A prefix that ends in ``/`` owns all below that
    folder, any other one file.  A leading ``./`` doesn't count on either side.
    ``ties`` first: the first registered of equally long prefixes; all: an array of all
    of them (more than one is ambiguous).
    """
    plain = lambda c: F.regexp_replace(F.trim(c), r"^\./", "")
    known = registry.withColumn("prefix", plain(F.col("prefix")))
    paths = items.select(F.col(path).alias("__path")).distinct()
    own = plain(F.col("__path"))
    folders = F.transform(F.slice(ancestors(own), 2, 1 << 30), lambda f: F.concat(f, F.lit("/")))
    hits = paths.withColumn("prefix", F.explode(F.array_distinct(F.concat(F.array(own), folders)))).join(known, "prefix")
    if ties == "first":
        best = hits.groupBy("__path").agg(F.max_by("owner", F.struct(F.length("prefix"), -F.col("ordinal"))).alias("owner"))
    else:
        longest = F.rank().over(Window.partitionBy("__path").orderBy(F.desc(F.length("prefix"))))
        best = hits.withColumn("r", longest).filter("r = 1").groupBy("__path").agg(F.array_sort(F.collect_set("owner")).alias("owner"))
    return items.join(best, F.col(path) == F.col("__path"), "left").drop("__path")


def flags(rows: DataFrame, sets: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """A boolean column for each key set that holds the row's key; staged semi-joins, no OR-join."""
    for name, (keys, on) in sets.items():
        rows = rows.join(
            keys.select(*on).distinct().withColumn(name, F.lit(True)), on, "left"
        ).withColumn(name, F.coalesce(name, F.lit(False)))
    return rows


def manifest_diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Each key with fixed, new or persisting."""
    a, b = before.select(*key).distinct().withColumn("a", F.lit(1)), after.select(*key).distinct().withColumn("b", F.lit(1))
    return a.join(b, key, "full_outer").select(
        *key,
        F.when(F.col("b").isNull(), "fixed").when(F.col("a").isNull(), "new").otherwise("persisting").alias("state")
    )


def compare_sides(left: DataFrame, right: DataFrame, key: str, digest: str) -> DataFrame:
    """missing-left, missing-right, content-drift or same for each key."""
    l, r = left.select(key, F.col(digest).alias("l")), right.select(key, F.col(digest).alias("r"))  # noqa: E741
    state = F.when(F.col("l").isNull(), "missing-left").when(F.col("r").isNull(), "missing-right").when(
        F.col("l") != F.col("r"), "content-drift"
    ).otherwise("same")
    return l.join(r, key, "full_outer").select(key, state.alias("state"))


def last_before(events: DataFrame, probe: Column, other: Column, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """As-of: for each row where ``probe`` holds, ``value`` of the last row before it where ``other`` holds; one window, no join."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn(name, F.last(F.when(other, F.col(value)), ignorenulls=True).over(w)).filter(probe)


def first_after(events: DataFrame, other: Column, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``value`` of the first row after each where ``other`` holds: the last one before it in the opposite order, which takes one pass."""
    w = Window.partitionBy(*by).orderBy(*[F.desc_nulls_last(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn(name, F.last(F.when(other, F.col(value)), ignorenulls=True).over(w))


def mentions(texts: DataFrame, terms: DataFrame, key: str, text: str, pattern: str = r"\w+") -> DataFrame:
    """term, n (texts that mention it) and hits, by an inverted index; unmentioned terms keep 0."""
    words = texts.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1))).alias("term"))
    wanted = terms.select(F.lower("term").alias("term")).distinct()
    found = words.join(wanted, "term", "left_semi").groupBy("term", key).count().groupBy("term").agg(
        F.count("*").alias("n"), F.sum("count").alias("hits")
    )
    return wanted.join(found, "term", "left").na.fill(0, ["n", "hits"])


def resolve_imports(specs: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """(importer, spec, target): the first of the ordered candidate paths that exists, else an alias that names exactly one file."""
    cand = specs.select("importer", "spec", F.posexplode("candidates").alias("at", "path")).join(files.select("path").distinct(), "path")
    direct = cand.groupBy("importer", "spec").agg(F.min_by("path", "at").alias("direct"))
    single = aliases.groupBy("spec").agg(F.countDistinct("path").alias("n"), F.min("path").alias("alias")).filter("n = 1")
    out = specs.select("importer", "spec").distinct().join(direct, ["importer", "spec"], "left").join(single, "spec", "left")
    return out.select("importer", "spec", F.coalesce("direct", "alias").alias("target")).filter("target IS NOT NULL AND target <> importer")


# windows


def latest(rows: DataFrame, key: list[str], ts: str, ordinal: str) -> DataFrame:
    """The latest row of each key and ``superseded``, the number of others; equal times keep the first, a null time is the epoch.

    One partial aggregation; ``ordinal`` is a number.
    """
    rest = [c for c in rows.columns if c not in key]
    t = F.coalesce(F.col(ts), F.timestamp_seconds(F.lit(0)))
    best = F.max_by(F.struct(*rest), F.struct(t, -F.col(ordinal)))
    return rows.groupBy(*key).agg(
        best.alias("__row"), (F.count("*") - 1).alias("superseded")
    ).select(*key, "__row.*", "superseded").select(*rows.columns, "superseded")


def keep_first(rows: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(ordinal))).filter("nth = 1").drop("nth")


def next_start(rows: DataFrame, by: list[str], start: str, total: Column) -> DataFrame:
    """``end``: one before the next start, at last the total."""
    return rows.withColumn("end", F.coalesce(F.lead(start).over(Window.partitionBy(*by).orderBy(start)) - 1, total))


# aggregates


def histograms(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n) of several columns in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    return rows.select(pairs.alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def clone_groups(
    rows: DataFrame, key: list[str], place: str, least: int = 2, hooks: tuple[str, ...] = (), protocol: tuple[str, ...] | None = None
) -> DataFrame:
    """Keys in ``least`` distinct places or more: occurrences counts rows.  Rows whose ``name`` is dunder or one of the ``hooks`` are left out.

    With ``protocol``, names that many adapters must have alike, a column ``protocol_name`` says whether a group has one of them.
    """
    if "name" in rows.columns:
        rows = rows.filter(~F.col("name").rlike("^__.*__$") & ~F.col("name").isin(*hooks))
    out = rows.groupBy(*key).agg(F.count("*").alias("occurrences"), F.countDistinct(place).alias("places")).filter(F.col("places") >= least)
    return out if protocol is None else out.withColumn("protocol_name", F.coalesce(F.col("name").isin(*protocol), F.lit(False)))


def census(rows: DataFrame, group: list[str], variant: str) -> DataFrame:
    """Count and share of classified rows for each variant, whether it is the majority (ties alphabetical); null is unclassified."""
    n = rows.filter(F.col(variant).isNotNull()).groupBy(*group, variant).agg(F.count("*").alias("n"))
    by = Window.partitionBy(*group)
    return n.withColumns(
        {"share": F.round(F.col("n") / F.sum("n").over(by), 6), "majority": F.row_number().over(by.orderBy(F.desc("n"), variant)) == 1}
    )


def month_pivot(rows: DataFrame, ts: str, column: str, values: list[str]) -> DataFrame:
    """Zero-filled counts by month (``unknown`` for an unreadable time) and value."""
    month = F.coalesce(F.date_format(ts, "yyyy-MM"), F.lit("unknown"))
    return rows.groupBy(month.alias("month")).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)


def top_ties(rows: DataFrame, score: str, k: int) -> DataFrame:
    """The k best with all ties at the cutoff."""
    best = rows.groupBy(score).count().orderBy(F.desc(score))
    w = Window.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    kept = best.limit(k).withColumn("before", F.coalesce(F.sum("count").over(w), F.lit(0))).filter(F.col("before") < k).select(score)
    return rows.join(kept, score, "left_semi")


def first_n(rows: DataFrame, key: list[str], ordinal: str, n: int = 3) -> DataFrame:
    """The first ``n`` rows of each key in the order they came."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(ordinal))).filter(F.col("nth") <= n).drop("nth")


def listed(rows: DataFrame, by: list[str], columns: list[str], name: str, most: int) -> DataFrame:
    """(by, name): the first ``most`` of a key's rows in the order of ``columns``, as an array of bounded size (structs, if several columns)."""
    w = Window.partitionBy(*by).orderBy(*columns)
    first = rows.select(*by, *columns).withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= most)
    held = F.transform(F.array_sort(F.collect_list(F.struct("__r", *columns))), lambda x: x[columns[0]] if len(columns) == 1 else F.struct(*[x[c].alias(c) for c in columns]))
    return first.groupBy(*by).agg(held.alias(name))


def set_digest(value: Column) -> Column:
    """An aggregate: a digest of distinct values, whatever their order, as sums of 60 and 60 bits of each one's MD5; partial sums merge."""
    half = lambda at: F.sum(F.conv(F.substring(F.md5(value.cast("string").cast("binary")), at, 15), 16, 10).cast("decimal(38,0)"))
    return F.concat_ws("-", half(1).cast("string"), half(16).cast("string"))


def stragglers(rows: DataFrame, group: list[str], variant: str, site: str) -> DataFrame:
    """(group, variant, sites) of the classified rows that don't follow the majority of their group."""
    less = census(rows, group, variant).filter("NOT majority").select(*group, variant)
    return rows.join(less, [*group, variant], "left_semi").groupBy(*group, variant).agg(F.array_sort(F.collect_set(site)).alias("sites"))
