"""Filters and lookups over ledgers, registries and lists of files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.functions.scalars import ancestors
from repolith.operators.relational import classify

# Verbs that begin the name of a command which asks, and of one which acts.
ASKING = (
    "list", "show", "check", "audit", "validate", "lint", "report", "status", "summary", "summarize", "coverage",
    "history", "verify", "diff", "find", "get", "print", "describe", "inspect", "count", "for", "search",
)
ACTING = (
    "init", "add", "append", "update", "rebuild", "promote", "create", "delete", "remove", "clear", "prune", "apply",
    "install", "uninstall", "set", "write", "record", "import", "export", "run", "build", "generate", "sync", "migrate",
    "revoke", "grant", "withdraw", "renew", "collect", "stage",
)


def scope_tags(files: DataFrame, focus: list[str]) -> DataFrame:
    """Files with ``scope``: focus below one of the focus folders (all, if there are none), else context."""
    if not focus:
        return files.withColumn("scope", F.lit("focus"))
    roots = [f.rstrip("/") for f in focus]
    return files.withColumn(
        "scope",
        F.when(F.arrays_overlap(ancestors(F.col("path")), F.array(*map(F.lit, roots))), "focus").otherwise("context")
    )


def scope_relation(members: DataFrame, by: list[str]) -> DataFrame:
    """(by, relation): focus_focus if all known scopes are focus, focus_context if some are, else context_only."""
    n = members.groupBy(*by).agg(F.count_if(F.col("scope") == "focus").alias("f"), F.count_if(F.col("scope") == "context").alias("c"))
    relation = F.when(F.col("f") == 0, "context_only").when(F.col("c") == 0, "focus_focus").otherwise("focus_context")
    return n.select(*by, relation.alias("relation"))


def ledger_entries(ledger: DataFrame, decisions: str | Iterable[str] | None = None, least: int = 0) -> DataFrame:
    """Entries with one of the decisions (a comma-separated text or several; none: any) and at least ``least`` lines, an unknown number counting 0."""
    if isinstance(decisions, str):
        decisions = decisions.split(",")
    wanted = [d.strip() for d in decisions or [] if d.strip()]
    rows = ledger.filter(F.coalesce("loc", F.lit(0)) >= least)
    return rows.filter(F.col("decision").isin(wanted)) if wanted else rows


def open_findings(findings: DataFrame, events: DataFrame, closing: Iterable[str], now: Column) -> DataFrame:
    """Findings that no closing event names, wherever it stands, with ``age_days`` in whole days (null for an unknown time).

    findings: id, created (timestamp), ...; events: id, status.
    """
    done = events.filter(F.col("status").isin(list(closing))).select("id").distinct()
    age = ((F.unix_timestamp(now) - F.unix_timestamp("created")) / 86400).cast("int")
    return findings.join(done, "id", "left_anti").withColumn("age_days", age)


def verb_class(name: Column, effect: Column, asking: Iterable[str] = ASKING, acting: Iterable[str] = ACTING) -> Column:
    """``action``, ``query`` or ``unclassified`` for a command, by what it was found to write and by its verb.

    ``effect`` is yes, no, flag-gated, or anything else (null too) for what couldn't be
    told.  A verb can make an action of a command, never a query of one that writes;
    it counts as a query's only where the effect is unknown.
    """
    verb = F.lower(F.substring_index(name, "-", 1))
    told = F.coalesce(effect, F.lit("unknown"))
    return F.when((told == "yes") | verb.isin(*acting), "action").when(told.isin("no", "flag-gated") | verb.isin(*asking), "query").otherwise(
        "unclassified"
    )


def scanned(files: DataFrame, suffixes: dict[str, list[str]], language: str | None = None) -> DataFrame:
    """Files with ``state``: scanned, or minified, test, other_language or unsupported for those that are passed over.  files: path."""
    suffix = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    lang = classify([(k, suffix.isin(v)) for k, v in suffixes.items()], "")
    state = F.when(lang == "", "unsupported").when(F.lit(language is not None) & (lang != (language or "")), "other_language")
    state = state.when(name.rlike(r"\.min\.[^.]+$"), "minified").when(
        name.rlike(r"^tests?_|[._]tests?\.[^.]+$|^tests?\.[^.]+$|^conftest\.py$"), "test"
    ).otherwise("scanned")
    return files.withColumns({"language": F.nullif(lang, F.lit("")), "state": state})


def over_budget(rows: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """Rows (kind, loc, ...) over their kind's budget, strictly, with ``budget``; kinds without one are passed over."""
    known = F.create_map(*[F.lit(x) for p in budgets.items() for x in p])
    return rows.withColumn("budget", F.try_element_at(known, F.col("kind"))).filter(F.col("loc") > F.col("budget"))


def lookup(registry: DataFrame, id_: str | None = None, status: str | None = None, slug: str | None = None) -> DataFrame:
    """Registry rows by id (leading zeros don't count), status and slug, all that are given; by id."""
    out = registry
    if id_ is not None:
        out = out.filter(F.ltrim("id", F.lit("0")) == id_.lstrip("0"))
    if status is not None:
        out = out.filter(F.lower("status") == status.lower())
    if slug is not None:
        out = out.filter(F.col("slug") == slug)
    return out.orderBy("id")


def neighbours(registry: DataFrame, names: DataFrame) -> DataFrame:
    """(name, neighbour, known) of the declared neighbours, one step, in declared order; ``known`` if they are registered themselves."""
    pairs = names.select("name").distinct().join(registry.select("name", F.posexplode("adjacency").alias("at", "neighbour")), "name")
    there = registry.select(F.col("name").alias("neighbour"), F.lit(True).alias("known")).distinct()
    return pairs.join(there, "neighbour", "left").select("name", "at", "neighbour", F.coalesce("known", F.lit(False)).alias("known"))
