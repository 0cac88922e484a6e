"""Inventory, coverage matrix, scorecards, paired trials and prompt groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.operators.relational import classify, histograms, listed, size_tier


def inventory(files: DataFrame, rules: list[tuple[str, Column]], suffixes: DataFrame) -> DataFrame:
    """Files with role (first rule that holds, else source), language (null where unsupported) and whether it is supported.

    suffixes: suffix, language.
    """
    known = suffixes.select("suffix", "language").withColumn("supported", F.lit(True))
    rows = files.withColumns({"role": classify(rules, "source"), "suffix": F.regexp_extract("path", r"(\.[^./]+)$", 1)})
    return rows.join(known, "suffix", "left").withColumn("supported", F.coalesce("supported", F.lit(False)))


def inventory_counts(rows: DataFrame) -> DataFrame:
    """(facet, value, n) by role, language, suffix and support, in one pass."""
    return histograms(rows, ["role", "language", "suffix", "supported"])


def coverage_matrix(catalog: DataFrame, documents: dict[str, DataFrame], key: str = "skill") -> DataFrame:
    """The catalog with one column for each coverage document (key, value).

    Each document must cover the catalog exactly: unknown, missing or repeated keys
    raise, with up to ten of them named.
    """
    out = catalog
    for name, doc in documents.items():
        have = doc.groupBy(key).agg(F.count("*").alias("n"), F.first("value").alias(name))
        both = catalog.select(key, F.lit(True).alias("wanted")).join(have, key, "full_outer")
        fault = F.when(F.col("wanted").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
        bad = both.select(key, fault.alias("fault")).filter("fault IS NOT NULL").orderBy(key).limit(10).collect()
        if bad:
            raise ValueError(f"{name}: " + ", ".join(f"{r.fault} {r[0]}" for r in bad))
        out = out.join(have.select(key, name), key, "left")
    return out


def scorecard(checks: DataFrame, by: list[str]) -> DataFrame:
    """(by, failures, verdict): fail for any consequential failure, pass-with-notes for any other, else pass.

    checks: passed, consequential.
    """
    failed = ~F.coalesce("passed", F.lit(False))
    n = checks.groupBy(*by).agg(F.count_if(failed).alias("failures"), F.count_if(failed & F.col("consequential")).alias("grave"))
    verdict = F.when(F.col("grave") > 0, "fail").when(F.col("failures") > 0, "pass-with-notes").otherwise("pass")
    return n.select(*by, "failures", verdict.alias("verdict"))


def paired_trials(trials: DataFrame, by: list[str], least_pct: float, least_saving: float, least_wins: int) -> DataFrame:
    """Median saving and median of the pairs' percentages, wins and the gate's verdict; trials: before, after."""
    saving = F.col("before") - F.col("after")
    n = trials.groupBy(*by).agg(
        F.median(saving).alias("median_saving"),
        F.median(F.when(F.col("before") != 0, 100 * saving / F.col("before"))).alias("median_pct"),
        F.count_if(saving > 0).alias("wins"),
    )
    return n.withColumn(
        "passed",
        F.coalesce(
            (F.col("median_pct") >= least_pct) & (F.col("median_saving") >= least_saving) & (F.col("wins") >= least_wins),
            F.lit(False)
        )
    )


def domain_of(text: Column, rules: list[tuple[str, str]], default: str = "utility") -> Column:
    """The domain of the first regex that matches the lower-cased text."""
    return classify([(name, F.lower(text).rlike(p)) for name, p in rules], default)


def prompt_groups(symbols: DataFrame, least: int = 2, most: int | None = None) -> DataFrame:
    """(domain, n, members, omitted) of domains with ``least`` symbols or more: all by name, or with ``most`` the first of them, and how many more there are.

    symbols: domain, name.
    """
    if most is None:
        out = symbols.groupBy("domain").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("name")))["name"].alias("members"))
        return out.filter(F.col("n") >= least).withColumn("omitted", F.col("n") - F.size("members"))
    n = symbols.groupBy("domain").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return n.join(listed(symbols, ["domain"], ["name"], "members", most), "domain").select("domain", "n", "members", (F.col("n") - F.size("members")).alias("omitted"))


def with_domains(definitions: DataFrame, rules: list[tuple[str, str]], tiers: list[tuple[int, str]], rest: str) -> DataFrame:
    """Collected definitions with the ``domain`` of their file and name, and the ``tier`` of their size, as prompts are made of."""
    where = F.concat_ws(" ", "path", "qualified_name", "parent_class")
    return definitions.withColumns({"domain": domain_of(where, rules), "tier": size_tier(F.col("size"), tiers, rest)})


def cross_domain(symbols: DataFrame, tiers: list[str], n: int) -> DataFrame:
    """The first ``n`` symbols over all domains: by tier, then size downwards, then name; symbols: name, tier, size."""
    rank = F.array_position(F.array(*map(F.lit, tiers)), F.col("tier"))
    return symbols.orderBy(F.when(rank > 0, rank).otherwise(len(tiers) + 1), F.desc("size"), "name").limit(n)


def conditions(runs: DataFrame, base: str, most_context: float = 0.7, most_tokens: float = 1.1) -> DataFrame:
    """(condition, context, tokens, context_ratio, token_ratio, passed) against the base condition; runs: condition, context, tokens."""
    n = runs.groupBy("condition").agg(F.sum("context").alias("context"), F.sum("tokens").alias("tokens"))
    ref = n.filter(F.col("condition") == base).select(F.col("context").alias("c"), F.col("tokens").alias("t"))
    rows = n.crossJoin(ref)  # one row on the right
    a, b = F.when(F.col("c") != 0, F.col("context") / F.col("c")), F.when(F.col("t") != 0, F.col("tokens") / F.col("t"))
    return rows.select(
        "condition", "context", "tokens", a.alias("context_ratio"), b.alias("token_ratio"),
        F.coalesce((a <= most_context) & (b <= most_tokens), F.lit(False)).alias("passed")
    )
