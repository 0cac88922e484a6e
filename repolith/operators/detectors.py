"""Detectors over tables of facts: definitions, references, edges, routes, terms and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Plan states from which no further work is expected.
TERMINAL = ("promoted", "abandoned", "rejected")


def dormant(defs: DataFrame, refs: DataFrame, literals: DataFrame) -> DataFrame:
    """Definitions that nothing refers to: ``unreferenced``, or ``uncertain`` if a string literal holds the name.

    defs: path, line, name, decorators; refs: name; literals: name.  Decorated
    definitions are callbacks of a framework and left out.
    """
    free = defs.filter(F.size(F.coalesce("decorators", F.array())) == 0).join(refs.select("name").distinct(), "name", "left_anti")
    quoted = literals.select("name", F.lit(True).alias("quoted")).distinct()
    state = F.when(F.col("quoted"), "uncertain").otherwise("unreferenced")
    return free.join(quoted, "name", "left").select("path", "line", "name", state.alias("state"))


def prefix_clusters(files: DataFrame, least: int = 3) -> DataFrame:
    """(folder, prefix, files) of ``least`` sibling files or more whose names share the part before the first ``-`` or ``_``."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    rows = files.select(
        "path", F.regexp_replace("path", r"/?[^/]+$", "").alias("folder"),
        F.regexp_extract(name, r"^([^-_.]+)[-_]", 1).alias("prefix")
    )
    out = rows.filter("prefix <> ''").groupBy("folder", "prefix").agg(F.array_sort(F.collect_set("path")).alias("files"))
    return out.filter(F.size("files") >= least)


def domain_clusters(symbols: DataFrame, least: int = 2) -> DataFrame:
    """Files whose names deal with ``least`` domains or more: clusters and and_count, one less than their number.

    symbols: path, name.  A name's domain is the noun after its leading verb:
    ``load_invoice`` and ``saveInvoice`` belong to ``invoice``.
    """
    snake = F.lower(F.regexp_replace("name", r"([a-z0-9])([A-Z])", "$1_$2"))
    words = F.filter(F.split(snake, "_+"), lambda w: w != "")
    noun = F.when(F.size(words) > 1, F.element_at(words, -1))
    rows = symbols.select("path", noun.alias("domain")).filter("domain IS NOT NULL")
    out = rows.groupBy("path").agg(F.array_sort(F.collect_set("domain")).alias("clusters"))
    return out.filter(F.size("clusters") >= least).withColumn("and_count", F.size("clusters") - 1)


def term_bands(texts: DataFrame, glossary: DataFrame, key: str, text: str) -> DataFrame:
    """(key, concept, band, terms) of glossary terms in texts.

    glossary: concept, term, standing (canonical, avoid, competing, superseded).
    avoid_term_hit: a term to avoid occurs; competing_term_coexistence: two terms or
    more of a concept, one of them competing; superseded_co_occurrence: a superseded
    term beside its canonical one.
    """
    words = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(\w+)"), F.lit(1)))).alias("term"))
    hits = words.join(glossary.select("concept", F.lower("term").alias("term"), "standing"), "term")
    seen = hits.groupBy(key, "concept").agg(
        F.array_sort(F.collect_set("term")).alias("terms"), F.collect_set("standing").alias("standings")
    )
    has = lambda s: F.array_contains("standings", s)
    bands = F.array(
        F.when(has("avoid"), "avoid_term_hit"),
        F.when(has("competing") & (F.size("terms") > 1), "competing_term_coexistence"),
        F.when(has("superseded") & has("canonical"), "superseded_co_occurrence"),
    )
    return seen.select(key, "concept", F.explode(F.filter(bands, lambda b: b.isNotNull())).alias("band"), "terms")


def implicit_states(operations: DataFrame, least: int = 2) -> DataFrame:
    """(carrier_type, field, operations, literals, classification) of string fields used as closed states.

    operations: carrier_type, field, field_type, literal, operation (comparison or
    assignment).  A field of its own type is a typed authority; a string field needs
    ``least`` literals, compared and assigned both.
    """
    n = operations.groupBy("carrier_type", "field").agg(
        F.count("*").alias("operations"),
        F.array_sort(F.collect_set("literal")).alias("literals"),
        F.collect_set("operation").alias("kinds"),
        F.max(F.col("field_type") != "string").alias("typed"),
    )
    closed = (F.size("literals") >= least) & F.array_contains("kinds", "comparison") & F.array_contains("kinds", "assignment")
    kind = F.when(
        F.col("typed"), "typed_state_authority"
    ).when(closed, "first_party_state_operation").otherwise("insufficient_closed_state_evidence")
    return n.select("carrier_type", "field", "operations", "literals", kind.alias("classification"))


def call_completeness(edges: DataFrame) -> DataFrame:
    """(caller, resolved, unresolved, state): complete if each of a caller's calls is resolved, unresolved if none is, else partial."""
    n = edges.groupBy("caller").agg(
        F.count_if(F.col("callee").isNotNull()).alias("resolved"),
        F.count_if(F.col("callee").isNull()).alias("unresolved")
    )
    return n.withColumn(
        "state",
        F.when(F.col("unresolved") == 0, "complete").when(F.col("resolved") == 0, "unresolved").otherwise("partial")
    )


def triage_pairs(pairs: DataFrame, calls: DataFrame, reject: float) -> DataFrame:
    """(a, b, verdict, reason) of candidate pairs with a token similarity and unresolved calls.

    pairs: a, b, similarity, unresolved; calls: caller, callee.  A pair that calls one
    another is rejected, as is one whose tokens are as similar as ``reject``; one with
    unresolved calls stays uncertain.
    """
    both = calls.select(F.col("caller").alias("a"), F.col("callee").alias("b")).union(calls.select("callee", "caller")).distinct()
    rows = pairs.join(both.withColumn("calls", F.lit(True)), ["a", "b"], "left")
    reason = F.when(F.col("calls"), "caller_callee").when(F.col("similarity") >= reject, "token_similar").when(
        F.col("unresolved") > 0, "direct_call_unresolved_or_dynamic"
    )
    rows = rows.withColumn("reason", reason)
    verdict = F.when(
        F.col("reason").isin("caller_callee", "token_similar"), "rejected"
    ).when(F.col("reason").isNotNull(), "uncertain").otherwise("confirmed")
    return rows.select("a", "b", verdict.alias("verdict"), "reason")


def select_with_omissions(rows: DataFrame, score: str, k: int) -> DataFrame:
    """All rows with ``selected``: among the k best or tied with the last of them; the others are the reported omissions."""
    n = rows.groupBy(score).count()
    best = n.orderBy(F.desc(score)).limit(k)
    w = Window.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    kept = best.withColumn(
        "before", F.coalesce(F.sum("count").over(w), F.lit(0))
    ).filter(F.col("before") < k).select(score, F.lit(True).alias("selected"))
    return rows.join(F.broadcast(kept), score, "left").withColumn("selected", F.coalesce("selected", F.lit(False)))  # at most k rows


def layer_violations(edges: DataFrame, layers: DataFrame, allowed: DataFrame) -> DataFrame:
    """Import edges (importer, imported) between layers that no rule allows; within a layer all is allowed, files without a layer are passed over.

    layers: path, layer; allowed: from_layer, to_layer.
    """
    a = layers.select(F.col("path").alias("importer"), F.col("layer").alias("from_layer"))
    b = layers.select(F.col("path").alias("imported"), F.col("layer").alias("to_layer"))
    rows = edges.select("importer", "imported").distinct().join(a, "importer").join(b, "imported").filter("from_layer <> to_layer")
    return rows.join(allowed, ["from_layer", "to_layer"], "left_anti").select("importer", "imported", "from_layer", "to_layer")


def route_family(route: Column, page_prefix: str = "", api_prefix: str = "", scoped_id: str = "") -> Column:
    """site_page, site_scoped_api, global_api or other, from a configurable shape; an empty part matches nothing."""
    held = r"<(?:[^:>]+:)?\Q" + scoped_id + r"\E>" if scoped_id else None
    page = route.rlike(rf"^\Q{page_prefix}\E/{held}/") if page_prefix and held else F.lit(False)
    api = route.startswith(api_prefix + "/") if api_prefix else F.lit(False)
    scoped = api & route.rlike(held) if held else F.lit(False)
    return F.when(page, "site_page").when(scoped, "site_scoped_api").when(api, "global_api").otherwise("other")


def normal_route(route: Column) -> Column:
    """``/sites/{id}/export`` for ``sites/<int:id>/export/``."""
    return F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(route, r"<(?:[^:>]+:)?([^>]+)>", "{$1}"), r"^/+|/+$", ""))


def stale_plans(plans: DataFrame, ledger: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Plans (slug, status, modified_at) that aren't terminal, older than ``days`` and not in flight.

    ledger: id, ordinal, state; only the last state of an id counts, and only
    ``in-flight`` is active tracking.
    """
    last = ledger.groupBy("id").agg(F.max_by("state", "ordinal").alias("state")).filter("state = 'in-flight'")
    old = (F.unix_timestamp(now) - F.unix_timestamp("modified_at")) / 86400 > days
    return plans.filter(~F.col("status").isin(*TERMINAL) & old).join(last.select(F.col("id").alias("slug")), "slug", "left_anti")


def fold_states(events: DataFrame, initial: DataFrame) -> DataFrame:
    """(id, state, transitions): the intake's state, or that of the last transition (id, at, ordinal, to_state)."""
    last = events.groupBy("id").agg(F.max_by("to_state", F.struct("at", "ordinal")).alias("to_state"), F.count("*").alias("transitions"))
    return initial.join(last, "id", "left").select(
        "id", F.coalesce("to_state", "state").alias("state"), F.coalesce("transitions", F.lit(0)).alias("transitions")
    )


def recent_evidence(claims: DataFrame, evidence: DataFrame, by: list[str], hours: int = 12) -> DataFrame:
    """Claims with ``backed``: whether evidence of the same key lies at most ``hours`` before them (inclusive).

    One window over both, so a hot key is sorted once and never paired.
    """
    both = claims.select("*", F.lit(None).cast("timestamp").alias("seen")).unionByName(
        evidence.select(*by, "at", F.col("at").alias("seen")), allowMissingColumns=True
    )
    w = Window.partitionBy(*by).orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = both.withColumns({"is_claim": F.col("seen").isNull(), "last": F.max("seen").over(w)}).filter("is_claim")
    near = F.unix_timestamp("at") - F.unix_timestamp("last") <= hours * 3600
    return rows.select(*claims.columns, F.coalesce(near, F.lit(False)).alias("backed"))


def scan_requests(requests: DataFrame, contracts: DataFrame) -> DataFrame:
    """(request, state, reason): accepted, or refused for an unknown detector or a mode or language that its contract lacks.

    requests: request, detector, mode, language; contracts: detector, modes, languages.
    """
    rows = requests.join(contracts, "detector", "left")
    reason = F.when(F.col("modes").isNull(), "unknown_detector").when(~F.array_contains("modes", F.col("mode")), "unsupported_mode").when(
        ~F.array_contains("languages", F.col("language")), "unsupported_language"
    )
    return rows.select("request", F.when(reason.isNull(), "accepted").otherwise("refused").alias("state"), reason.alias("reason"))


def dismissible(complete: Column, granularity: Column) -> Column:
    """Only complete findings of line granularity may be dismissed."""
    return F.coalesce(complete & (granularity == "line"), F.lit(False))


def importance(findings: DataFrame, locators: DataFrame, tiers: tuple[str, ...]) -> DataFrame:
    """Findings with ``tier`` and ``tier_rank`` (1 is first; unlisted paths come last) of the longest locator prefix of their path.

    locators: prefix, tier.
    """
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    hit = findings.select("path").distinct().withColumn("prefix", F.explode(prefixes)).join(locators, "prefix")
    best = hit.groupBy("path").agg(F.max_by("tier", F.length("prefix")).alias("tier"))
    rank = F.array_position(F.array(*map(F.lit, tiers)), F.col("tier"))
    return findings.join(best, "path", "left").withColumn("tier_rank", F.when(rank > 0, rank).otherwise(len(tiers) + 1))


def posture(findings: DataFrame, rules: DataFrame, overrides: DataFrame) -> DataFrame:
    """Findings with ``kept``: a rule may be dialled only in a recoverable tier and a covered band; an unknown rule stays in force.

    findings: rule, ...; rules: rule, tier, covered; overrides: rule, enabled.
    """
    rows = findings.join(rules, "rule", "left").join(overrides, "rule", "left")
    dialable = F.coalesce((F.col("tier") == "recoverable") & F.col("covered"), F.lit(False))
    return rows.withColumn("kept", ~dialable | F.coalesce("enabled", F.lit(True))).drop("enabled")
