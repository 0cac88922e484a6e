"""Command rules, grants, patch scans and tool status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.functions.scalars import version_key
from repolith.operators.relational import small


def unquoted(command: Column) -> Column:
    """Quoted text blanked, so that a rule doesn't fire on what is only mentioned."""
    return F.regexp_replace(F.regexp_replace(command, r"'[^']*'", "''"), r'"[^"]*"', '""')


def evaluate(commands: DataFrame, rules: DataFrame, first_only: list[str]) -> DataFrame:
    """(id, rule, decision) of the rules that a command matches.

    commands: id, command; rules: rule, pattern, raw, grp, decision, ordinal.  Rules
    that aren't raw see the command without quoted text.  Of a group in
    ``first_only``, the first matching rule counts.  The rules are broadcast once
    they are counted; see ``relational.small``.
    """
    seen = commands.withColumn("plain", unquoted(F.col("command")))
    subject = F.when(F.col("raw"), F.col("command")).otherwise(F.col("plain"))
    hits = seen.join(small(rules), F.regexp_like(subject, F.col("pattern")))
    nth = F.row_number().over(Window.partitionBy("id", "grp").orderBy("ordinal"))
    return hits.withColumn("nth", nth).filter(
        (F.col("nth") == 1) | ~F.col("grp").isin(first_only)
    ).select("id", "rule", "decision", "ordinal")


def strongest(hits: DataFrame, severity: tuple[str, ...] = ("allow", "warn", "ask", "deny")) -> DataFrame:
    """The most severe decision of each command, the first rule on ties."""
    level = F.array_position(F.array(*map(F.lit, severity)), F.col("decision"))
    best = F.max_by(F.struct("rule", "decision"), F.struct(level.alias("l"), (-F.col("ordinal")).alias("o"))).alias("best")
    return hits.groupBy("id").agg(best).select("id", "best.*")


def floor_irreversible(decision: Column, irreversible: Column) -> Column:
    return F.when(irreversible & decision.isin("allow", "warn"), "ask").otherwise(decision)


def grants_for(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """(request, grant) pairs that apply: equal rule, session (null fits any), command pattern, and all paths within the glob.

    requests: request, rule, session, command, paths; grants: grant, rule, session,
    pattern, path_regex (see ``glob_regex``).  Compound commands and, where a glob is
    set, empty path lists never match.
    """
    g = grants.select("grant", "rule", F.col("session").alias("g_session"), "pattern", "path_regex")
    rows = requests.join(g, "rule")
    session = F.col("g_session").isNull() | (F.col("g_session") == F.col("session"))
    command = F.col("pattern").isNull() | (F.regexp_like("command", F.col("pattern")) & ~F.col("command").rlike(r"[;&|`\n]|\$\("))
    paths = F.col("path_regex").isNull() | ((F.size("paths") > 0) & F.forall("paths", lambda p: F.regexp_like(p, F.col("path_regex"))))
    return rows.filter(session & command & paths).select("request", "grant")


#: How a patch names the file whose lines follow: blocks of ``***``, and unified diffs; what follows is a path, blanks and all.
HEADERS = ("*** Update File: ", "*** Add File: ", "+++ b/", "+++ ")


def patch_additions(patches: DataFrame) -> DataFrame:
    """(id, path, line, text) of added lines, the file carried down from its header.

    patches: id, patch, and if there are any path (the file where no header names one),
    new_string (text put in) and content (a whole file, only with a path), whose lines
    all count as added.  ``line`` is the line within what holds it.
    """
    given = F.coalesce(F.col("path"), F.lit("")) if "path" in patches.columns else F.lit("")
    split = lambda c: F.posexplode(F.split(F.regexp_replace(c, r"\r?\n$", ""), "\r?\n")).alias("at", "text")
    rows = patches.select("id", given.alias("given"), split("patch"))
    named = [F.when(F.startswith("text", F.lit(h)), F.trim(F.substr("text", F.lit(len(h) + 1)))) for h in HEADERS]
    header = F.last(F.coalesce(*named), ignorenulls=True).over(Window.partitionBy("id").orderBy("at"))
    added = F.col("text").startswith("+") & ~F.col("text").startswith("+++")
    line = (F.col("at") + 1).alias("line")
    out = rows.withColumn("path", F.coalesce(header, "given")).filter(added).select("id", "path", line, F.substr("text", F.lit(2)).alias("text"))
    for c in ("new_string", "content"):
        if c in patches.columns:
            whole = patches.filter((F.col(c) != "") & ((given != "") | F.lit(c == "new_string"))).select("id", given.alias("path"), split(c))
            out = out.union(whole.select("id", "path", line, "text"))
    return out


#: Predicates over added lines (columns path and text) by name; a caller may put others in their place.
PREDICATES = {
    "secret": lambda: F.col("text").rlike(r"(?i)(?:password|secret|token|api_key)\s*[:=]\s*[\"'][^\"']{4,}"),
    "debugger": lambda: F.col("path").endswith(".py") & F.col("text").rlike(r"^\s*(?:import pdb|breakpoint\()"),
}


def patch_findings(additions: DataFrame, predicates: dict | None = None) -> DataFrame:
    """(id, path, line, predicate) of added lines for which a predicate holds; ``predicates`` take the place of those of the same name."""
    chosen = PREDICATES | (predicates or {})
    hit = F.filter(F.array(*[F.when(F.coalesce(p(), F.lit(False)), n) for n, p in chosen.items()]), lambda x: x.isNotNull())
    return additions.select("id", "path", "line", F.explode(hit).alias("predicate"))


def suppress(findings: DataFrame, markers: DataFrame) -> DataFrame:
    """Findings without a marker of their rule on one of the lines [start, end] of the same path."""
    m = markers.select(F.col("path").alias("m_path"), F.col("rule").alias("m_rule"), F.col("line").alias("m_line"))
    return findings.join(
        m,
        [F.col("path") == F.col("m_path"), F.col("rule") == F.col("m_rule"), F.col("m_line").between(F.col("start"), F.col("end"))],
        "left_anti"
    )


def tool_status(tools: DataFrame, projects: DataFrame) -> DataFrame:
    """(capability, status, reasons): available, too-old or unavailable if all its tools are so, else limited.

    tools: capability, tool, version (null: not there), least; projects: capability of
    those that have project metadata.  Without it, available is only limited.
    """
    old = version_key(F.col("version")) < version_key(F.col("least"))
    state = F.when(F.col("version").isNull(), "unavailable").when(F.coalesce(old, F.lit(False)), "too-old").otherwise("available")
    n = tools.groupBy("capability").agg(F.min(state).alias("a"), F.max(state).alias("z"))
    there = projects.select("capability", F.lit(True).alias("project")).distinct()
    n = n.join(there, "capability", "left").withColumn("project", F.coalesce("project", F.lit(False)))
    status = F.when(F.col("a") != F.col("z"), "limited").otherwise(F.col("a"))
    why = F.when(status == "limited", "partial-toolchain").when(status != "available", F.concat(F.lit("toolchain-"), status))
    reasons = F.array_compact(F.array(why, F.when(~F.col("project"), "project-metadata-unavailable")))
    lowered = F.when((status == "available") & ~F.col("project"), "limited").otherwise(status)
    return n.select("capability", lowered.alias("status"), reasons.alias("reasons"))


def trajectory(before: DataFrame, after: DataFrame) -> DataFrame:
    """(callee, option, was, share, course) of two ``divergence`` results: spreading, receding, steady, new or closed."""
    a = before.select("callee", "option", F.col("share").alias("was"))
    rows = a.join(after.select("callee", "option", "share"), ["callee", "option"], "full_outer")
    course = F.when(F.col("was").isNull(), "new").when(F.col("share").isNull(), "closed").when(
        F.col("share") > F.col("was"), "spreading"
    ).when(F.col("share") < F.col("was"), "receding").otherwise("steady")
    return rows.select("callee", "option", "was", "share", course.alias("course"))


def divergence(calls: DataFrame, least_share: float = 0.8, least_size: int = 3) -> DataFrame:
    """(callee, option, present, size, share, stragglers) for options that most call sites of a callee pass and some don't.

    calls: callee, site, options.  All is grouped by callee or more, so calls that are
    dealt by callee beforehand (``session.dealt``) aren't shuffled again.
    """
    size = calls.groupBy("callee").agg(F.countDistinct("site").alias("size"))
    used = calls.select("callee", "site", F.explode("options").alias("option")).distinct()
    n = used.groupBy("callee", "option").agg(F.count("*").alias("present")).join(size, "callee").withColumn(
        "share", F.col("present") / F.col("size")
    )
    kept = n.filter((F.col("size") >= least_size) & (F.col("share") >= least_share) & (F.col("present") < F.col("size")))
    group = ["callee", "option", "present", "size", "share"]
    passed = F.coalesce(F.bool_or(F.array_contains("options", F.col("option"))), F.lit(False))
    missing = calls.join(kept, "callee").groupBy(*group, "site").agg(passed.alias("passed")).filter("NOT passed")
    return missing.groupBy(*group).agg(F.array_sort(F.collect_list("site")).alias("stragglers"))
