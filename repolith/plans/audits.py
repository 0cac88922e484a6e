"""Whole audits: triage of scans, ledger review, friction summary, spec coverage."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.functions.scalars import calendar_days, elapsed_days, iso_timestamp, percentage
from repolith.operators.relational import flags, latest
from repolith.sources.sinks import shown


# Decisions whose work is queued or under way.
QUEUED = ("split_queued", "split_in_progress", "consolidate_queued", "consolidate_in_progress")


def triage(scans: DataFrame, findings: DataFrame, dismissals: DataFrame, now: str, grace_days: int = 7) -> DataFrame:
    """Scans with findings, the latest of each (skill, target), as grace, acknowledged or unaccounted, with age_days.

    The positive filter comes before latest-per-key, so a newer clean scan doesn't
    supersede an older dirty one.  Grace is inclusive and holds for future times; an
    unreadable time is the epoch.  A scan is acknowledged by a finding or dismissal
    that names its scan id, or by one of its skill at or after its time.
    """
    at = F.to_timestamp(F.lit(now))
    rows = scans.filter("coalesce(findings_total, 0) > 0").withColumn("at", iso_timestamp(F.col("ts")))
    rows = latest(rows, ["skill", "target"], "at", "ordinal").withColumn("at", F.coalesce("at", F.timestamp_seconds(F.lit(0))))
    rows = flags(
        rows,
        {
            "by_finding": (findings.select(F.col("source_scan").alias("scan_id")), ["scan_id"]),
            "by_dismissal": (dismissals.select(F.coalesce("source_scan", "scan_id").alias("scan_id")), ["scan_id"])
        }
    )
    said = findings.select(
        F.col("source_skill").alias("skill"), iso_timestamp(F.col("created_at")).alias("t")
    ).union(dismissals.select("skill", iso_timestamp(F.col("ts")).alias("t")))
    rows = rows.join(said.groupBy("skill").agg(F.max("t").alias("last_said")), "skill", "left")
    age = elapsed_days(F.col("at"), at)
    known = F.col("by_finding") | F.col("by_dismissal") | F.coalesce(F.col("last_said") >= F.col("at"), F.lit(False))
    grace = F.unix_timestamp(at) - F.unix_timestamp("at") <= grace_days * 86400
    state = F.when(known, "acknowledged").when(grace, "grace").otherwise("unaccounted")
    return rows.select("skill", "target", "scan_id", "findings_total", "superseded", age.alias("age_days"), state.alias("state"))


def gate(rows: DataFrame, state: str = "unaccounted") -> int:
    """Exit status: 1 if any row is in the state, else 0."""
    return int(rows.filter(F.col("state") == state).limit(1).count() > 0)


def report(build: Callable[[], DataFrame], state: str = "unaccounted", form: str = "text", limit: int = 100) -> tuple[int, str]:
    """(exit status, report): 0 if no row of what is built is in the state, 1 if some are, 2 if it can't be built, as text or JSON."""
    try:
        rows = build()
        bad = rows.filter(F.col("state") == state)
        some, more = shown(bad, limit)
    except Exception as e:  # the caller gets a status, not a trace
        text = f"{type(e).__name__}: {e}".split("\n")[0][:200]
        return 2, json.dumps({"status": 2, "error": text}) if form == "json" else f"error: {text}"
    status = int(bool(some))
    if form == "json":
        return status, json.dumps({"status": status, "rows": [r.asDict(True) for r in some], "omitted": more}, default=str)
    return status, "\n".join([", ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in some] + [f"{len(some) + more} {state}"])


def needs_review(
    ledger: DataFrame, metrics: DataFrame, today: str, days: int | None = None, least: int | None = None,
    growth: int | None = None, skipped: Iterable[str] = QUEUED
) -> DataFrame:
    """(path, last_reviewed, decision, current_loc, prior_loc, loc_delta, reasons) of entries to be looked at again, largest first.

    Bounds of the caller: ``days`` of age, ``least`` lines, ``growth`` in per cent since
    the review (only from a prior size that is known and not 0); bounds of the entry:
    after_days and after_loc_delta.  All are inclusive, and without a bound there is no
    trigger.  An entry never reviewed is a million days old, one with an unreadable date
    0; a file without metrics keeps its prior size.  Decisions in ``skipped`` wait already.
    """
    rows = ledger.filter(~F.coalesce(F.col("decision").isin(*skipped), F.lit(False)))
    rows = rows.join(metrics.select("path", F.col("loc").alias("__now")), "path", "left")
    prior = F.coalesce("loc", F.lit(0)).cast("long")
    rows = rows.withColumns({"prior_loc": prior, "current_loc": F.coalesce(F.col("__now").cast("long"), prior)})
    age, delta = calendar_days(F.col("last_reviewed"), F.to_date(F.lit(today))), F.col("current_loc") - F.col("prior_loc")
    percent = F.when(F.col("prior_loc") != 0, (delta / F.col("prior_loc") * 100).cast("int"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    bound = lambda n: F.lit(n).cast("int")
    fired = [
        F.when(age >= bound(days), text("age=", age, "d>=", bound(days), "d")),
        F.when(age >= F.col("after_days"), text("per-entry age=", age, "d>=", F.col("after_days"), "d")),
        F.when(F.col("current_loc") >= bound(least), text("loc=", F.col("current_loc"), ">=", bound(least))),
        F.when(delta >= F.col("after_loc_delta"), text("per-entry delta=", delta, ">=", F.col("after_loc_delta"))),
        F.when(percent >= bound(growth), text("growth=", percent, "%>=", bound(growth), "%")),
    ]
    rows = rows.withColumns({"loc_delta": delta, "reasons": F.array_compact(F.array(*fired))}).filter(F.size("reasons") > 0)
    return rows.select("path", "last_reviewed", "decision", "current_loc", "prior_loc", "loc_delta", "reasons").orderBy(F.desc("current_loc"), "path")


def drift_scan(metrics: DataFrame, ledger: DataFrame, least: int) -> DataFrame:
    """Files of ``least`` lines or more that the ledger doesn't know."""
    return metrics.filter(F.col("loc") >= least).join(ledger.select("path"), "path", "left_anti")


def friction(events: DataFrame, now: str, days: int = 14, vocabulary: tuple[str, ...] = ("allow", "ask", "deny")) -> DataFrame:
    """decision, n and rules within the horizon (inclusive), zero-filled to the vocabulary."""
    inside = events.filter(
        F.unix_timestamp(F.to_timestamp(F.lit(now))) - F.unix_timestamp(iso_timestamp(F.col("timestamp"))) <= days * 86400
    )
    counted = inside.groupBy("decision").agg(F.count("*").alias("n"), F.countDistinct("rule_id").alias("rules"))
    words = events.sparkSession.createDataFrame([(v,) for v in vocabulary], "decision string")
    return words.join(counted, "decision", "full_outer").na.fill(0, ["n", "rules"])


def coverage(items: DataFrame, refs: DataFrame) -> DataFrame:
    """Each spec item with its references and buckets, and orphan references as rows of bucket ``orphan``.

    Buckets may overlap: done without a reference is ``unproven``; referenced before it
    is done is ``ahead``, and if its status is partial ``partial`` too.
    """
    n = refs.groupBy("spec", "item").agg(F.count("*").alias("refs"), F.countDistinct("path").alias("files"))
    rows = items.join(n, ["spec", "item"], "full_outer").withColumn("refs", F.coalesce("refs", F.lit(0))).withColumn(
        "files", F.coalesce("files", F.lit(0))
    )
    done, some, there = F.col("status") == "done", F.col("refs") > 0, F.col("status").isNotNull()
    buckets = F.array(
        F.when(~there, "orphan"), F.when(done & ~some, "unproven"), F.when(done & some, "covered"), F.when(
            there & (F.col("status") == "partial"), "partial"
        ),
        F.when(there & ~done & some, "ahead"), F.when(there & ~done & ~some & (F.col("status") != "partial"), "open"),
    )
    return rows.select("spec", "item", "status", "refs", "files", F.filter(buckets, lambda b: b.isNotNull()).alias("buckets"))


def compliance(lines: DataFrame, good: str, bad: str) -> DataFrame:
    """Lines by path: compliant (they hold the text ``good``, whatever else), violating (the regex ``bad`` without it), pct."""
    ok = F.col("text").contains(good)
    n = lines.groupBy("path").agg(F.count_if(ok).alias("compliant"), F.count_if(~ok & F.col("text").rlike(bad)).alias("violating"))
    return n.withColumn("pct", percentage(F.col("compliant"), F.col("compliant") + F.col("violating")))
