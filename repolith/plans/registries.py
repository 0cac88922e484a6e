"""Checks of registries against each other and against files."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repolith.functions.scalars import ancestors
from repolith.operators.relational import owner, reasons


def dispositions(candidates: DataFrame, registry: DataFrame, exemptions: DataFrame) -> DataFrame:
    """path, owner (all winners) and registered, ambiguous, exempt, partial or uncovered for each candidate path.

    A folder that no prefix holds but that holds a registered prefix is ``partial``.
    """
    rows = owner(candidates, registry, ties="all").join(exemptions.select("path", F.lit(True).alias("exempt")).distinct(), "path", "left")
    above = registry.select(F.explode(ancestors(F.col("prefix"))).alias("path")).distinct().withColumn("above", F.lit(True))
    rows = rows.join(above, "path", "left")
    state = F.when(F.size("owner") > 1, "ambiguous").when(
        F.size("owner") == 1, "registered"
    ).when(F.col("exempt"), "exempt").when(F.col("above"), "partial").otherwise("uncovered")
    return rows.select("path", "owner", state.alias("state"))


def stale_exemptions(exemptions: DataFrame, candidates: DataFrame) -> DataFrame:
    return exemptions.join(candidates, "path", "left_anti")


def decision_drift(
    decisions: DataFrame, today: str, known: tuple[str, ...] = ("proposed", "accepted", "superseded", "rejected"),
    days: int = 30
) -> DataFrame:
    """(id, message): bad status, malformed date, proposed for over ``days`` without a revisit, accepted without embodiment, unknown or one-sided supersession."""
    day = F.try_to_timestamp("date", F.lit("yyyy-MM-dd"))
    why = reasons([
        ("bad status", ~F.col("status").isin(*known)),
        ("malformed date", F.col("date").isNotNull() & day.isNull()),
        (
            "proposed too long",
            (F.col("status") == "proposed") & (F.datediff(F.to_date(F.lit(today)), day) > days) & F.col("revisit").isNull()
        ),
        ("accepted without embodiment", (F.col("status") == "accepted") & (F.coalesce(F.size("embodied_by"), F.lit(0)) <= 0)),
    ])
    own = decisions.select("id", F.explode(why).alias("message"))
    links = decisions.select("id", F.explode("supersedes").alias("other"))
    known_ids = decisions.select(F.col("id").alias("other"), F.col("superseded_by").alias("back"))
    broken = links.join(known_ids, "other", "left_anti").select("id", F.concat(F.lit("supersedes unknown "), "other").alias("message"))
    sided = links.join(known_ids, "other").filter(~F.col("back").eqNullSafe(F.col("id"))).select(
        "id", F.concat(F.lit("not superseded back by "), "other").alias("message")
    )
    return own.union(broken).union(sided)


def broken_links(plans: DataFrame, specs: DataFrame, decisions: DataFrame) -> DataFrame:
    """(id, message) of plans that name an unknown spec, and specs that name an unknown decision.

    plans: id, specs; specs: id, decisions; decisions: id.
    """
    def missing(rows, column, known, kind):
        links = rows.select("id", F.explode(column).alias("other"))
        return links.join(
            known.select(F.col("id").alias("other")).distinct(), "other", "left_anti"
        ).select("id", F.concat(F.lit(f"unknown {kind} "), "other").alias("message"))

    return missing(plans, "specs", specs, "spec").union(missing(specs, "decisions", decisions, "decision"))


def freshness(artifacts: DataFrame, commits: DataFrame) -> DataFrame:
    """artifact and stale: whether a commit below one of its scope folders is later than written_at; no commit is fresh."""
    scope = artifacts.select("artifact", "written_at", F.explode("scope").alias("folder"))
    parents = commits.select(
        "ts",
        F.explode(
            F.expr("transform(sequence(1, size(split(path, '/'))), n -> array_join(slice(split(path, '/'), 1, n), '/'))")
        ).alias("folder")
    )
    newest = scope.join(
        parents.groupBy("folder").agg(F.max("ts").alias("ts")), "folder", "left"
    ).groupBy("artifact").agg(F.max("ts").alias("ts"), F.max("written_at").alias("written_at"))
    return newest.select("artifact", F.coalesce(F.col("ts") > F.col("written_at"), F.lit(False)).alias("stale"))


def reviewed(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Findings with hidden, resurfaced (evidence or detector version has changed), regression (it was fixed) or new.

    findings: subject, fingerprint, and version if known; decisions: subject, fingerprint,
    disposition, recorded_at, ordinal (the latest of a subject counts), and version if
    known.  It fails open: a decision without a fingerprint or of an unknown disposition hides nothing.
    """
    none = F.lit(None).cast("string")
    findings = findings if "version" in findings.columns else findings.withColumn("version", none)
    decisions = decisions if "version" in decisions.columns else decisions.withColumn("version", none)
    last = Window.partitionBy("subject").orderBy(F.desc("recorded_at"), F.desc("ordinal"))
    d = decisions.withColumn("nth", F.row_number().over(last)).filter("nth = 1").select(
        "subject", F.col("fingerprint").alias("seen"), "disposition", F.col("version").alias("seen_version")
    )
    same = F.col("seen").isNotNull() & (F.col("seen") == F.col("fingerprint")) & F.col("seen_version").eqNullSafe(F.col("version"))
    hides = F.col("disposition").isin("dismissed", "accepted", "false_positive")
    state = F.when(F.col("disposition").isNull(), "new").when(F.col("disposition") == "fixed", "regression").when(
        hides & F.coalesce(same, F.lit(False)), "hidden"
    ).otherwise("resurfaced")
    return findings.join(d, "subject", "left").select("subject", "fingerprint", state.alias("state"))


def perimeter(files: DataFrame, coverage: DataFrame, accepted: DataFrame, least: int) -> DataFrame:
    """root, language, loc, files, covered_by and state of each cell; coverage for the language ``any`` never covers."""
    cells = files.groupBy("root", "language").agg(F.sum("loc").alias("loc"), F.count("*").alias("files"))
    by = coverage.filter("language <> 'any'").groupBy("language").agg(F.array_sort(F.collect_set("detector")).alias("covered_by"))
    rows = cells.join(by, "language", "left").join(
        accepted.select("root", "language", F.lit(True).alias("ok")), ["root", "language"], "left"
    )
    state = F.when(
        F.col("covered_by").isNotNull(), "covered"
    ).when(F.col("ok"), "accepted").when(F.col("loc") >= least, "gap").otherwise("small")
    return rows.select(
        "root", "language", "loc", "files",
        F.coalesce("covered_by", F.array().cast("array<string>")).alias("covered_by"), state.alias("state")
    )


def ratchet(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """id, allowed (the tightened baseline) and state: new and grown metrics fail, others hold."""
    rows = now.select("id", F.col("metric").alias("n")).join(baseline.select("id", F.col("metric").alias("b")), "id", "full_outer")
    state = F.when(F.col("b").isNull(), "new").when(F.col("n") > F.col("b"), "grown").when(F.col("n").isNull(), "gone").otherwise("held")
    return rows.select("id", F.least("n", "b").alias("allowed"), state.alias("state"))


def tokens_present(required: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """token and ok, missing_token or missing_file."""
    rows = required.join(manifest.select("token", "path"), "token", "left").join(
        files.select("path", F.lit(True).alias("there")).distinct(), "path", "left"
    )
    return rows.select(
        "token",
        F.when(F.col("path").isNull(), "missing_token").when(F.col("there").isNull(), "missing_file").otherwise("ok").alias("state")
    )


def clone_clusters(pairs: DataFrame) -> DataFrame:
    """(member, cluster, multiplicity) of clone pairs a, b: least member reachable, by label steps until nothing changes.

    Each round is checkpointed reliably; labels also jump to their own label, so rounds grow with the logarithm of a chain.
    """
    context = pairs.sparkSession.sparkContext
    if context.getCheckpointDir() is None:  # only where spark.checkpoint.dir is unset and all runs on one machine, as in tests
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp())
    edges = pairs.select("a", "b").union(pairs.select("b", "a")).distinct()
    label = edges.select(F.col("a").alias("member")).distinct().withColumn("cluster", F.col("member"))
    while True:
        near = edges.join(
            label.withColumnRenamed("member", "b"), "b"
        ).groupBy(F.col("a").alias("member")).agg(F.min("cluster").alias("least"))
        step = label.join(near, "member").select("member", F.least("cluster", "least").alias("cluster"), F.col("cluster").alias("was"))
        hop = step.select(F.col("member").alias("cluster"), F.col("cluster").alias("further"))
        step = step.join(hop, "cluster").select("member", "was", "further").checkpoint()
        label = step.select("member", F.col("further").alias("cluster"))
        if not step.filter("further <> was").limit(1).count():
            break
    return label.join(label.groupBy("cluster").agg(F.count("*").alias("multiplicity")), "cluster").select("member", "cluster", "multiplicity")
