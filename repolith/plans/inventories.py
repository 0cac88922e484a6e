"""Two-sided checks: what is declared against what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.operators.relational import small


def symbol_differences(code: DataFrame, spec: DataFrame, stale_if: Column | None = None) -> DataFrame:
    """(name, state): ``missing`` in the specs or ``stale`` there, of the code's and the specs' names; ``stale_if`` limits which can be stale."""
    a, b = code.select("name").distinct(), spec.select("name").distinct()
    gone = b.join(a, "name", "left_anti")
    gone = gone if stale_if is None else gone.filter(stale_if)
    return a.join(b, "name", "left_anti").withColumn("state", F.lit("missing")).union(gone.withColumn("state", F.lit("stale")))


def inbound(files: DataFrame, edges: DataFrame, available: DataFrame) -> DataFrame:
    """(path, used_by, inbound_paths): distinct importers of each file but itself; null, not 0, for languages whose imports aren't known.

    files: path, language; edges: importer, target (a path, or a folder whose files are all meant); available: language.
    """
    folder = F.regexp_replace("path", r"/[^/]+$", "")
    e = edges.select("importer", "target").distinct()
    direct = e.join(files.select(F.col("path").alias("target")), "target").select(F.col("target").alias("path"), "importer")
    fanned = e.join(files.filter(F.col("path").contains("/")).select("path", folder.alias("target")), "target").select("path", "importer")
    n = direct.union(fanned).filter("path <> importer").groupBy("path").agg(F.array_sort(F.collect_set("importer")).alias("inbound_paths"))
    known = available.select("language", F.lit(True).alias("known")).distinct()
    rows = files.select("path", "language").join(known, "language", "left").join(n, "path", "left")
    held = F.when(F.col("known"), F.coalesce("inbound_paths", F.array().cast("array<string>")))
    return rows.select("path", F.when(F.col("known"), F.size(held)).alias("used_by"), held.alias("inbound_paths"))


def import_map(edges: DataFrame, subsystems: DataFrame) -> DataFrame:
    """(subsystem, inside, inbound, outbound, barrel) counts of import edges, and whether others come in by one file only.

    edges: importer, imported; subsystems: path, subsystem.
    """
    a = subsystems.select(F.col("path").alias("importer"), F.col("subsystem").alias("a"))
    b = subsystems.select(F.col("path").alias("imported"), F.col("subsystem").alias("b"))
    rows = edges.select("importer", "imported").distinct().join(a, "importer", "left").join(b, "imported", "left")
    same = F.col("a") == F.col("b")
    end = lambda sub, how, door=None: F.struct(sub.alias("subsystem"), F.lit(how).alias("how"), (F.lit(None).cast("string") if door is None else door).alias("door"))
    across = ~F.coalesce(same, F.lit(False))
    ends = F.array(
        F.when(same, end(F.col("a"), "inside")), F.when(across, end(F.col("b"), "inbound", F.col("imported"))),
        F.when(across, end(F.col("a"), "outbound"))
    )
    flat = rows.select(F.explode(F.filter(ends, lambda x: x.isNotNull())).alias("x")).select("x.*").filter("subsystem IS NOT NULL")
    kinds = [F.count_if(F.col("how") == k).alias(k) for k in ("inside", "inbound", "outbound")]
    return flat.groupBy("subsystem").agg(*kinds, (F.countDistinct("door") == 1).alias("barrel"))


def legacy_references(files: DataFrame, references: DataFrame) -> DataFrame:
    """(path, reference, allowed): files whose text holds a reference, allowed below one of its ``allowed`` prefixes.

    references: reference, allowed (array); a small table whose size is checked.
    """
    hits = files.join(small(references), F.col("text").contains(F.col("reference")))
    return hits.select("path", "reference", F.exists("allowed", lambda p: F.col("path").startswith(p)).alias("allowed"))


def producers(declared: DataFrame, produced: DataFrame) -> DataFrame:
    """(name, state): unproduced, undeclared, duplicate (declared twice) or out_of_order (declared after a larger name); names without a fault give no row.

    declared: name, ordinal; produced: name.
    """
    from pyspark.sql import Window

    both = declared.groupBy("name").agg(F.count("*").alias("n"), F.min("ordinal").alias("at")).join(
        produced.select("name", F.lit(True).alias("made")).distinct(), "name", "full_outer"
    )
    larger = declared.withColumn("before", F.max("name").over(Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)))  # one short list
    late = larger.filter("before > name").select("name", F.lit(True).alias("late")).distinct()
    rows = both.join(late, "name", "left")
    faults = F.array(
        F.when(F.col("n").isNull(), "undeclared"), F.when(
            F.col("made").isNull(), "unproduced"
        ), F.when(F.col("n") > 1, "duplicate"), F.when(F.col("late"), "out_of_order")
    )
    return rows.select("name", F.explode(F.filter(faults, lambda f: f.isNotNull())).alias("state"))


def closed_domain(domain: DataFrame, dispositions: DataFrame, ledger: DataFrame, files: DataFrame) -> DataFrame:
    """(surface, fault): every surface must have exactly one disposition, a deferred one an id of the ledger, evidence a path that exists.

    domain: surface; dispositions: surface, state, deferred_id, evidence; ledger: id; files: path.
    """
    n = dispositions.groupBy("surface").agg(F.count("*").alias("n"))
    counted = domain.select("surface", F.lit(True).alias("wanted")).distinct().join(n, "surface", "full_outer")
    fault = F.when(F.col("wanted").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    out = counted.select("surface", fault.alias("fault")).filter("fault IS NOT NULL")
    deferred = dispositions.filter("state = 'deferred'").select("surface", F.col("deferred_id").alias("id"))
    out = out.union(deferred.join(ledger.select("id").distinct(), "id", "left_anti").select("surface", F.lit("unknown_id").alias("fault")))
    evidence = dispositions.filter("evidence IS NOT NULL").select("surface", F.col("evidence").alias("path"))
    return out.union(
        evidence.join(files.select("path").distinct(), "path", "left_anti").select("surface", F.lit("no_evidence").alias("fault"))
    )


def stray_hits(hits: DataFrame, allowed: DataFrame, include: str, exclude: str | None = None) -> DataFrame:
    """Distinct hit files that aren't allowed, within the scope of the regexes."""
    rows = hits.filter(F.col("path").rlike(include)).select("path").distinct()
    rows = rows.filter(~F.col("path").rlike(exclude)) if exclude else rows
    return rows.join(allowed.select("path").distinct(), "path", "left_anti")


def recalled(planted: DataFrame, hits: DataFrame) -> DataFrame:
    """(path, hits, recalled) of every planted file: each must have a hit."""
    n = hits.groupBy("path").agg(F.count("*").alias("n"))
    rows = planted.select("path").distinct().join(n, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("hits"))
    return rows.withColumn("recalled", F.col("hits") > 0)


def reverse_index(refs: DataFrame) -> DataFrame:
    """(path, covered_by, ids): the specs that cover a file and the items that name it; refs: spec, item, path."""
    item = F.concat_ws("#", "spec", "item")
    return refs.groupBy("path").agg(F.array_sort(F.collect_set("spec")).alias("covered_by"), F.array_sort(F.collect_set(item)).alias("ids"))


def section_counts(items: DataFrame, sections: list[str]) -> DataFrame:
    """Items of each spec by section, zero-filled."""
    return items.groupBy("spec").pivot("section", sections).agg(F.count(F.lit(1))).na.fill(0)


def caller_info(refs: DataFrame, defined: DataFrame) -> DataFrame:
    """(name, total_refs, ref_files, categorized) of each definition, its own file left out; 0 and empty where nothing refers to it.

    refs: name, path, category; defined: name, path.
    """
    own = defined.select("name", "path").distinct()
    n = refs.join(own, ["name", "path"], "left_anti").groupBy("name", "category", "path").count()
    by = n.groupBy("name", "category").agg(F.sum("count").alias("n"), F.collect_set("path").alias("paths"))
    rows = by.groupBy("name").agg(
        F.sum("n").alias("total_refs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("paths")))).alias("ref_files"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("categorized"),
    )
    empty, none = F.array().cast("array<string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    out = own.select("name").distinct().join(rows, "name", "left")
    return out.select(
        "name", F.coalesce("total_refs", F.lit(0)).alias("total_refs"),
        F.coalesce("ref_files", empty).alias("ref_files"), F.coalesce("categorized", none).alias("categorized")
    )
