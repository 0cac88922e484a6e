"""Project metadata: profiles, queue items, artifacts, exported commits and changes, XML projects, compilation databases."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.sources.sinks import shown

#: What a project file may hold; other elements are passed over.
PROJECT = "PropertyGroup array<struct<TargetFramework: string, TargetFrameworks: string, OutputType: string, Nullable: string>>, ItemGroup array<struct<PackageReference: array<struct<_Include: string, _Version: string>>, ProjectReference: array<struct<_Include: string>>>>"
#: The members of a compilation database's entry; others, or missing ones, make it malformed.
COMPILE_KEYS = ["arguments", "directory", "file"]


def profiles(docs: DataFrame) -> DataFrame:
    """(language, suffix) of JSON profiles (path, text) with an id and suffixes."""
    parsed = docs.select("path", F.from_json("text", "id string, suffixes array<string>", {"mode": "FAILFAST"}).alias("p"))
    return parsed.select(F.col("p.id").alias("language"), F.explode("p.suffixes").alias("suffix"))


def contested_suffixes(owned: DataFrame) -> DataFrame:
    """(suffix, languages) of suffixes that more than one language claims; loading is to be refused if there are any."""
    return owned.groupBy("suffix").agg(F.array_sort(F.collect_set("language")).alias("languages")).filter(F.size("languages") > 1)


def queue_items(files: DataFrame, entry: str) -> DataFrame:
    """One row for each (path, text): the fields of ``entry`` and ``status``; what can't be read stays, as ``unreadable``."""
    fields = entry if "status" in entry else entry + ", status string"
    rows = files.select(
        "path", F.from_json("text", fields).alias("item"), F.trim("text").startswith("{").alias("is_object"),
        F.try_parse_json("text").isNotNull().alias("is_json")
    )
    ok = F.coalesce(F.col("is_object") & F.col("is_json"), F.lit(False))
    names = [c for c in rows.schema["item"].dataType.names if c != "status"]
    return rows.select(
        "path", *[F.when(ok, F.col(f"item.{c}")).alias(c) for c in names],
        F.when(ok, F.coalesce("item.status", F.lit("unknown"))).otherwise("unreadable").alias("status")
    )


def artifacts(files: DataFrame, kinds: list[tuple[str, str]]) -> DataFrame:
    """(kind, path, summary): the first informative line of files whose path a kind's regex matches; one row for each kind."""
    lines = F.filter(
        F.transform(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n"), lambda x: F.trim(x)),
        lambda x: (x != "") & ~x.rlike(r"^(---|#!|<!--|```)")
    )
    hit = F.filter(F.array(*[F.when(F.col("path").rlike(p), k) for k, p in kinds]), lambda k: k.isNotNull())
    return files.select(
        F.explode(hit).alias("kind"), "path",
        F.regexp_replace(F.try_element_at(lines, F.lit(1)), r"^#+\s*", "").alias("summary")
    )


def last_commits(commits: DataFrame) -> DataFrame:
    """(path, last_commit) of exported commits (path, ts)."""
    return commits.groupBy("path").agg(F.max("ts").alias("last_commit"))


def changed_paths(*changes: DataFrame) -> DataFrame:
    """Distinct paths of several exported change tables (path, change_type) that still exist."""
    out = changes[0]
    for c in changes[1:]:
        out = out.unionByName(c)
    return out.filter("change_type <> 'deleted'").select("path").distinct()


def usage(events: DataFrame) -> DataFrame:
    """(run, usage, commands): the last usage record of each run and its commands in order.

    events: run, ordinal, kind (usage, command), value.
    """
    last = F.max_by(F.when(F.col("kind") == "usage", F.col("value")), F.when(F.col("kind") == "usage", F.col("ordinal")))
    commands = F.array_sort(F.collect_list(F.when(F.col("kind") == "command", F.struct("ordinal", "value"))))
    out = events.groupBy("run").agg(last.alias("usage"), commands.alias("commands"))
    return out.withColumn("commands", F.transform("commands", lambda c: c["value"]))


def select_corpus(manifest: DataFrame, names: list[str], slice_: str | None = None) -> DataFrame:
    """Manifest rows with one of the names (all if none is given) and of the slice; an unknown name is an error."""
    known = {r[0] for r in manifest.filter(F.col("name").isin(names)).select("name").distinct().collect()} if names else set()
    if missing := sorted(set(names) - known):
        raise ValueError(f"unknown names: {', '.join(missing)}")
    out = manifest.filter(F.col("name").isin(names)) if names else manifest
    return out if slice_ is None else out.filter(F.col("slice") == slice_)


def xml_projects(files: DataFrame) -> DataFrame:
    """(path, frameworks, packages, references, readable) of XML project files (path, text); unreadable ones stay, with empty lists."""
    rows = files.select("path", F.from_xml("text", PROJECT, {"rowTag": "Project", "mode": "PERMISSIVE"}).alias("p"))
    empty = F.array().cast("array<string>")
    flat = lambda c: F.coalesce(F.filter(c, lambda x: x.isNotNull() & (x != "")), empty)
    targets = F.flatten(F.transform(F.coalesce("p.PropertyGroup", F.array()), lambda g: F.split(F.coalesce(g["TargetFrameworks"], g["TargetFramework"], F.lit("")), ";")))
    items = F.coalesce("p.ItemGroup", F.array())
    packages = F.flatten(F.filter(F.transform(items, lambda g: F.transform(g["PackageReference"], lambda r: F.concat_ws("@", r["_Include"], r["_Version"]))), lambda x: x.isNotNull()))
    references = F.flatten(
        F.filter(F.transform(items, lambda g: F.transform(g["ProjectReference"], lambda r: r["_Include"])), lambda x: x.isNotNull())
    )
    readable = F.col("p.PropertyGroup").isNotNull() | F.col("p.ItemGroup").isNotNull()
    return rows.select(
        "path", flat(targets).alias("frameworks"), flat(packages).alias("packages"),
        flat(references).alias("references"), readable.alias("readable")
    )


def compile_databases(databases: DataFrame, expected: DataFrame, inputs: DataFrame, standard: str = "c++20") -> DataFrame:
    """(root, state) of each root: missing, malformed, mismatched-directory, wrong-language, wrong-mode, incomplete, stale or valid.

    databases: root, text, modified_at (null text: missing); expected: root, file;
    inputs: root, modified_at.  The first entry with a fault names it.
    """
    entry = "array<map<string, string>>"
    parsed = databases.select("root", "text", "modified_at", F.from_json("text", entry).alias("rows"))
    e = parsed.select("root", F.posexplode("rows").alias("at", "e"))
    e = e.withColumn("args", F.from_json(F.col("e")["arguments"], "array<string>"))
    file, args = F.col("e")["file"], F.col("args")
    shape = F.array_sort(F.map_keys("e")) == F.array(*map(F.lit, COMPILE_KEYS))
    given = F.filter(args, lambda a: a.startswith("-std="))
    fault = (
        F.when(F.coalesce(~shape, F.lit(True)), "malformed")
        .when(F.col("e")["directory"] != F.col("root"), "mismatched-directory")
        .when(~file.startswith("/") | args.isNull() | F.exists(args, lambda a: a.isNull() | (a == "")), "malformed")
        .when(~file.rlike(r"\.(cc|cpp|cxx)$"), "wrong-language")
        .when(
            (F.size(given) == 0) | (F.try_element_at(given, F.lit(-1)) != "-std=" + standard) | ~F.array_contains(args, "-c"),
            "wrong-mode"
        )
        .when(~F.array_contains(args, file), "malformed")
    )
    judged = e.select("root", "at", file.alias("file"), fault.alias("fault"))
    first = judged.groupBy("root").agg(F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("at"))).alias("fault"))
    a, b = judged.select("root", "file").distinct().withColumn("there", F.lit(1)), expected.select("root", "file").distinct().withColumn(
        "wanted", F.lit(1)
    )
    differ = a.join(b, ["root", "file"], "full_outer").filter("there IS NULL OR wanted IS NULL").select(
        "root", F.lit(True).alias("differs")
    ).distinct()
    newest = inputs.groupBy("root").agg(F.max("modified_at").alias("newest"))
    rows = parsed.join(first, "root", "left").join(differ, "root", "left").join(newest, "root", "left")
    state = (
        F.when(F.col("text").isNull(), "missing")
        .when(F.col("rows").isNull(), "malformed")
        .when(F.col("fault").isNotNull(), F.col("fault"))
        .when(F.col("differs"), "incomplete")
        .when(F.col("newest").isNull(), "malformed")
        .when(F.col("modified_at") < F.col("newest"), "stale")
        .otherwise("valid")
    )
    return rows.select("root", state.alias("state"))


#: A build's evidence: what was built, by which tools and commands, from and into which files, and how its checks ended.
EVIDENCE = (
    "schema_version int, status string, project_root string, target string, tools map<string, string>, "
    "inputs array<struct<path: string, role: string, sha256: string>>, commands array<array<string>>, "
    "outputs array<struct<path: string, sha256: string>>, checks map<string, struct<returncode: int, stdout: string, stderr: string>>"
)
EVIDENCE_KEYS = ["checks", "commands", "inputs", "outputs", "project_root", "schema_version", "status", "target", "tools"]


def build_evidence(evidence: DataFrame, expected: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(root, state) of each root's build evidence, the first fault of: missing, malformed, mismatched-root, tool-mismatch, incomplete, stale,
    wrong-command, missing-output, output-mismatch, native-check-failure; else valid.

    evidence: root, text (null: missing); expected: root, version, target, tools (map), commands (arrays), smoke;
    inputs: root, path, role, sha256 (now; null: no such file); outputs: root, path, sha256 (now; null: no such file).
    """
    rows = evidence.select("root", "text", F.from_json("text", EVIDENCE).alias("e"), F.array_sort(F.json_object_keys("text")).alias("keys"))
    digest = lambda x: x["sha256"].rlike("^[0-9a-f]{64}$")
    safe = lambda x: x["path"].isNotNull() & ~x["path"].rlike(r"^/|(?:^|/)\.\.(?:/|$)|\\\\")
    one = lambda a: F.size(F.array_distinct(F.transform(a, lambda x: x["path"]))) == F.size(a)
    good_in = F.forall(
        "e.inputs",
        lambda x: F.coalesce(safe(x) & digest(x) & x["role"].isin("source", "test") & x["path"].endswith(".kt"), F.lit(False))
    )
    good_out = F.forall("e.outputs", lambda x: F.coalesce(safe(x) & digest(x), F.lit(False)))
    checks = F.forall(F.map_values("e.checks"), lambda x: x["returncode"].isNotNull() & x["stdout"].isNotNull() & x["stderr"].isNotNull())
    names = F.array_sort(F.map_keys("e.checks")) == F.array(F.lit("smoke"), F.lit("test"))
    shape = (
        F.col("keys") == F.array(*map(F.lit, EVIDENCE_KEYS))
    ) & good_in & one(F.col("e.inputs")) & good_out & one(F.col("e.outputs")) & checks & names

    def compared(table: DataFrame, column: str, key: list[str]) -> DataFrame:
        """(root, differs, gone, changed) of the files that are named against those that are wanted."""
        told = rows.select("root", F.explode(f"e.{column}").alias("x")).select(
            "root", *[F.col(f"x.{k}") for k in key], F.col("x.sha256").alias("told"), F.lit(True).alias("there")
        )
        both = told.join(table.select("root", *key, "sha256", F.lit(True).alias("wanted")), ["root", *key], "full_outer")
        return both.groupBy("root").agg(
            F.bool_or(F.col("there").isNull() | F.col("wanted").isNull()).alias(f"{column}_differ"),
            F.bool_or(F.col("wanted") & F.col("sha256").isNull()).alias(f"{column}_gone"),
            F.bool_or(F.col("sha256") != F.col("told")).alias(f"{column}_changed"),
        )

    rows = rows.join(expected, "root", "left").join(
        compared(inputs, "inputs", ["path", "role"]), "root", "left"
    ).join(compared(outputs, "outputs", ["path"]), "root", "left")
    same = lambda a, b: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(a)))) == F.to_json(F.map_from_entries(F.array_sort(F.map_entries(b))))
    holds = lambda x: F.coalesce(x, F.lit(False))
    state = (
        F.when(F.col("text").isNull(), "missing")
        .when(~holds(shape), "malformed")
        .when(
            ~holds(
                (F.col("e.schema_version") == F.col("version")) & (F.col("e.status") == "complete")
                & (F.col("e.target") == F.col("target"))
            ),
            "malformed"
        )
        .when(~holds(F.col("e.project_root") == F.col("root")), "mismatched-root")
        .when(~holds(same(F.col("e.tools"), F.col("tools"))), "tool-mismatch")
        .when(holds(F.col("inputs_differ")), "incomplete")
        .when(holds(F.col("inputs_gone")), "malformed")
        .when(holds(F.col("inputs_changed")), "stale")
        .when(~holds(F.col("e.commands") == F.col("commands")), "wrong-command")
        .when(holds(F.col("outputs_differ")), "incomplete")
        .when(holds(F.col("outputs_gone")), "missing-output")
        .when(holds(F.col("outputs_changed")), "output-mismatch")
        .when(F.exists(F.map_values("e.checks"), lambda x: x["returncode"] != 0), "native-check-failure")
        .when(~holds(F.col("e.checks")["smoke"]["stdout"] == F.col("smoke")), "native-check-failure")
        .otherwise("valid")
    )
    return rows.select("root", state.alias("state"))


def json_projects(files: DataFrame) -> DataFrame:
    """(path, name, packages, scripts, readable) of JSON project files (path, text), packages as ``name@range`` of all kinds; unreadable ones stay."""
    kinds = ["dependencies", "devDependencies", "peerDependencies"]
    fields = "name string, " + ", ".join(f"{k} map<string, string>" for k in kinds) + ", scripts map<string, string>"
    rows = files.select(
        "path", F.from_json("text", fields).alias("p"),
        (F.trim("text").startswith("{") & F.try_parse_json("text").isNotNull()).alias("ok")
    )
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    listed = [
        F.transform(F.map_entries(F.coalesce(F.col(f"p.{k}"), none)), lambda e: F.concat_ws("@", e["key"], e["value"]))
        for k in kinds
    ]
    ok = F.coalesce("ok", F.lit(False))
    packages = F.when(ok, F.array_sort(F.array_distinct(F.concat(*listed)))).otherwise(F.array().cast("array<string>"))
    scripts = F.when(ok, F.array_sort(F.map_keys(F.coalesce("p.scripts", none)))).otherwise(F.array().cast("array<string>"))
    return rows.select(
        "path", F.when(ok, F.col("p.name")).alias("name"), packages.alias("packages"), scripts.alias("scripts"),
        ok.alias("readable")
    )


def changed_in_range(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """Distinct paths that a ref range has changed and that its last change has left in place.

    commits: id, ordinal, the exported commits of the range from the oldest; changes: id, path, change_type.
    """
    rows = changes.join(commits.select("id", "ordinal"), "id")
    last = rows.groupBy("path").agg(F.max_by("change_type", "ordinal").alias("change_type"))
    return last.filter("change_type <> 'deleted'").select("path")


def attestation(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts only, nothing of the rows themselves."""
    return rows.groupBy(*by).agg(F.count("*").alias("rows"))


def attestation_yaml(counts: DataFrame, title: str, limit: int = 1000) -> str:
    """``attestation`` as YAML, keys in order; what is beyond ``limit`` rows is counted in ``omitted``."""
    some, more = shown(counts.orderBy(*counts.columns[:-1]), limit)
    quoted = lambda v: "null" if v is None else v if isinstance(v, int) else json.dumps(str(v), ensure_ascii=False)
    lines = [f"{title}:"] + [f"  {'- ' if not i else '  '}{c}: {quoted(r[c])}" for r in some for i, c in enumerate(counts.columns)]
    return "\n".join((lines if some else [f"{title}: []"]) + [f"omitted: {more}"]) + "\n"


def html_table(rows: DataFrame, title: str, limit: int = 1000) -> str:
    """A dashboard table of a report, escaped; what is beyond ``limit`` rows is counted below it."""
    cell = lambda v: "" if v is None else html.escape(str(v))
    some, more = shown(rows, limit)
    head = "".join(f"<th>{cell(c)}</th>" for c in rows.columns)
    body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in some)
    rest = f"<p>{more} more rows.</p>" if more else ""
    return f"<section><h2>{cell(title)}</h2><table><tr>{head}</tr>{body}</table>{rest}</section>"


def write_scope(spark: SparkSession, path: str, scope: list[str], written_at: str) -> None:
    """A sidecar of the folders that an artifact was made from, beside it."""
    spark.createDataFrame(
        [(scope, written_at)], "scope array<string>, written_at string"
    ).coalesce(1).write.mode("overwrite").json(f"{path}.scope")


def read_scope(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("scope array<string>, written_at string").json(f"{path}.scope")
