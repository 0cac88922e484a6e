"""Registries of Markdown documents, typed record logs, clone reports and pinned corpora."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.sources.logs import read_jsonl

HEAD = re.compile(r"\A---\n(.*?)\n---[ \t]*(?:\n|\Z)", re.S)


def scalar(text: str):
    """The value of a plain YAML scalar or flow list."""
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        return [scalar(x) for x in re.findall(r"\"[^\"]*\"|'[^']*'|[^,\s][^,]*", text[1:-1])]
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    text = re.split(r"\s+#", text)[0].strip()
    if text in ("", "~", "null"):
        return None
    if text in ("true", "false"):
        return text == "true"
    return int(text) if re.fullmatch(r"-?\d{1,18}", text) else text


def block(lines: list[tuple[int, str]], at: int, indent: int):
    """The mapping or list that begins at a line, and the line after it."""
    listed = lines[at][1].startswith("- ") or lines[at][1] == "-"
    out: list | dict = [] if listed else {}
    while at < len(lines) and lines[at][0] == indent and (lines[at][1].startswith("- ") or lines[at][1] == "-") == listed:
        text = lines[at][1]
        if listed:
            rest = text[1:].strip()
            if re.match(r"[\w-]+:(\s|$)", rest):  # a mapping that begins on the dash's line
                lines[at] = (indent + 2, rest)
                value, at = block(lines, at, indent + 2)
            else:
                value, at = below(lines, at, indent, rest)
            out.append(value)
            continue
        m = re.match(r"([^:]+):(?:\s+(.*))?$", text)
        if not m:
            raise ValueError(f"no mapping: {text}")
        value, at = below(lines, at, indent, m[2] or "")
        out[m[1].strip()] = value
    return out, at


def below(lines: list[tuple[int, str]], at: int, indent: int, rest: str):
    """A value on its line, folded or literal text, or the block further in."""
    at += 1
    if rest in ("|", ">", "|-", ">-"):
        held = []
        while at < len(lines) and lines[at][0] > indent:
            held.append(lines[at][1])
            at += 1
        return ("\n" if rest[0] == "|" else " ").join(held), at
    if rest:
        return scalar(rest), at
    further = at < len(lines) and (
        lines[at][0] > indent or (lines[at][0] == indent and lines[at][1].startswith("- ") and not lines[at - 1][1].startswith("- "))
    )
    return block(lines, at, lines[at][0]) if further else (None, at)


def parse_front_matter(text: str) -> tuple[dict, str, bool]:
    """Metadata (nested mappings, lists and scalars), body, and whether there was front matter; unreadable metadata raises ValueError."""
    text = re.sub(r"\r\n?", "\n", text.removeprefix("﻿"))
    m = HEAD.match(text)
    if not m:
        return {}, text, False
    lines = [(len(x) - len(x.lstrip(" ")), x.strip()) for x in m[1].split("\n") if x.strip() and not x.strip().startswith("#")]
    if not lines:
        return {}, text[m.end() :], True
    found, at = block(lines, 0, lines[0][0])
    if at < len(lines) or not isinstance(found, dict):
        raise ValueError("metadata can't be read")
    return found, text[m.end() :], True


def documents(files: DataFrame) -> DataFrame:
    """(path, metadata as JSON, body, has_frontmatter, error) of (path, text); what can't be read stays, with its error."""

    def run(batches):
        for b in batches:
            rows = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    meta, body, there = parse_front_matter(text or "")
                    rows.append((path, json.dumps(meta, ensure_ascii=False), body, there, None))
                except (ValueError, IndexError, RecursionError) as e:
                    rows.append((path, None, text, False, str(e) or type(e).__name__))
            cols = list(zip(*rows)) or [[]] * 5
            kinds = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds)],
                names=["path", "metadata", "body", "has_frontmatter", "error"]
            )

    return files.select("path", "text").mapInArrow(run, "path string, metadata string, body string, has_frontmatter boolean, error string")


def registry(files: DataFrame, schema: str) -> DataFrame:
    """(path, fields of ``schema``, body) of a registry's documents; those without front matter or unreadable are passed over.

    Use it for decisions, plans, specs, precedents and subsystems with their own fields.
    """
    rows = documents(files).filter("has_frontmatter").withColumn("__m", F.from_json("metadata", schema))
    return rows.select("path", "__m.*", "body")


def catalog(files: DataFrame, fields: list[str]) -> DataFrame:
    """(path, one text for each field) of every document; any that can't be read fails the load, with up to ten of them named."""
    rows = documents(files)
    bad = [r[0] for r in rows.filter("error IS NOT NULL OR NOT has_frontmatter").select("path").orderBy("path").limit(10).collect()]
    if bad:
        raise ValueError("unreadable: " + ", ".join(bad))
    return rows.select("path", *[F.get_json_object("metadata", f"$.{f}").alias(f) for f in fields])


def records(rows: DataFrame, schemas: dict[str, str], raw: str = "raw") -> dict[str, DataFrame]:
    """One relation for each ``type`` of the JSON records in column ``raw``, with its own schema; records of other types are passed over."""
    kind = F.get_json_object(raw, "$.type")
    rest = [c for c in rows.columns if c != raw]
    return {k: rows.filter(kind == k).select(*rest, F.from_json(raw, s).alias("__r")).select(*rest, "__r.*") for k, s in schemas.items()}


def read_records(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """``records`` of JSON-lines files, bad lines left out."""
    return records(read_jsonl(spark, path, "type string").filter("NOT bad").select("source_file", "ordinal", "raw"), schemas)


#: What a clone finder reports of a pair.
CLONES = "duplicates array<struct<format: string, lines: int, firstFile: struct<name: string, start: int, end: int>, secondFile: struct<name: string, start: int, end: int>>>"


def clone_report(files: DataFrame) -> DataFrame:
    """(format, lines, first, second) of the reports (path, text) of a clone finder, ends as structs of name, start and end; a pair's smaller end comes first."""
    pairs = files.select(F.explode(F.from_json("text", CLONES)["duplicates"]).alias("d")).select("d.*")
    a, b = F.col("firstFile"), F.col("secondFile")
    return pairs.select("format", "lines", F.least(a, b).alias("first"), F.greatest(a, b).alias("second"))


def clone_edges(report: DataFrame) -> DataFrame:
    """(a, b): the ends of clone pairs as ``name:start-end``, for ``registries.clone_clusters``."""
    end = lambda c: F.concat(F.col(f"{c}.name"), F.lit(":"), F.col(f"{c}.start"), F.lit("-"), F.col(f"{c}.end"))
    return report.select(end("first").alias("a"), end("second").alias("b"))


def corpus_faults(manifest: DataFrame, languages: list[str]) -> DataFrame:
    """(name, fault) of a pinned corpus: repeated name, revision that is no full commit id, source without https, unknown language, slice below 1."""
    n = manifest.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").select("name", F.lit("repeated").alias("fault"))
    faults = F.array(
        F.when(~F.coalesce(F.col("revision").rlike("^[0-9a-f]{40}$"), F.lit(False)), "revision"),
        F.when(~F.coalesce(F.col("source").startswith("https://"), F.lit(False)), "source"),
        F.when(~F.coalesce(F.col("language").isin(languages), F.lit(False)), "language"),
        F.when(F.coalesce(F.col("slice"), F.lit(0)) < 1, "slice"),
    )
    return n.union(manifest.select("name", F.explode(F.filter(faults, lambda f: f.isNotNull())).alias("fault")))


def search_roots(files: DataFrame, roots: list[str], suffixes: list[str], skipped: list[str]) -> DataFrame:
    """(path, root): files of the suffixes that are a root or below one, by the first root given that holds them; equal roots count once.

    Roots that leave their base (``..``) are an error; folders named in ``skipped`` or that begin with a dot are passed over.
    """
    clean = list(dict.fromkeys(r.strip("/").removeprefix("./") for r in roots))
    if bad := [r for r in clean if ".." in r.split("/")]:
        raise ValueError("outside the base: " + ", ".join(bad))
    at = F.coalesce(*[F.when((F.col("path") == r) | F.col("path").startswith(r + "/") | F.lit(r in ("", ".")), r) for r in clean])
    rows = files.withColumn("root", at).filter(F.col("root").isNotNull() & F.regexp_extract("path", r"(\.[^./]+)$", 1).isin(suffixes))
    inside = F.split(F.expr("substring(path, length(root) + 1)"), "/")
    folders = F.slice(inside, F.lit(1), F.size(inside) - 1)
    return rows.filter(~F.exists(folders, lambda f: f.isin(skipped) | (f.startswith(".") & (f != ".")))).dropDuplicates(["path"])
