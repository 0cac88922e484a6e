"""JSON-lines logs, keyed JSON documents, Markdown with front matter, and file trees."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolith.session import cut


#: Splits whose offsets may be broadcast: a row of a path and three numbers each.
MOST_SPLITS = 50_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, ordinal, raw) of the lines of text files, blank ones too; ordinals from 1.

    Files are read in pieces, however large they are.  The lines of a piece come in
    order, so their running number less the least of the piece is their place in it, and
    what the pieces before it hold is a sum over one row for each piece.  Text isn't
    shuffled unless there are very many pieces.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("__start"), F.col("value").alias("raw")
    ).withColumn("__at", F.monotonically_increasing_id())
    pieces = cut(lines.groupBy("source_file", "__start").agg(F.min("__at").alias("__first"), F.count("*").alias("__n")))
    before = Window.partitionBy("source_file").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    if pieces.limit(MOST_SPLITS + 1).count() <= MOST_SPLITS:
        pieces = F.broadcast(pieces)
    place = (F.col("__before") + F.col("__at") - F.col("__first") + 1).alias("ordinal")
    return lines.join(pieces, ["source_file", "__start"]).select("source_file", place, "raw")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON-lines files with ``source_file``, ``ordinal`` (line number from 1), ``raw`` and ``bad``.

    Blank lines are skipped; a line that is no JSON object is kept with ``bad`` true
    and null fields, so that callers count, warn or drop.
    """
    kept = numbered_lines(spark, path).filter(F.trim("raw") != "")
    fields = T._parse_datatype_string(schema)
    parsed = F.from_json(
        "raw", T.StructType([*fields.fields, T.StructField("_corrupt", T.StringType())]),
        {"columnNameOfCorruptRecord": "_corrupt"}
    )
    rows = kept.withColumn("row", parsed)
    bad = F.col("row").isNull() | F.col("row._corrupt").isNotNull() | ~F.trim("raw").startswith("{")
    rows = rows.withColumn("bad", bad)
    return rows.select(
        "source_file", "ordinal", "raw", "bad",
        *[F.when(~F.col("bad"), F.col(f"row.`{f.name}`")).alias(f.name) for f in fields.fields]
    )


def bad_rows(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source_file").agg(F.count_if("bad").alias("bad"), F.count("*").alias("lines"))


def union_copies(copies: list[DataFrame], key: list[str]) -> DataFrame:
    """Union of log copies in which the first of equal keys wins, by copy and then by ordinal."""
    out = None
    for n, c in enumerate(copies):
        c = c.withColumn("copy", F.lit(n))
        out = c if out is None else out.unionByName(c)
    order = Window.partitionBy(*key).orderBy("copy", "ordinal")
    return out.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def read_keyed(spark: SparkSession, path: str, entry: str, member: str = "entries") -> DataFrame:
    """One row for each key of a JSON document ``{member: {key: entry}}``; an empty file is an empty relation."""
    text = spark.read.text(path, wholetext=True).filter(F.trim("value") != "")
    parsed = text.select(F.from_json("value", f"`{member}` map<string, struct<{entry}>>", {"mode": "FAILFAST"}).alias("doc"))
    return parsed.select(F.explode(f"doc.`{member}`").alias("key", "entry")).select("key", "entry.*")


def front_matter(files: DataFrame) -> DataFrame:
    """metadata (map of scalar fields), lists (map of list fields), body and has_frontmatter of (path, text); BOM and CRLF are normalised."""
    text = F.regexp_replace(F.regexp_replace("text", "^\ufeff", ""), "\r\n?", "\n")
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:"))
    name = lambda x: F.regexp_extract(x, r"^([\w-]+):", 1)
    value = lambda x: F.regexp_replace(F.trim(F.regexp_extract(x, r"^[\w-]+:(.*)$", 1)), "^[\"'](.*)[\"']$", "$1")
    listed = F.filter(lines, lambda x: value(x).rlike(r"^\[.*\]$"))
    items = lambda x: F.filter(F.transform(F.split(F.regexp_extract(value(x), r"^\[(.*)\]$", 1), ","), lambda i: F.trim(F.regexp_replace(i, "[\"']", ""))), lambda i: i != "")
    dedup = lambda a: F.map_from_entries(F.filter(a, lambda e, i: ~F.exists(F.slice(a, i + 2, F.size(a)), lambda later: later["k"] == e["k"])))
    return files.select(
        "path",
        dedup(F.transform(lines, lambda x: F.struct(name(x).alias("k"), value(x).alias("v")))).alias("metadata"),
        dedup(F.transform(listed, lambda x: F.struct(name(x).alias("k"), items(x).alias("v")))).alias("lists"),
        F.regexp_replace(text, r"(?s)\A---\n.*?\n---(?:\n|\z)", "").alias("body"),
        (block != "").alias("has_frontmatter"),
    )


def file_tree(spark: SparkSession, root: str, glob: str = "*", skipped: list[str] | None = None, text: bool = True, links: bool = False) -> DataFrame:
    """path below ``root``, suffix, size and text (null: not UTF-8) of its files, without those below folders named in ``skipped``; each path once.

    Spark lists the tree, in tasks where it is large, and the listing stays with it: no
    folder is walked here and no file is read before its path is chosen.  Symbolic links
    of a local tree, and what lies below linked folders, are passed over unless ``links`` is set.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    home = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top = fs.resolvePath(home).toUri().getPath().rstrip("/")
    plain = F.regexp_replace("path", "^[a-z]+:(//[^/]*)?/*", "/")
    below = F.substring(plain, F.lit(len(top) + 2), F.length(plain))
    own = F.lit(True) if links or fs.getUri().getScheme() != "file" else unlinked(top)(below)
    rows = files.filter(own).select(below.alias("path"), F.col("length").alias("size"), *[F.col("content")] * text)
    if skipped:
        folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
        rows = rows.filter(~F.arrays_overlap(folders, F.array(*map(F.lit, skipped))))
    rows = rows.withColumn("suffix", F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return rows.withColumn("text", F.try_validate_utf8(F.col("content").cast("string"))).drop("content") if text else rows


def unlinked(root: str):
    """A pandas UDF: whether a path below a local ``root`` neither is a symbolic link nor goes through one; looked at where the rows are."""
    base = os.path.realpath(root)

    @F.pandas_udf("boolean")
    def run(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: os.path.realpath(os.path.join(base, p)) == os.path.join(base, p))

    return run


def validate(rows: DataFrame, rules: list[tuple[str, Column, str]], ordinal: str = "ordinal") -> DataFrame:
    """(ordinal, field, message) for each rule (field, condition that must hold, message) that a row breaks; null breaks it."""
    broken = F.filter(
        F.array(
            *[F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(f).alias("field"), F.lit(m).alias("message"))) for f, ok, m in rules]
        ),
        lambda x: x.isNotNull()
    )
    return rows.select(ordinal, F.explode(broken).alias("error")).select(ordinal, "error.*")
