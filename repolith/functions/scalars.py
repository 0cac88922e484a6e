"""Scalar expressions: globs, versions, timestamps, durations, ages, digests, redaction."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """An anchored, case-sensitive regex for a glob whose ``*`` crosses ``/``; a trailing slash means everything below."""
    out = []
    for c in pattern + ("*" if pattern.endswith("/") else ""):
        out.append(".*" if c == "*" else "." if c == "?" else re.escape(c))
    return "(?s)^" + "".join(out) + "$"


def version_key(v: Column) -> Column:
    """The first number groups of a version as an array of four ints, padded with zeros; arrays compare as versions do."""
    found = F.transform(F.regexp_extract_all(v, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    return F.slice(F.concat(found, F.array_repeat(F.lit(0), 4)), 1, 4)


def iso_timestamp(raw: Column) -> Column:
    """UTC timestamp of an ISO-8601 string; null where it can't be read."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(raw), "Z$", "+00:00"))


def elapsed_days(then: Column, now: Column) -> Column:
    """Whole 24-hour units, truncated towards zero."""
    return ((F.unix_timestamp(now) - F.unix_timestamp(then)) / 86400).cast("int")


def floored_days(then: Column, now: Column) -> Column:
    return F.greatest(F.lit(0), F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 86400).cast("int"))


def calendar_days(then: Column, now: Column, missing: int = 10**6) -> Column:
    """Difference of calendar dates; a missing date is ``missing`` days old, a malformed one 0."""
    day = F.try_to_timestamp(F.substring(then, 1, 10), F.lit("yyyy-MM-dd"))
    return F.when(then.isNull() | (then == ""), missing).when(day.isNull(), 0).otherwise(F.datediff(now, day))


def duration_seconds(text: Column, cap_days: int = 30) -> Column:
    """Seconds of ``14d``, ``12h`` or ``30m``; null for anything else, for zero and for more than ``cap_days``."""
    n = F.try_to_number(F.regexp_extract(F.trim(text), r"^(\d{1,9})[dhm]$", 1), F.lit("999999999")).cast("long")
    unit = F.when(F.trim(text).endswith("d"), 86400).when(F.trim(text).endswith("h"), 3600).otherwise(60)
    return F.when((n > 0) & (n * unit <= cap_days * 86400), n * unit)


def percentage(part: Column, whole: Column, digits: int = 1) -> Column:
    """Rounded half-even; null for a zero denominator."""
    return F.when(whole != 0, F.bround(100.0 * part / whole, digits))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def short_digest(text: Column, size: int = 12) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, size)


def stable_id(*parts: Column) -> Column:
    """An id of what a finding is about, without its line."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def redact(text: Column, patterns: list[str], size: int = 200) -> Column:
    """Secrets replaced, white space collapsed, cut to ``size`` characters."""
    for p in patterns:
        text = F.regexp_replace(text, p, "[redacted]")
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, size)


def ancestors(path: Column) -> Column:
    """A path and all its parent folders, longest first, without a trailing slash."""
    parts = F.split(F.regexp_replace(path, "/+$", ""), "/")
    return F.reverse(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))


def normal_path(path: Column) -> Column:
    """``.`` and ``..`` resolved; null where the path leaves its root."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    step = lambda done, p: F.when(done.isNull() | ((p == "..") & (F.size(done) == 0)), F.lit(None)).when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def one_line(text: Column, size: int) -> Column:
    """White space collapsed, cut at a word's end so that with ``...`` it has at most ``size`` characters; a longer first word is cut inside."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    head = F.substring(flat, 1, size - 2)
    words = F.regexp_extract(head, r"^(.*)\s\S*$", 1)
    return F.when(F.length(flat) <= size, flat).otherwise(
        F.concat(F.when(words != "", words).otherwise(F.substring(flat, 1, size - 3)), F.lit("..."))
    )


def date_prefix(*fields: Column) -> Column:
    """The first ten characters of the first field that has as many; they aren't checked to be a date."""
    return F.coalesce(*[F.when(F.length(f) >= 10, F.substring(f, 1, 10)) for f in fields])


def line_of(text: Column, offset: Column) -> Column:
    """The line (from 1) of a character offset (from 0)."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.translate(head, "\n", "")) + 1


def column_of(text: Column, offset: Column) -> Column:
    """The column (from 1) of a character offset (from 0)."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(F.element_at(F.split(head, "\n"), -1)) + 1


def java_version_key(v: Column) -> Column:
    """``version_key`` in which the old ``1.8`` counts as ``8``."""
    return version_key(F.regexp_replace(v, r"^\D*1\.(?=\d)", ""))


def canonical_json(row: Column | str) -> Column:
    """A JSON object's members by name, as text: one identity for whatever order they came in."""
    pairs = F.from_json(row, "map<string, string>")
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(pairs))))


def tree_digest(files, by: list[str]):
    """(by, digest): SHA-256 over the sorted (path, digest of the bytes) of (by, path, text)."""
    own = F.concat_ws(":", "path", F.sha2("text", 256))
    return files.groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(own)), "\n"), 256).alias("digest"))


def cell(text: Column) -> Column:
    """Text for a cell of a Markdown table."""
    return F.replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s*\n\s*", " "), F.lit("|"), F.lit("\\|"))


def nested(doc: Column, path: str, default: str) -> Column:
    """A member of a JSON document by its path (``$.a.b``), or the default where it is absent or null."""
    return F.coalesce(F.get_json_object(doc, path), F.lit(default))


def description(text: Column, least: int = 16, most: int = 150) -> Column:
    """The first paragraph of a source's leading docstring or comment, on one line of at most ``most`` characters; null if it has fewer than ``least``."""
    body = F.regexp_replace(text, r"\A(?:\ufeff|#![^\n]*\n|\s)*", "")
    quoted = F.regexp_extract(body, r"(?s)\A[rRuU]?(?:\"\"\"|''')(.*?)(?:\"\"\"|''')", 1)
    block = F.regexp_replace(F.regexp_extract(body, r"(?s)\A/\*+(.*?)\*/", 1), r"(?m)^\s*\*+ ?", "")
    marked = F.regexp_replace(F.regexp_extract(body, r"\A((?:[ \t]*(?:#|//+)[^\n]*(?:\n|\z))+)", 1), r"(?m)^\s*(?:#+|//+)!? ?", "")
    found = F.when(quoted != "", quoted).when(block != "", block).otherwise(marked)
    first = F.regexp_extract(F.regexp_replace(found, r"\A\s+", ""), r"(?s)\A(.+?)(?:\n\s*\n|\z)", 1)
    short = one_line(first, most)
    return F.when(F.length(short) >= least, short)
