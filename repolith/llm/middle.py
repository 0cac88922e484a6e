"""Fill-in-the-middle: documents cut into prefix, middle and suffix at unit borders, and put together again.

Everything is one row at a time in Arrow batches: no shuffle, and a worker holds one
batch of texts.  Cases: a null text counts as empty and stays plain; a null doc_id is
seeded as the empty text; repeated rows give repeated results; rows of one doc_id have
the same seeds; an empty table gives no rows; further columns, whatever their names,
are only taken where ``keep`` names them; very long texts hold 8 bytes for each unit.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Sequence

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.llm._common import prepare

LINES = r"[^\n]*\n|[^\n]+"
#: Sentinels before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
CUT = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def seeds(salt: str, name: str) -> list[int]:
    """The first four 8-digit groups of the hex SHA-256 of ``salt:name``, as integers."""
    digest = sha256(f"{salt}:{name}")
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def divide(text: str, ends: array, h: list[int], rate: int, spm: int, marks: tuple[str, str, str]) -> tuple:
    """A row of ``CUT`` but for its digest; ``ends`` holds 0 and each unit's end."""
    n, (p, s, m) = len(ends) - 1, marks
    if not text or any(x in text for x in marks) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = ends[low], ends[high]
    before, middle, after = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, f"{s}{after}{p}{before}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{before}{s}{after}{m}{middle}"


def rebuild(output: str, form: str, marks: tuple[str, str, str]) -> str:
    """The text that ``divide`` has cut; texts that hold a mark are never cut, so every mark is found once."""
    p, s, m = marks
    if form == "plain":
        return output
    first, second = (s, p) if form == "spm" else (p, s)
    one, two, middle = regex.split("|".join(map(regex.escape, (second, m))), output.removeprefix(first))
    return two + middle + one if form == "spm" else one + middle + two


def cut_middle(unit: str, salt: str, rate: int, spm: int, marks: tuple[str, str, str]):
    """A pandas UDF of (doc_id as text, text) to ``CUT``."""
    found = regex.compile(unit)

    @F.pandas_udf(CUT)
    def run(name: pd.Series, text: pd.Series) -> pd.DataFrame:
        out = []
        for i, t in zip(name, text):
            ends = array("q", [0])
            ends.extend(x.end() for x in found.finditer(t))
            row = divide(t, ends, seeds(salt, i), rate, spm, marks)
            out.append((*row, sha256(row[-1])))
        frame = pd.DataFrame(out, columns=["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"])
        return frame.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return run


def restored(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """struct(text, text_sha256): the text rebuilt from an output and its form (nulls: an empty plain text)."""

    @F.pandas_udf("text string, text_sha256 string")
    def run(out: pd.Series, kind: pd.Series) -> pd.DataFrame:
        texts = [rebuild(o, k, tuple(marks)) for o, k in zip(out, kind)]
        return pd.DataFrame({"text": texts, "text_sha256": [sha256(t) for t in texts]})

    return run(F.coalesce(output, F.lit("")), F.coalesce(form, F.lit("plain")))


def transform(
    docs: DataFrame, unit: str = LINES, salt: str = "7", rate: int = 100, spm: int = 50,
    marks: Sequence[str] = MARKS, keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """The ``keep`` columns and, for every document, n (units), form, prefix_chars, middle_chars, output, output_sha256.

    ``unit`` matches the units one after another, over code points.  ``rate`` percent of
    the documents are cut, ``spm`` percent of those put the suffix first; which, and
    where, follows from the hashes of salt and doc_id alone.  Texts that are empty or
    hold a mark stay plain.  Marks must differ, none within another, and none may end
    as a mark begins: then no mark can come about by chance where pieces meet.
    """
    overlap = any(a.endswith(b[:k]) for a in marks for b in marks for k in range(1, len(b)))
    if len({*marks}) != 3 or not all(marks) or overlap or any(a in b for a in marks for b in marks if a != b):
        raise ValueError("marks must be three texts that neither hold nor overlap each other")
    prepare(docs.sparkSession)
    run = cut_middle(unit, salt, rate, spm, tuple(marks))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    found = run(name, F.coalesce(F.col("text").cast("string"), F.lit("")))
    kept = docs.select(*[F.col(f"`{c}`") for c in keep], F.struct(found.alias("cut")).alias("fim"))
    return kept.select(*[F.col(f"`{c}`") for c in keep], "fim.cut.*")
