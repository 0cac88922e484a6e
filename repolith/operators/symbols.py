"""Symbols of source files: Python by its syntax tree, JavaScript and TypeScript by column-0 declarations."""

from __future__ import annotations

import ast
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.session import prepare, spread

SCHEMA = "path string, name string, qualified_name string, kind string, line int, end_line int, arity int, has_self boolean, parent string, decorators array<string>, digest string, signature string"
FIELDS = [
    ("path", pa.string()), ("name", pa.string()), ("qualified_name", pa.string()), ("kind", pa.string()),
    ("line", pa.int32()), ("end_line", pa.int32()), ("arity", pa.int32()), ("has_self", pa.bool_()),
    ("parent", pa.string()), ("decorators", pa.list_(pa.string())), ("digest", pa.string()), ("signature", pa.string())
]


class _Blank(ast.NodeTransformer):
    """Names and constants blanked, so that equal structure gives an equal dump."""

    def visit_Name(self, node):
        return ast.copy_location(ast.Name("_", node.ctx), node)

    def visit_arg(self, node):
        return ast.arg("_")

    def visit_Constant(self, node):
        return ast.copy_location(ast.Constant(type(node.value).__name__), node)


def python_symbols(path: str, source: str) -> list[tuple]:
    """Functions, methods and classes of a file; a file that can't be parsed gives one row of kind ``unparsed``."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return [(path, None, None, "unparsed", None, None, None, None, None, [], None, None)]
    out = []

    def visit(body, parents):
        for node in body:
            if isinstance(node, ast.ClassDef):
                out.append((path, node.name, ".".join([*parents, node.name]), "class", node.lineno, node.end_lineno, None, None, parents[-1] if parents else None, [ast.unparse(d) for d in node.decorator_list], None, None))
                visit(node.body, [*parents, node.name])
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                a = node.args
                names = [x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs]]
                decorators = [ast.unparse(d) for d in node.decorator_list]
                own = bool(names) and names[0] in ("self", "cls") and bool(parents) and "staticmethod" not in decorators
                dump = ast.dump(ast.Module([_Blank().visit(ast.parse(ast.unparse(s))) for s in node.body], []))
                out.append((path, node.name, ".".join([*parents, node.name]), "method" if parents else "function", node.lineno, node.end_lineno, len(names), own, parents[-1] if parents else None, decorators, hashlib.md5(dump.encode()).hexdigest()[:12], ",".join(names[own:])))
    visit(tree.body, [])
    return out


def extract_python(files: DataFrame) -> DataFrame:
    """Symbols of (path, text), parsed on the executors in Arrow batches."""

    def run(batches):
        for b in batches:
            rows = [r for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in python_symbols(p, t or "")]
            cols = list(zip(*rows)) or [[]] * len(FIELDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, FIELDS)], names=[n for n, _ in FIELDS])

    prepare(files.sparkSession)
    return spread(files.select("path", "text")).mapInArrow(run, SCHEMA)


#: A script's line in tokens: names, arrows, and any other sign by itself.
TOKEN = r"([A-Za-z_$][A-Za-z0-9_$]*|=>|\S)"


def declared(line: Column) -> Column:
    """struct(name, kind) of what a line declares at its very beginning, else null; told by its first tokens.

    ``function name (`` with or without async, ``class name``, ``window . name =``, and a
    name that const, let or var binds to a function: ``= function``, ``= name =>`` or
    ``= ( ... ) =>``, each with or without async.
    """
    every = F.regexp_extract_all(line, F.lit(TOKEN), F.lit(1))
    later = lambda tokens: F.when(F.get(tokens, 0) == "async", F.slice(tokens, 2, 1 << 30)).otherwise(tokens)
    t = lambda tokens, k: F.coalesce(F.get(tokens, k), F.lit(""))
    named = lambda x: x.rlike("^[A-Za-z_$]")
    free, value = later(every), later(F.slice(every, 4, 1 << 30))
    closing = F.array_position(value, ")").cast("int")
    function = (t(value, 0) == "function") | (named(t(value, 0)) & (t(value, 1) == "=>")) | (
        (t(value, 0) == "(") & (closing > 0) & (t(value, closing) == "=>")
    )
    told = [
        ((t(free, 0) == "function") & named(t(free, 1)) & (t(free, 2) == "("), t(free, 1), "function"),
        (t(every, 0).isin("const", "let", "var") & named(t(every, 1)) & (t(every, 2) == "=") & function, t(every, 1), "function"),
        ((t(every, 0) == "class") & named(t(every, 1)), t(every, 1), "class"),
        ((t(every, 0) == "window") & (t(every, 1) == ".") & named(t(every, 2)) & t(every, 3).startswith("="), t(every, 2), "function"),
    ]
    found = [F.when(holds & line.rlike(r"^\S"), F.struct(name.alias("name"), F.lit(kind).alias("kind"))) for holds, name, kind in told]
    return F.coalesce(*found)


def extract_script(files: DataFrame) -> DataFrame:
    """name, kind (function or class), line, end_line (before the next declaration) and loc of column-0 declarations."""
    every = F.split(F.regexp_replace("text", "\n$", ""), "\n")
    lines = spread(files.select("path", "text")).select("path", F.posexplode(every).alias("at", "held"), F.size(every).alias("total"))
    likely = lines.filter(F.col("held").rlike(r"^(async|function|const|let|var|class|window)\b"))
    found = likely.select("path", "total", (F.col("at") + 1).alias("line"), declared(F.col("held")).alias("x")).filter("x IS NOT NULL")
    end = F.coalesce(F.lead("line").over(Window.partitionBy("path").orderBy("line")) - 1, F.col("total"))
    return found.withColumn("end_line", end).select(
        "path", "x.name", "x.kind", "line", "end_line", (F.col("end_line") - F.col("line") + 1).alias("loc")
    )


#: What makes a branch in a script: words, operators and arms.
SCRIPT_BRANCH = r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?\?|\?(?![.:?])"


def script_hotspots(files: DataFrame, least_score: int, least_lines: int = 1) -> DataFrame:
    """(path, name, line, end_line, branch_score) of a script's column-0 functions with at least that score and that many lines.

    A score of text: comments to a line's end and quoted text don't count.
    """
    found = extract_script(files).filter(F.col("kind") == "function")
    rows = found.join(files.select("path", F.split("text", "\n").alias("__lines")), "path")
    body = F.array_join(F.slice("__lines", F.col("line"), F.col("loc")), "\n")
    plain = F.regexp_replace(F.regexp_replace(body, r"\"[^\"\n]*\"|'[^'\n]*'|`[^`]*`", "''"), r"//[^\n]*", "")
    rows = rows.withColumn("branch_score", F.regexp_count(plain, F.lit(SCRIPT_BRANCH)))
    return rows.filter(
        (F.col("branch_score") >= least_score) & (F.col("loc") >= least_lines)
    ).select("path", "name", "line", "end_line", "branch_score")


def name_audit(symbols: DataFrame, generic: tuple[str, ...] = ()) -> DataFrame:
    """(name, definitions, files, signatures, lines, verdict): names with two definitions or more in two files or more, duplicate if
    all have one signature, else shadow; and names of the ``generic`` verbs, however often defined, as rows of their own.  Properties are left out.
    """
    own = symbols.filter("kind IN ('function', 'method') AND NOT array_contains(decorators, 'property')")
    n = own.groupBy("name").agg(
        F.count("*").alias("definitions"), F.countDistinct("path").alias("files"),
        F.countDistinct("signature").alias("signatures"), F.sum(F.col("end_line") - F.col("line") + 1).alias("lines")
    )
    verdicts = F.array(
        F.when((F.col("definitions") >= 2) & (F.col("files") >= 2), F.when(F.col("signatures") == 1, "duplicate").otherwise("shadow")),
        F.when(F.col("name").isin(*generic), "generic")
    )
    return n.select("*", F.explode(F.filter(verdicts, lambda v: v.isNotNull())).alias("verdict"))
