"""Checks of Python sources by name: each yields findings for a syntax tree; and branch scores of functions."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.operators.facts import FUNCTIONS, over_sources

#: (line, column, first and last line on which a marker allows it, message) of each finding.
Check = Callable[[ast.AST], Iterator[tuple[int, int, int, int, str]]]

CHECKS: dict[str, Check] = {}

BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.match_case)
#: Handlers of these catch everything.
BROAD = ("Exception", "BaseException")


def check(rule: str) -> Callable[[Check], Check]:
    """Register a check; a later one of the same name takes its place."""

    def add(f: Check) -> Check:
        CHECKS[rule] = f
        return f

    return add


def broad(handler: ast.ExceptHandler) -> bool:
    return handler.type is None or (isinstance(handler.type, ast.Name) and handler.type.id in BROAD)


def silent(body: list[ast.stmt]) -> str | None:
    """What the only statement of a body does, if it hides the error."""
    match body:
        case [ast.Pass()]:
            return "pass"
        case [ast.Continue()]:
            return "continue"
        case [ast.Return(value=None) | ast.Return(value=ast.Constant(value=None))]:
            return "return None"
    return None


@check("silent-handler")
def silent_handler(tree):
    for node in ast.walk(tree):
        if isinstance(node, ast.ExceptHandler) and broad(node) and (how := silent(node.body)):
            yield node.lineno, node.col_offset, node.lineno, node.body[-1].end_lineno, f"handler hides the error by {how}"


@check("bare-handler")
def bare_handler(tree):
    for node in ast.walk(tree):
        if isinstance(node, ast.ExceptHandler) and node.type is None:
            yield node.lineno, node.col_offset, node.lineno, node.lineno, "handler names no error"


# How the names of functions begin that promise to read only, names that say what they do, and methods that write.
READING = ("get_", "fetch_", "load_", "list_", "find_", "check_")
PLAIN_NAMES = ("get_or_create", "update_or_create")
WRITING = ("save", "delete", "update", "update_or_create", "create", "bulk_create", "bulk_update", "get_or_create")
# Methods that hand a task over, and texts that emitted sources must not hold.
DISPATCHING = ("delay", "apply_async")
RETIRED = ("from core.services", "import core.services")


def calls_by_function(tree: ast.AST) -> Iterator[tuple[ast.AST, list[ast.Call]]]:
    """Each function with the calls of methods in it that no inner function holds, in the order of the text."""
    todo, held = [(tree, None)], {}
    while todo:
        node, owner = todo.pop()
        if isinstance(node, FUNCTIONS):
            owner = node
            held[node] = []
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and owner is not None:
            held[owner].append(node)
        todo += [(x, owner) for x in ast.iter_child_nodes(node)]
    for function, calls in held.items():
        yield function, sorted(calls, key=lambda c: (c.lineno, c.col_offset))


@check("query-mutation")
def reads_that_write(tree):
    """One finding for a function that promises to read, at its first call that writes; a marker may stand anywhere in it."""
    for function, calls in calls_by_function(tree):
        writes = [c for c in calls if c.func.attr in WRITING]
        if writes and function.name.startswith(READING) and function.name not in PLAIN_NAMES:
            told = ", ".join(sorted({c.func.attr for c in writes}))
            yield writes[0].lineno, writes[0].col_offset, function.lineno, function.end_lineno, f"{function.name} reads by its name and calls {told}"


@check("safe-dispatch")
def bare_dispatch(tree):
    for node in ast.walk(tree):
        match node:
            case ast.Call(func=ast.Attribute(attr=name)) if name in DISPATCHING:
                yield node.lineno, node.col_offset, node.lineno, node.end_lineno, f"bare dispatch by {name}"


@check("codegen-emits-new-paths")
def retired_paths(tree):
    """One finding for each text; only its first line can hold a marker."""
    for node in ast.walk(tree):
        if isinstance(node, ast.Constant) and isinstance(node.value, str):
            held = next((t for t in RETIRED if t in node.value), None)
            if held:
                yield node.lineno, node.col_offset, node.lineno, node.lineno, f"emitted text holds {held}"


#: Rules that only some paths are for, and rules whose marker is another than ``noqa: <rule>``.
ROUTES = {"codegen-emits-new-paths": (r"(^|/)(app|core)/services/extraction/extraction_compiler/", None)}
MARKERS = {"query-mutation": r"#\s*hidden-mutation:\s*\S"}


def branch_score(function: ast.AST) -> int:
    """Branches, loops, handlers, cases, further operands of and/or and conditions of comprehensions, those of inner functions left out."""
    score, todo = 0, list(ast.iter_child_nodes(function))
    while todo:
        node = todo.pop()
        if isinstance(node, (*FUNCTIONS, ast.ClassDef)):
            continue
        score += isinstance(node, BRANCHES)
        score += len(node.values) - 1 if isinstance(node, ast.BoolOp) else 0
        score += len(node.ifs) if isinstance(node, ast.comprehension) else 0
        todo.extend(ast.iter_child_nodes(node))
    return score


def run_checks(files: DataFrame, rules: list[str] | None = None, routes: dict[str, tuple[str, str | None]] | None = None) -> DataFrame:
    """(path, rule, line, col, message) of the named checks, all if none is named, over (path, text); an unknown name is an error.

    ``routes`` gives a rule the paths it is for (a regex to find, and one that must not be found), ``ROUTES``
    where it doesn't name one.  A finding goes if one of its lines holds ``# noqa: <rule>: <reason>``, or
    the marker of ``MARKERS``, with a reason.
    """
    chosen = {r: CHECKS[r] for r in (CHECKS if rules is None else rules)}

    def rows_of(tree, lines):
        for rule, f in chosen.items():
            allowed = re.compile(MARKERS.get(rule, rf"#\s*noqa:\s*{re.escape(rule)}:\s*\S"))
            for line, col, first, last, message in f(tree):
                if not any(allowed.search(x) for x in lines[first - 1 : last]):
                    yield rule, line, col, message

    found = over_sources(files, {"rule": "string", "line": "int", "col": "int", "message": "string"}, rows_of)
    for rule, (include, exclude) in (ROUTES | (routes or {})).items():
        fits = F.col("path").rlike(include) & ~(F.col("path").rlike(exclude) if exclude else F.lit(False))
        found = found.filter((F.col("rule") != rule) | fits)
    return found


def hotspots(files: DataFrame, least_score: int, least_lines: int = 1) -> DataFrame:
    """(path, name, line, end_line, branch_score) of functions with at least that score and that many lines."""

    def rows_of(tree, lines):
        for node in ast.walk(tree):
            if isinstance(node, FUNCTIONS):
                yield node.name, node.lineno, node.end_lineno, branch_score(node)

    found = over_sources(files, {"name": "string", "line": "int", "end_line": "int", "branch_score": "int"}, rows_of)
    return found.filter((found.branch_score >= least_score) & (found.end_line - found.line + 1 >= least_lines))
