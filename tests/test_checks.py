"""Checks and branch scores on small sources."""

import pytest

from repolith.operators import checks

SOURCE = """
def busy(a, b):
    if a and b or a:
        for x in [y for y in a if y]:
            pass
    try:
        return 1 if a else 2
    except Exception:
        return None
    def inner():
        if a: pass

def calm():
    try:
        return 1
    except:
        raise

def narrow():
    try:
        return 1
    except ValueError:
        pass

def told():
    try:
        return 1
    except Exception:
        pass  # noqa: silent-handler: best effort
"""


def test_checks(spark):
    files = spark.createDataFrame([("a.py", SOURCE), ("bad.py", "def ("), ("none.py", None)], "path string, text string")
    got = sorted((r["path"], r["rule"], r["line"]) for r in checks.run_checks(files).collect())
    assert got == [("a.py", "bare-handler", 16), ("a.py", "silent-handler", 8)]
    assert checks.run_checks(files, ["bare-handler"]).count() == 1
    assert checks.run_checks(files, None, {"bare-handler": (r"\.py$", r"^a")}).count() == 1
    with pytest.raises(KeyError):
        checks.run_checks(files, ["unknown"])


def test_hotspots(spark):
    files = spark.createDataFrame([("a.py", SOURCE)], "path string, text string")
    got = {r["name"]: r["branch_score"] for r in checks.hotspots(files, 0).collect()}
    # if, two further operands, for, a comprehension's condition, handler, conditional
    assert got == {"busy": 7, "inner": 1, "calm": 1, "narrow": 1, "told": 1}
    assert [r["name"] for r in checks.hotspots(files, 7, 10).collect()] == ["busy"]
    assert checks.hotspots(files.limit(0), 0).count() == 0
