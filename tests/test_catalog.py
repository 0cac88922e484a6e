"""Every query of the catalogue against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from repolith import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_and_sql_agree(spark, tables, name):
    found = entry.queries()[name](spark, SF)
    run = tables.execute(catalog.ORACLE[name])
    named = [c[0] for c in run.description]
    assert sorted(named) == sorted(found.columns)
    want = sorted((tuple(plain(r[named.index(c)]) for c in found.columns) for r in run.fetchall()), key=repr)
    assert sorted((tuple(plain(v) for v in r) for r in found.collect()), key=repr) == want


def test_names():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 150


def test_near_grading_runs(spark):
    r = entry.queries()["planted_near"](spark, SF).first()
    exact = entry.queries()["planted_grade"](spark, SF).first()
    assert r.tp >= exact.tp and r.tp + r.fp == exact.tp + exact.fp


def test_no_cartesian_product_in_rule_joins(spark):
    for name in ("routed_urls", "command_hits"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" in plan


def test_prompt_groups_name_every_symbol(spark):
    d = SF.replace("0.001", "0.01")
    rows = entry.queries()["domain_groups"](spark, d).collect()
    assert all(len(x.members) == x.n for x in rows) and max(x.n for x in rows) > 100
    assert sum(len(x.members) for x in rows) == spark.read.parquet(f"{d}/part.parquet").count()


def test_clone_chains_are_not_cut(spark):
    rows = entry.queries()["clone_components"](spark, SF).collect()
    keys = {x.c_custkey for x in spark.read.parquet(f"{SF}/customer.parquet").collect()}
    assert keys <= {x.member for x in rows} and max(x.multiplicity for x in rows) > 16


def test_subsystems_hold_every_finding(spark):
    d = SF.replace("0.001", "0.01")
    rows = entry.queries()["findings_by_subsystem"](spark, d).collect()
    assert all(len(x.ids) == x.n for x in rows) and max(x.n for x in rows) > 100
    assert sum(len(x.ids) for x in rows) == spark.read.parquet(f"{d}/customer.parquet").count()


def test_every_event_is_a_violation(spark):
    hits = {x.tag: x.hits for x in entry.queries()["violation_tags"](spark, SF).collect()}
    events = spark.read.parquet(f"{SF}/events.parquet").filter("event_id % 7 <> 0")
    assert hits == {t: events.filter(f"event_type = '{t}'").count() for t in ("click", "view", "nothing")}


def test_pairs_are_grouped_in_parts_by_input_size(spark):
    plan = entry.queries()["triaged_pairs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
