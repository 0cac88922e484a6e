"""Queries: audits, policies, registries and two-sided checks on the driver's tables, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolith.catalog import query, table
from repolith.operators import calls, intervals, matching, policy
from repolith.operators import relational as rel
from repolith.plans import audits, inventories, registries
from repolith.session import dealt

c = F.col


def text(x):
    return c(x).cast("string")


# audits

RAW = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
NOW = "2024-01-20 00:00:00"


def scan_rows(spark, d):
    e = table(spark, d, "events")
    return e.select(
        c("event_type").alias("skill"), text("user_id").alias("target"), text("event_id").alias("scan_id"), (
            c("event_id") % 4
        ).alias("findings_total"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), c("event_id").alias("ordinal"),
    )


@query(f"""
WITH s AS (SELECT event_type AS skill, CAST(user_id AS VARCHAR) AS target, CAST(event_id AS VARCHAR) AS scan_id, event_id % 4 AS findings_total, CAST({RAW} AS TIMESTAMP) AS moment, event_id FROM events WHERE event_id % 4 > 0),
l AS (SELECT *, row_number() OVER (PARTITION BY skill, target ORDER BY moment DESC, event_id) AS k, count(*) OVER (PARTITION BY skill, target) - 1 AS superseded FROM s),
f AS (SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE value > 90), m AS (SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE value < 5),
t AS (SELECT event_type AS skill, max(CAST({RAW} AS TIMESTAMP)) AS last FROM events WHERE value > 99 GROUP BY 1)
SELECT l.skill, target, scan_id, findings_total, superseded, CAST(trunc((epoch(TIMESTAMP '{NOW}') - epoch(moment)) / 86400) AS INTEGER) AS age_days,
  CASE WHEN scan_id IN (SELECT id FROM f) OR scan_id IN (SELECT id FROM m) OR coalesce(t.last >= moment, false) THEN 'acknowledged'
       WHEN epoch(TIMESTAMP '{NOW}') - epoch(moment) <= 7 * 86400 THEN 'grace' ELSE 'unaccounted' END AS state
FROM l LEFT JOIN t USING (skill) WHERE k = 1""")
def scan_triage(spark, d):
    e = table(spark, d, "events")
    none = F.lit(None).cast("string")
    findings = e.filter("value > 90").select(text("event_id").alias("source_scan"), none.alias("source_skill"), none.alias("created_at")).union(
        e.filter("value > 99").select(none, c("event_type"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    )
    dismissals = e.filter("value < 5").select(
        none.alias("source_scan"), text("event_id").alias("scan_id"), none.alias("skill"), none.alias("ts")
    )
    return audits.triage(scan_rows(spark, d), findings, dismissals, NOW)


@query("""
WITH m AS (SELECT l_suppkey AS k, count(*) AS loc FROM lineitem WHERE l_quantity > 25 GROUP BY 1),
r AS (SELECT s_name AS path, CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 11 = 0 THEN 'soon' ELSE '1998-0' || (1 + s_suppkey % 9) || '-15' END AS last_reviewed, CASE WHEN s_suppkey % 5 = 0 THEN 'split_queued' ELSE 'keep' END AS decision,
  CAST(coalesce(m.loc, CASE WHEN s_suppkey % 17 = 0 THEN 0 ELSE s_nationkey * 10 END) AS BIGINT) AS current_loc, CAST(CASE WHEN s_suppkey % 17 = 0 THEN 0 ELSE s_nationkey * 10 END AS BIGINT) AS prior_loc, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 200 END AS d, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey % 90 END AS g FROM supplier LEFT JOIN m ON k = s_suppkey),
a AS (SELECT *, current_loc - prior_loc AS loc_delta, CASE WHEN last_reviewed IS NULL THEN 1000000 WHEN last_reviewed = 'soon' THEN 0 ELSE date_diff('day', TRY_CAST(last_reviewed AS DATE), DATE '1998-12-01') END AS age FROM r WHERE decision <> 'split_queued'),
t AS (SELECT *, list_filter([CASE WHEN age >= 120 THEN 'age=' || age || 'd>=120d' END, CASE WHEN age >= d THEN 'per-entry age=' || age || 'd>=' || d || 'd' END, CASE WHEN current_loc >= 200 THEN 'loc=' || current_loc || '>=200' END,
  CASE WHEN loc_delta >= g THEN 'per-entry delta=' || loc_delta || '>=' || g END, CASE WHEN prior_loc <> 0 AND CAST(trunc(loc_delta / prior_loc * 100) AS INTEGER) >= 40 THEN 'growth=' || CAST(trunc(loc_delta / prior_loc * 100) AS INTEGER) || '%>=40%' END], lambda x: x IS NOT NULL) AS reasons FROM a)
SELECT path, last_reviewed, decision, current_loc, prior_loc, loc_delta, reasons FROM t WHERE len(reasons) > 0""")
def ledger_review(spark, d):
    k = c("s_suppkey")
    seen = F.when(k % 7 == 0, None).when(k % 11 == 0, "soon").otherwise(F.concat(F.lit("1998-0"), (1 + k % 9).cast("string"), F.lit("-15")))
    ledger = table(spark, d, "supplier").select(
        c("s_name").alias("path"), F.when(k % 17 != 0, c("s_nationkey") * 10).cast("long").alias("loc"), seen.alias("last_reviewed"),
        F.when(k % 5 == 0, "split_queued").otherwise("keep").alias("decision"),
        F.when(k % 3 == 0, k % 200).cast("int").alias("after_days"), F.when(k % 4 == 0, k % 90).cast("int").alias("after_loc_delta"),
    )
    n = table(spark, d, "lineitem").filter("l_quantity > 25").groupBy("l_suppkey").agg(F.count("*").alias("loc"))
    metrics = n.join(table(spark, d, "supplier"), c("l_suppkey") == k).select(c("s_name").alias("path"), "loc")
    # a prior size that is unknown counts 0, and so does the present one where nothing is measured
    return audits.needs_review(ledger, metrics, "1998-12-01", 120, 200, 40)


@query("SELECT p_partkey AS path, p_size AS loc FROM part WHERE p_size >= 30 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09)")
def files_not_in_ledger(spark, d):
    known = table(spark, d, "lineitem").filter("l_discount > 0.09").select(c("l_partkey").alias("path"))
    return audits.drift_scan(table(spark, d, "part").select(c("p_partkey").alias("path"), c("p_size").alias("loc")), known, 30)


@query(f"""
WITH e AS (SELECT event_type AS decision, count(*) AS n, count(DISTINCT user_id) AS rules FROM events WHERE epoch(TIMESTAMP '{NOW}') - floor(epoch(ts)) <= 14 * 86400 GROUP BY 1),
v AS (SELECT unnest(['click', 'ask', 'deny']) AS decision)
SELECT coalesce(v.decision, e.decision) AS decision, coalesce(n, 0) AS n, coalesce(rules, 0) AS rules FROM v FULL JOIN e ON v.decision = e.decision""")
def friction_counts(spark, d):
    e = table(spark, d, "events").select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), c("event_type").alias("decision"),
        c("user_id").alias("rule_id")
    )
    return audits.friction(e, NOW, 14, ("click", "ask", "deny"))


@query("""
WITH i AS (SELECT p_brand AS spec, p_partkey AS item, CASE WHEN p_size < 20 THEN 'done' WHEN p_size < 35 THEN 'partial' ELSE 'todo' END AS status FROM part WHERE p_size < 48),
r AS (SELECT p_brand AS spec, l_partkey AS item, count(*) AS refs, count(DISTINCT l_suppkey) AS files FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_discount > 0.07 GROUP BY ALL)
SELECT coalesce(i.spec, r.spec) AS spec, coalesce(i.item, r.item) AS item, status, coalesce(refs, 0) AS refs, coalesce(files, 0) AS files,
  list_filter([CASE WHEN status IS NULL THEN 'orphan' END, CASE WHEN status = 'done' AND refs IS NULL THEN 'unproven' END, CASE WHEN status = 'done' AND refs > 0 THEN 'covered' END,
    CASE WHEN status = 'partial' THEN 'partial' END, CASE WHEN status <> 'done' AND refs > 0 THEN 'ahead' END, CASE WHEN status = 'todo' AND refs IS NULL THEN 'open' END], lambda x: x IS NOT NULL) AS buckets
FROM i FULL JOIN r ON i.spec = r.spec AND i.item = r.item""")
def spec_coverage(spark, d):
    part = table(spark, d, "part")
    status = F.when(c("p_size") < 20, "done").when(c("p_size") < 35, "partial").otherwise("todo")
    items = part.filter("p_size < 48").select(c("p_brand").alias("spec"), c("p_partkey").alias("item"), status.alias("status"))
    refs = table(spark, d, "lineitem").filter("l_returnflag = 'R' AND l_discount > 0.07").join(part, c("l_partkey") == c("p_partkey"))
    return audits.coverage(items, refs.select(c("p_brand").alias("spec"), c("p_partkey").alias("item"), c("l_suppkey").alias("path")))


@query("""
WITH l AS (SELECT doc_id AS path, unnest(string_split(text, chr(10))) AS t FROM documents),
n AS (SELECT path, count(*) FILTER (contains(t, ' a ')) AS compliant, count(*) FILTER (NOT contains(t, ' a ') AND regexp_matches(t, '[0-9]{3}')) AS violating FROM l GROUP BY path)
SELECT path, compliant, violating, CASE WHEN compliant + violating > 0 THEN round_even(100.0 * compliant / (compliant + violating), 1) END AS pct FROM n""")
def line_compliance(spark, d):
    lines = table(spark, d, "documents").select(c("doc_id").alias("path"), F.explode(F.split("text", "\n")).alias("text"))
    return audits.compliance(lines, " a ", "[0-9]{3}")


# policies

RULES = [
    ("no-view", "view.*[1-4]7", False, "a", "deny", 1), ("big", "[0-9]{2}", True, "a", "warn", 2),
    ("click", "^click", False, "b", "ask", 3), ("k", "k", True, "b", "allow", 4)
]
COMMAND = "event_type || ' ''' || props || ''' ' || (event_id % 50)"
HITS = f"""
WITH r(rule, pattern, raw, grp, decision, ordinal) AS (VALUES {", ".join(str(x) for x in RULES)}),
s AS (SELECT event_id AS id, {COMMAND} AS command FROM events),
q AS (SELECT id, command, regexp_replace(regexp_replace(command, '''[^'']*''', '''''', 'g'), '"[^"]*"', '""', 'g') AS plain FROM s),
h AS (SELECT id, rule, grp, decision, ordinal, row_number() OVER (PARTITION BY id, grp ORDER BY ordinal) AS nth FROM q JOIN r ON regexp_matches(CASE WHEN raw THEN command ELSE plain END, pattern)),
k AS (SELECT id, rule, decision, ordinal FROM h WHERE nth = 1 OR grp <> 'a')
"""


def commands(spark, d):
    text_ = F.concat(c("event_type"), F.lit(" '"), c("props"), F.lit("' "), (c("event_id") % 50).cast("string"))
    return table(spark, d, "events").select(c("event_id").alias("id"), text_.alias("command"))


def rules(spark):
    return spark.createDataFrame(RULES, "rule string, pattern string, raw boolean, grp string, decision string, ordinal int")


@query(HITS + "SELECT id, rule, decision, CAST(ordinal AS INTEGER) AS ordinal FROM k")
def command_hits(spark, d):
    return policy.evaluate(commands(spark, d), rules(spark), ["a"])


@query(HITS + "SELECT id, arg_max(rule, (list_position(['allow', 'warn', 'ask', 'deny'], decision), -ordinal)) AS rule, "
       "CASE WHEN id % 2 = 0 AND arg_max(decision, (list_position(['allow', 'warn', 'ask', 'deny'], decision), -ordinal)) IN ('allow', 'warn') THEN 'ask' "
       "ELSE arg_max(decision, (list_position(['allow', 'warn', 'ask', 'deny'], decision), -ordinal)) END AS decision FROM k GROUP BY id")  # fmt: skip
def command_decisions(spark, d):
    best = policy.strongest(policy.evaluate(commands(spark, d), rules(spark), ["a"]))
    return best.select("id", "rule", policy.floor_irreversible(c("decision"), c("id") % 2 == 0).alias("decision"))


GRANTS = [
    ("g1", "click", None, "^click [0-9]", None), ("g2", "click", "s1", None, "^a/"),
    ("g3", "view", "s2", "view", "^(a|b)/"), ("g4", "purchase", None, None, None)
]


@query("""
WITH g(g, rule, session, pattern, paths_like) AS (VALUES """ + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in x) + ")" for x in GRANTS) + """),
q AS (SELECT event_id AS request, event_type AS rule, 's' || (user_id % 3) AS session, event_type || ' ' || (event_id % 9) || CASE WHEN event_id % 5 = 0 THEN '; ls' ELSE '' END AS command,
  CASE WHEN event_id % 4 = 0 THEN [] WHEN event_id % 4 = 1 THEN ['a/x'] WHEN event_id % 4 = 2 THEN ['a/x', 'b/y'] ELSE ['c/z'] END AS paths FROM events)
SELECT request, g.g AS "grant" FROM q JOIN g ON q.rule = g.rule WHERE (g.session IS NULL OR g.session = q.session) AND (pattern IS NULL OR (regexp_matches(command, pattern) AND NOT contains(command, ';')))
  AND (paths_like IS NULL OR (len(paths) > 0 AND len(list_filter(paths, lambda p: NOT regexp_matches(p, paths_like))) = 0))""")
def grants_that_apply(spark, d):
    k, empty = c("event_id") % 4, F.array().cast("array<string>")
    paths = F.when(k == 0, empty).when(k == 1, F.array(F.lit("a/x"))).when(
        k == 2, F.array(F.lit("a/x"), F.lit("b/y"))
    ).otherwise(F.array(F.lit("c/z")))
    command = F.concat(
        c("event_type"), F.lit(" "), (c("event_id") % 9).cast("string"),
        F.when(c("event_id") % 5 == 0, "; ls").otherwise("")
    )
    asks = table(spark, d, "events").select(
        c("event_id").alias("request"), c("event_type").alias("rule"),
        F.concat(F.lit("s"), (c("user_id") % 3).cast("string")).alias("session"), command.alias("command"),
        paths.alias("paths")
    )
    return policy.grants_for(
        asks,
        spark.createDataFrame(GRANTS, "grant string, rule string, session string, pattern string, path_regex string")
    )


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k, 'line ' || l_linenumber || ' of ' || l_partkey AS t FROM lineitem)
SELECT l_orderkey AS id, CASE l_orderkey % 4 WHEN 3 THEN 'given' ELSE 'a b' || l_orderkey END AS path, CAST(2 * k - CASE WHEN l_orderkey % 4 = 3 THEN 1 ELSE 0 END AS INTEGER) AS line, t AS text FROM r
UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'given' END, unnest([1, 2]), unnest(['put', 'in']) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) AND o_orderkey % 5 = 0
UNION ALL SELECT o_orderkey, 'given', 1, 'whole' FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) AND o_orderkey % 2 = 1""")
def patch_lines(spark, d):
    k = c("l_orderkey")
    kind = F.when(k % 4 == 0, "+++ b/a b").when(k % 4 == 1, "*** Update File: a b").when(k % 4 == 2, "+++ a b")
    line = F.concat_ws(" ", F.lit("line"), c("l_linenumber"), F.lit("of"), c("l_partkey"))
    held = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("t"))))
    body = F.array_join(F.transform("held", lambda x: F.concat(F.lit("+"), x["t"])), "\n-gone\n")
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(held.alias("held"))
    head = F.when(kind.isNotNull(), F.concat(kind, text("l_orderkey"), F.lit("\n"))).otherwise("")
    return policy.patch_additions(rows.select(
        k.alias("id"), F.concat(head, body).alias("patch"), F.when(k % 2 == 1, "given").alias("path"),
        F.when(k % 5 == 0, "put\nin\n").alias("new_string"), F.lit("whole").alias("content"),
    ))


@query("""
WITH t AS (SELECT p_brand || '-' || p_type AS capability, CASE WHEN p_size % 5 = 0 THEN NULL ELSE '3.' || p_size || '.1' END AS version FROM part),
s AS (SELECT capability, CASE WHEN version IS NULL THEN 'unavailable' WHEN CAST(split_part(version, '.', 2) AS INTEGER) < 25 THEN 'too-old' ELSE 'available' END AS s FROM t),
p AS (SELECT DISTINCT p_brand || '-' || p_type AS capability FROM part WHERE p_size > 20 AND p_retailprice > 905),
n AS (SELECT s.capability, CASE WHEN count(DISTINCT s) > 1 THEN 'limited' ELSE min(s) END AS st, bool_or(p.capability IS NOT NULL) AS there FROM s LEFT JOIN p ON s.capability = p.capability GROUP BY 1)
SELECT capability, CASE WHEN st = 'available' AND NOT there THEN 'limited' ELSE st END AS status,
  list_filter([CASE st WHEN 'limited' THEN 'partial-toolchain' WHEN 'too-old' THEN 'toolchain-too-old' WHEN 'unavailable' THEN 'toolchain-unavailable' END, CASE WHEN NOT there THEN 'project-metadata-unavailable' END], lambda x: x IS NOT NULL) AS reasons FROM n""")
def tool_states(spark, d):
    part, capability = table(spark, d, "part"), F.concat_ws("-", "p_brand", "p_type").alias("capability")
    version = F.when(c("p_size") % 5 != 0, F.concat(F.lit("3."), text("p_size"), F.lit(".1")))
    tools = part.select(capability, c("p_name").alias("tool"), version.alias("version"), F.lit("3.25").alias("least"))
    return policy.tool_status(tools, part.filter("p_size > 20 AND p_retailprice > 905").select(capability))


DIVERGENCE = """
WITH u AS (SELECT l_suppkey AS callee, l_orderkey AS site, bool_or(l_quantity > {q}) AS a, bool_or(l_tax >= 0.02) AS b FROM lineitem GROUP BY ALL),
n AS (SELECT callee, count(*) AS size, count(*) FILTER (a) AS na, count(*) FILTER (b) AS nb FROM u GROUP BY callee),
f AS (SELECT callee, size, 'a' AS option, na AS present FROM n UNION ALL SELECT callee, size, 'b', nb FROM n),
d{q} AS (SELECT callee, option, present, size, present / size AS share FROM f WHERE size >= 3 AND present / size >= 0.5 AND present < size)
"""


def option_calls(spark, d, q):
    used = F.array_compact(F.array(F.when(F.bool_or(c("l_quantity") > q), "a"), F.when(F.bool_or(c("l_tax") >= 0.02), "b")))
    line = dealt(table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_quantity", "l_tax"), "l_suppkey")
    return line.groupBy(c("l_suppkey").alias("callee"), c("l_orderkey").alias("site")).agg(used.alias("options"))


@query(DIVERGENCE.format(q=15) + "SELECT x.callee, option, present, size, round(share, 9) AS share, list(site ORDER BY site) AS stragglers "
       "FROM d15 x JOIN u ON x.callee = u.callee AND NOT CASE WHEN option = 'a' THEN a ELSE b END GROUP BY ALL")  # fmt: skip
def option_divergence(spark, d):
    return policy.divergence(option_calls(spark, d, 15), 0.5).withColumn("share", F.round("share", 9))


@query("WITH x AS (" + DIVERGENCE.format(q=25).strip() + " SELECT * FROM d25), y AS (" + DIVERGENCE.format(q=15).strip() + " SELECT * FROM d15) "
       "SELECT coalesce(x.callee, y.callee) AS callee, coalesce(x.option, y.option) AS option, CASE WHEN x.share IS NULL THEN 'new' WHEN y.share IS NULL THEN 'closed' "
       "WHEN y.share > x.share THEN 'spreading' WHEN y.share < x.share THEN 'receding' ELSE 'steady' END AS course FROM x FULL JOIN y ON x.callee = y.callee AND x.option = y.option")  # fmt: skip
def option_trajectory(spark, d):
    before, after = (policy.divergence(option_calls(spark, d, q), 0.5) for q in (25, 15))
    return policy.trajectory(before, after).select("callee", "option", "course")


@query("""
WITH f AS (SELECT l_orderkey AS path, l_returnflag AS rule, l_linenumber AS s, l_linenumber + 1 AS e, l_partkey FROM lineitem WHERE l_discount > 0.04)
SELECT path, rule, s AS start, e AS "end", l_partkey FROM f WHERE NOT EXISTS (SELECT 1 FROM lineitem m WHERE m.l_discount <= 0.02 AND m.l_orderkey = path AND m.l_returnflag = rule AND m.l_linenumber BETWEEN s AND e)""")
def findings_not_allowed(spark, d):
    line = table(spark, d, "lineitem")
    found = line.filter("l_discount > 0.04").select(
        c("l_orderkey").alias("path"), c("l_returnflag").alias("rule"), c("l_linenumber").alias("start"),
        (c("l_linenumber") + 1).alias("end"), "l_partkey"
    )
    marks = line.filter("l_discount <= 0.02").select(
        c("l_orderkey").alias("path"), c("l_returnflag").alias("rule"), c("l_linenumber").alias("line")
    )
    return policy.suppress(found, marks)


ROUTES = [("num", "[0-9]$", None), ("deep", "/[^/]+/[^/]+/", r"\?"), ("net", r"\.net/", "en")]


@query("WITH r(rule, i, x) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in x) + ")" for x in ROUTES) + ") "
       "SELECT DISTINCT url, rule FROM pages JOIN r ON regexp_matches(url, i) AND NOT coalesce(regexp_matches(url, x), false)")  # fmt: skip
def routed_urls(spark, d):
    rules_ = spark.createDataFrame(ROUTES, "rule string, include string, exclude string")
    return rel.route(table(spark, d, "pages").select("url"), rules_, "url").select("url", "rule")


# registries


@query("""
WITH f AS (SELECT c_custkey AS subject, CAST(c_nationkey AS VARCHAR) AS fingerprint FROM customer),
d AS (SELECT o_custkey AS subject, CASE o_orderkey % 4 WHEN 0 THEN 'fixed' WHEN 1 THEN 'dismissed' WHEN 2 THEN 'accepted' ELSE 'later' END AS disposition, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(c_nationkey + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS VARCHAR) END AS seen,
  row_number() OVER (PARTITION BY o_custkey ORDER BY strftime(o_orderdate, '%Y-%m') DESC, o_orderkey DESC) AS k FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT f.subject, fingerprint, CASE WHEN disposition IS NULL THEN 'new' WHEN disposition = 'fixed' THEN 'regression' WHEN disposition IN ('dismissed', 'accepted') AND seen = fingerprint THEN 'hidden' ELSE 'resurfaced' END AS state
FROM f LEFT JOIN d ON f.subject = d.subject AND k = 1""")
def reviewed_states(spark, d):
    findings = table(spark, d, "customer").select(c("c_custkey").alias("subject"), text("c_nationkey").alias("fingerprint"), "c_nationkey")
    k = c("o_orderkey")
    seen = F.when(k % 5 != 0, (c("c_nationkey") + F.when(k % 3 == 0, 1).otherwise(0)).cast("string"))
    kind = F.when(k % 4 == 0, "fixed").when(k % 4 == 1, "dismissed").when(k % 4 == 2, "accepted").otherwise("later")
    decided = table(spark, d, "orders").join(findings, c("o_custkey") == c("subject")).select(
        "subject", seen.alias("fingerprint"), kind.alias("disposition"),
        F.date_format("o_orderdate", "yyyy-MM").alias("recorded_at"), k.alias("ordinal")
    )
    return registries.reviewed(findings.drop("c_nationkey"), decided)


@query("""
WITH d AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'proposed' WHEN 1 THEN 'accepted' WHEN 2 THEN 'rejected' ELSE 'odd' END AS status,
  CASE WHEN o_orderkey % 9 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date, o_orderkey % 8 = 0 AS revisit, o_orderkey % 2 = 1 AND o_orderkey % 6 = 1 AS embodied, o_orderkey + 1 AS other,
  CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey - 1 END AS back FROM orders)
SELECT id, 'bad status' AS message FROM d WHERE status = 'odd' UNION ALL SELECT id, 'malformed date' FROM d WHERE date = 'soon'
UNION ALL SELECT id, 'proposed too long' FROM d WHERE status = 'proposed' AND date <> 'soon' AND date_diff('day', TRY_CAST(date AS DATE), DATE '1996-01-01') > 30 AND NOT revisit
UNION ALL SELECT id, 'accepted without embodiment' FROM d WHERE status = 'accepted' AND NOT embodied
UNION ALL SELECT id, 'supersedes unknown ' || other FROM d WHERE id % 3 = 0 AND other NOT IN (SELECT id FROM d)
UNION ALL SELECT d.id, 'not superseded back by ' || d.other FROM d JOIN d e ON d.other = e.id WHERE d.id % 3 = 0 AND e.back IS DISTINCT FROM d.id""")
def decision_faults(spark, d):
    k = c("o_orderkey")
    empty = F.array().cast("array<long>")
    rows = table(spark, d, "orders").select(
        k.alias("id"), F.when(
            k % 4 == 0, "proposed"
        ).when(k % 4 == 1, "accepted").when(k % 4 == 2, "rejected").otherwise("odd").alias("status"),
        F.when(k % 9 == 0, "soon").otherwise(
            F.date_format("o_orderdate", "yyyy-MM-dd")
        ).alias("date"), F.when(k % 8 == 0, "yes").alias("revisit"),
        F.when(
            (k % 2 == 1) & (k % 6 == 1), F.array(k)
        ).otherwise(empty).alias("embodied_by"), F.when(k % 3 == 0, F.array(k + 1)).otherwise(empty).alias("supersedes"),
        F.when(k % 7 == 0, k - 1).alias("superseded_by"),
    )
    return registries.decision_drift(rows, "1996-01-01")


@query("SELECT o_orderkey AS id, 'unknown spec ' || (o_orderkey % 40) AS message FROM orders WHERE o_orderkey % 40 NOT IN (SELECT p_partkey FROM part WHERE p_size > 10) "
       "UNION ALL SELECT p_partkey, 'unknown decision ' || (p_size * 3) FROM part WHERE p_size > 10 AND p_size * 3 NOT IN (SELECT s_suppkey FROM supplier)")  # fmt: skip
def broken_registry_links(spark, d):
    plans = table(spark, d, "orders").select(c("o_orderkey").alias("id"), F.array(c("o_orderkey") % 40).alias("specs"))
    specs = table(spark, d, "part").filter("p_size > 10").select(
        c("p_partkey").alias("id"), F.array((c("p_size") * 3).cast("long")).alias("decisions")
    )
    return registries.broken_links(plans, specs, table(spark, d, "supplier").select(c("s_suppkey").alias("id")))


@query("""
WITH a AS (SELECT c_custkey AS artifact, CAST(c_nationkey AS VARCHAR) AS n, TIMESTAMP '1997-01-01' + to_days(CAST(c_custkey % 900 AS INTEGER)) AS w FROM customer),
m AS (SELECT CAST(s_nationkey AS VARCHAR) AS n, max(l_shipdate) AS ts FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber = 1 GROUP BY 1)
SELECT artifact, coalesce(m.ts > w, false) AS stale FROM a LEFT JOIN m ON a.n = m.n""")
def artifact_freshness(spark, d):
    written = F.expr("timestamp '1997-01-01' + make_dt_interval(cast(c_custkey % 900 as int))")
    made = table(spark, d, "customer").select(
        c("c_custkey").alias("artifact"), written.alias("written_at"),
        F.array(F.concat(F.lit("src/"), text("c_nationkey"))).alias("scope")
    )
    path = F.concat(F.lit("src/"), text("s_nationkey"), F.lit("/"), text("l_partkey"))
    commits = table(spark, d, "lineitem").filter("l_linenumber = 1").join(
        table(spark, d, "supplier"), c("l_suppkey") == c("s_suppkey")
    ).select(path.alias("path"), c("l_shipdate").alias("ts"))
    return registries.freshness(made, commits)


@query("SELECT CAST(p_partkey AS VARCHAR) AS token, CASE WHEN p_size % 3 = 0 THEN 'missing_token' WHEN p_size % 3 = 1 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09) THEN 'missing_file' WHEN p_size % 3 = 1 THEN 'ok' ELSE 'missing_file' END AS state FROM part")
def evidence_tokens(spark, d):
    part = table(spark, d, "part")
    path = F.when(c("p_size") % 3 == 1, text("p_partkey")).otherwise("nowhere")
    files = table(spark, d, "lineitem").filter("l_discount > 0.09").select(text("l_partkey").alias("path"))
    return registries.tokens_present(
        part.select(text("p_partkey").alias("token")),
        part.filter("p_size % 3 <> 0").select(text("p_partkey").alias("token"), path.alias("path")), files
    )


@query("""
WITH p AS (SELECT DISTINCT c_custkey AS a, c_custkey + 1 + c_custkey % 3 AS b, c_custkey % 3 = 2 AS lane FROM customer),
s AS (SELECT *, CASE WHEN lag(b) OVER (PARTITION BY lane ORDER BY a) = a THEN 0 ELSE 1 END AS new FROM p), g AS (SELECT *, sum(new) OVER (PARTITION BY lane ORDER BY a) AS chain FROM s),
m AS (SELECT lane, chain, a AS member FROM g UNION SELECT lane, chain, b FROM g)
SELECT member, min(member) OVER (PARTITION BY lane, chain) AS cluster, count(*) OVER (PARTITION BY lane, chain) AS multiplicity FROM m""")
def clone_components(spark, d):
    """Chains through all customers: a key leads to the next of its lane, so without a gap there are two of them, however long."""
    k = c("c_custkey")
    return registries.clone_clusters(table(spark, d, "customer").select(k.alias("a"), (k + 1 + k % 3).alias("b")))


@query("""
WITH p AS (SELECT DISTINCT CASE WHEN p_size % 5 = 0 THEN 'lib' WHEN p_size % 5 = 1 THEN 'lib/a/' || p_partkey WHEN p_size % 5 = 2 THEN 'lib/b/' || p_partkey WHEN p_size % 5 = 3 THEN 'app/' || p_partkey ELSE 'tmp/' || p_partkey END AS path FROM part)
SELECT path, CASE WHEN path LIKE 'lib/a/%' THEN ['alpha'] WHEN path LIKE 'lib/b/%' THEN ['beta', 'gamma'] END AS owner,
  CASE WHEN path LIKE 'lib/a/%' THEN 'registered' WHEN path LIKE 'lib/b/%' THEN 'ambiguous' WHEN path LIKE 'app/%' AND CAST(substr(path, 5) AS BIGINT) % 2 = 0 THEN 'exempt' WHEN path = 'lib' THEN 'partial' ELSE 'uncovered' END AS state FROM p""")
def candidate_dispositions(spark, d):
    k, p = c("p_size") % 5, text("p_partkey")
    path = F.when(k == 0, "lib").when(
        k == 1, F.concat(F.lit("lib/a/"), p)
    ).when(k == 2, F.concat(F.lit("lib/b/"), p)).when(k == 3, F.concat(F.lit("app/"), p)).otherwise(F.concat(F.lit("tmp/"), p))
    paths = table(spark, d, "part").select(path.alias("path")).distinct()
    registry = spark.createDataFrame(
        [("alpha", "lib/a/", 1), ("beta", "lib/b/", 2), ("gamma", "./lib/b/", 3)],
        "owner string, prefix string, ordinal int"
    )
    exempt = table(spark, d, "part").filter("p_partkey % 2 = 0").select(F.concat(F.lit("app/"), p).alias("path"))
    return registries.dispositions(paths, registry, exempt)


@query("SELECT s_name AS path FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_discount > 0.09 AND l_tax > 0.07 AND l_quantity > 40)")
def exemptions_without_candidate(spark, d):
    used = table(spark, d, "lineitem").filter("l_discount > 0.09 AND l_tax > 0.07 AND l_quantity > 40").join(
        table(spark, d, "supplier"), c("l_suppkey") == c("s_suppkey")
    )
    return registries.stale_exemptions(
        table(spark, d, "supplier").select(c("s_name").alias("path")), used.select(c("s_name").alias("path"))
    )


# two-sided checks


@query("SELECT DISTINCT l_partkey AS name, 'missing' AS state FROM lineitem WHERE l_linenumber > 5 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25) "
       "UNION ALL SELECT p_partkey, 'stale' FROM part WHERE p_size < 25 AND p_partkey % 2 = 0 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber > 5)")  # fmt: skip
def symbols_against_spec(spark, d):
    code = table(spark, d, "lineitem").filter("l_linenumber > 5").select(c("l_partkey").alias("name"))
    return inventories.symbol_differences(
        code, table(spark, d, "part").filter("p_size < 25").select(c("p_partkey").alias("name")), c("name") % 2 == 0
    )


FILE = "'n' || {n} || '/f' || {k}"


@query("""
WITH f AS (SELECT 'n' || s_nationkey || '/f' || s_suppkey AS path, 'n' || s_nationkey AS folder, CASE WHEN s_suppkey % 5 = 0 THEN 'go' ELSE 'py' END AS language, s_suppkey FROM supplier),
e AS (SELECT DISTINCT x.path AS importer, CASE WHEN o_orderkey % 50 = 0 THEN y.folder ELSE y.path END AS target FROM orders JOIN f x ON x.s_suppkey = o_custkey JOIN f y ON y.s_suppkey = o_orderkey % (SELECT count(*) FROM supplier) + 1),
h AS (SELECT f.path, importer FROM e JOIN f ON target = f.path UNION SELECT f.path, importer FROM e JOIN f ON target = f.folder),
n AS (SELECT path, list(importer ORDER BY importer) AS l FROM h WHERE path <> importer GROUP BY path)
SELECT f.path, CASE WHEN language = 'py' THEN CAST(coalesce(len(l), 0) AS INTEGER) END AS used_by, CASE WHEN language = 'py' THEN coalesce(l, []) END AS inbound_paths FROM f LEFT JOIN n USING (path)""")
def inbound_importers(spark, d):
    s = table(spark, d, "supplier")
    files = s.select(
        F.concat(F.lit("n"), text("s_nationkey"), F.lit("/f"), text("s_suppkey")).alias("path"),
        F.when(c("s_suppkey") % 5 == 0, "go").otherwise("py").alias("language"), "s_suppkey"
    )
    n = s.agg(F.count("*").alias("n"))
    x, y = files.select(
        c("path").alias("importer"), c("s_suppkey").alias("i")
    ), files.select(c("path").alias("whole"), c("s_suppkey").alias("j"))
    o = table(spark, d, "orders").crossJoin(n).withColumn("j", c("o_orderkey") % c("n") + 1).join(x, c("o_custkey") == c("i")).join(y, "j")
    target = F.when(c("o_orderkey") % 50 == 0, F.regexp_replace("whole", "/.*", "")).otherwise(c("whole"))
    return inventories.inbound(
        files.drop("s_suppkey"), o.select("importer", target.alias("target")),
        spark.createDataFrame([("py",)], "language string")
    )


@query("""
WITH f AS (SELECT s_suppkey AS path, 'n' || s_nationkey AS sub FROM supplier WHERE s_acctbal > 0), e AS (SELECT DISTINCT o_custkey AS importer, o_orderkey % 97 AS imported FROM orders),
j AS (SELECT a.sub AS a, b.sub AS b, imported FROM e LEFT JOIN f a ON importer = a.path LEFT JOIN f b ON imported = b.path),
x AS (SELECT a AS subsystem, 'inside' AS how, NULL AS door FROM j WHERE a = b UNION ALL SELECT b, 'inbound', imported FROM j WHERE a IS DISTINCT FROM b UNION ALL SELECT a, 'outbound', NULL FROM j WHERE a IS DISTINCT FROM b)
SELECT subsystem, count(*) FILTER (how = 'inside') AS inside, count(*) FILTER (how = 'inbound') AS inbound, count(*) FILTER (how = 'outbound') AS outbound, count(DISTINCT door) = 1 AS barrel FROM x WHERE subsystem IS NOT NULL GROUP BY subsystem""")
def subsystem_imports(spark, d):
    owned = table(spark, d, "supplier").filter("s_acctbal > 0").select(
        text("s_suppkey").alias("path"), F.concat(F.lit("n"), text("s_nationkey")).alias("subsystem")
    )
    edges = table(spark, d, "orders").select(text("o_custkey").alias("importer"), (c("o_orderkey") % 97).cast("string").alias("imported"))
    return inventories.import_map(edges, owned)


@query("WITH r(reference, a) AS (VALUES ('MIT License', 'src1'), ('Apache License', 'src'), ('GNU', 'none')) "
       "SELECT source || '/' || doc_id AS path, reference, starts_with(source, a) AS allowed FROM documents JOIN r ON contains(text, reference)")  # fmt: skip
def legacy_mentions(spark, d):
    files = table(spark, d, "documents").select(F.concat_ws("/", "source", "doc_id").alias("path"), "text")
    refs = spark.createDataFrame(
        [("MIT License", ["src1"]), ("Apache License", ["src"]), ("GNU", ["none"])],
        "reference string, allowed array<string>"
    )
    return inventories.legacy_references(files, refs)


@query("""
WITH d AS (SELECT n_name AS name, n_nationkey AS o FROM nation WHERE n_nationkey < 20 UNION ALL SELECT n_name, 100 FROM nation WHERE n_nationkey = 3), p AS (SELECT n_name AS name FROM nation WHERE n_nationkey > 4),
l AS (SELECT DISTINCT name FROM (SELECT name, max(name) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM d) WHERE b > name)
SELECT name, 'undeclared' AS state FROM p WHERE name NOT IN (SELECT name FROM d) UNION ALL SELECT DISTINCT name, 'unproduced' FROM d WHERE name NOT IN (SELECT name FROM p)
UNION ALL SELECT name, 'duplicate' FROM d GROUP BY name HAVING count(*) > 1 UNION ALL SELECT name, 'out_of_order' FROM l""")
def contract_producers(spark, d):
    n = table(spark, d, "nation")
    declared = n.filter("n_nationkey < 20").select(
        c("n_name").alias("name"), c("n_nationkey").alias("ordinal")
    ).union(n.filter("n_nationkey = 3").select("n_name", F.lit(100)))
    return inventories.producers(declared, n.filter("n_nationkey > 4").select(c("n_name").alias("name")))


@query("""
WITH s AS (SELECT c_custkey AS surface, CASE WHEN c_custkey % 3 = 0 THEN 'deferred' ELSE 'kept' END AS state, c_custkey % 60 AS did, c_custkey % 90 AS ev FROM customer WHERE c_acctbal >= 0
  UNION ALL SELECT c_custkey, 'kept', NULL, NULL FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT -c_custkey, 'kept', NULL, NULL FROM customer WHERE c_custkey < 4),
n AS (SELECT surface, count(*) AS n FROM s GROUP BY 1)
SELECT coalesce(c_custkey, surface) AS surface, CASE WHEN c_custkey IS NULL THEN 'unknown' WHEN n IS NULL THEN 'missing' ELSE 'repeated' END AS fault FROM customer FULL JOIN n ON c_custkey = surface WHERE c_custkey IS NULL OR n IS NULL OR n > 1
UNION ALL SELECT surface, 'unknown_id' FROM s WHERE state = 'deferred' AND (did IS NULL OR did NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey < 40))
UNION ALL SELECT surface, 'no_evidence' FROM s WHERE ev IS NOT NULL AND ev NOT IN (SELECT p_partkey FROM part WHERE p_partkey < 70)""")
def surface_completeness(spark, d):
    k, none = c("c_custkey"), F.lit(None).cast("long")
    cust = table(spark, d, "customer")
    said = cust.filter("c_acctbal >= 0").select(
        k.alias("surface"), F.when(k % 3 == 0, "deferred").otherwise("kept").alias("state"),
        (k % 60).alias("deferred_id"), (k % 90).alias("evidence")
    )
    said = said.union(
        cust.filter("c_mktsegment = 'BUILDING'").select(k, F.lit("kept"), none, none)
    ).union(cust.filter("c_custkey < 4").select(-k, F.lit("kept"), none, none))
    ids = table(spark, d, "supplier").filter("s_suppkey < 40").select(c("s_suppkey").alias("id"))
    return inventories.closed_domain(
        cust.select(k.alias("surface")), said, ids,
        table(spark, d, "part").filter("p_partkey < 70").select(c("p_partkey").alias("path"))
    )


@query("SELECT DISTINCT url AS path FROM pages WHERE regexp_matches(url, 'example') AND NOT regexp_matches(url, '/de/') AND url NOT IN (SELECT url FROM pages WHERE contains(url, '7'))")
def stray_pages(spark, d):
    pages = table(spark, d, "pages").select("page_id", c("url").alias("path"))
    return inventories.stray_hits(pages, pages.filter("contains(path, '7')"), "example", "/de/")


@query("SELECT p_partkey AS path, coalesce(n, 0) AS hits, coalesce(n, 0) > 0 AS recalled FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_discount > 0.08 GROUP BY 1) ON l_partkey = p_partkey")
def planted_recall(spark, d):
    hits = table(spark, d, "lineitem").filter("l_discount > 0.08").select(c("l_partkey").alias("path"))
    return inventories.recalled(table(spark, d, "part").select(c("p_partkey").alias("path")), hits)


@query("SELECT l_suppkey AS path, list(DISTINCT l_returnflag ORDER BY l_returnflag) AS covered_by, list(DISTINCT l_returnflag || '#' || l_linenumber ORDER BY l_returnflag || '#' || l_linenumber) AS ids FROM lineitem WHERE l_discount > 0.05 GROUP BY 1")
def spec_index(spark, d):
    refs = table(spark, d, "lineitem").filter("l_discount > 0.05")
    return inventories.reverse_index(
        refs.select(c("l_returnflag").alias("spec"), text("l_linenumber").alias("item"), c("l_suppkey").alias("path"))
    )


@query("SELECT p_brand AS spec, count(*) FILTER (p_size < 10) AS small, count(*) FILTER (p_size >= 10) AS large, 0::BIGINT AS none FROM part GROUP BY 1")
def spec_sections(spark, d):
    rows = table(spark, d, "part").select(c("p_brand").alias("spec"), F.when(c("p_size") < 10, "small").otherwise("large").alias("section"))
    return inventories.section_counts(rows, ["small", "large", "none"])


@query("""
WITH r AS (SELECT l_partkey AS name, l_returnflag AS category, 'f' || l_suppkey AS path FROM lineitem WHERE l_discount > 0.05 AND 'f' || l_suppkey <> 'f' || (l_partkey % 50)),
n AS (SELECT name, count(*) AS total, list(DISTINCT path ORDER BY path) AS files, count(*) FILTER (category = 'A') AS a FROM r GROUP BY name)
SELECT p_partkey AS name, coalesce(total, 0) AS total_refs, coalesce(files, []) AS ref_files, coalesce(a, 0) AS in_a FROM part LEFT JOIN n ON name = p_partkey""")
def caller_counts(spark, d):
    refs = table(spark, d, "lineitem").filter("l_discount > 0.05").select(
        c("l_partkey").alias("name"), F.concat(F.lit("f"), text("l_suppkey")).alias("path"),
        c("l_returnflag").alias("category")
    )
    own = table(spark, d, "part").select(
        c("p_partkey").alias("name"), F.concat(F.lit("f"), (c("p_partkey") % 50).cast("string")).alias("path")
    )
    rows = inventories.caller_info(refs, own)
    return rows.select("name", "total_refs", "ref_files", F.coalesce(F.try_element_at("categorized", F.lit("A")), F.lit(0)).alias("in_a"))


# joins with ranges, calls and imports


@query("""
WITH p AS (SELECT l_partkey AS file, l_linenumber AS line, row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY l_orderkey) AS k, l_orderkey AS o FROM lineitem WHERE l_returnflag = 'R'),
f AS (SELECT l_partkey AS file, l_linenumber AS line, row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY l_orderkey) AS k, l_orderkey AS o FROM lineitem WHERE l_returnflag = 'A')
SELECT CAST(p.file AS VARCHAR) AS file, CAST(f.o AS VARCHAR) AS finding, CAST(p.o AS VARCHAR) AS instance FROM p JOIN f USING (file, line, k)""")
def planted_matches(spark, d):
    rows = table(spark, d, "lineitem").select(
        c("l_orderkey").alias("id"), text("l_partkey").alias("file"), c("l_linenumber").alias("line"),
        c("l_orderkey").alias("ordinal"), "l_returnflag"
    )
    return matching.match_findings(rows.filter("l_returnflag = 'R'"), rows.filter("l_returnflag = 'A'"))


@query("""
WITH p AS (SELECT l_partkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), f AS (SELECT l_partkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL),
t AS (SELECT CAST(sum(least(p.n, f.n)) AS BIGINT) AS tp FROM p JOIN f USING (l_partkey, l_linenumber)), a AS (SELECT (SELECT tp FROM t) AS tp, (SELECT CAST(sum(n) AS BIGINT) FROM p) AS pn, (SELECT CAST(sum(n) AS BIGINT) FROM f) AS fn_)
SELECT tp, fn_ - tp AS fp, pn - tp AS fn, tp / fn_ AS precision, tp / pn AS recall, CASE WHEN fn_ = tp AND pn = tp THEN 'pass' ELSE 'fail' END AS verdict FROM a""")
def planted_grade(spark, d):
    rows = table(spark, d, "lineitem").select(
        c("l_orderkey").alias("id"), text("l_partkey").alias("file"), c("l_linenumber").alias("line"),
        c("l_orderkey").alias("ordinal"), "l_returnflag"
    )
    return matching.grade(rows.filter("l_returnflag = 'R'"), rows.filter("l_returnflag = 'A'"))


@query("""
WITH RECURSIVE p AS (SELECT l_partkey AS file, l_linenumber AS line, l_orderkey * 8 + l_linenumber AS o FROM lineitem WHERE l_returnflag = 'R'),
f AS (SELECT l_partkey AS file, l_linenumber AS line, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 8 + l_linenumber) AS k FROM lineitem WHERE l_returnflag = 'A'),
g(file, k, taken) AS (SELECT DISTINCT file, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM f
  UNION ALL SELECT g.file, f.k, CASE WHEN min(p.o) IS NULL THEN g.taken ELSE list_append(g.taken, min(p.o)) END FROM g JOIN f ON f.file = g.file AND f.k = g.k + 1
    LEFT JOIN p ON p.file = f.file AND abs(p.line - f.line) <= 1 AND NOT list_contains(g.taken, p.o) GROUP BY g.file, f.k, g.taken),
n AS (SELECT CAST(sum(len(t)) AS BIGINT) AS tp FROM (SELECT file, max_by(taken, k) AS t FROM g GROUP BY file)), a AS (SELECT (SELECT tp FROM n) AS tp, (SELECT count(*) FROM p) AS pn, (SELECT count(*) FROM f) AS fn_)
SELECT tp, fn_ - tp AS fp, pn - tp AS fn, tp / fn_ AS precision, tp / pn AS recall, CASE WHEN fn_ = tp AND pn = tp THEN 'pass' ELSE 'fail' END AS verdict FROM a""")
def planted_near(spark, d):
    """``planted_grade`` with a tolerance of one line, greedy in the order of arrival."""
    rows = table(spark, d, "lineitem").select(
        c("l_orderkey").alias("id"), text("l_partkey").alias("file"), c("l_linenumber").alias("line"),
        (c("l_orderkey") * 8 + c("l_linenumber")).alias("ordinal"), "l_returnflag"
    )
    return matching.grade(rows.filter("l_returnflag = 'R'"), rows.filter("l_returnflag = 'A'"), 1)


@query("""
WITH i AS (SELECT row_number() OVER () AS id, l_orderkey AS f, l_linenumber AS s, l_linenumber + 1 AS e, l_partkey FROM lineitem WHERE l_returnflag = 'N'), b AS (SELECT l_orderkey AS f, l_linenumber AS s, l_linenumber + 2 AS e, l_linenumber AS name FROM lineitem WHERE l_returnflag <> 'N' AND l_linestatus = 'F'),
h AS (SELECT id, i.f, i.s, i.e, l_partkey, arg_max(name, (b.s, -b.e)) AS owner FROM i LEFT JOIN b ON i.f = b.f AND i.s >= b.s AND i.e <= b.e GROUP BY ALL)
SELECT f AS path, s AS start, e AS "end", l_partkey, owner, CASE WHEN owner IS NULL THEN CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.f = h.f AND b.s <= h.e AND b.e >= h.s) THEN 'crosses' ELSE 'outside' END END AS reason FROM h""")
def clone_span_owners(spark, d):
    line, n = table(spark, d, "lineitem"), c("l_linenumber")
    items = line.filter("l_returnflag = 'N'").select(c("l_orderkey").alias("path"), n.alias("start"), (n + 1).alias("end"), "l_partkey")
    spans = line.filter("l_returnflag <> 'N' AND l_linestatus = 'F'").select(
        c("l_orderkey").alias("path"), n.alias("start"), (n + 2).alias("end"), n.alias("name")
    )
    return intervals.placed(items, spans, ["path"], "name").withColumnRenamed("name", "owner")


@query("SELECT event_id, user_id, handler FROM (SELECT *, first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS handler FROM events) WHERE event_type = 'view'")
def next_purchase(spark, d):
    rows = rel.first_after(table(spark, d, "events"), c("event_type") == "purchase", ["user_id"], ["ts", "event_id"], "event_id", "handler")
    return rows.filter("event_type = 'view'").select("event_id", "user_id", "handler")


@query("""
WITH d AS (SELECT DISTINCT 'm' || (p_partkey // 4) AS name, p_brand || '.m' || (p_partkey // 4) AS q, 's' || p_size || '.py' AS file, p_brand AS cls FROM part),
e AS (SELECT DISTINCT 's' || p_size || '.py' AS file, p_brand AS cls, p_brand || '.m' || (p_partkey // 4) AS q, l_linenumber % 3 = 1 AS own,
  CASE l_linenumber % 3 WHEN 0 THEN 'x.m' || ((l_partkey + l_suppkey) // 4) WHEN 1 THEN 'm' || (l_partkey // 4) ELSE p_brand || '.m' || ((l_partkey + l_suppkey) // 4) END AS callee FROM lineitem JOIN part ON l_partkey = p_partkey),
w AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.file = e.file AND d.q = e.cls || '.' || e.callee) THEN 1 ELSE 2 END AS how FROM e WHERE own
  UNION ALL SELECT *, CASE WHEN callee IN (SELECT name FROM d) OR callee IN (SELECT q FROM d) THEN 3 ELSE 4 END FROM e WHERE NOT own),
t AS (SELECT w.file, w.q, d.file AS f2, d.q AS q2 FROM w JOIN d ON how = 1 AND d.file = w.file AND d.q = w.cls || '.' || w.callee
  UNION SELECT w.file, w.q, d.file, d.q FROM w JOIN d ON how = 2 AND d.cls = w.cls AND d.name = w.callee
  UNION SELECT w.file, w.q, d.file, d.q FROM w JOIN d ON how = 3 AND d.name = w.callee UNION SELECT w.file, w.q, d.file, d.q FROM w JOIN d ON how = 3 AND d.q = w.callee
  UNION SELECT w.file, w.q, d.file, d.q FROM w JOIN d ON how = 4 AND contains(w.callee, '.') AND d.name = split_part(w.callee, '.', -1))
SELECT DISTINCT file || '::' || q AS caller, f2 || '::' || q2 AS callee FROM t WHERE file <> f2 OR q <> q2""")
def resolved_calls(spark, d):
    part = table(spark, d, "part")
    named = lambda k: F.concat(F.lit("m"), F.floor(k / 4).cast("string"))
    name, file = named(c("p_partkey")), F.concat(F.lit("s"), text("p_size"), F.lit(".py"))
    defs = part.select(F.concat_ws(".", "p_brand", name).alias("qualified_name"), name.alias("name"), file.alias("file"), c("p_brand").alias("parent_class"))
    n, far = c("l_linenumber") % 3, named(c("l_partkey") + c("l_suppkey"))
    called = F.when(n == 0, F.concat(F.lit("x."), far)).when(n == 1, named(c("l_partkey"))).otherwise(F.concat_ws(".", "p_brand", far))
    edges = dealt(table(spark, d, "lineitem"), "l_partkey").join(part, c("l_partkey") == c("p_partkey")).select(
        F.concat(file, F.lit("::"), F.concat_ws(".", "p_brand", name)).alias("caller"), called.alias("callee_name"),
        F.when(n == 1, "self").otherwise("name").alias("call_style"), file.alias("caller_file"), c("p_brand").alias("caller_class")
    )
    return calls.resolve_calls(edges, defs)


@query("""
WITH f AS (SELECT 'f' || p_partkey AS path FROM part WHERE p_size < 30), s AS (SELECT DISTINCT 'f' || l_partkey AS importer, 's' || l_suppkey AS spec, l_suppkey AS k FROM lineitem WHERE l_linenumber = 1),
c AS (SELECT importer, spec, 'f' || (k * 2) AS path, 0 AS nth FROM s UNION ALL SELECT importer, spec, 'f' || (k + 1), 1 FROM s), b AS (SELECT importer, spec, arg_min(c.path, nth) AS direct FROM c JOIN f ON c.path = f.path GROUP BY ALL),
a AS (SELECT 's' || s_suppkey AS spec, min('f' || s_nationkey) AS alias FROM supplier WHERE s_acctbal > 0 GROUP BY 1)
SELECT s.importer, s.spec, coalesce(direct, alias) AS target FROM s LEFT JOIN b USING (importer, spec) LEFT JOIN a ON s.spec = a.spec WHERE coalesce(direct, alias) IS NOT NULL AND coalesce(direct, alias) <> s.importer""")
def resolved_imports(spark, d):
    k = c("l_suppkey")
    cand = F.array(F.concat(F.lit("f"), (k * 2).cast("string")), F.concat(F.lit("f"), (k + 1).cast("string")))
    specs = table(spark, d, "lineitem").filter("l_linenumber = 1").select(
        F.concat(F.lit("f"), text("l_partkey")).alias("importer"),
        F.concat(F.lit("s"), text("l_suppkey")).alias("spec"), cand.alias("candidates")
    ).distinct()
    files = table(spark, d, "part").filter("p_size < 30").select(F.concat(F.lit("f"), text("p_partkey")).alias("path"))
    s = table(spark, d, "supplier")
    alias = F.concat(F.lit("s"), text("s_suppkey"))
    names = s.filter("s_acctbal > 0").select(alias.alias("spec"), F.concat(F.lit("f"), text("s_nationkey")).alias("path"))
    odd = s.filter("s_acctbal <= 0").select(alias.alias("spec"), F.explode(F.array(F.lit("f1"), F.lit("f2"))).alias("path"))
    return rel.resolve_imports(specs, files, names.union(odd))
