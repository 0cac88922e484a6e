"""Queries: readers, sinks and facts of sources, on texts made of the driver's tables, each with SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from repolith import session
from repolith.catalog import query, table
from repolith.operators import checks, clones, facts, policy, symbols
from repolith.operators import relational as rel
from repolith.sources import logs, metadata, registries, sinks

c = F.col


def text(x):
    return c(x).cast("string")


def said(*parts):
    """Texts and columns joined."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# documents


def cards(spark, d, faulty=True):
    """A Markdown document for each part: nested front matter, and (``faulty``) for some none, CRLF or an unreadable one."""
    p = table(spark, d, "part")
    head = said(
        "---\nid: ", c("p_partkey"), "\ntitle: \"Part: ", c("p_name"), "\"\nsize:\n  n: ", c("p_size"),
        "\n  tags: [a, '", c("p_type"), "']\nlinks:\n- one\n- two: ", c("p_partkey") + 1, "\n---\n"
    )
    whole = said(head, "# About\n", c("p_brand"), "\n")
    k = c("p_partkey") % 10
    broken = said("---\nid: ", c("p_partkey"), "\n no mapping here\n---\nx")
    shape = F.when(k == 0, said("# About\n", c("p_brand"))).when(
        k == 1, said("\ufeff", F.replace(whole, F.lit("\n"), F.lit("\r\n")))
    ).when(k == 2, broken).otherwise(whole)
    shape = shape if faulty else whole
    return p.select(said("docs/", c("p_partkey"), ".md").alias("path"), shape.alias("text"))


@query("""
SELECT 'docs/' || p_partkey || '.md' AS path, p_partkey % 10 NOT IN (0, 2) AS has_frontmatter, CASE WHEN p_partkey % 10 NOT IN (0, 2) THEN p_size END AS n, CASE WHEN p_partkey % 10 NOT IN (0, 2) THEN 'Part: ' || p_name END AS title,
  CASE WHEN p_partkey % 10 NOT IN (0, 2) THEN p_type END AS kind, CASE WHEN p_partkey % 10 NOT IN (0, 2) THEN CAST(p_partkey + 1 AS VARCHAR) END AS two, p_partkey % 10 = 2 AS broken,
  CASE WHEN p_partkey % 10 = 0 THEN '# About' || chr(10) || p_brand WHEN p_partkey % 10 <> 2 THEN '# About' || chr(10) || p_brand || chr(10) END AS body FROM part""")
def front_matter(spark, d):
    get = lambda p: F.get_json_object("metadata", p)
    rows = registries.documents(cards(spark, d))
    return rows.select(
        "path", "has_frontmatter", get("$.size.n").cast("int").alias("n"), get("$.title").alias("title"),
        get("$.size.tags[1]").alias("kind"), get("$.links[1].two").alias("two"), c("error").isNotNull().alias("broken"),
        F.when(c("error").isNull(), c("body")).alias("body")
    )


@query("SELECT 'docs/' || p_partkey || '.md' AS path, p_partkey AS id, p_size AS n, ['a', p_type] AS tags FROM part WHERE p_partkey % 10 NOT IN (0, 2)")
def card_registry(spark, d):
    rows = registries.registry(cards(spark, d), "id long, size struct<n: int, tags: array<string>>")
    return rows.select("path", "id", c("size.n").alias("n"), c("size.tags").alias("tags"))


@query("SELECT 'docs/' || p_partkey || '.md' AS path, CAST(p_partkey AS VARCHAR) AS id, 'Part: ' || p_name AS title, NULL::VARCHAR AS owner FROM part")
def card_catalog(spark, d):
    return registries.catalog(cards(spark, d, faulty=False), ["id", "title", "owner"])


@query("SELECT 'docs/' || p_partkey || '.md' AS path, p_partkey % 10 <> 0 AS has_frontmatter, CASE WHEN p_partkey % 10 <> 0 THEN CAST(p_partkey AS VARCHAR) END AS id FROM part")
def flat_front_matter(spark, d):
    rows = logs.front_matter(cards(spark, d))
    return rows.select("path", "has_frontmatter", F.try_element_at("metadata", F.lit("id")).alias("id"))


@query("SELECT 'doc' AS kind, 'docs/' || p_partkey || '.md' AS path, CASE WHEN p_partkey % 10 = 0 THEN 'About' WHEN p_partkey % 10 = 2 THEN 'id: ' || p_partkey ELSE 'id: ' || p_partkey END AS summary FROM part "
       "UNION ALL SELECT 'seven', 'docs/' || p_partkey || '.md', CASE WHEN p_partkey % 10 = 0 THEN 'About' ELSE 'id: ' || p_partkey END FROM part WHERE p_partkey % 10 = 7")  # fmt: skip
def artifact_lines(spark, d):
    files = cards(spark, d).withColumn("text", F.regexp_replace("text", "^\ufeff", ""))
    return metadata.artifacts(files, [("doc", r"\.md$"), ("seven", r"7\.md$")])


@query("SELECT 'p' || (p_size % 3) AS language, '.x' || p_partkey AS suffix FROM part")
def profile_suffixes(spark, d):
    doc = said('{"id": "p', c("p_size") % 3, '", "suffixes": [".x', c("p_partkey"), '"], "more": 1}')
    return metadata.profiles(table(spark, d, "part").select(text("p_partkey").alias("path"), doc.alias("text")))


@query("SELECT '.x' || (p_partkey % 900) AS suffix, list(DISTINCT 'p' || (p_size % 3) ORDER BY 'p' || (p_size % 3)) AS languages FROM part GROUP BY 1 HAVING count(DISTINCT p_size % 3) > 1")
def contested(spark, d):
    return metadata.contested_suffixes(
        table(spark, d, "part").select(said("p", c("p_size") % 3).alias("language"), said(".x", c("p_partkey") % 900).alias("suffix"))
    )


@query("SELECT CAST(event_id AS VARCHAR) AS path, CASE WHEN event_id % 5 > 1 THEN event_type END AS recipe, CASE WHEN event_id % 5 > 1 THEN CAST(user_id AS INTEGER) END AS budget, CASE event_id % 5 WHEN 0 THEN 'unreadable' WHEN 1 THEN 'unreadable' WHEN 2 THEN 'unknown' ELSE 'staged' END AS status FROM events")
def queue_rows(spark, d):
    k = c("event_id") % 5
    doc = said('{"recipe": "', c("event_type"), '", "budget": ', c("user_id"), F.when(k == 2, "").otherwise(', "status": "staged"'), "}")
    files = table(spark, d, "events").select(
        text("event_id").alias("path"),
        F.when(k == 0, "[1, 2]").when(k == 1, '{"recipe": ').otherwise(doc).alias("text")
    )
    return metadata.queue_items(files, "recipe string, budget int")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS path, CASE WHEN s_suppkey % 3 = 0 THEN [] WHEN s_suppkey % 3 = 1 THEN ['net8.0'] ELSE ['net8.0', 'net9.0'] END AS frameworks, CASE WHEN s_suppkey % 3 > 0 THEN ['Lib@' || s_nationkey] ELSE [] END AS packages, s_suppkey % 3 > 0 AS readable FROM supplier")
def project_files(spark, d):
    k = c("s_suppkey") % 3
    frames = F.when(k == 1, "<TargetFramework>net8.0</TargetFramework>").otherwise("<TargetFrameworks>net8.0;net9.0</TargetFrameworks>")
    doc = said(
        "<Project><PropertyGroup>", frames, '</PropertyGroup><ItemGroup><PackageReference Include="Lib" Version="',
        c("s_nationkey"), '"/></ItemGroup></Project>'
    )
    found = metadata.xml_projects(
        table(spark, d, "supplier").select(text("s_suppkey").alias("path"), F.when(k == 0, "<html>").otherwise(doc).alias("text"))
    )
    return found.drop("references")


@query("SELECT 'js' AS format, CAST(p_size AS INTEGER) AS lines, 'a' || least(p_partkey, p_size) AS first, 'a' || greatest(p_partkey, p_size) AS second FROM part WHERE length(CAST(p_partkey AS VARCHAR)) = length(CAST(p_size AS VARCHAR)) AND p_partkey <> p_size")
def clone_pairs(spark, d):
    end = lambda k, n: said('{"name": "a', n, '", "start": 1, "end": 9}')
    doc = said(
        '{"duplicates": [{"format": "js", "lines": ', c("p_size"), ', "firstFile": ', end(1, c("p_partkey")),
        ', "secondFile": ', end(2, c("p_size")), "}]}"
    )
    part = table(spark, d, "part").filter("length(p_partkey) = length(p_size) AND p_partkey <> p_size")
    found = registries.clone_report(part.select(text("p_partkey").alias("path"), doc.alias("text")))
    return found.select("format", "lines", c("first.name").alias("first"), c("second.name").alias("second"))


@query("SELECT n_name AS name, 'repeated' AS fault FROM nation WHERE n_nationkey = 4 UNION ALL SELECT n_name, 'revision' FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT n_name, 'source' FROM nation WHERE n_nationkey % 7 = 0 "
       "UNION ALL SELECT n_name, 'language' FROM nation WHERE n_regionkey = 2 UNION ALL SELECT n_name, 'language' FROM nation WHERE n_nationkey = 4 AND n_regionkey = 2 UNION ALL SELECT n_name, 'slice' FROM nation WHERE n_nationkey = 0")  # fmt: skip
def corpus_manifest_faults(spark, d):
    k = c("n_nationkey")
    rows = table(spark, d, "nation").select(
        c("n_name").alias("name"), F.when(
            k % 7 == 0, "git@host"
        ).otherwise("https://host/x").alias("source"), F.when(k % 5 == 0, "main").otherwise(F.sha1(c("n_name"))).alias("revision"),
        F.when(c("n_regionkey") == 2, "cobol").otherwise("go").alias("language"), k.alias("slice"),
    )
    return registries.corpus_faults(rows.union(rows.filter("slice = 4")), ["go", "python"])


@query("SELECT n_name AS name, n_regionkey AS slice FROM nation WHERE n_nationkey IN (1, 2, 3) AND n_regionkey = 1")
def selected_corpus(spark, d):
    n = table(spark, d, "nation")
    names = [r[0] for r in n.filter("n_nationkey IN (1, 2, 3)").select("n_name").collect()]
    return metadata.select_corpus(n.select(c("n_name").alias("name"), c("n_regionkey").alias("slice")), names, 1)


@query("""
WITH f AS (SELECT CASE doc_id % 5 WHEN 0 THEN 'lib/a' WHEN 1 THEN 'lib/a/.git' WHEN 2 THEN 'app' WHEN 3 THEN 'app/vendor' ELSE 'other' END || '/f' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.md' END AS path, doc_id FROM documents)
SELECT path, CASE WHEN path LIKE 'lib/%' THEN 'lib' ELSE 'app' END AS root FROM f WHERE doc_id % 5 IN (0, 2) AND path LIKE '%.py'""")
def scoped_search(spark, d):
    k = c("doc_id") % 5
    folder = F.when(k == 0, "lib/a").when(k == 1, "lib/a/.git").when(k == 2, "app").when(k == 3, "app/vendor").otherwise("other")
    files = table(spark, d, "documents").select(
        said(folder, "/f", c("doc_id"), F.when(c("doc_id") % 2 == 0, ".py").otherwise(".md")).alias("path")
    )
    return registries.search_roots(files.union(files), ["./lib/", "app", "lib"], [".py"], ["vendor"]).select("path", "root")


# logs


@query("SELECT event_id, 'def' AS kind, event_type AS name, user_id AS n FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 'edge', event_type, NULL FROM events WHERE event_id % 3 = 1")
def typed_records(spark, d):
    k = c("event_id") % 3
    kind = F.when(k == 0, "def").when(k == 1, "edge").otherwise("other")
    rows = table(spark, d, "events").select(
        "event_id",
        said('{"type": "', kind, '", "name": "', c("event_type"), '", "n": ', c("user_id"), "}").alias("raw")
    )
    found = registries.records(rows, {"def": "name string, n long", "edge": "name string"})
    a = found["def"].select("event_id", F.lit("def").alias("kind"), "name", "n")
    return a.union(found["edge"].select("event_id", F.lit("edge"), "name", F.lit(None).cast("long")))


@query("SELECT event_id, user_id, copy FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY copy, event_id) AS k FROM (SELECT *, 0 AS copy FROM events WHERE value > 20 UNION ALL SELECT *, 1 FROM events)) WHERE k = 1")
def merged_copies(spark, d):
    e = table(spark, d, "events").withColumn("ordinal", c("event_id"))
    return logs.union_copies([e.filter("value > 20"), e], ["user_id", "event_type"]).select("event_id", "user_id", "copy")


@query("SELECT event_id AS ordinal, 'value' AS field, 'out of range' AS message FROM events WHERE value IS NULL OR value > 90 UNION ALL SELECT event_id, 'type', 'unknown' FROM events WHERE event_type NOT IN ('click', 'view')")
def schema_errors(spark, d):
    rows = table(spark, d, "events").withColumnRenamed("event_id", "ordinal")
    return logs.validate(rows, [("value", c("value") <= 90, "out of range"), ("type", c("event_type").isin("click", "view"), "unknown")])


@query("WITH r AS (SELECT event_type AS source_file, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS ordinal, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT source_file, ordinal FROM r WHERE n <= 1990 OR ordinal > n - 500")
def trimmed_logs(spark, d):
    line = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id"))  # a log's lines are numbered where it is read
    return sinks.trim_log(table(spark, d, "events").select(c("event_type").alias("source_file"), line.cast("long").alias("ordinal")), 1990, 500)


def written_log(spark, d):
    """A log of all events as JSON lines in files of ascending ids: after every fifth event a blank line, after every seventh a broken one."""
    k = c("event_id")
    line = F.to_json(F.struct("event_id", "event_type"))
    line = F.concat(line, F.when(k % 5 == 0, "\n  ").otherwise(""), F.when(k % 7 == 0, "\n{broken").otherwise(""))
    path = f"{session.shared_dir(spark)}/repolith/{uuid.uuid4().hex}"
    table(spark, d, "events").repartitionByRange(8, "event_id").sortWithinPartitions("event_id").select(line.alias("value")).write.text(path)
    return path


@query("SELECT event_id, event_type, CAST(sum(1 + (event_id % 5 = 0)::INT + (event_id % 7 = 0)::INT) OVER (ORDER BY event_id) - (event_id % 5 = 0)::INT - (event_id % 7 = 0)::INT AS BIGINT) AS line FROM events")
def json_log_rows(spark, d):
    """The line of each event, over all files: a file's own line numbers, after the lines of the files before it."""
    path = written_log(spark, d)
    rows = logs.read_jsonl(spark, path, "event_id long, event_type string").filter("NOT bad")
    each = logs.numbered_lines(spark, path).groupBy("source_file").agg(F.max("ordinal").alias("n"))
    first = rows.groupBy("source_file").agg(F.min("event_id").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # of 8 files
    files = each.join(first, "source_file").withColumn("before", before)
    return rows.join(F.broadcast(files), "source_file").select("event_id", "event_type", (c("ordinal") + c("before")).alias("line"))


@query("SELECT CAST(sum((event_id % 7 = 0)::INT) AS BIGINT) AS bad, CAST(sum(1 + (event_id % 7 = 0)::INT) AS BIGINT) AS lines FROM events")
def json_log_faults(spark, d):
    found = logs.bad_rows(logs.read_jsonl(spark, written_log(spark, d), "event_id long, event_type string"))
    return found.agg(F.sum("bad").alias("bad"), F.sum("lines").alias("lines"))


@query("SELECT c_custkey AS id, c_nationkey AS nation FROM customer")
def keyed_entries(spark, d):
    """A JSON document for each nation, ``{"entries": {key: entry}}``, and an empty file."""
    entry = F.map_from_entries(F.collect_list(F.struct(text("c_custkey"), F.struct("c_custkey", "c_nationkey"))))
    docs = table(spark, d, "customer").groupBy("c_nationkey").agg(F.to_json(F.struct(entry.alias("entries"))).alias("value"))
    path = f"{session.shared_dir(spark)}/repolith/{uuid.uuid4().hex}"
    docs.write.partitionBy("c_nationkey").text(path)
    rows = logs.read_keyed(spark, path, "c_custkey long, c_nationkey int")
    return rows.select(c("key").cast("long").alias("id"), c("c_nationkey").alias("nation"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0")
def replaced_rows(spark, d):
    """What is read after two versions were published one after the other."""
    path = f"{session.shared_dir(spark)}/repolith/{uuid.uuid4().hex}"
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name")
    sinks.replace_json(rows, path)
    sinks.replace_json(table(spark, d, "supplier").filter("s_acctbal > 0").select("s_suppkey", "s_name"), path)
    return sinks.read_current(spark, path, "s_suppkey long, s_name string")


@query("""
WITH v AS (SELECT o_custkey AS key, strftime(o_orderdate, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ordinal, o_orderkey AS n FROM orders WHERE o_orderstatus = 'F'),
w AS (SELECT o_custkey AS key, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY strftime(o_orderdate, '%Y-%m-%d') || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') DESC) AS k FROM orders WHERE o_orderstatus <> 'F'),
m AS (SELECT key, max(day) AS last, max(ordinal) AS o FROM v GROUP BY key),
a AS (SELECT key, day, ordinal, n FROM v UNION ALL SELECT w.key, w.day, coalesce(o + 1, 1), n FROM w LEFT JOIN m USING (key) WHERE k = 1 AND (last IS NULL OR w.day >= last))
SELECT key, arg_max(n, (day, ordinal)) AS n, max(day) AS day, CAST(count(*) - 1 AS INTEGER) AS before FROM a GROUP BY key""")
def upserted(spark, d):
    from pyspark.sql import Window

    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    o = table(spark, d, "orders").select(c("o_custkey").alias("key"), day.alias("day"), c("o_orderkey").alias("n"), "o_orderstatus")
    stored = o.filter("o_orderstatus = 'F'").drop("o_orderstatus").withColumn(
        "ordinal", F.row_number().over(Window.partitionBy("key").orderBy("n"))
    )
    new = o.filter("o_orderstatus <> 'F'").drop("o_orderstatus").withColumn("at", F.concat("day", F.lpad(text("n"), 12, "0")))
    new = new.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("at")))).filter("k = 1").drop("k", "at")
    rows = sinks.latest_with_history(sinks.upsert(stored, new, ["key"], "day"), ["key"], "day")
    return rows.select("key", "n", "day", F.size("history").alias("before"))


@query("SELECT s_suppkey, s_nationkey, 'computed' AS side FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL SELECT s_suppkey, s_nationkey + 1, 'stored' FROM supplier WHERE s_suppkey % 5 = 0")
def stale_artifact_rows(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", c("s_nationkey").cast("long").alias("s_nationkey"))
    return sinks.drift(s, s.withColumn("s_nationkey", c("s_nationkey") + F.when(c("s_suppkey") % 5 == 0, 1).otherwise(0)))


@query("SELECT event_type, user_id % 7 AS grp, count(*) AS \"rows\" FROM events GROUP BY ALL")
def attested_counts(spark, d):
    return metadata.attestation(table(spark, d, "events").withColumn("grp", c("user_id") % 7), ["event_type", "grp"])


@query("SELECT l_partkey AS path, max(l_shipdate) AS last_commit FROM lineitem GROUP BY 1")
def last_touched(spark, d):
    return metadata.last_commits(table(spark, d, "lineitem").select(c("l_partkey").alias("path"), c("l_shipdate").alias("ts")))


@query("SELECT DISTINCT l_partkey AS path FROM lineitem WHERE l_returnflag <> 'R' AND (l_linenumber = 1 OR l_discount > 0.05)")
def changed_files(spark, d):
    kind = F.when(c("l_returnflag") == "R", "deleted").otherwise("modified")
    rows = table(spark, d, "lineitem").select(c("l_partkey").alias("path"), kind.alias("change_type"), "l_linenumber", "l_discount")
    return metadata.changed_paths(
        rows.filter("l_linenumber = 1").select("path", "change_type"),
        rows.filter("l_discount > 0.05").select("path", "change_type")
    )


@query("SELECT user_id AS run, arg_max(props, event_id) FILTER (event_type = 'view') AS usage, coalesce(list(CAST(value AS VARCHAR) ORDER BY event_id) FILTER (event_type = 'click'), []) AS commands FROM (SELECT user_id, event_id, event_type, props, CAST(value AS BIGINT) AS value FROM (SELECT * REPLACE (floor(value) AS value) FROM events)) GROUP BY 1")
def run_usage(spark, d):
    kind = F.when(c("event_type") == "view", "usage").when(c("event_type") == "click", "command").otherwise("other")
    value = F.when(c("event_type") == "view", c("props")).otherwise(F.floor("value").cast("string"))
    return metadata.usage(table(spark, d, "events").select(c("user_id").alias("run"), c("event_id").alias("ordinal"), kind.alias("kind"), value.alias("value")))


# facts of sources


def modules(spark, d):
    """A Python module for each part: a class of 2 or 3 methods, a function that calls them, and handlers."""
    k, s = c("p_partkey"), c("p_size")
    third = F.when(k % 2 == 0, "    def third(self, a, b):\n        return self.first(a)\n").otherwise("")
    hide = F.when(k % 3 == 0, "pass").when(k % 3 == 1, "return None").otherwise("raise")
    kind = F.when(s % 2 == 0, "Exception").otherwise("ValueError")
    allow = F.when(k % 5 == 0, "  # noqa: silent-handler: tolerated").otherwise("")
    body = said(
        "import json\n\n@wrap.it(1)\nclass Part", k, "(Base):\n    def __init__(self):\n        pass\n    def first(self, a):\n        return other(a)\n    @property\n    def second(self):\n        return 1\n", third,
        "\nasync def load_", s, "(request, x=1):\n    try:\n        return Part", k, "().first(int(request.GET.get('x')))\n    except ", kind, ":\n        ", hide, allow, "\n\ndef _call_llm(p):\n    json.loads(request.body)\n    if p and x or y:\n        pass\n",
    )
    return table(spark, d, "part").select(said("src/m", k, ".py").alias("path"), F.when(k % 11 == 0, "def (").otherwise(body).alias("text"))


PATH = "'src/m' || p_partkey || '.py'"
GOOD = "FROM part WHERE p_partkey % 11 <> 0"
EXTRA = "CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 0 END"


@query(f"""
SELECT {PATH} AS path, 'Part' || p_partkey AS qualified_name, 'class' AS kind, 4 AS line, 0 AS arity, ['wrap.it'] AS decorators {GOOD}
UNION ALL SELECT {PATH}, 'Part' || p_partkey || '.first', 'method', 7, 1, [] {GOOD} UNION ALL SELECT {PATH}, 'Part' || p_partkey || '.second', 'method', 10, 0, ['property'] {GOOD}
UNION ALL SELECT {PATH}, 'Part' || p_partkey || '.third', 'method', 12, 2, [] {GOOD} AND p_partkey % 2 = 0
UNION ALL SELECT {PATH}, 'load_' || p_size, 'function', 13 + {EXTRA}, 2, [] {GOOD}""")
def source_definitions(spark, d):
    return facts.definitions(modules(spark, d), ["_call_llm"]).select("path", "qualified_name", "kind", "line", "arity", "decorators")


@query(f"""
SELECT {PATH} AS path, {PATH} || '::Part' || p_partkey || '.first' AS caller, 'other' AS callee_name, 'name' AS call_style, 8 AS line {GOOD}
UNION ALL SELECT {PATH}, {PATH} || '::Part' || p_partkey || '.third', 'first', 'self', 13 {GOOD} AND p_partkey % 2 = 0
UNION ALL SELECT {PATH}, {PATH} || '::load_' || p_size, unnest(['first', 'Part' || p_partkey, 'int', 'get']), unnest(['attribute', 'name', 'name', 'attribute']), 15 + {EXTRA} {GOOD}
UNION ALL SELECT {PATH}, {PATH} || '::_call_llm', 'json.loads', 'attribute', 20 + {EXTRA} {GOOD}""")
def source_calls(spark, d):
    return facts.call_edges(modules(spark, d)).drop("caller_class")


@query(f"""
SELECT {PATH} AS path, 'Part' || p_partkey AS name, 'class' AS kind, 4 AS line, CAST(8 AS INTEGER) AS loc {GOOD} AND p_partkey % 2 = 1
UNION ALL SELECT {PATH}, 'Part' || p_partkey || '.' || unnest(['first', 'second', 'third']), 'method', unnest([7, 10, 12]), 2 {GOOD} AND p_partkey % 2 = 0
UNION ALL SELECT {PATH}, 'load_' || p_size, 'async_function', 13 + {EXTRA}, 5 {GOOD} UNION ALL SELECT {PATH}, '_call_llm', 'function', 19 + {EXTRA}, 4 {GOOD}""")
def adapter_symbols(spark, d):
    return facts.module_symbols(modules(spark, d)).select("path", "name", "kind", "line", "loc")


@query(f"SELECT {PATH} AS path, 4 AS line, 'Part' || p_partkey AS name, 'services' AS kind {GOOD} UNION ALL SELECT {PATH}, 4, 'Part' || p_partkey, 'views' {GOOD} AND p_partkey % 10 = 7 "
       f"UNION ALL SELECT {PATH}, 13 + {EXTRA}, 'load_' || p_size, 'functions' {GOOD} UNION ALL SELECT {PATH}, 19 + {EXTRA}, '_call_llm', 'functions' {GOOD}")  # fmt: skip
def symbols_by_kind(spark, d):
    m = modules(spark, d)
    out = facts.symbols_of_kind(m, "tasks", ["it"])  # only the class is decorated so
    for kind in ("views", "services", "functions"):
        out = out.union(facts.symbols_of_kind(m, kind, ending="7"))
    return out


@query(f"""
SELECT {PATH} AS path, 'unchecked_int' AS pattern, 15 + {EXTRA} AS line, 'int' AS name {GOOD} UNION ALL SELECT {PATH}, 'raw_body', 20 + {EXTRA}, 'loads' {GOOD} UNION ALL SELECT {PATH}, 'model_call', 19 + {EXTRA}, '_call_llm' {GOOD}""")
def source_patterns(spark, d):
    return facts.patterns(modules(spark, d))


@query(f"SELECT {PATH} AS path, 'silent-handler' AS rule, 16 + {EXTRA} AS line, 'handler hides the error by ' || CASE WHEN p_partkey % 3 = 0 THEN 'pass' ELSE 'return None' END AS message {GOOD} AND p_partkey % 3 < 2 AND p_size % 2 = 0 AND p_partkey % 5 <> 0")
def silent_handlers(spark, d):
    files = modules(spark, d)
    found = checks.run_checks(files, ["silent-handler"], {"silent-handler": (r"\.py$", None)})
    return found.drop("col")


@query("""
WITH f AS (SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN 'app/services/extraction/extraction_compiler/m' ELSE 'app/m' END || p_partkey || '.py' AS path FROM part)
SELECT path, 'query-mutation' AS rule, 4 AS line, 4 AS col, 'get_' || k || ' reads by its name and calls create, save' AS message FROM f WHERE k % 3 <> 0
UNION ALL SELECT path, 'safe-dispatch', 6, 4, 'bare dispatch by delay' FROM f WHERE k % 4 <> 0
UNION ALL SELECT path, 'codegen-emits-new-paths', 8, 11, 'emitted text holds from core.services' FROM f WHERE path LIKE '%compiler%' AND k % 5 <> 0""")
def source_lint(spark, d):
    k, s = c("p_partkey"), c("p_size")
    mark = lambda n, text: F.when(k % n == 0, text).otherwise("")
    body = said(
        "def get_", k, "(a):\n    def inner():\n        a.delete()\n    a.create()\n    a.save(1)", mark(3, "  # hidden-mutation: told"),
        "\n    go.delay(a)", mark(4, "  # noqa: safe-dispatch: told"), "\ndef get_or_create(a):\n    return 'from core.services.x import y', a.create()",
        mark(5, "  # noqa: codegen-emits-new-paths: told"), "\n",
    )
    path = said(F.when(s % 2 == 0, "app/services/extraction/extraction_compiler/m").otherwise("app/m"), k, ".py")
    files = table(spark, d, "part").select(path.alias("path"), body.alias("text"))
    return checks.run_checks(files, ["query-mutation", "safe-dispatch", "codegen-emits-new-paths"])


@query(f"SELECT {PATH} AS path, '_call_llm' AS name, 19 + {EXTRA} AS line, 3 AS branch_score {GOOD}")
def branch_hotspots(spark, d):
    return checks.hotspots(modules(spark, d), 2).select("path", "name", "line", "branch_score")


@query(f"SELECT {PATH} AS path, 13 + {EXTRA} AS line, 'load_' || p_size AS name, 5 AS loc, 4 AS budget {GOOD} UNION ALL SELECT {PATH}, 12, 'Part' || p_partkey || '.third', 2, 1 {GOOD} AND p_partkey % 2 = 0")
def fat_functions(spark, d):
    return facts.size_budgets(modules(spark, d), 4, 1, ["Base"], ["third"])


@query(f"SELECT name, arity, has_self, count(*) AS occurrences, count(DISTINCT path) AS places, name = 'second' AS protocol_name FROM (SELECT {PATH} AS path, unnest(['first', 'second', 'load_' || p_size]) AS name, unnest([2, 1, 2]) AS arity, unnest([true, true, false]) AS has_self {GOOD} "
       f"UNION ALL SELECT {PATH}, 'third', 3, true {GOOD} AND p_partkey % 2 = 0) GROUP BY ALL HAVING count(DISTINCT path) >= 2")  # fmt: skip
def fingerprint_clones(spark, d):
    found = facts.fingerprints(modules(spark, d), ["_call_llm"])
    return rel.clone_groups(found, ["name", "arity", "has_self"], "path", protocol=("second", "close"))


@query("SELECT 'src/h' || p_partkey || '.py' AS path, 2 AS blocks, [4, 10] AS lines FROM part WHERE p_size % 2 = 0")
def repeated_handlers(spark, d):
    handler = lambda a, b, last: said("try:\n    go()\nexcept E:\n    ", a, ".state = '", b, "'\n    log(", a, ")\n    ", last, "\n")
    last = F.when(c("p_size") % 2 == 0, "item.save()").otherwise("item.save(1, 2)")
    body = said(handler("item", "failed", "item.save()"), handler("job", c("p_name"), last))
    files = table(spark, d, "part").select(said("src/h", c("p_partkey"), ".py").alias("path"), body.alias("text"))
    return facts.handler_blocks(files).drop("digest")


SCRIPT = "'src/s' || p_partkey || '.ts'"


@query(f"""
SELECT {SCRIPT} AS path, 'load' || p_partkey AS name, 'function' AS kind, 2 AS line, 4 AS end_line, 3 AS loc FROM part UNION ALL SELECT {SCRIPT}, 'Box', 'class', 5, 7, 3 FROM part
UNION ALL SELECT {SCRIPT}, 'f' || p_size, 'function', 8, CASE WHEN p_size % 2 = 0 THEN 8 ELSE 10 END, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 3 END FROM part UNION ALL SELECT {SCRIPT}, 'Api', 'function', 9, 10, 2 FROM part WHERE p_size % 2 = 0""")
def script_declarations(spark, d):
    last = F.when(c("p_size") % 2 == 0, "window.Api = {\n}\n").otherwise("const plain = 3\ntype T = number\n")
    body = said(
        "import x from 'y'\nasync function load", c("p_partkey"),
        "(a) {\n  function inner() {}\n}\nclass Box {\n  run() {}\n}\nconst f", c("p_size"), " = async (a, b) => a\n",
        last
    )
    return symbols.extract_script(table(spark, d, "part").select(said("src/s", c("p_partkey"), ".ts").alias("path"), body.alias("text")))


@query("""
WITH r AS (SELECT p_name AS name, p_brand AS path, CASE WHEN p_size % 2 = 0 THEN 'a' ELSE 'a,b' END AS signature, p_size AS n FROM part WHERE p_size % 3 > 0),
g AS (SELECT name, count(*) AS definitions, count(DISTINCT path) AS files, count(DISTINCT signature) AS signatures, CAST(sum(n) AS BIGINT) AS lines FROM r GROUP BY name)
SELECT *, CASE WHEN signatures = 1 THEN 'duplicate' ELSE 'shadow' END AS verdict FROM g WHERE definitions >= 2 AND files >= 2 UNION ALL SELECT *, 'generic' FROM g WHERE name IN ('blue rod', 'small gear')""")
def audited_names(spark, d):
    shape = F.when(c("p_size") % 2 == 0, "a").otherwise("a,b")
    marks = F.when(c("p_size") % 3 == 0, F.array(F.lit("property"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, d, "part").select(
        c("p_name").alias("name"), c("p_brand").alias("path"), F.lit("function").alias("kind"),
        shape.alias("signature"), marks.alias("decorators"), F.lit(1).alias("line"), c("p_size").alias("end_line")
    )
    return symbols.name_audit(rows, ("blue rod", "small gear"))


@query(f"""
SELECT {PATH} AS path, 'Part' || p_partkey AS name, 'class' AS kind, 4 AS line {GOOD} AND p_partkey % 2 = 1 UNION ALL SELECT {PATH}, 'Part' || p_partkey || '.' || unnest(['first', 'second', 'third']), 'method', unnest([7, 10, 12]) {GOOD} AND p_partkey % 2 = 0
UNION ALL SELECT {PATH}, 'load_' || p_size, 'async_function', 13 + {EXTRA} {GOOD} UNION ALL SELECT {PATH}, '_call_llm', 'function', 19 + {EXTRA} {GOOD}
UNION ALL SELECT 'src/' || n_name || '.rb', NULL, 'unsupported', NULL FROM nation UNION ALL SELECT 'src/' || r_name || '.js', 'go', 'function', 1 FROM region""")
def symbols_of_all_languages(spark, d):
    known = facts.Adapters()
    known.register([".py", ".js"], lambda files: facts.module_symbols(files))
    known.register([".js", ".ts"], symbols.extract_script)
    ruby = table(spark, d, "nation").select(said("src/", c("n_name"), ".rb").alias("path"), F.lit("def x").alias("text"))
    script = table(spark, d, "region").select(said("src/", c("r_name"), ".js").alias("path"), F.lit("function go() {}\n").alias("text"))
    return known.symbols(modules(spark, d).union(ruby).union(script)).drop("end_line")


@query("SELECT l_orderkey AS id, 'f' || l_orderkey || '.py' AS path, CAST(1 + k AS INTEGER) AS line, CASE WHEN l_linenumber = 1 THEN 'debugger' ELSE 'secret' END AS predicate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) WHERE l_linenumber IN (1, 2)")
def patch_secrets(spark, d):
    n = c("l_linenumber")
    line = F.when(n == 1, "+import pdb").when(n == 2, '+token = "abcdef"').when(n == 3, "+ok").otherwise("+token = x")
    rows = table(spark, d, "lineitem").select("l_orderkey", n, line.alias("t")).distinct().groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "t"))).alias("h")
    )
    patches = rows.select(
        c("l_orderkey").alias("id"),
        said("+++ b/f", c("l_orderkey"), ".py\n", F.array_join(F.transform("h", lambda x: x["t"]), "\n")).alias("patch")
    )
    return policy.patch_findings(policy.patch_additions(patches))


@query(
    f"SELECT {SCRIPT} AS path, 'go' || p_size AS name, 1 AS line, 6 AS end_line, CAST(5 + p_size % 2 AS INTEGER) AS branch_score FROM part"
)
def script_hotspots(spark, d):
    more = F.when(c("p_size") % 2 == 1, "x ? 1 : 2").otherwise("x?.y")
    body = said(
        "function go", c("p_size"), "(x) {\n  if (x && y || 'a && b') { // if so\n    for (;;) {}\n  }\n  return x ?? ",
        more, "\n}\nclass A {\n  if () {}\n}\n"
    )
    files = table(spark, d, "part").select(said("src/s", c("p_partkey"), ".ts").alias("path"), body.alias("text"))
    return symbols.script_hotspots(files, 2, 3)


STATES = [
    "valid", "missing", "malformed", "mismatched-root", "tool-mismatch", "incomplete", "stale", "wrong-command",
    "missing-output", "output-mismatch", "native-check-failure"
]


@query("SELECT 'r' || s_suppkey AS root, " + repr(STATES) + "[1 + s_suppkey % 11] AS state FROM supplier")
def build_evidence_states(spark, d):
    s, k, key = table(spark, d, "supplier"), c("s_suppkey") % 11, text("s_suppkey")
    root, hashed = said("r", key), F.sha2(key, 256)
    pick = lambda n, odd, else_: F.when(k == n, odd).otherwise(else_)
    doc = said(
        '{"schema_version": 1, "status": "', pick(
            2, "partial", F.lit("complete")
        ), '", "target": "17", "project_root": "', pick(3, F.lit("elsewhere"), root), '", "tools": {"java": "/j", "kotlinc": "',
        pick(4, "/other", F.lit("/k")), '"}, "inputs": [{"path": "a.kt", "role": "source", "sha256": "', pick(
            6, F.sha2(said(key, "x"), 256), hashed
        ), '"}',
        pick(
            5, "", said(', {"path": "t.kt", "role": "test", "sha256": "', hashed, '"}')
        ), '], "commands": [["k", "', pick(7, "no", F.lit("go")), '"]], "outputs": [{"path": "o.jar", "sha256": "', hashed,
        '"}], "checks": {"test": {"returncode": ', pick(
            10, "1", F.lit("0")
        ), ', "stdout": "", "stderr": ""}, "smoke": {"returncode": 0, "stdout": "hi", "stderr": ""}}}',
    )
    tools = F.create_map(F.lit("kotlinc"), F.lit("/k"), F.lit("java"), F.lit("/j"))
    wanted = s.select(
        root.alias("root"), F.lit(1).alias("version"), F.lit("17").alias("target"), tools.alias("tools"),
        F.array(F.array(F.lit("k"), F.lit("go"))).alias("commands"), F.lit("hi").alias("smoke")
    )
    source, test = F.struct(
        F.lit("a.kt").alias("path"), F.lit("source").alias("role")
    ), F.struct(F.lit("t.kt").alias("path"), F.lit("test").alias("role"))
    files = s.select(
        root.alias("root"), hashed.alias("sha256"), F.explode(F.array(source, test)).alias("x")
    ).select("root", "sha256", "x.*")
    made = s.select(
        root.alias("root"), F.lit("o.jar").alias("path"),
        F.when(k == 8, None).when(k == 9, F.sha2(said(key, "y"), 256)).otherwise(hashed).alias("sha256")
    )
    return metadata.build_evidence(s.select(root.alias("root"), F.when(k != 1, doc).alias("text")), wanted, files, made)


@query("SELECT CAST(s_suppkey AS VARCHAR) AS path, CASE WHEN s_suppkey % 4 > 0 THEN 's' || s_suppkey END AS name, CASE WHEN s_suppkey % 4 = 0 THEN [] WHEN s_suppkey % 4 = 1 THEN ['a@^' || s_nationkey] ELSE ['a@^' || s_nationkey, 'b@2'] END AS packages, "
       "CASE WHEN s_suppkey % 4 > 0 THEN ['build', 'test'] ELSE [] END AS scripts, s_suppkey % 4 > 0 AS readable FROM supplier")  # fmt: skip
def json_project_files(spark, d):
    k = c("s_suppkey") % 4
    more = F.when(k == 1, "").otherwise(', "devDependencies": {"b": "2"}')
    doc = said(
        '{"name": "s', c("s_suppkey"), '", "dependencies": {"a": "^', c("s_nationkey"), '"}', more,
        ', "scripts": {"test": "t", "build": "b"}}'
    )
    return metadata.json_projects(
        table(spark, d, "supplier").select(text("s_suppkey").alias("path"), F.when(k == 0, "[1]").otherwise(doc).alias("text"))
    )


@query("SELECT path FROM (SELECT l_partkey AS path, arg_max(l_returnflag, l_orderkey * 10 + l_linenumber) AS last FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1) WHERE last <> 'R'")
def changed_in_range(spark, d):
    """Each line item is a commit that changes its part; the range are the items of finished orders."""
    commit = (c("l_orderkey") * 10 + c("l_linenumber")).alias("id")
    done = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(c("o_orderkey").alias("l_orderkey"))
    line = table(spark, d, "lineitem")
    commits = line.join(done, "l_orderkey", "left_semi").select(commit).distinct().withColumn("ordinal", c("id"))
    kind = F.when(c("l_returnflag") == "R", "deleted").otherwise("modified")
    return metadata.changed_in_range(commits, line.select(commit, c("l_partkey").alias("path"), kind.alias("change_type")))


@query(r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS t FROM d),
k AS (SELECT doc_id, line, regexp_extract_all(t, '[A-Za-z0-9_]+|[^ \t-\rA-Za-z0-9_]') AS ts FROM l), t AS (SELECT doc_id, line, unnest(range(0, len(ts))) AS k, unnest(ts) AS tok FROM k),
o AS (SELECT doc_id, line, tok, row_number() OVER (PARTITION BY doc_id ORDER BY line, k) - 1 AS at_ FROM t),
g AS (SELECT doc_id, at_, line, lead(line, 39) OVER w AS last, md5(string_agg(tok, ' ') OVER (PARTITION BY doc_id ORDER BY at_ ROWS BETWEEN CURRENT ROW AND 39 FOLLOWING)) AS h FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY at_)),
f AS (SELECT *, min((doc_id, at_, line, last)) OVER (PARTITION BY h) AS a FROM g WHERE last IS NOT NULL),
s AS (SELECT doc_id AS b, at_, line, last, a[1] AS a, a[3] AS a_line, a[4] AS a_last, at_ - a[2] AS shift FROM f WHERE (doc_id, at_) > (a[1], a[2])),
i AS (SELECT *, at_ - row_number() OVER (PARTITION BY b, a, shift ORDER BY at_) AS island FROM s)
SELECT a, min(a_line) AS a_start, max(a_last) AS a_end, b, min(line) AS b_start, max(last) AS b_end, count(*) + 39 AS tokens FROM i GROUP BY a, b, shift, island""")
def source_clone_pairs(spark, d):
    return clones.clone_pairs(table(spark, d, "documents").select(c("doc_id").alias("path"), "text"), 40)
