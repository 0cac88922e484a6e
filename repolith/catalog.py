"""Queries: the operators on the driver's tables, each with SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith import session
from repolith.functions import scalars
from repolith.operators import chunks, detectors, graph, intervals, relational as rel
from repolith.plans import matrix, registries
from repolith.streaming import folds

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: A registry of owners by path prefix, two of them nested.
REGISTRY = [
    ("english", "./example.net/en/", 1), ("net", "example.net/", 2), ("org", "example.org/", 3),
    ("french", "example.org/fr/", 4), ("nobody", "example.com/de", 5), ("com", "example.com/", 6)
]
TYPES = ["click", "error", "purchase", "signup", "view"]


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def unchecked(f):
    """A query that SQL can't express; its operator has a test of its own."""
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT event_id, user_id, event_type, ts, n - 1 AS superseded FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS k, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events) WHERE k = 1")
def latest_per_key(spark, d):
    return rel.latest(
        table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id"
    ).select("event_id", "user_id", "event_type", "ts", "superseded")


@query(
    "SELECT strftime(ts, '%Y-%m') AS month, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in TYPES)
    + " FROM events GROUP BY 1"
)
def month_pivot(spark, d):
    return rel.month_pivot(table(spark, d, "events"), "ts", "event_type", TYPES)


@query("SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 10")
def top_with_ties(spark, d):
    return rel.top_ties(table(spark, d, "part"), "p_size", 10).select("p_partkey", "p_size")


@query("SELECT CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 30 THEN 'medium' WHEN p_size <= 45 THEN 'large' ELSE 'huge' END AS tier, count(*) AS n FROM part GROUP BY 1")
def size_tiers(spark, d):
    tier = rel.size_tier(F.col("p_size"), [(10, "small"), (30, "medium"), (45, "large")], "huge")
    return table(spark, d, "part").groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))


@query("SELECT 'p_brand' AS facet, p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2 UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY 2")
def facet_histograms(spark, d):
    return rel.histograms(table(spark, d, "part"), ["p_brand", "p_type", "p_size"])


@query("SELECT md5(text) AS digest, count(*) AS occurrences, count(DISTINCT doc_id) AS places FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2")
def clone_groups(spark, d):
    return rel.clone_groups(table(spark, d, "documents").withColumn("digest", F.md5(F.col("text").cast("binary"))), ["digest"], "doc_id")


@query("SELECT source, lang, n, round(n / sum(n) OVER (PARTITION BY source), 6) AS share, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1 AS majority FROM (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY source, lang)")
def language_census(spark, d):
    return rel.census(table(spark, d, "documents"), ["source"], "lang")


@query("SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS returned, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount >= 0.08) AS discounted, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AS in_debt FROM orders")
def order_flags(spark, d):
    line = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    debt = table(spark, d, "customer").filter("c_acctbal < 0").withColumnRenamed("c_custkey", "o_custkey")
    return rel.flags(
        table(spark, d, "orders"),
        {
            "returned": (line.filter("l_returnflag = 'R'"), ["o_orderkey"]),
            "discounted": (line.filter("l_discount >= 0.08"), ["o_orderkey"]), "in_debt": (debt, ["o_custkey"])
        }
    ).select("o_orderkey", "returned", "discounted", "in_debt")


@query(
    "WITH r(owner, prefix, o) AS (VALUES " + ", ".join(map(str, REGISTRY)) + "), "
    "p AS (SELECT page_id, regexp_extract(regexp_extract(url, '://([^?#]*)', 1), '(example\\.[a-z]+/.*)$', 1) AS path FROM pages), "
    "h AS (SELECT page_id, owner, row_number() OVER (PARTITION BY page_id ORDER BY length(prefix) DESC, o) AS k FROM p JOIN r ON path = ltrim(prefix, './') OR (suffix(prefix, '/') AND starts_with(path, ltrim(prefix, './')))) "
    "SELECT p.page_id, h.owner FROM p LEFT JOIN h ON p.page_id = h.page_id AND k = 1"
)
def longest_prefix_owner(spark, d):
    path = F.regexp_extract(F.regexp_extract("url", r"://([^?#]*)", 1), r"(example\.[a-z]+/.*)$", 1)
    registry = spark.createDataFrame(REGISTRY, "owner string, prefix string, ordinal int")
    return rel.owner(table(spark, d, "pages").select("page_id", path.alias("path")), registry).select("page_id", "owner")


@query("SELECT l_orderkey, l_linenumber, coalesce(lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1, 7) AS \"end\" FROM lineitem")
def next_line_start(spark, d):
    return rel.next_start(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", F.lit(7)).select("l_orderkey", "l_linenumber", "end")


SPANS = "SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + 3600 AS e FROM events"


@query(f"""
WITH t AS (SELECT c_custkey AS user_id, CAST(1800000000 + c_custkey AS BIGINT) AS total FROM customer WHERE c_acctbal > 0), x AS (SELECT s.user_id, s.s, s.e FROM ({SPANS}) s UNION ALL SELECT user_id, 0, 0 FROM t UNION ALL SELECT user_id, total + 1, total + 1 FROM t),
r AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x) SELECT user_id, reach + 1 AS gap_start, s - 1 AS gap_end FROM r WHERE s > reach + 1""")
def activity_gaps(spark, d):
    k = F.col("c_custkey")
    totals = table(spark, d, "customer").filter("c_acctbal > 0").select(k.alias("user_id"), (1800000000 + k).cast("long").alias("total"))
    return intervals.gaps(spans(spark, d), ["user_id"], totals)


def spans(spark, d):
    start = F.unix_timestamp(F.date_trunc("second", "ts"))
    return table(spark, d, "events").select("user_id", "event_id", "event_type", start.alias("start"), (start + 3600).alias("end"))


@query(f"WITH x AS (SELECT e.event_type, s.* FROM ({SPANS}) s JOIN events e USING (event_id)) SELECT event_id, user_id FROM x WHERE event_type <> 'purchase' AND EXISTS (SELECT 1 FROM x y WHERE y.event_type = 'purchase' AND y.user_id = x.user_id AND x.s <= y.e AND x.e >= y.s)")
def near_purchase(spark, d):
    s = spans(spark, d)
    return intervals.overlapping(
        s.filter("event_type <> 'purchase'"), s.filter("event_type = 'purchase'"), ["user_id"]
    ).select("event_id", "user_id")


@query("SELECT event_id, user_id, last_view FROM (SELECT *, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_view FROM events) WHERE event_type = 'purchase'")
def view_before_purchase(spark, d):
    is_ = lambda t: F.col("event_type") == t
    return rel.last_before(
        table(spark, d, "events"), is_("purchase"), is_("view"), ["user_id"], ["ts", "event_id"], "event_id",
        "last_view"
    ).select("event_id", "user_id", "last_view")


PART_SUPPLIER = "SELECT DISTINCT l_partkey AS src, -l_suppkey AS dst FROM lineitem UNION SELECT DISTINCT -l_suppkey, l_partkey FROM lineitem"


@query(
    f"WITH RECURSIVE e AS ({PART_SUPPLIER}), b(node, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT e.dst, depth + 1 FROM b JOIN e ON b.node = e.src WHERE depth < 8) "
    "SELECT 1::BIGINT AS start, node, min(depth)::INTEGER AS depth FROM b GROUP BY node"
)
def bounded_reach(spark, d):
    """Parts and (negative) suppliers within 8 steps of part 1, over all line items."""
    line = table(spark, d, "lineitem")
    down = line.select(F.col("l_partkey").alias("src"), (-F.col("l_suppkey")).alias("dst"))
    return graph.shortest_depths(
        down.union(line.select(-F.col("l_suppkey"), "l_partkey")), spark.range(1, 2).select(F.col("id").alias("node"))
    )


@query("WITH a AS (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'), b AS (SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1994-01-01') SELECT o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'fixed' WHEN a.o_orderkey IS NULL THEN 'new' ELSE 'persisting' END AS state FROM a FULL JOIN b USING (o_orderkey)")
def manifest_diff(spark, d):
    o = table(spark, d, "orders")
    return rel.manifest_diff(
        o.filter("o_orderdate < TIMESTAMP '1997-01-01'"), o.filter("o_orderdate >= TIMESTAMP '1994-01-01'"),
        ["o_orderkey"]
    )


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def keep_first(spark, d):
    rows = table(spark, d, "documents").withColumn("digest", F.sha2("text", 256))
    return rel.keep_first(rows, ["digest"], "doc_id").select("doc_id", "source")


@query(
    "WITH t AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[a-zA-Z]+'))) AS term FROM benchmark), "
    "w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents), "
    "c AS (SELECT term, count(DISTINCT doc_id) AS n, count(*) AS hits FROM w GROUP BY term) "
    "SELECT t.term, coalesce(n, 0) AS n, CAST(coalesce(hits, 0) AS BIGINT) AS hits FROM t LEFT JOIN c USING (term)"
)
def term_mentions(spark, d):
    terms = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("term"))
    return rel.mentions(table(spark, d, "documents"), terms, "doc_id", "text", "[a-z]+")


@query("SELECT doc_id, CASE WHEN text LIKE '%icensed%' AND n_chars > 2000 THEN ['license', 'long'] WHEN text LIKE '%icensed%' THEN ['license'] WHEN n_chars > 2000 THEN ['long'] ELSE [] END AS why FROM documents")
def review_reasons(spark, d):
    why = rel.reasons([("license", F.col("text").contains("icensed")), ("long", F.col("n_chars") > 2000)])
    return table(spark, d, "documents").select("doc_id", why.alias("why"))


@query("SELECT source, doc_id, substr(md5(text), 1, 12) AS digest, greatest(1, length(text) // 4) AS tokens FROM documents")
def token_estimates(spark, d):
    return table(spark, d, "documents").select(
        "source", "doc_id", scalars.short_digest(F.col("text")).alias("digest"),
        scalars.token_estimate(F.col("text")).alias("tokens")
    )


@query(
    "WITH c AS (SELECT source, lang, CAST(sum(n_chars) AS BIGINT) AS loc, count(*) AS files FROM documents GROUP BY source, lang), "
    "k AS (SELECT lang, list_sort(list(DISTINCT detector)) AS covered_by FROM (VALUES ('en', 'words'), ('en', 'lines'), ('de', 'words'), ('any', 'bytes')) v(lang, detector) WHERE lang <> 'any' GROUP BY lang) "
    "SELECT source AS root, c.lang AS language, loc, files, CASE WHEN covered_by IS NOT NULL THEN 'covered' WHEN source = 'src1' AND c.lang = 'fr' THEN 'accepted' WHEN loc >= 20000 THEN 'gap' ELSE 'small' END AS state FROM c LEFT JOIN k ON c.lang = k.lang"
)
def perimeter_cells(spark, d):
    files = table(spark, d, "documents").select(
        F.col("source").alias("root"), F.col("lang").alias("language"), F.col("n_chars").alias("loc")
    )
    covers = spark.createDataFrame(
        [("en", "words"), ("en", "lines"), ("de", "words"), ("any", "bytes")], "language string, detector string"
    )
    accepted = spark.createDataFrame([("src1", "fr")], "root string, language string")
    return registries.perimeter(files, covers, accepted, 20000).drop("covered_by")


@query(
    "WITH n AS (SELECT o_custkey AS id, count(*) AS m FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1), b AS (SELECT o_custkey AS id, count(*) AS m FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1) "
    "SELECT coalesce(n.id, b.id) AS id, least(n.m, b.m) AS allowed, CASE WHEN b.m IS NULL THEN 'new' WHEN n.m > b.m THEN 'grown' WHEN n.m IS NULL THEN 'gone' ELSE 'held' END AS state FROM n FULL JOIN b ON n.id = b.id"
)
def order_ratchet(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "id")
    count = lambda rows: rows.groupBy("id").agg(F.count("*").alias("metric"))
    return registries.ratchet(
        count(o.filter("o_orderdate >= TIMESTAMP '1996-01-01'")),
        count(o.filter("o_orderdate < TIMESTAMP '1996-01-01'"))
    )


@query("SELECT p_partkey, p_size, p_size >= (SELECT min(p_size) FROM (SELECT p_size FROM part ORDER BY p_size DESC LIMIT 10)) AS selected FROM part")
def selection_with_omissions(spark, d):
    return detectors.select_with_omissions(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", 10)


@query("SELECT o_custkey AS caller, count(*) FILTER (o_orderstatus <> 'O') AS resolved, count(*) FILTER (o_orderstatus = 'O') AS unresolved, CASE WHEN bool_and(o_orderstatus <> 'O') THEN 'complete' WHEN bool_and(o_orderstatus = 'O') THEN 'unresolved' ELSE 'partial' END AS state FROM orders GROUP BY o_custkey")
def call_completeness(spark, d):
    o = table(spark, d, "orders")
    return detectors.call_completeness(
        o.select(F.col("o_custkey").alias("caller"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderkey")).alias("callee"))
    )


LAYERS = [("0-URGENT", "2-HIGH"), ("1-URGENT", "2-HIGH"), ("1-URGENT", "3-MEDIUM")]


@query(
    "WITH l AS (SELECT o_orderkey, o_orderkey % 5 || '-' || CASE o_orderkey % 3 WHEN 0 THEN 'URGENT' WHEN 1 THEN 'HIGH' ELSE 'MEDIUM' END AS layer FROM orders), "
    "e AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS b FROM lineitem) "
    "SELECT e.a AS importer, e.b AS imported, x.layer AS from_layer, y.layer AS to_layer FROM e JOIN l x ON e.a = x.o_orderkey JOIN l y ON e.b = y.o_orderkey "
    "WHERE x.layer <> y.layer AND (x.layer, y.layer) NOT IN (VALUES " + ", ".join(map(str, LAYERS)) + ")"
)
def layer_violations(spark, d):
    name = F.when(F.col("path") % 3 == 0, "URGENT").when(F.col("path") % 3 == 1, "HIGH").otherwise("MEDIUM")
    layers = table(spark, d, "orders").select(F.col("o_orderkey").alias("path")).select(
        "path", F.concat_ws("-", F.col("path") % 5, name).alias("layer")
    )
    edges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("importer"), F.col("l_partkey").alias("imported"))
    return detectors.layer_violations(edges, layers, spark.createDataFrame(LAYERS, "from_layer string, to_layer string"))


FOLDED = "SELECT u AS id, coalesce(last_type, 'new') AS state, n AS transitions FROM (SELECT c_custkey AS u FROM customer) LEFT JOIN (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, count(*) AS k FROM events GROUP BY user_id) ON u = user_id CROSS JOIN LATERAL (SELECT coalesce(k, 0) AS n)"


def transitions(spark, d):
    return table(spark, d, "events").select(
        F.col("user_id").alias("id"), F.col("ts").alias("at"), F.col("event_id").alias("ordinal"),
        F.col("event_type").alias("to_state")
    )


def entities(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("new").alias("state"))


@query(FOLDED)
def folded_states(spark, d):
    return detectors.fold_states(transitions(spark, d), entities(spark, d))


@query(FOLDED)
def folded_stream(spark, d):
    """The same from a log that comes as a stream, its state beginning with the intake."""
    base = f"{session.shared_dir(spark)}/repolith/{uuid.uuid4().hex}"
    transitions(spark, d).write.json(f"{base}/in")
    stream = folds.fold_stream(folds.log_stream(spark, f"{base}/in", "id long, at timestamp, ordinal long, to_state string"), entities(spark, d))
    folds.each_batch(stream, folds.keep_batch(f"{base}/out"), f"{base}/checkpoint", "update").awaitTermination()
    return folds.kept_states(spark, f"{base}/out", entities(spark, d))


@query("SELECT event_id, EXISTS (SELECT 1 FROM events v WHERE v.event_type = 'view' AND v.user_id = e.user_id AND v.ts <= e.ts AND floor(epoch(e.ts)) - floor(epoch(v.ts)) <= 12 * 3600) AS backed FROM events e WHERE event_type = 'purchase'")
def recent_evidence(spark, d):
    e = table(spark, d, "events").withColumn("at", F.col("ts"))
    return detectors.recent_evidence(
        e.filter("event_type = 'purchase'").select("event_id", "user_id", "at"),
        e.filter("event_type = 'view'").select("user_id", "at"), ["user_id"]
    ).select("event_id", "backed")


@query("SELECT l_orderkey, 'C-' || lpad(CAST(k AS VARCHAR), 2, '0') AS chunk, CASE WHEN k = 1 THEN 1 ELSE l_linenumber END AS first, coalesce(nxt - 1, 9) AS last FROM (SELECT l_orderkey, l_linenumber, row_number() OVER w AS k, lead(l_linenumber) OVER w AS nxt FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber))")
def chunk_tiles(spark, d):
    return chunks.tile(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], "l_linenumber", F.lit(9))


@query("""
WITH RECURSIVE i AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS n, CAST(l_linenumber + l_suppkey % 20 AS BIGINT) AS m, l_returnflag = 'R' AS closes, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem),
p AS (SELECT l_orderkey, l_linenumber, k, 1 AS chunk, n, m, closes FROM i WHERE k = 1 UNION ALL
  SELECT i.l_orderkey, i.l_linenumber, i.k, p.chunk + CASE WHEN p.closes OR p.n + i.n > 60 OR p.m + i.m > 30 THEN 1 ELSE 0 END, CASE WHEN p.closes OR p.n + i.n > 60 OR p.m + i.m > 30 THEN i.n ELSE p.n + i.n END,
    CASE WHEN p.closes OR p.n + i.n > 60 OR p.m + i.m > 30 THEN i.m ELSE p.m + i.m END, i.closes
  FROM p JOIN i ON i.l_orderkey = p.l_orderkey AND i.k = p.k + 1) SELECT l_orderkey, l_linenumber, chunk FROM p""")
def packed_with_breaks(spark, d):
    loc = F.col("l_linenumber") + F.col("l_suppkey") % 20
    at = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("at")
    items = table(spark, d, "lineitem").select("l_orderkey", at, "l_quantity", loc.alias("loc"), "l_returnflag")
    packed = chunks.pack(items, ["l_orderkey"], "at", "l_quantity", "loc", F.col("l_returnflag") == "R", 60, 30)
    return packed.select("l_orderkey", "at.l_linenumber", "chunk")


@query("SELECT l_returnflag, count(*) FILTER (l_discount > 0.08) AS failures, CASE WHEN bool_or(l_discount > 0.08 AND l_quantity >= 50 AND l_returnflag IN ('A', 'R')) THEN 'fail' WHEN bool_or(l_discount > 0.08) THEN 'pass-with-notes' ELSE 'pass' END AS verdict FROM lineitem GROUP BY l_returnflag")
def mode_scorecard(spark, d):
    checks = table(spark, d, "lineitem").select(
        "l_returnflag", (F.col("l_discount") <= 0.08).alias("passed"),
        ((F.col("l_quantity") >= 50) & F.col("l_returnflag").isin("A", "R")).alias("consequential")
    )
    return matrix.scorecard(checks, ["l_returnflag"])


DOMAINS = [("sized", "^(small|medium|large)$"), ("offer", "promo|economy")]


@query(
    "SELECT domain, count(*) AS n, list(p_partkey ORDER BY p_partkey) AS members FROM (SELECT p_partkey, CASE "
    + " ".join(f"WHEN regexp_matches(lower(p_type), '{p}') THEN '{n}'" for n, p in DOMAINS)
    + " ELSE 'utility' END AS domain FROM part) GROUP BY domain HAVING count(*) >= 2"
)
def domain_groups(spark, d):
    return matrix.prompt_groups(
        table(spark, d, "part").select(matrix.domain_of(F.col("p_type"), DOMAINS).alias("domain"), F.col("p_partkey").alias("name"))
    ).select("domain", "n", "members")


@query("SELECT doc_id, concept, band, terms FROM (WITH g(concept, term, standing) AS (VALUES ('pair', 'the', 'canonical'), ('pair', 'and', 'competing'), ('pair', 'der', 'superseded'), ('out', 'license', 'avoid')), "
       "w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '\\w+')) AS term FROM documents), "
       "s AS (SELECT doc_id, concept, list(DISTINCT term ORDER BY term) AS terms, list(DISTINCT standing) AS st FROM w JOIN g USING (term) GROUP BY doc_id, concept) "
       "SELECT doc_id, concept, 'avoid_term_hit' AS band, terms FROM s WHERE list_contains(st, 'avoid') UNION ALL SELECT doc_id, concept, 'competing_term_coexistence', terms FROM s WHERE list_contains(st, 'competing') AND len(terms) > 1 "
       "UNION ALL SELECT doc_id, concept, 'superseded_co_occurrence', terms FROM s WHERE list_contains(st, 'superseded') AND list_contains(st, 'canonical'))")
def term_bands(spark, d):
    glossary = spark.createDataFrame(
        [("pair", "the", "canonical"), ("pair", "and", "competing"), ("pair", "der", "superseded"), ("out", "license", "avoid")],
        "concept string, term string, standing string"
    )
    return detectors.term_bands(table(spark, d, "documents").select("doc_id", "text"), glossary, "doc_id", "text")


@query("SELECT 'orders' AS carrier_type, o_orderpriority AS field, count(*) AS operations, list(DISTINCT o_orderstatus ORDER BY o_orderstatus) AS literals, CASE WHEN count(DISTINCT o_orderstatus) >= 2 AND bool_or(o_totalprice > 100000) AND bool_or(o_totalprice <= 100000) THEN 'first_party_state_operation' ELSE 'insufficient_closed_state_evidence' END AS classification FROM orders GROUP BY o_orderpriority")
def implicit_states(spark, d):
    ops = table(spark, d, "orders").select(
        F.lit("orders").alias("carrier_type"), F.col("o_orderpriority").alias("field"),
        F.lit("string").alias("field_type"), F.col("o_orderstatus").alias("literal"),
        F.when(F.col("o_totalprice") > 100000, "comparison").otherwise("assignment").alias("operation")
    )
    return detectors.implicit_states(ops)


@query("SELECT page_id, CASE WHEN regexp_matches(path, '^/en/[^/]+') THEN 'english' WHEN starts_with(path, '/de/') THEN 'german' ELSE 'other' END AS family, '/' || trim(path, '/') AS normal FROM (SELECT page_id, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages)")
def url_families(spark, d):
    path = F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1)
    family = rel.classify([("english", path.rlike("^/en/[^/]+")), ("german", path.startswith("/de/"))], "other")
    return table(spark, d, "pages").select("page_id", family.alias("family"), detectors.normal_route(path).alias("normal"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49 AND l_discount > 0.09) ")
def dormant_suppliers(spark, d):
    defs = table(spark, d, "supplier").select(
        F.lit("s").alias("path"), F.lit(1).alias("line"), F.col("s_suppkey").alias("name"),
        F.array().cast("array<string>").alias("decorators")
    )
    refs = table(spark, d, "lineitem").filter(
        "l_returnflag = 'R' AND l_quantity > 49 AND l_discount > 0.09"
    ).select(F.col("l_suppkey").alias("name"))
    free = detectors.dormant(defs, refs, refs).select(F.col("name").alias("s_suppkey"))
    return free.join(table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
