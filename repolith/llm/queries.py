"""The operators applied to their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.llm import bpe, codes, embeddings, langid, licenses, lines, middle, mixing, simhash, sketches, substrings, urls

URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(_read(spark, sf_dir, "documents"), 100)
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"), bits=4, width=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_read(spark, sf_dir, "embeddings"), cosine=0.93)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages"), URL_RULES)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(_read(spark, sf_dir, "documents"), weights=(1, 2, 3), share=1.0, most=3.0)
    return mixing.each_row(found).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.nearest(_read(spark, sf_dir, "embeddings"), every=50, k=5)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(
        _read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = middle.transform(_read(spark, sf_dir, "documents"))
    back = middle.restored(F.col("output"), F.col("form"))
    names = "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"
    return found.select(*names, back.text_sha256.alias("restored_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(_read(spark, sf_dir, "embeddings"), parts=8, entries=16, number=6, scale=4096)


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprints(_read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_simhash_dedup, op3_embedding_dedup, op4_url_filter, op5_license_scan, op6_source_mix,
        op7_nearest_vectors, op8_line_dedup, op9_language_id, op10_bpe_codec, op11_fill_in_middle, op12_vector_codes,
        op13_document_fingerprints
    )
}

ORACLE: dict[str, str] = {}

ORACLE["op1_suffix_dedup"] = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
z AS (SELECT doc_id, b, octet_length(b) AS n FROM d),
w AS (SELECT doc_id, unnest(range(0, n - 99)) AS i, b FROM z WHERE n >= 100),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY b[i + 1:i + 100] ORDER BY doc_id, i) AS k FROM w),
g AS (SELECT doc_id, i, max(i + 100) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r WHERE k > 1),
m AS (SELECT doc_id, i, sum(CASE WHEN reach IS NULL OR i > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
s AS (SELECT doc_id, span, min(i) AS a, max(i) + 100 AS e FROM m GROUP BY doc_id, span),
p AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM s
      UNION ALL SELECT z.doc_id, coalesce(max(s.e), 0), max(z.n) FROM z LEFT JOIN s USING (doc_id) GROUP BY z.doc_id),
k AS (SELECT p.doc_id, unhex(string_agg(hex(z.b[p.x + 1:p.y]), '' ORDER BY p.x)) AS kept FROM p JOIN z USING (doc_id) GROUP BY p.doc_id),
t AS (SELECT doc_id, sum(e - a) AS removed, count(*) AS spans FROM s GROUP BY doc_id)
SELECT z.doc_id, CAST(z.n AS BIGINT) AS n_bytes, CAST(coalesce(t.removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(t.spans, 0) AS BIGINT) AS n_spans, sha256(k.kept) AS kept_sha256
FROM z JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)
"""

ORACLE["op3_embedding_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
       AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
c(vec_id, reach) AS (SELECT vec_id, vec_id FROM v UNION SELECT c.vec_id, l.b FROM c JOIN l ON c.reach = l.a),
m AS (SELECT vec_id, min(reach) AS component_id FROM c GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, m.component_id, vec_id = m.component_id AS kept
FROM m LEFT JOIN n USING (vec_id)
"""

#: The templates' shingles, their number, and the length of the windows that they are looked for in.
_SCANNER = licenses.Scanner(licenses.NOTICES)
_WORDS = {n: licenses.WORD.findall(licenses.NOTICES[n].lower()) for n in _SCANNER.names}
_SHINGLES = {n: sorted({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) for n, w in _WORDS.items()}
_PAIRS = ", ".join(f"('{n}', '{s}')" for n, found in _SHINGLES.items() for s in found)
_WINDOWS = ", ".join(f"('{n}', {w}, {w // 2}, {len(_SHINGLES[n])})" for n, w in zip(_SCANNER.names, _SCANNER.window))

ORACLE["op5_license_scan"] = rf"""
WITH tp(license, shingle) AS (VALUES {_PAIRS}), ti(license, long, half, size) AS (VALUES {_WINDOWS}),
tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS ws FROM documents WHERE text <> ''),
spot AS (SELECT doc_id, ws, unnest(range(0, greatest(1, len(ws) - 4))) AS pos FROM tok WHERE len(ws) > 0),
sh AS (SELECT doc_id, pos, array_to_string(ws[pos + 1:pos + 5], ' ') AS s FROM spot),
hit AS (SELECT DISTINCT doc_id, license, pos, s FROM sh JOIN tp ON s = shingle),
win AS (SELECT DISTINCT doc_id, ti.license, long, half, size, greatest(0, (pos // half + k) * half) AS a FROM (SELECT DISTINCT doc_id, pos FROM hit), ti, (VALUES (-1), (0)) v(k)),
part AS (SELECT * FROM win w WHERE EXISTS (SELECT 1 FROM hit h WHERE h.doc_id = w.doc_id AND h.license = w.license AND h.pos >= a AND h.pos < a + long)),
found AS (SELECT w.doc_id, w.license, a, count(DISTINCT s) / size AS share, min(pos) AS p, max(pos) AS q
  FROM part w JOIN hit h ON h.doc_id = w.doc_id AND h.license = w.license AND pos >= a - half AND pos < a + long + half GROUP BY w.doc_id, w.license, a, size HAVING count(DISTINCT s) / size >= 0.8),
m AS (SELECT *, p > coalesce(max(q) OVER (PARTITION BY doc_id, license ORDER BY p, q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS new FROM found)
SELECT doc_id, license, max(share) AS containment, count(*) FILTER (new) AS matches, min(p) AS first_word FROM m GROUP BY doc_id, license
"""

ORACLE["op11_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS us, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2,
      CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(us) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS lo, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS hi,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(us[1:lo], ''), '') AS pre, coalesce(array_to_string(us[lo + 1:hi], ''), '') AS mid, coalesce(array_to_string(us[hi + 1:n], ''), '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


def _lloyd(number: int) -> str:
    """Rounds written out: a{k} has the nearest entries by the books c{k}, c{k + 1} the floors of their means."""
    steps = []
    for k in range(number + 1):
        steps.append(f"""
d{k} AS (SELECT x.id, x.part, c.entry, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN c{k} c ON x.part = c.part AND x.pos = c.pos GROUP BY ALL),
a{k} AS MATERIALIZED (SELECT id, part, min((d, entry)) AS best FROM d{k} GROUP BY ALL),""")
        if k < number:
            steps.append(f"""
m{k} AS (SELECT x.part, a.best[2] AS entry, x.pos, sum(x.v) AS s, count(*) AS n FROM x JOIN a{k} a ON x.id = a.id AND x.part = a.part GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, c.pos, CASE WHEN m.n IS NULL THEN c.v ELSE CAST((m.s - ((m.s % m.n) + m.n) % m.n) // m.n AS BIGINT) END AS v
  FROM c{k} c LEFT JOIN m{k} m ON c.part = m.part AND c.entry = m.entry AND c.pos = m.pos),""")
    return "".join(steps)


ORACLE["op12_vector_codes"] = f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS id, vec_id, label, list_transform(embedding, lambda z: CAST(floor(4096 * CAST(z AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0),
x AS MATERIALIZED (SELECT id, k * 8 // len(e) AS part, k % (len(e) // 8) AS pos, e[k + 1] AS v FROM (SELECT id, e, unnest(range(0, len(e))) AS k FROM v)),
c0 AS (SELECT part, id AS entry, pos, v FROM x WHERE id < 16),{_lloyd(6)}
b AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) AS h FROM c6),
r AS (SELECT id, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a6 GROUP BY id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM r JOIN v USING (id), b
"""

ORACLE["op8_line_dedup"] = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS t FROM d WHERE text IS NOT NULL),
s AS (SELECT * FROM l WHERE regexp_matches(t, '[^\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')),
f AS (SELECT t, min((doc_id, i)) AS place FROM s GROUP BY t),
k AS (SELECT t, place, unnest(range(1, length(t) + 1)) AS k FROM f WHERE length(t) >= 20),
v AS (SELECT t, place, k, left(t, k - 1) || substr(t, k + 1) AS x FROM k),
n AS (SELECT f.t FROM v JOIN f ON v.x = f.t AND length(f.t) >= 20 WHERE v.place < f.place
      UNION SELECT v.t FROM v JOIN f ON v.x = f.t AND length(f.t) >= 20 WHERE f.place < v.place
      UNION SELECT a.t FROM v a JOIN v b ON a.k = b.k AND a.x = b.x WHERE b.place < a.place),
g AS (SELECT s.doc_id, s.i FROM s JOIN f ON s.t = f.t WHERE (s.doc_id, s.i) > f.place OR s.t IN (SELECT t FROM n)),
r AS (SELECT l.doc_id, string_agg(l.t, chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS kept, count(*) AS n_lines, count(g.i) AS n_removed FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""
