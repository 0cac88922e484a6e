"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame functions only.

A sketch has three tables of cells; a digest adds itself to one cell of each: a count, an
XOR of digests and one of their checks.  Sketches of two versions subtract cell by cell.
What both hold cancels out; a cell left with one digest gives it away, and taking that
one out of its other cells may free the next (peeling).  Where cells stay, larger
sketches are made: the digests are divided by their leading bits, and a part that still
won't peel gets wider tables, then all is divided further.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.llm._common import cut, prepare, reducers

TABLES = 3
#: The number of cells in a table is a power of two: of a fingerprint, and of the larger sketch of a part.
CELLS, WIDER = 3, 5
#: Digests of both versions that a part of a divided comparison holds on average.
LOAD = 8
#: Rounds of peeling; a sketch that needs more counts as failed.
ROUNDS = 8
#: Bytes of text that a bucket of neighbours holds at most, about.
BUCKET = 64 << 20
#: Documents in the sample for each bucket whose border it sets.
PER_BUCKET = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def once(rows: DataFrame, **values: Column) -> DataFrame:
    """Further columns that later expressions read, but don't compute again."""
    packed = F.explode(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))).alias("_once")
    return rows.select("*", packed).select(*rows.columns, "_once.*")


def check(d: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(d), 32)


def digests(text: Column) -> Column:
    """The distinct digests of the text's paragraphs (lines that aren't blank), ascending."""
    said = F.filter(F.split(text, "\n"), lambda p: F.trim(p) != "")
    return F.array_sort(F.array_distinct(F.transform(said, lambda p: F.xxhash64(p))))


def hit(d: Column, at: Column, bits: int) -> Column:
    """Whether a digest is in a cell; table k goes by the bits from 10 k on."""
    low = F.lit((1 << bits) - 1)
    return F.call_function("shiftright", d, F.shiftright(at, bits) * 10).bitwiseAND(low) == at.bitwiseAND(low)


def cell(n: Column, d: Column, c: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), d.cast("long").alias("d"), c.cast("long").alias("c"))


def sketch(found: Column, bits: int) -> Column:
    """The cells of all tables, for an array of digests."""
    zero = cell(F.lit(0), F.lit(0), F.lit(0))
    add = lambda a, d: cell(a.n + 1, a.d.bitwiseXOR(d), a.c.bitwiseXOR(check(d)))
    one = lambda at: F.aggregate(found, zero, lambda a, d: F.when(hit(d, at, bits), add(a, d)).otherwise(a))
    return F.transform(F.sequence(F.lit(0), F.lit((TABLES << bits) - 1)), one)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: cell(x.n - y.n, x.d.bitwiseXOR(y.d), x.c.bitwiseXOR(y.c)))


def peel(cells: Column, bits: int) -> Column:
    """struct(ok, plus, minus) of a subtracted sketch: whether all came off, and how many digests were of either side."""

    def take(s: Column, found: Column) -> Column:
        off = lambda a, f: cell(a.n - f.n, a.d.bitwiseXOR(f.d), a.c.bitwiseXOR(f.c))
        left = F.transform(s.cells, lambda x, at: F.aggregate(found, x, lambda a, f: F.when(hit(f.d, at, bits), off(a, f)).otherwise(a)))
        added = F.size(F.filter(found, lambda f: f.n == 1))
        return F.struct(
            left.alias("cells"), (s.plus + added).alias("plus"), (s.minus + F.size(found) - added).alias("minus"), (F.size(found) > 0).alias("more")
        )

    def step(s: Column, _: Column) -> Column:
        lone = F.array_distinct(F.filter(s.cells, lambda x: (F.abs(x.n) == 1) & (x.c == check(x.d))))
        return F.when(s.more, let(lone, lambda found: take(s, found))).otherwise(s)

    start = F.struct(cells.alias("cells"), F.lit(0).alias("plus"), F.lit(0).alias("minus"), F.lit(True).alias("more"))
    done = lambda s: F.forall(s.cells, lambda x: (x.n == 0) & (x.d == 0) & (x.c == 0))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.struct(done(s).alias("ok"), s.plus.alias("plus"), s.minus.alias("minus"))
    )


def below(found: Column, least: Column) -> Column:
    """How many of the ascending digests are less, by binary search."""

    def step(s: Column, _: Column) -> Column:
        mid = F.shiftright(s.lo + s.hi, 1)
        down = F.struct(s.lo.alias("lo"), mid.alias("hi"))
        up = F.struct((mid + 1).alias("lo"), s.hi.alias("hi"))
        return F.when(s.lo >= s.hi, s).when(F.get(found, mid) < least, up).otherwise(down)

    steps = F.sequence(F.lit(0), F.floor(F.log2(F.size(found) + 1)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(found).alias("hi")), step, lambda s: s.lo)


def divided(a: Column, b: Column, level: int) -> Column:
    """struct(ok, plus, minus) of sketches for each part of the digests, four times as many parts a level."""

    def part(found: Column, bits: Column, v: Column) -> Column:
        start = below(found, F.call_function("shiftleft", v, 64 - bits))
        end = F.when(v + 1 == F.call_function("shiftleft", F.lit(1).cast("long"), bits - 1), F.size(found)).otherwise(
            below(found, F.call_function("shiftleft", v + 1, 64 - bits))
        )
        return let(start, lambda s: F.slice(found, s + 1, end - s))

    def compared(x: Column, y: Column) -> Column:
        at = lambda bits: peel(minus(sketch(x, bits), sketch(y, bits)), bits)
        return let(at(CELLS), lambda r: F.when(r.ok, r).otherwise(at(WIDER)))

    def whole(bits: Column) -> Column:
        half = F.call_function("shiftleft", F.lit(1).cast("long"), bits - 1)
        each = F.transform(
            F.sequence(-half, half - 1), lambda v: let(part(a, bits, v), lambda x: let(part(b, bits, v), lambda y: compared(x, y)))
        )
        nothing = F.struct(F.lit(True).alias("ok"), F.lit(0).alias("plus"), F.lit(0).alias("minus"))
        return F.aggregate(
            each, nothing, lambda s, r: F.struct((s.ok & r.ok).alias("ok"), (s.plus + r.plus).alias("plus"), (s.minus + r.minus).alias("minus"))
        )

    size = F.ceil(F.log2((F.size(a) + F.size(b)) / F.lit(float(LOAD)) + 1)).cast("int")
    return let(F.greatest(F.lit(1), size) + 2 * level, whole)


def likeness(a: Column, b: Column, result: Column) -> Column:
    """Digests of both by digests of either (1 where there are none); null where the sketches didn't peel."""
    both = (F.size(a) + F.size(b) - result.plus - result.minus) / 2
    either = both + result.plus + result.minus
    return F.when(result.ok, F.when(either == 0, 1.0).otherwise(both / either))


def written(cells: Column) -> Column:
    """A sketch as text: 16 bytes for each cell, in base 64."""
    each = F.transform(cells, lambda x: F.concat(F.lpad(F.hex(x.n), 8, "0"), F.lpad(F.hex(x.d), 16, "0"), F.lpad(F.hex(x.c), 8, "0")))
    return F.translate(F.base64(F.unhex(F.array_join(each, ""))), "\r\n", "")


def _borders(keys: DataFrame, buckets: int, n: int, first) -> list[tuple]:
    """Keys that divide all texts in buckets of about equal size, from a sample whose size goes by their number."""
    share = min(1.0, PER_BUCKET * buckets / n)
    drawn = F.pmod(F.xxhash64("id", "h1", "h2"), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = sorted((r.id, r.h1, r.h2, r.size) for r in keys.filter(drawn).select("id", "h1", "h2", "size").collect())
    each, held, out = sum(r[3] for r in sample) / buckets, 0, []
    for *key, size in sample:
        if held >= each * (len(out) + 1) and tuple(key) != first:
            out.append(tuple(key))
        held += size
    return out


def followed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, found, next, next_found, times): every document with its paragraph digests and the next document's text and digests.

    Documents go by doc_id, nulls last, ties by two hashes of the text; the last is
    followed by the first.  Each goes to a bucket of neighbours with its text, once; the
    first of a bucket goes to the bucket before it too.  Rows that repeat doc_id and
    text are made one row first, if there are any; ``times`` says how often a row of
    the result stands.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("id"),
        F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text")
    )
    size = F.max(F.octet_length("text") + 200).alias("size")
    keys = cut(rows.groupBy("id", "h1", "h2").agg(F.count("*").alias("copies"), size))
    n, most, first, held = keys.agg(F.count("*"), F.max("copies"), F.min(F.struct("id", "h1", "h2")), F.sum("size")).first()
    if not n:
        empty = "array<bigint>"
        return rows.filter("false").select(
            "doc_id", "text", F.lit(None).cast(empty).alias("found"), F.lit("").alias("next"), F.lit(None).cast(empty).alias("next_found"), F.lit(1).cast("long").alias("times")
        )
    if most > 1:
        rows = rows.groupBy("id", "h1", "h2").agg(F.any_value("doc_id").alias("doc_id"), F.any_value("text").alias("text"), F.count("*").alias("copies"))
    else:
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    tasks = reducers(docs.sparkSession)
    buckets = tasks * math.ceil(held / BUCKET / tasks)
    borders = _borders(keys, min(n, buckets), n, tuple(first))
    last = len(borders)
    heads = [[tuple(first), *borders][k] for k in range(last + 1)]
    lists = [F.split(F.lit(",".join(str(h[k]) for h in heads)), ",").cast("array<bigint>") for k in range(3)]
    key = ("id", "h1", "h2")

    def step(s: Column, _: Column) -> Column:  # the last head that isn't above the key
        mid = F.shiftright(s.lo + s.hi + 1, 1)
        above = F.struct(*[F.get(x, mid) for x in lists]) > F.struct(*key)
        return F.when(s.lo >= s.hi, s).when(above, F.struct(s.lo.alias("lo"), (mid - 1).alias("hi"))).otherwise(F.struct(mid.alias("lo"), s.hi.alias("hi")))

    search = F.aggregate(F.sequence(F.lit(0), F.lit(last.bit_length())), F.struct(F.lit(0).alias("lo"), F.lit(last).alias("hi")), step, lambda s: s.lo)
    dealt = once(rows, own=search)
    is_head = F.struct(*[F.get(x, F.col("own")) for x in lists]) == F.struct(*key)
    home = F.struct(F.col("own").alias("bucket"), F.lit(False).alias("guest"))
    before = F.struct(F.pmod(F.col("own") - 1, F.lit(last + 1)).alias("bucket"), F.lit(True).alias("guest"))
    dealt = dealt.select(*key, "doc_id", "text", "copies", F.explode(F.when(is_head, F.array(home, before)).otherwise(F.array(home))).alias("to"))
    dealt = dealt.select(*key, "doc_id", "text", "copies", "to.*").repartitionById(last + 1, F.col("bucket"))
    order = Window.partitionBy("bucket").orderBy("guest", *key)
    near = dealt.withColumn("found", digests(F.col("text")))
    near = near.withColumns({"next": F.lead("text").over(order), "next_found": F.lead("found").over(order)}).filter("NOT guest")
    one = lambda text, found, times: F.struct(text.alias("next"), found.alias("next_found"), times.cast("long").alias("times"))
    following = one(F.col("next"), F.col("next_found"), F.lit(1))
    if most > 1:  # copies but the last are followed by a copy
        again = one(F.col("text"), F.col("found"), F.col("copies") - 1)
        following = F.explode(F.when(F.col("copies") > 1, F.array(following, again)).otherwise(F.array(following)))
    return near.select("doc_id", "text", "found", following.alias("v")).select("doc_id", "text", "found", "v.*")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every document.

    The edited text has the last half of the code points replaced by as many first ones
    (or all) of the next document, by ascending doc_id; after the last comes the first.
    A fingerprint is the sketch of a text's distinct paragraphs, 3 x 8 cells in base 64.
    Likeness is the share of common paragraphs in all of both, from the peeled
    difference of the two sketches, or of larger ones where those don't peel.

    Null texts are empty, without paragraphs, and like each other.  Null doc_ids come
    last, ties are ordered by hashes of the text; rows that repeat doc_id and text are
    documents of their own, next to each other.  Only doc_id and text are read, so other
    columns of any name don't matter.  An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    rows = followed(docs)
    rows = once(rows, n_chars=F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next", F.lit(1), half))
    rows = once(rows, edited=edited).drop("text", "next")
    rows = once(rows, edited_sha256=F.sha2("edited", 256), edited_found=digests(F.col("edited"))).drop("edited")
    # the edited text and the next one, side by side from here on
    rows = rows.withColumn("others", F.array("edited_found", "next_found")).drop("edited_found", "next_found")
    own, a = F.col("cells"), F.col("found")
    every = F.transform(F.concat(F.array(a), F.col("others")), lambda x: sketch(x, CELLS))
    rows = once(rows, every=every).withColumn("cells", F.col("every")[0])
    rows = once(rows, results=F.transform(F.slice("every", 2, 2), lambda x: peel(minus(own, x), CELLS)))
    rows = rows.select(
        "doc_id", "n_chars", "edited_sha256", written(own).alias("fingerprint"), written(F.col("every")[1]).alias("edited_fingerprint"),
        F.zip_with("others", "results", lambda b, r: likeness(a, b, r)).alias("near"), "found", "others", "times"
    )
    names, done, level = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"], [], 0
    while True:
        again = F.zip_with("near", "others", lambda n, b: F.when(n.isNull(), divided(a, b, level)))
        tried = once(rows, again=again)
        near = F.transform(F.arrays_zip("near", "others", "again"), lambda x: F.coalesce(x.near, likeness(a, x.others, x.again)))
        tried = tried.withColumn("near", near).drop("again")
        whole = ~F.exists("near", lambda x: x.isNull())
        held = cut(tried.withColumns({c: F.when(~whole, F.col(c)) for c in ("found", "others")}))
        done.append(held.filter(whole).select(*names, F.col("near")[0].alias("near_edited"), F.col("near")[1].alias("near_next"), "times"))
        rows = held.filter(~whole)
        if rows.isEmpty():
            break
        level += 1
    names += ["near_edited", "near_next"]
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select(*names)
