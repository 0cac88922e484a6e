"""Product codes of vectors: integer Lloyd rounds whose sums are kept up by what has changed.

Vectors lie packed in blocks, in a table bucketed by block; the assignments of a round
lie in another, bucketed alike, so the two meet without a shuffle.  A round shuffles
the plus and minus contributions of parts whose entry has changed, added up for each
block; the driver keeps counts and sums of ``parts`` x ``entries`` entries and nothing
that grows with the rows.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.llm._common import cut, held_until, parts_for, prepare, release, remove, scratch, shared_dir

#: Components are held within this, so that squared distances of a vector fit 64 bits.
MOST = 1 << 27
#: Vectors of a block.
BLOCK = 4096
DELTAS = "array<struct<part:int,entry:int,n:long,total:array<long>>>"
NONE = 255


def integers(vectors: pa.Array, scale: int) -> np.ndarray:
    """A row of floor(scale * x) for each vector; all have the same length."""
    flat = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return np.clip(np.floor(flat * scale), -MOST, MOST).astype(np.int32).reshape(len(vectors), -1)


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest entry (ties: the lower one) and its squared distance, exactly."""
    span = max(int(np.abs(part).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * span * span * part.shape[1] < 1 << 53:  # every number on the way is a whole double
        x, b = part.astype(np.float64), book.astype(np.float64)
        d = (x * x).sum(1)[:, None] - 2 * (x @ b.T) + (b * b).sum(1)[None, :]
        at = d.argmin(1)
        return at, d[np.arange(len(at)), at].astype(np.int64)
    best = np.full(len(part), np.iinfo(np.int64).max)
    at = np.zeros(len(part), np.int64)
    for k, entry in enumerate(book):
        d = ((part.astype(np.int64) - entry) ** 2).sum(1)
        at[d < best] = k
        best = np.minimum(best, d)
    return at, best


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (a byte for each part) and summed squared distances of the rows of ``x``; books[part, entry, position]."""
    parts, _, width = books.shape
    codes, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
    for p in range(parts):
        at, d = nearest(x[:, p * width : (p + 1) * width], books[p])
        codes[:, p] = at
        error += d
    return codes, error


def changes(x: np.ndarray, old: np.ndarray, new: np.ndarray, width: int) -> list[dict]:
    """For entries that rows have come to or left: the rows' number and sum, those that left counted negative."""
    out = []
    for p in range(new.shape[1]):
        moved = np.flatnonzero(old[:, p] != new[:, p])
        part = x[moved, p * width : (p + 1) * width].astype(np.int64)
        for codes, sign in ((new[moved, p], 1), (old[moved, p], -1)):
            for e in np.unique(codes):
                if e != NONE:
                    mine = part[codes == e]
                    out.append({"part": p, "entry": int(e), "n": sign * len(mine), "total": (sign * mine.sum(0)).tolist()})
    return out


def pack(rows: DataFrame, name: str, label: str, scale: int) -> DataFrame:
    """Blocks of up to ``BLOCK`` vectors: (block, ids, labels, vectors as packed 32-bit integers)."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"ids array<{types[name]}>, labels array<{types[label]}>, packed binary"

    def run(batches):
        held: list[pa.RecordBatch] = []

        def block():
            t = pa.Table.from_batches(held).combine_chunks()
            x = integers(t.column(2).combine_chunks(), scale)
            ends = pa.array([0, len(t)], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, t.column(k).combine_chunks()) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([*lists, pa.array([x.tobytes()], pa.binary())], names=["ids", "labels", "packed"])

        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(h.num_rows for h in held) + 512 > BLOCK:
                yield block()
                held = []
        if held:
            yield block()
        release()

    return rows.select(name, label, "vector").mapInArrow(run, schema).withColumn("block", F.monotonically_increasing_id())


def table_name() -> str:
    return f"codes_{uuid.uuid4().hex}"


def write_bucketed(df: DataFrame, buckets: int) -> tuple[str, DataFrame]:
    """(path, table) in the shared folder, bucketed by ``block``; the table's name is the path's last part."""
    name = table_name()
    path = f"{shared_dir(df.sparkSession)}/repolith/{name}"
    df.write.bucketBy(buckets, "block").sortBy("block").option("path", path).format("parquet").saveAsTable(name)
    return path, df.sparkSession.table(name)


def drop_bucketed(spark, path: str) -> None:
    """The table's name and its files."""
    spark.sql(f"DROP TABLE IF EXISTS {path.rsplit('/', 1)[1]}")
    remove(spark, [path])


def rounds(blocks: DataFrame, books: np.ndarray, number: int, write) -> np.ndarray:
    """The books after so many rounds over ``blocks``; ``write`` keeps each round's assignments."""
    parts, entries, width = books.shape
    counts = [[0] * entries for _ in range(parts)]
    sums = [[[0] * width for _ in range(entries)] for _ in range(parts)]
    last, path = None, None
    for _ in range(number):
        fixed = books

        def step(batches, books=fixed, width=width, parts=parts):
            for b in batches:
                for block, packed, old in zip(*(b.column(k).to_pylist() for k in range(3))):
                    x = np.frombuffer(packed, np.int32).reshape(-1, parts * width)
                    new, _ = assign(x, books)
                    old = np.full(new.shape, NONE, np.uint8) if old is None else np.frombuffer(old, np.uint8).reshape(new.shape)
                    delta = changes(x, old, new, width)
                    yield pa.RecordBatch.from_pylist(
                        [{"block": block, "codes": new.tobytes(), "deltas": delta}],
                        schema=pa.schema([("block", pa.int64()), ("codes", pa.binary()), ("deltas", pa.list_(pa.struct(
                            [("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))]
                        )))])
                    )
            release()

        if last is None:
            rows = blocks.select("block", "packed", F.lit(None).cast("binary").alias("codes"))
        else:
            rows = blocks.select("block", "packed").join(last.select("block", "codes").hint("merge"), "block")
        before = path
        path, last = write(rows.select("block", "packed", "codes").mapInArrow(step, f"block long, codes binary, deltas {DELTAS}"))
        if before is not None:
            drop_bucketed(blocks.sparkSession, before)
        moved = last.select(F.explode("deltas").alias("d")).select("d.*")
        total = [F.sum(F.col("total")[k].cast("decimal(38,0)")).alias(f"t{k}") for k in range(width)]
        for d in moved.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect():  # one row for each entry at most
            counts[d.part][d.entry] += d.n
            sums[d.part][d.entry] = [a + int(d[f"t{k}"]) for k, a in enumerate(sums[d.part][d.entry])]
        books = books.copy()
        for p in range(parts):
            for e in range(entries):
                if counts[p][e]:
                    books[p, e] = [s // counts[p][e] for s in sums[p][e]]
    if path is not None:
        drop_bucketed(blocks.sparkSession, path)
    return books


def compress(
    rows: DataFrame, name: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = 8, entries: int = 16, number: int = 6, scale: int = 4096
) -> DataFrame:
    """Rows (name, code, error, label_error, codebooks_sha256) for every whole and finite vector.

    Components become floor(scale * x) and vectors are cut into ``parts`` equal parts.
    The books begin with the parts of the ``entries`` rows of least name (nulls last,
    ties by vector); ``number`` times every part goes to its nearest entry (ties to the
    lower) and every entry that has parts becomes the floor of their mean.  ``code``
    has two hex digits for each part, ``error`` the summed squared distances,
    ``label_error`` the errors of all rows of that label (nulls are one label; null beyond 64 bits),
    ``codebooks_sha256`` the digest of all final components, joined by commas.

    Dropped: vectors that are null, hold null or non-finite components, have no
    component, or have not the length of the first row (by name) or one that ``parts``
    divides.  With fewer rows than entries, the books have that many entries.
    Components beyond 2^27 count as that.  Repeated rows count as often as they stand
    there and give repeated results; an empty table gives no rows; other columns are
    ignored.  At most 255 entries.
    """
    if not 1 <= entries <= 255:
        raise ValueError("1 to 255 entries")
    spark = prepare(rows.sparkSession)
    x = F.col(f"`{vector}`")
    sound = x.isNotNull() & (F.size(x) > 0) & (F.size(x) % parts == 0) & F.forall(
        x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    )
    kept = rows.filter(sound).select(
        F.col(f"`{name}`").alias("name"), F.col(f"`{label}`").alias("label"), F.transform(x, lambda c: c.cast("double")).alias("vector")
    )
    first = kept.orderBy(F.col("name").asc_nulls_last(), "vector").limit(entries).collect()
    if first:
        first = [r for r in first if len(r.vector) == len(first[0].vector)]
    out = f"name {kept.schema['name'].dataType.simpleString()}, label {kept.schema['label'].dataType.simpleString()}, code string, error long"
    if not first:
        found, digest = spark.createDataFrame([], out), hashlib.sha256(b"").hexdigest()
    else:
        length = len(first[0].vector)
        kept = kept.filter(F.size("vector") == length)
        if len(first) < entries:  # others of another length were among the least
            first = kept.orderBy(F.col("name").asc_nulls_last(), "vector").limit(entries).collect()
        start = integers(pa.array([r.vector for r in first], pa.list_(pa.float64())), scale)
        books = start.astype(np.int64).reshape(len(first), parts, length // parts).transpose(1, 0, 2)
        with scratch(spark):  # the packed table goes once it is dealt; block numbers must not change before that
            packed = cut(pack(kept, "name", "label", scale))
            buckets = parts_for(packed)
            path, blocks = write_bucketed(packed.repartition(buckets, "block"), buckets)
        held_until(path)
        books = rounds(blocks, np.ascontiguousarray(books), number, lambda df: write_bucketed(df, buckets))
        spark.sql(f"DROP TABLE IF EXISTS {path.rsplit('/', 1)[1]}")
        digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

        def last(batches, books=books, length=length):
            for b in batches:
                for k in range(b.num_rows):
                    ids, labels = (b.column(c)[k].values for c in (0, 1))
                    codes, error = assign(np.frombuffer(b.column(2)[k].as_py(), np.int32).reshape(-1, length), books)
                    text = [c.tobytes().hex() for c in codes]
                    for s in range(0, len(text), 2048):
                        e = slice(s, s + 2048)
                        yield pa.RecordBatch.from_arrays(
                            [ids[e], labels[e], pa.array(text[e]), pa.array(error[e])], names=["name", "label", "code", "error"]
                        )
            release()

        found = spark.read.parquet(path).select("ids", "labels", "packed").mapInArrow(last, out)
    found = cut(found)
    whole = found.groupBy("label", F.xxhash64("label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    whole = whole.select(F.col("label").alias("of"), "label_error")
    return found.join(whole, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("name").alias(name), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
