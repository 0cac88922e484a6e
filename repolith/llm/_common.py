"""What the training-data operators share: session set-up, cutting lineage and packed blocks.

A packed block is one binary value that holds several numpy columns of equal
length.  Map tasks deal their keys to blocks by hash, one block for each
reducer, so a shuffle moves few large rows and reducers work on whole arrays.
A map task first reduces what it holds to one entry for each key, so a key
that is in a third of all rows reaches a reducer once for each map task only.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
U64 = np.uint64
#: Bytes of an Arrow batch, and of the compressed input whose blocks a reducer holds at once.
BATCH, SLICE = 16 << 20, 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and keep the session's Arrow batches small enough for long texts, by rows and by bytes."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 512:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH)).rstrip("b")) > BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    return spark


def release() -> None:
    """Give freed memory back, which idle workers would otherwise hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset and all runs on one machine (as in tests), one of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "repolith-checkpoints")
    return found.rstrip("/")


#: Lists that the open ``scratch`` blocks collect the paths of cut tables in.
_open: list[list[str]] = []


def cut(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared folder and reread them: lineage ends, lost executors lose nothing.

    The table stays as long as a result may read it; see ``scratch``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/repolith/{uuid.uuid4().hex}"
    df.write.parquet(path)
    held_until(path)
    return spark.read.schema(df.schema).parquet(path)


def held_until(path: str) -> None:
    """A table's files go with the innermost open ``scratch`` block, if there is one."""
    if _open:
        _open[-1].append(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables, by Spark's own file systems."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables cut within the block go when it ends: write what is to stay before that."""
    held: list[str] = []
    _open.append(held)
    try:
        yield held
    finally:
        _open.remove(held)
        remove(spark, held)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores put before them until no column has them (Spark takes no notice of case)."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def reducers(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bytes that Spark takes rows to have whose size it doesn't know, or more.
UNKNOWN = 2.0**60


def parts_for(rows: DataFrame) -> int:
    """Parts that keys are dealt to: as many for each reducer as its share of the input has slices.

    A reducer's parts come to it in order, one at a time, so that what it holds at
    once doesn't grow with the input.
    """
    n = reducers(rows.sparkSession)
    size = float(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    slices = math.ceil(size / SLICE / n) if size < UNKNOWN else 16
    return n * max(1, slices)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def deal(part: np.ndarray, cols: list[np.ndarray]):
    """Yield (part, packed block) for the rows of each part."""
    order = np.argsort(part, kind="stable")
    part, cols = part[order], [c[order] for c in cols]
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
    for s, e in zip(starts, [*starts[1:], len(part)]):
        yield int(part[s]), b"".join(c[s:e].tobytes() for c in cols)


def unpack(blobs: list[bytes], kinds: list[str]) -> list[np.ndarray]:
    """Columns of the given dtypes from packed blocks."""
    width, out = sum(np.dtype(k).itemsize for k in kinds), [[] for _ in kinds]
    for b in blobs:
        n, at = len(b) // width, 0
        for k, kind in enumerate(kinds):
            out[k].append(np.frombuffer(b, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(x) if x else np.empty(0, k) for x, k in zip(out, kinds)]


BLOCKS = "part int, kind int, block binary"


def block_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, kind, block = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(block, pa.binary())],
        names=["part", "kind", "block"]
    )


def gather(blocks: DataFrame, reduce, schema: str) -> DataFrame:
    """``reduce({kind: [block, ...]})`` sees all blocks of a part, one part after another.

    Parts are dealt to reducers and sorted there by Spark, which spills, so a task holds one part's blocks at once.
    """

    def run(batches):
        now, kinds = None, {}
        for b in batches:
            for p, k, x in zip(*(b.column(i).to_pylist() for i in range(3))):
                if p != now and kinds:
                    yield from reduce(kinds)
                    kinds = {}
                now = p
                kinds.setdefault(k, []).append(x)
        yield from reduce(kinds)
        kinds.clear()
        release()

    n = reducers(blocks.sparkSession)
    return blocks.repartitionById(n, F.pmod("part", F.lit(n))).sortWithinPartitions("part").mapInArrow(run, schema)


def with_keys(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc (null: the least long), tie (64 bits that tell texts of one doc_id apart) and the text's UTF-8 bytes (null: empty)."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"),
        F.xxhash64(body).alias("tie"),
        F.col("doc_id"),
        body.cast("binary").alias("body"),
    )


def first_flags(keys: list[np.ndarray], places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort by keys, then places.  Returns the order, whether an entry begins a new key, and whether its place is that key's first."""
    order = np.lexsort([*places[::-1], *keys[::-1]])
    if not len(order):
        return order, np.zeros(0, bool), np.zeros(0, bool)
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    first = np.ones(len(order), bool)
    for p in places:
        p = p[order]
        first &= p == p[head]
    return order, new, first
