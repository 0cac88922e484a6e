"""What operators ask of the session: the package on the workers' path, and tables in the shared folder that cut lineage."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, from whatever folder the driver was started."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset and all runs on one machine (as in tests), one of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "repolith-checkpoints")
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared folder and reread them: lineage ends, lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/repolith/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(files: DataFrame) -> DataFrame:
    """Files dealt by path to a few tasks for each core: many short files can lie in one part of a table, whose work would be one task's."""
    spark = files.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(parts, "path")


#: Bytes of input, as Spark estimates it, for each part that keys are dealt to, and the most bytes it is taken for.
PART_BYTES, UNKNOWN = 2 << 20, 1 << 34


def _size(rows: DataFrame) -> float:
    return float(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts_of(*tables: DataFrame, each: int = PART_BYTES) -> int:
    """Parts for a shuffle of what comes from these tables: one for each ``each`` bytes that they read, as many as the session has at least.

    What is read counts, not what Spark takes a join to give, which is the product of both
    sides.  If that size isn't known, there are 16 times as many as the session has.
    """
    leaves = [t._jdf.queryExecution().optimizedPlan().collectLeaves() for t in tables]
    size = sum(float(str(x.apply(k).stats().sizeInBytes())) for x in leaves for k in range(x.size()))
    least = int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(math.ceil(size / each), least) if size < 1 << 60 else 16 * least


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows dealt by key to parts whose number grows with the input, so that what groups them by these keys or more holds no more at a larger size."""
    parts = max(math.ceil(min(_size(rows), UNKNOWN) / PART_BYTES), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, *by)
