"""Append-only logs as streams: entities folded to their last state, and claims held against recent evidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from repolith.streaming.leases import keyed_states


def log_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON, from whatever files come to a folder."""
    return spark.readStream.schema(schema).json(path)


def each_batch(stream: DataFrame, fold: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    """Run ``fold`` on every micro-batch that is there, then stop."""
    return stream.writeStream.outputMode(mode).foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class LastState(StatefulProcessor):
    """By entity: the intake's state, or that of the last transition by (at, ordinal), and how many there were."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long, ordinal long, state string, transitions long")

    def handleInitialState(self, key: Any, initialState: Row, timerValues) -> None:
        self.last.update((None, None, initialState.state, 0))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        at, ordinal, state, n = self.last.get() if self.last.exists() else (None, None, None, 0)
        if n == 0 and state is None:
            return  # of no entity that the intake knows
        for r in rows:
            n += 1
            if at is None or (r.at, r.ordinal) >= (at, ordinal):
                at, ordinal, state = r.at, r.ordinal, r.to_state
        self.last.update((at, ordinal, state, n))
        yield Row(id=key[0], state=state, transitions=n)

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame, intake: DataFrame) -> DataFrame:
    """(id, state, transitions) of every entity that a micro-batch has moved; the state begins with the rows of ``intake``.

    events: id, at, ordinal, to_state; intake: id, state.  As ``detectors.fold_states``
    over all events so far; events of unknown entities are passed over, those without a time come first.
    """
    rows = keyed_states(events).select("id", F.coalesce(F.unix_micros("at"), F.lit(-(2**63))).alias("at"), F.col("ordinal").cast("long").alias("ordinal"), "to_state")
    kind = rows.schema["id"].dataType.simpleString()
    known = intake.select("id", "state").groupBy("id")
    return rows.groupBy("id").transformWithState(LastState(), f"id {kind}, state string, transitions long", "Update", "None", known)


def keep_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A fold for ``each_batch``: a batch has a folder of its own, so one that comes again writes the same once more."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def kept_states(spark: SparkSession, path: str, intake: DataFrame) -> DataFrame:
    """(id, state, transitions) from the batches that are kept, and from the intake where nothing has moved."""
    last = F.max_by(F.struct("state", "transitions"), "batch").alias("x")
    moved = spark.read.parquet(path).groupBy("id").agg(last).select("id", F.col("x.state").alias("__state"), "x.transitions")
    rows = intake.select("id", "state").join(moved, "id", "left")
    return rows.select("id", F.coalesce("__state", "state").alias("state"), F.coalesce("transitions", F.lit(0)).alias("transitions"))


def backed_stream(claims: DataFrame, evidence: DataFrame, by: list[str], key: str, hours: int = 12, delay: str = "1 hour") -> DataFrame:
    """Claims with ``backed``: whether evidence of the same key lies at most ``hours`` before them (inclusive), each claim once.

    A join of two streams bounded in event time: evidence leaves the state ``hours``
    after it, a claim once the watermarks have passed it.  A claim is told as backed as
    soon as evidence is there, and as not backed only when none can come any more;
    evidence that comes later than ``delay`` is dropped and backs nothing.  ``key`` tells
    claims apart.  This goes beyond ``detectors.recent_evidence``, which looks at all rows.
    """
    c = claims.withWatermark("at", delay).alias("c")
    e = evidence.select(*[F.col(b).alias(f"__{b}") for b in by], F.col("at").alias("__at")).withWatermark("__at", delay).alias("e")
    near = (F.col("__at") <= F.col("at")) & (F.col("__at") >= F.col("at") - F.expr(f"INTERVAL {int(hours)} HOURS"))
    for b in by:
        near = near & (F.col(b) == F.col(f"__{b}"))
    rows = c.join(e, near, "leftOuter").select(*claims.columns, F.col("__at").isNotNull().alias("backed"))
    return rows.dropDuplicatesWithinWatermark([key])
