"""Leases on rules: granted, looked up, used up, expired and ended, as two keyed states with timers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from repolith.session import prepare

#: A compound command, which no grant covers.
COMPOUND = re.compile(r"[;&|`\n]|\$\(")
#: What events may hold, in the order in which rows go from one state to the next.
EVENT = {
    "rule_id": "string", "kind": "string", "at": "long", "ordinal": "long", "grant_id": "string", "expires_at": "long", "session_id": "string",
    "uses": "int", "command_pattern": "string", "path_regex": "string", "command": "string", "paths": "array<string>", "event_time": "timestamp",
}
GRANT = "grant_id string, expires_at long, session_id string, uses int, command_pattern string, path_regex string"


def covers(grant: Row, request: Row) -> bool:
    """Whether a grant fits a request: its session, its command and all its paths; compound commands and, where a glob is set, empty path lists never fit."""
    if grant.session_id is not None and grant.session_id != request.session_id:
        return False
    command, paths = request.command or "", list(request.paths or [])
    if grant.command_pattern and (COMPOUND.search(command) or not re.search(grant.command_pattern, command)):
        return False
    return not grant.path_regex or (bool(paths) and all(re.search(grant.path_regex, p) for p in paths))


def in_order(rows: Iterator[Row]) -> list[Row]:
    return sorted(rows, key=lambda r: (r.at, r.ordinal))


class Sessions(StatefulProcessor):
    """By session: the rules that have had a grant in it and when the last of each expires.  An end becomes one end for each of them; all else goes on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rules = handle.getMapState("rules", "rule_id string", "expires_at long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in in_order(rows):
            if r.kind == "end":
                for rule in [k[0] for k in self.rules.keys()]:
                    yield Row(**{n: rule if n == "rule_id" else r[n] for n in EVENT})
                self.rules.clear()
                continue
            if r.kind == "grant" and r.session_id is not None:
                held = self.rules.getValue((r.rule_id,)) if self.rules.containsKey((r.rule_id,)) else None
                last = max(r.expires_at, held[0] if held else r.expires_at)
                self.rules.updateValue((r.rule_id,), (last,))
                self.handle.registerTimer((last + 1) * 1000)
            yield Row(**{n: r[n] for n in EVENT})

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        for rule in [k for k, v in self.rules.iterator() if (v[0] + 1) * 1000 <= now]:
            self.rules.removeKey(rule)
        return iter(())

    def close(self) -> None:
        pass


class Leases(StatefulProcessor):
    """By rule: its live grants in the order they came."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.grants = handle.getListState("grants", GRANT)

    def keep(self, grants: list[Row]) -> None:
        if grants:
            self.grants.put([tuple(g) for g in grants])
        else:
            self.grants.clear()

    def held(self) -> list[Row]:
        named = Row(*[f.split()[0] for f in GRANT.split(", ")])
        return [named(*g) for g in self.grants.get()]

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        named = Row(*[f.split()[0] for f in GRANT.split(", ")])
        grants = self.held()
        for r in in_order(rows):
            grants = [g for g in grants if g.expires_at >= r.at]
            if r.kind == "grant":
                grants.append(named(r.grant_id, r.expires_at, r.session_id, r.uses, r.command_pattern, r.path_regex))
                self.handle.registerTimer((r.expires_at + 1) * 1000)
            elif r.kind == "end":
                grants = [g for g in grants if g.session_id != r.session_id]
            else:
                nth = next((k for k, g in enumerate(grants) if covers(g, r)), None)
                yield Row(rule_id=key[0], ordinal=r.ordinal, grant_id=None if nth is None else grants[nth].grant_id)
                if nth is not None and grants[nth].uses is not None:
                    left = grants[nth].uses - 1
                    grants[nth : nth + 1] = [named(*[left if n == "uses" else grants[nth][n] for n in grants[nth].__fields__])] if left > 0 else []
        self.keep(grants)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        self.keep([g for g in self.held() if (g.expires_at + 1) * 1000 > now])
        return iter(())

    def close(self) -> None:
        pass


#: The state store that keyed states with timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_states(df: DataFrame) -> DataFrame:
    """The stream, in a session whose state store can keep lists, maps and timers."""
    prepare(df.sparkSession).conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return df


def lease_stream(events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """(rule_id, ordinal, grant_id or null) for each request, in (at, ordinal) order within a micro-batch.

    events: rule_id, kind (grant, request, end), at and expires_at (long seconds),
    ordinal, grant_id, session_id, uses, and if they matter command_pattern and
    path_regex of grants, command and paths of requests.  Expiry is inclusive.  A grant
    without uses left goes, and so does one whose expiry the watermark has passed
    (``delay`` behind the latest event), though its rule stays silent.  A session's end
    takes its grants from all rules, whatever rule the event names.  Events behind the
    watermark are dropped.
    """
    there = set(events.columns)
    rows = keyed_states(events).select(
        *[(F.col(c) if c in there else F.lit(None)).cast(t).alias(c) for c, t in EVENT.items() if c != "event_time"],
        F.timestamp_seconds("at").alias("event_time")
    ).withWatermark("event_time", delay)
    schema = ", ".join(f"{c} {t}" for c, t in EVENT.items())
    told = rows.withColumn("session", F.coalesce("session_id", F.lit(""))).groupBy("session").transformWithState(
        Sessions(), schema, "Append", "EventTime", eventTimeColumnName="event_time"
    )
    return told.groupBy("rule_id").transformWithState(Leases(), "rule_id string, ordinal long, grant_id string", "Append", "EventTime")
