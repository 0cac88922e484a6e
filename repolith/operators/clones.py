"""Clones from source: runs of equal tokens that stand earlier too, as line ranges of both places."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repolith.operators.intervals import placed
from repolith.session import parts_of, prepare

#: Words of ASCII letters, digits and underscores, and every other sign by itself.
TOKEN = re.compile(r"[A-Za-z0-9_]+|[^ \t-\rA-Za-z0-9_]")
#: An odd number whose powers weigh the tokens of a run.
WEIGHT = 0x9E3779B97F4A7C15
#: Runs of a stretch at most.
STRETCH = 512


def run_hashes(tokens: list[str], least: int) -> np.ndarray:
    """A 64-bit hash of each ``least`` tokens that follow each other, a sum over all runs at once."""
    known = {t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little") for t in set(tokens)}
    x = np.array([known[t] for t in tokens], np.uint64)
    n, total, weight = len(x) - least + 1, np.zeros(max(0, len(x) - least + 1), np.uint64), 1
    for k in range(least if n > 0 else 0):
        total += x[k : k + n] * np.uint64(weight)
        weight = weight * WEIGHT % (1 << 64)
    return (total ^ (total >> np.uint64(29))).view(np.int64)


def token_runs(files: DataFrame, least: int) -> DataFrame:
    """(key, path, at, hashes, lines): every run of ``least`` tokens, in stretches of runs that follow each other and have one key.

    A run's key is the least hash of the shorter runs within it, so equal runs have one
    key wherever they stand, and neighbours mostly share it: a run costs little more than
    its hash.  at: the place of the stretch's first run; lines: of each run's first and
    last token.
    """
    kind, short = files.schema["path"].dataType, (least + 1) // 2

    def binary(values, ends):
        return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * 8).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])

    def run(batches):
        for b in batches:
            for path, text in zip(b.column(0), b.column(1).to_pylist()):
                told = [(n, t) for n, line in enumerate((text or "").split("\n"), 1) for t in TOKEN.findall(line)]
                if len(told) < least or not path.is_valid:
                    continue
                tokens, lines = [t for _, t in told], np.array([n for n, _ in told], np.int32)
                hashes = run_hashes(tokens, least)
                keys = np.lib.stride_tricks.sliding_window_view(run_hashes(tokens, short), least - short + 1).min(axis=1)
                both = np.stack([lines[: len(hashes)], lines[least - 1 :]], axis=1)
                new = np.r_[True, keys[1:] != keys[:-1]]
                new[::STRETCH] = True
                for s in range(0, len(hashes), STRETCH * 1000):  # so that a very long text makes no very long batch
                    at = s + np.flatnonzero(new[s : s + STRETCH * 1000])
                    ends = np.r_[at, min(s + STRETCH * 1000, len(hashes))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[at]), pa.repeat(path, len(at)), pa.array(at.astype(np.int32)), binary(hashes[s : ends[-1]], ends - s), binary(both[s : ends[-1]], ends - s)],
                        names=["key", "path", "at", "hashes", "lines"]
                    )

    prepare(files.sparkSession)
    return files.select("path", "text").mapInArrow(run, f"key long, path {kind.simpleString()}, at int, hashes binary, lines binary")


def _flat(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of packed arrays of 8-byte items, and the number of items of each row."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind), np.diff(ends) // 8


def _met_earlier(batches):
    """Of stretches sorted by key, path and place: those parts whose runs stand earlier too, in the same order.

    A batch is settled at once.  Only the first places of the last key's runs are kept
    for the next batch, so copies of a passage cost no memory.
    """
    key = held = None
    for b in batches:
        if not b.num_rows:
            continue
        keys, (hashes, n), (lines, _) = b.column(0).to_numpy(), _flat(b.column(3), np.int64), _flat(b.column(4), np.int32)
        row, first_of_row = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
        at, lines = b.column(2).to_numpy()[row] + np.arange(len(row), dtype=np.int32) - first_of_row[row].astype(np.int32), lines.reshape(-1, 2)
        paths, key_of = b.column(1), keys[row]
        if held is not None and keys[0] == key:  # what was met first stands before the batch
            hashes, at, lines = np.r_[held[0], hashes], np.r_[held[1], at], np.concatenate([held[2], lines])
            row, key_of = np.r_[np.arange(len(held[0])), row + len(held[0])], np.r_[np.full(len(held[0]), key), key_of]
            paths = pa.concat_arrays([held[3], paths])
        order = np.argsort(hashes, kind="stable")
        new = np.r_[True, hashes[order][1:] != hashes[order][:-1]]
        first = np.empty(len(order), np.int64)
        first[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        key = keys[-1]
        keep = np.flatnonzero((first == np.arange(len(first))) & (key_of == key))
        held = hashes[keep], at[keep], lines[keep], paths.take(pa.array(row[keep]))
        file = paths.dictionary_encode().indices.to_numpy()[row]
        later = np.flatnonzero((file != file[first]) | (at != at[first]))
        if not len(later):
            continue
        f = first[later]
        shift = at[later] - at[f]
        more = (np.diff(later) == 1) & (np.diff(row[later]) == 0) & (file[f][1:] == file[f][:-1]) & (shift[1:] == shift[:-1])
        s = np.flatnonzero(np.r_[True, ~more])
        e = np.r_[s[1:], len(later)] - 1
        take = lambda x: paths.take(pa.array(row[x]))
        yield pa.RecordBatch.from_arrays(
            [take(later[s]), take(f[s]), *map(pa.array, (shift[s], at[later[s]], (e - s + 1).astype(np.int32), lines[later[s], 0], lines[later[e], 1], lines[f[s], 0], lines[f[e], 1]))],
            names=["path", "a", "shift", "at", "n", "line", "last", "a_line", "a_last"]
        )


def clone_pairs(files: DataFrame, least: int = 20) -> DataFrame:
    """(a, a_start, a_end, b, b_start, b_end, tokens): lines of ``b`` whose tokens stand earlier, and the lines of ``a`` where they do.

    Every run of ``least`` tokens is held against the first place that has it (least
    path, then position).  Runs of ``b`` that follow each other there as they do here are
    one pair, as long as can be.  So a passage that is in a thousand files gives a
    thousand pairs with the first of them, not one for each two files.  Blanks and line
    breaks don't matter.  files: path (distinct), text.

    Each run is shuffled once, in a stretch of its neighbours; what goes on from there
    are parts of pairs.
    """
    kind = files.schema["path"].dataType.simpleString()
    runs = token_runs(files, least).repartition(parts_of(files), "key").sortWithinPartitions("key", "path", "at")
    parts = runs.mapInArrow(_met_earlier, f"path {kind}, a {kind}, shift int, at int, n int, line int, last int, a_line int, a_last int")
    w = Window.partitionBy("path", "a", "shift").orderBy("at")
    new = F.coalesce(F.lag(F.col("at") + F.col("n")).over(w) != F.col("at"), F.lit(True)).cast("int")
    islands = parts.withColumn("new", new).withColumn("island", F.sum("new").over(w)).groupBy("path", "a", "shift", "island")
    return islands.agg(
        F.min("a_line").alias("a_start"), F.max("a_last").alias("a_end"), F.min("line").alias("b_start"), F.max("last").alias("b_end"),
        (F.sum("n") + least - 1).alias("tokens"),
    ).select("a", "a_start", "a_end", F.col("path").alias("b"), "b_start", "b_end", "tokens")


def duplication(files: DataFrame, spans: DataFrame, least: int = 20) -> DataFrame:
    """``clone_pairs`` with ``owner`` and ``reason`` of b's lines: the innermost span (path, start, end, name) that holds them, see ``intervals.placed``."""
    pairs = clone_pairs(files, least).withColumnsRenamed({"b": "path", "b_start": "start", "b_end": "end"})
    return placed(pairs, spans, ["path"], "name").withColumnsRenamed({"path": "b", "start": "b_start", "end": "b_end", "name": "owner"})
