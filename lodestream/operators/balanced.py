"""Exact results for every key in balanced work, however few keys hold most rows.

Rows are range partitioned on (key, time, id) by sampled quantiles, so a heavy key is split over
several partitions; each partition folds its rows into one state for each key, and the states of
keys that cross an edge are stitched in order of the partitions.

Defined results: rows with a null key are left out of the results (the caller counts them where
they matter); a null time counts as a row but takes no part in times and pauses; an empty table
gives no rows; columns other than the named ones are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.operators.runs import flat, ranged, starts
from lodestream.session import materialize

_NONE = np.iinfo(np.int64).min
_STATE = "key string, n_rows bigint, first_us bigint, last_us bigint, pause_us bigint, pid int, at_edge boolean"


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One state for each key of a sorted range: rows, first and last time, longest pause. Times in microseconds."""
    pid, held, is_first = TaskContext.get().partitionId(), None, True

    def out(states: list[tuple], edge: list[bool]) -> pa.RecordBatch:
        keys, *numbers = zip(*states, strict=True)
        blank = [pa.array([None if x == _NONE else x for x in c], pa.int64()) for c in numbers]
        return pa.record_batch([pa.array(keys, pa.string()), *blank, pa.array([pid] * len(keys), pa.int32()), pa.array(edge)], names=["key", "n_rows", "first_us", "last_us", "pause_us", "pid", "at_edge"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, us = flat(batch.column("key")), flat(batch.column("us"))
        at = us.fill_null(_NONE).to_numpy()
        begin = starts([key], held and (held[0],)).nonzero()[0]
        if held is None or len(begin) == 0 or begin[0] != 0:
            begin = np.r_[0, begin[begin > 0]]
        n = np.diff(np.r_[begin, len(at)])
        gap = np.full(len(at), _NONE)
        real = at != _NONE
        ok = real[1:] & real[:-1]
        gap[1:][ok] = (at[1:] - at[:-1])[ok]
        gap[begin] = _NONE
        low = np.minimum.reduceat(np.where(real, at, np.iinfo(np.int64).max), begin)
        low[low == np.iinfo(np.int64).max] = _NONE
        fresh = list(zip(key.take(pa.array(begin)).to_pylist(), n.tolist(), low.tolist(), np.maximum.reduceat(at, begin).tolist(), np.maximum.reduceat(gap, begin).tolist(), strict=True))
        if held is not None and held[0] == fresh[0][0]:
            fresh[0] = _joined(held, fresh[0])
        elif held is not None:
            fresh.insert(0, held)
        held = fresh.pop()
        if fresh:
            yield out(fresh, [is_first and i == 0 for i in range(len(fresh))])
            is_first = False
    if held is not None:
        yield out([held], [True])


def _joined(a: tuple, b: tuple) -> tuple:
    """Two states of one key, ``a`` before ``b``."""
    key, n, first, last, pause = a
    bridge = b[2] - last if b[2] != _NONE and last != _NONE else _NONE
    return key, n + b[1], first if first != _NONE else b[2], max(last, b[3]), max(pause, b[4], bridge)


def key_states(df: DataFrame, key: Column, at: Column, row_id: Column, partitions: int | None = None) -> DataFrame:
    """(key, n_rows, first_at, last_at, longest_pause_s) for every key that isn't null.

    ``longest_pause_s`` is the longest time between two rows of a key that follow each other in time,
    so it needs the rows' order and the stitching of split keys; null with fewer than two times.
    At most two states of each partition are stitched, so the second aggregation is tiny.
    """
    rows = df.select(key.cast("string").alias("key"), F.unix_micros(at.cast("timestamp")).alias("us"), row_id.alias("rid")).where("key is not null")
    split = ranged(rows, ["key"], ["us", "rid"], partitions).select("key", "us")
    states = materialize(split.mapInArrow(_states, _STATE), "states")
    part = F.struct("pid", "first_us", "last_us")
    timed = F.array_sort(F.collect_list(F.when(F.col("first_us").isNotNull(), part)))
    edges = states.where("at_edge").groupBy("key").agg(F.sum("n_rows").alias("n_rows"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.max("pause_us").alias("inner_us"), timed.alias("p"))
    between = F.expr("array_max(transform(sequence(2, greatest(size(p), 2)), i -> get(p, i - 1).first_us - get(p, i - 2).last_us))")
    stitched = edges.select("key", "n_rows", "first_us", "last_us", F.greatest("inner_us", between).alias("pause_us"))
    whole = states.where("not at_edge").select(*stitched.columns).unionByName(stitched)
    return whole.select("key", "n_rows", F.timestamp_micros("first_us").alias("first_at"), F.timestamp_micros("last_us").alias("last_at"), (F.col("pause_us") / 1e6).alias("longest_pause_s"))


def heavy_keys(states: DataFrame, total: int, share: float) -> DataFrame:
    """The keys that hold at least ``share`` of ``total`` rows: at most 1/share of them."""
    return states.where(F.col("n_rows") >= F.lit(total * share))
