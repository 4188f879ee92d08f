"""Event-time windows, running sessions and stream-stream joins (extensions)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, MapType, StructType


def tumbling(stream: DataFrame, *, time: str, width: str, delay: str, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregates of each window of ``width`` and each of ``keys``: ``window_start`` and ``window_end``, the keys and the
    aggregates. A window is emitted once, when the watermark (the largest time so far, less ``delay``) passes its end. Rows whose window is
    closed by then are left out (see ``late_rows``), and so are those with a null time. A null key is a key of its own."""
    seen = stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), *keys).agg(*aggregates)
    return seen.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in seen.columns if c != "w"])


def late_rows(batch: DataFrame, watermark_ms: int, *, time: str, width: str) -> DataFrame:
    """The rows of a batch that ``tumbling`` leaves out at this watermark, with their ``window_start``."""
    w = F.window(time, width)
    placed = batch.where(F.col(time).isNotNull()).withColumn("w", w)
    return placed.where(F.unix_millis("w.end") <= watermark_ms).withColumn("window_start", F.col("w.start")).drop("w")


def sessions(stream: DataFrame, *, time: str, gap: str, delay: str, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregates of each session of ``keys``: rows that follow each other within ``gap``. ``session_end`` is the gap after
    the last row. A session is emitted once, when the watermark passes its end. Null times and keys as in ``tumbling``."""
    seen = stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*aggregates)
    return seen.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *[c for c in seen.columns if c != "w"])


def joined_within(left: DataFrame, right: DataFrame, *, by: list[str], left_time: str, right_time: str, within: str, delay: str, columns: dict[str, str], how: str = "left_outer") -> DataFrame:
    """Each row of ``left`` with all rows of ``right`` of the same ``by`` columns that come at its time or up to ``within`` later.

    ``columns`` names the columns of ``right`` to add and their names. State of both sides is kept until
    the watermark (the smaller one of both streams) rules a partner out; then an outer join emits a row of ``left`` that had none, with
    nulls. Null keys match nothing.
    """
    x = left.withWatermark(left_time, delay)
    keys = [f"__by{i}" for i in range(len(by))]
    y = right.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), F.col(right_time).alias("__time"), *(F.col(c).alias(f"__c{i}") for i, c in enumerate(columns))).withWatermark("__time", delay)
    match = (F.col("__time") >= F.col(left_time)) & (F.col("__time") <= F.col(left_time) + F.expr(f"INTERVAL {within}"))
    for c, k in zip(by, keys):
        match = match & (F.col(c) == F.col(k))
    return x.join(y, match, how).select(*left.columns, *(F.col(f"__c{i}").alias(name) for i, name in enumerate(columns.values())))


#: A session as state and as it is emitted; times are microseconds.
SESSION = "start BIGINT, end BIGINT, n_events BIGINT, amount BIGINT, first_id BIGINT, first_type STRING, last_id BIGINT, last_type STRING"


#: Groups that keys are dealt to by a hash. A group is one call and one timer, so that their cost doesn't follow the number of keys.
GROUPS = 512
#: Sessions in one value of the state, and pieces that are gathered at least before they are merged.
BLOCK = 50_000


class RunningSessions(StatefulProcessor):
    """Sessions of a group of keys that grow and merge as rows come in any order, and end by a timer.

    State is a list of blocks of sessions (Arrow bytes, so that keys of any plain type come back as they were) and not of
    rows, so a key with very many rows holds little. A session is emitted and dropped when the watermark
    passes ``gap_us`` after its last row.
    """

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "block BINARY")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held, new, n = self._held(), [], 0
        for frame in rows:
            new.append(self._of(frame))
            n += len(new[-1])
            if n >= max(len(held), BLOCK):  # so that what is held isn't merged again for every frame
                held, new, n = self._merged([held, *new]), [], 0
        self._keep(self._merged([held, *new]))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = self._held()
        done = held["end"] + self.gap_us <= timerValues.getCurrentWatermarkInMs() * 1000
        self._keep(held[~done])
        if done.any():
            yield held[done]

    def close(self) -> None:
        pass

    def _of(self, frame: pd.DataFrame) -> pd.DataFrame:
        """The sessions that the rows (key, t, id, type, amount) of one frame make by themselves."""
        made = {"key": frame["key"], "start": frame["t"], "end": frame["t"], "n_events": 1, "amount": frame["amount"], "first_id": frame["id"], "first_type": frame["type"], "last_id": frame["id"], "last_type": frame["type"]}
        return self._merged([pd.DataFrame(made)])

    def _merged(self, parts: list[pd.DataFrame]) -> pd.DataFrame:
        parts = [p for p in parts if len(p)]
        if not parts:
            return pd.DataFrame({"key": [], "end": []})
        s = pd.concat(parts, ignore_index=True)
        code = s["key"].factorize(use_na_sentinel=False)[0]
        order = np.lexsort((s["first_id"], s["start"], code))
        s, code = s.iloc[order].reset_index(drop=True), code[order]
        reached = s["end"].groupby(code).cummax().to_numpy()
        begins = np.ones(len(s), bool)
        begins[1:] = (code[1:] != code[:-1]) | (s["start"].to_numpy()[1:] - reached[:-1] > self.gap_us)
        first = np.flatnonzero(begins)
        # the rows in the order of their ends, session by session
        last = np.lexsort((s["last_id"], s["end"], begins.cumsum()))[np.append(first[1:], len(s)) - 1]
        total = lambda c: np.add.reduceat(s[c].to_numpy(), first)
        heads, ends = s.iloc[first].reset_index(drop=True), s.iloc[last].reset_index(drop=True)
        return heads.assign(end=ends["end"], n_events=total("n_events"), amount=total("amount"), last_id=ends["last_id"], last_type=ends["last_type"])

    def _held(self) -> pd.DataFrame:
        blocks = [pa.ipc.open_stream(bytes(b)).read_pandas() for (b,) in self.open.get()]
        return pd.concat(blocks, ignore_index=True) if blocks else self._merged([])

    def _keep(self, held: pd.DataFrame) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if not len(held):
            self.open.clear()
            return
        blocks = []
        for i in range(0, len(held), BLOCK):
            table, out = pa.Table.from_pandas(held.iloc[i : i + BLOCK], preserve_index=False), pa.BufferOutputStream()
            with pa.ipc.new_stream(out, table.schema) as writer:
                writer.write_table(table)
            blocks.append((out.getvalue().to_pybytes(),))
        self.open.put(blocks)
        self.handle.registerTimer(-(-(int(held["end"].min()) + self.gap_us) // 1000))


def running_sessions(stream: DataFrame, *, time: str, key: str, id_: str, type_: str, amount: str, gap_us: int, delay: str, groups: int = GROUPS) -> DataFrame:
    """Sessions of each ``key`` with their first and last rows by (time, id), as ``RunningSessions`` keeps them: the key, and the
    columns of ``SESSION``. Rows with a null key, time or id are left out; a null amount counts as 0. The key is a number, text, time or other plain value.

    Rows of a session may come in any order and in any runs, as long as the watermark has not passed ``gap_us`` after
    the session's last row; the result doesn't depend on how they are cut. ``groups`` is as many tasks as can share the keys, and
    must stay the same for a checkpoint.
    """
    if isinstance(stream.schema[key].dataType, (ArrayType, MapType, StructType)):
        raise TypeError(f"{key} is no plain value: {stream.schema[key].dataType.simpleString()}")
    rows = stream.withWatermark(time, delay).where(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(id_).isNotNull())
    rows = rows.select(F.pmod(F.hash(key), F.lit(groups)).alias("group"), F.col(key).alias("key"), F.col(time).alias("time"), F.unix_micros(time).alias("t"), F.col(id_).cast("long").alias("id"), F.col(type_).alias("type"), F.coalesce(F.col(amount).cast("long"), F.lit(0)).alias("amount"))
    kind = stream.schema[key].dataType.simpleString()
    made = rows.groupBy("group").transformWithStateInPandas(RunningSessions(gap_us), f"key {kind}, {SESSION}", "Append", "EventTime")
    return made.withColumnRenamed("key", key)
