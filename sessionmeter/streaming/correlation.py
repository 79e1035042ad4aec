"""Pairing start and end events in a stream, with starts kept across batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.correlation import (PAIR_COLUMNS, PAIR_SCHEMA, REPEAT_MS, START, WINDOW_MS, Pending, frame_of,
                                     match_event, pair_row, records_of)

_STATE = StructType([StructField(f, LongType() if f in ("line", "ts", "rank") else StringType()) for f in START])


class Correlator(StatefulProcessor):
    """Pending starts per file in list state; a timer releases them when they are too old."""

    def __init__(self, window: int = WINDOW_MS, repeat: int = REPEAT_MS):
        self.window, self.repeat = window, repeat

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.starts = handle.getListState("starts", _STATE)

    def _load(self) -> Pending:
        pending = Pending()
        for values in self.starts.get():
            start = dict(zip(START, values))
            pending.add(start["ts"], start["tool_name"], start["signature"], start)
        return pending

    def _save(self, pending: Pending) -> None:
        rows = [tuple(start[f] for f in START) for _, start in pending.alive.values()]
        self.starts.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if rows:
            self.starts.put(rows)
            self.handle.registerTimer(rows[0][START.index("ts")] + self.window + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = [f for f in rows if len(f)]
        events = pd.concat(frames).sort_values(["ts", "rank", "line"], kind="stable") if frames else None
        pending, out = self._load(), []
        for event in records_of(events) if events is not None else ():
            out += [pair_row(key[0], *pair) for pair in match_event(event, pending, self.window, self.repeat)]
        self._save(pending)
        if out:
            yield frame_of(out, PAIR_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pending = self._load()
        old = pending.expire(expiredTimerInfo.getExpiryTimeInMs() - self.window)
        self._save(pending)
        if old:
            yield frame_of([pair_row(key[0], start, None) for start in old], PAIR_COLUMNS)

    def close(self) -> None:
        pass


def correlate_stream(events: DataFrame, window: int = WINDOW_MS, repeat: int = REPEAT_MS) -> DataFrame:
    """Pairs from a stream of tool-log events; a start without end follows when its time is up.

    Needs the RocksDB state store. Events must come in order across batches, up to the
    watermark; inside a batch they are sorted.
    """
    timed = events.withColumn("event_time", F.timestamp_millis("ts")).withWatermark("event_time", f"{window} milliseconds")
    return timed.groupBy("file").transformWithStateInPandas(
        Correlator(window, repeat), outputStructType=PAIR_SCHEMA, outputMode="append", timeMode="EventTime")
