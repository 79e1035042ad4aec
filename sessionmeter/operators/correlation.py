"""Pairing start and end events of tool calls.

Matching is greedy in time order over a whole file: an end takes a pending start of the last
five minutes, preferring equal signature, then equal tool, then the nearest; with nothing in
common it takes the earliest. So a pause longer than the window is a safe cut. What still is
long after cutting there runs in pieces of fixed duration: each piece starts from what the
piece before left pending, and pieces are rerun until none starts from something else.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import HOUR_MS, short_hash
from ..functions.staging import staged
from ..runtime import checkpointed
from .ordered import carry_forward, with_next

WINDOW_MS = 300_000
REPEAT_MS = 1_000

FIELDS = {"line": "bigint", "ts": "bigint", "rank": "int", "event_type": "string", "tool_name": "string",
          "command": "string", "signature": "string", "exit_code": "bigint", "duration_ms": "bigint",
          "stdout_bytes": "bigint", "stderr_bytes": "bigint", "error": "string"}
START = [f for f in FIELDS if f not in ("exit_code", "duration_ms", "stdout_bytes", "stderr_bytes", "error", "event_type")]
END = list(FIELDS)

PAIR_COLUMNS = ["file", *["s_" + f for f in START], *["e_" + f for f in END]]
PAIR_SCHEMA = "file string, " + ", ".join([f"s_{f} {FIELDS[f]}" for f in START] + [f"e_{f} {FIELDS[f]}" for f in END])
_RUN_SCHEMA = PAIR_SCHEMA + ", segment bigint, piece bigint, carried boolean"


class Pending:
    """Starts without an end yet, in order of time, with lookups by signature and tool.

    Each key maps times to the ids that start then. An id leaves all its keys with itself, so
    every step takes the same time however many starts are pending.
    """

    def __init__(self):
        self.alive: OrderedDict[int, tuple] = OrderedDict()
        self.index: dict[tuple, OrderedDict[int, OrderedDict[int, None]]] = {}
        self.keys_of: dict[int, tuple] = {}
        self.next_id = 0

    @staticmethod
    def _keys(tool, signature):
        yield ("signature", signature)
        if tool:
            yield ("tool", tool)
            yield ("both", signature, tool)

    def add(self, ts, tool, signature, payload):
        self.alive[self.next_id] = (ts, payload)
        self.keys_of[self.next_id] = tuple(self._keys(tool, signature))
        for key in self.keys_of[self.next_id]:
            self.index.setdefault(key, OrderedDict()).setdefault(ts, OrderedDict())[self.next_id] = None
        self.next_id += 1

    def _remove(self, found):
        ts, payload = self.alive.pop(found)
        for key in self.keys_of.pop(found):
            times = self.index[key]
            del times[ts][found]
            if not times[ts]:
                del times[ts]
            if not times:
                del self.index[key]
        return payload

    def _nearest(self, key):
        """Newest start under a key; of several at the same time the first."""
        times = self.index.get(key)
        return next(iter(times[next(reversed(times))])) if times else None

    def repeats(self, ts, signature, within):
        found = self._nearest(("signature", signature))
        return found is not None and abs(ts - self.alive[found][0]) <= within

    def take(self, tool, signature):
        """Remove and return the start an end belongs to, None if nothing is pending."""
        keys = [("both", signature, tool)] if tool else []
        keys.append(("signature", signature))
        if tool:
            keys.append(("tool", tool))
        for key in keys:
            found = self._nearest(key)
            if found is not None:
                return self._remove(found)
        if not self.alive:
            return None
        return self._remove(next(iter(self.alive)))

    def expire(self, before):
        """Remove and return starts older than a time."""
        gone = []
        while self.alive:
            first = next(iter(self.alive))
            if self.alive[first][0] >= before:
                break
            gone.append(self._remove(first))
        return gone


def match_event(event: dict, pending: Pending, window=WINDOW_MS, repeat=REPEAT_MS) -> list[tuple]:
    """Pairs ``(start, end)`` an event settles; either may be None. Events come in order."""
    settled = [(old, None) for old in pending.expire(event["ts"] - window)]
    if event["event_type"] != "start":
        settled.append((pending.take(event["tool_name"], event["signature"]), event))
    elif event.get("carried") or not pending.repeats(event["ts"], event["signature"], repeat):
        pending.add(event["ts"], event["tool_name"], event["signature"], event)
    return settled


def pair_row(file, start, end):
    row = {"file": file}
    row.update({"s_" + f: start[f] if start else None for f in START})
    row.update({"e_" + f: end[f] if end else None for f in END})
    return row


def records_of(frame: pd.DataFrame):
    """Rows of a pandas frame as dicts with None for missing values."""
    columns = {c: [None if v is None or v is pd.NA or v != v else v for v in frame[c].tolist()] for c in frame.columns}
    for i in range(len(frame)):
        yield {c: values[i] for c, values in columns.items()}


def frame_of(rows, columns):
    """A pandas frame whose integer columns keep missing values."""
    frame = pd.DataFrame(rows, columns=columns)
    for column in columns:
        base = column[2:] if column[:2] in ("s_", "e_") else column
        if FIELDS.get(base) == "int":
            frame[column] = frame[column].astype("Int32")
        elif FIELDS.get(base) == "bigint" or base in ("segment", "piece"):
            frame[column] = frame[column].astype("Int64")
    return frame


def _runner(window, repeat, piece_ms, batch=20_000):
    """Task function over rows sorted by piece and event order; it holds one piece's pending starts."""
    columns = [*PAIR_COLUMNS, "segment", "piece", "carried"]

    def row(place, start, end, carried=False):
        return {**pair_row(place[0], start, end), "segment": place[1], "piece": place[2], "carried": carried}

    def close(place, pending):
        ends = place[1] + (place[2] + 1) * piece_ms
        rows = [row(place, start, None) for start in pending.expire(ends - window)]
        return rows + [row(place, start, None, True) for _, start in pending.alive.values()]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, pending, rows = None, Pending(), []
        for frame in frames:
            for event in records_of(frame):
                at = (event["file"], int(event["segment"]), int(event["piece"]))
                if at != place:
                    if place is not None:
                        rows += close(place, pending)
                    place, pending = at, Pending()
                rows += [row(place, *pair) for pair in match_event(event, pending, window, repeat)]
                if len(rows) >= batch:
                    yield frame_of(rows, columns)
                    rows = []
        if place is not None:
            rows += close(place, pending)
        if rows:
            yield frame_of(rows, columns)

    return run


def segmented(events: DataFrame, window: int = WINDOW_MS, piece_ms: int = HOUR_MS) -> DataFrame:
    """Add ``segment``, the time its first event has, and ``piece`` within the segment.

    The events are materialised, so that the log is parsed once.
    """
    events = checkpointed(events)
    times = checkpointed(events.select("file", "ts").distinct())
    following = with_next(times, ["file"], "ts", "ts", "next_ts")
    opens = (following.filter(F.col("next_ts") - F.col("ts") > window).select("file", F.col("next_ts").alias("ts"))
             .unionByName(times.groupBy("file").agg(F.min("ts").alias("ts")))
             .withColumn("opens", F.col("ts")))
    placed = carry_forward(times.join(opens, ["file", "ts"], "left"), ["file"], "ts", "opens", "segment",
                           include_current=True, chunk=HOUR_MS).select("file", "ts", "segment")
    return events.join(placed, ["file", "ts"]).withColumn(
        "piece", F.floor((F.col("ts") - F.col("segment")) / F.lit(piece_ms)))


def correlate(events: DataFrame, window: int = WINDOW_MS, repeat: int = REPEAT_MS, piece_ms: int = HOUR_MS) -> DataFrame:
    """Pairs ``s_*, e_*`` per file; a side is null for an event without a partner.

    A column ``carried`` marks starts that an earlier run left pending.
    """
    if piece_ms <= window:
        raise ValueError("a piece must be longer than the matching window")
    place = ["file", "segment", "piece"]
    columns = [*place, *FIELDS, "carried"]
    base = checkpointed(segmented(events, window, piece_ms).withColumn(
        "carried", F.coalesce("carried", F.lit(False)) if "carried" in events.columns else F.lit(False)).select(*columns))
    run = _runner(window, repeat, piece_ms)
    work = lambda df: (df.repartition(*place).sortWithinPartitions(*place, "ts", "rank", "line")
                       .mapInPandas(run, _RUN_SCHEMA))
    pieces = base.select(*place).distinct()

    def handed_on(out):
        """What each piece leaves to the next one, as events of that piece."""
        left = out.filter("carried").withColumn("piece", F.col("piece") + 1).join(pieces, place, "left_semi")
        return left.select(*place, *[F.col("s_" + f).alias(f) if f in START else (
            F.lit("start") if f == "event_type" else F.lit(None).cast(FIELDS[f])).alias(f) for f in FIELDS],
            F.lit(True).alias("carried"))

    def digest(df, name):
        return df.groupBy(*place).agg(F.count("*").alias(name + "_n"), F.bit_xor(F.xxhash64("ts", "line")).alias(name + "_x"))

    out = checkpointed(work(base))
    given = base.limit(0)
    while True:
        offered = handed_on(out)
        changed = digest(offered, "new").join(digest(given, "old"), place, "full").filter(
            ~(F.col("new_n").eqNullSafe(F.col("old_n")) & F.col("new_x").eqNullSafe(F.col("old_x")))).select(*place)
        changed = checkpointed(changed)
        if changed.isEmpty():
            break
        redone = work(base.join(changed, place, "left_semi").unionByName(offered.join(changed, place, "left_semi")))
        given = offered
        out = checkpointed(out.join(changed, place, "left_anti").unionByName(redone))
    next_piece = pieces.withColumn("piece", F.col("piece") - 1)
    open_end = out.filter("carried").join(next_piece, place, "left_anti")
    return out.filter("not carried").unionByName(open_end).select(*PAIR_COLUMNS)


def _hash16(*parts):
    return short_hash(F.concat_ws(":", *[p.cast("string") for p in parts]), 16)


def tool_calls(pairs: DataFrame) -> DataFrame:
    """Tool calls from pairs. A call without a start begins its duration before the end."""
    began = F.coalesce(F.col("s_ts"), F.col("e_ts") - F.coalesce("e_duration_ms", F.lit(0)))
    kind, code = F.col("e_event_type"), F.col("e_exit_code")
    status = (F.when(kind.isNull(), "unknown").when((kind == "failure") | F.coalesce(code != 0, F.lit(False)), "failed")
              .otherwise("ok"))
    rows = staged(pairs, start_ts=began, source_line=F.coalesce("s_line", "e_line"),
                  signature=F.coalesce("s_signature", "e_signature"))
    key = _hash16(F.col("file"), F.col("source_line"), F.col("signature"), F.col("start_ts"))
    rows = rows.withColumn("dedup_key", key)
    return rows.select(
        F.col("dedup_key").alias("id"), F.lit(None).cast("string").alias("session_id"),
        F.coalesce("s_tool_name", "e_tool_name", F.lit("unknown")).alias("tool_name"),
        F.coalesce("s_command", "e_command").alias("command"), status.alias("status"), "start_ts",
        F.col("e_ts").alias("end_ts"), F.coalesce(F.col("e_duration_ms"), F.col("e_ts") - F.col("start_ts")).alias("duration_ms"),
        code.alias("exit_code"), F.col("e_error").alias("error"), F.col("e_stdout_bytes").alias("stdout_bytes"),
        F.col("e_stderr_bytes").alias("stderr_bytes"), F.col("file").alias("source_file"), "source_line",
        _hash16(F.col("signature"), F.col("start_ts")).alias("correlation_key"), "dedup_key")


def tool_call_events(pairs: DataFrame) -> DataFrame:
    """One row per start and per end, tied by the correlation key."""
    as_json = lambda **parts: F.to_json(F.struct(*[c.alias(n) for n, c in parts.items()]), {"ignoreNullFields": "false"})
    key = _hash16(F.coalesce("s_signature", "e_signature"), F.coalesce("s_ts", "e_ts"))
    ended = {n: F.col("e_" + n) for n in ("command", "exit_code", "duration_ms", "stdout_bytes", "stderr_bytes", "error")}

    def side(tag, event_type, payload, code):
        column = lambda n: F.col(tag + n)
        return F.struct(F.coalesce(column("tool_name"), F.lit("unknown")).alias("tool_name"), event_type.alias("event_type"),
                        column("ts").alias("ts"), payload.alias("payload"), code.alias("exit_code"),
                        column("line").alias("source_line"), column("signature").alias("signature"))

    start = side("s_", F.lit("start"), as_json(command=F.col("s_command"), signature=F.col("s_signature")),
                 F.lit(None).cast("bigint"))
    end = side("e_", F.col("e_event_type"), as_json(**ended), F.col("e_exit_code"))
    rows = pairs.select("file", key.alias("correlation_key"), F.inline(F.array(start, end))).filter(F.col("ts").isNotNull())
    rows = rows.withColumn("dedup_key", _hash16(*[F.col(c) for c in ("file", "source_line", "event_type", "ts", "signature")]))
    return rows.select(F.col("dedup_key").alias("id"), F.lit(None).cast("string").alias("session_id"), "tool_name",
                       "event_type", "ts", "payload", "exit_code", F.col("file").alias("source_file"), "source_line",
                       "correlation_key", "dedup_key")
