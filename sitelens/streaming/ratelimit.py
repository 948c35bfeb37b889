"""Fixed-window rate limiter (W1-W4), batch and Structured Streaming.

Semantics (per key, events ordered by ``(ts, id)``): a window opens at the
first accepted event and lasts ``window`` seconds (half-open); at most
``limit`` events are accepted in it; rejected events neither count nor extend
it.  ``refresh_on_accept`` models the reference's fallback where an unknown
expiry is taken as a full hour, i.e. every accepted event restarts the hour.

The batch form finds window openings by successor pointers
(``operators/windows.py``); the stream keeps ``(expiry, count, start)`` per key in
value state, which a timer at the window's end removes (event time) or which expires
by its own time to live (processing time, as the reference's transients do).

Defined cases: an event without a time, or whose limit is null or below 1, is not
accepted, opens no window and has ``window_start_us`` null and count 0; a null key
is a key of its own; in the batch form a key has one limit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sitelens.config import RATE_WINDOW_SECONDS
from sitelens.operators.windows import ranked

US = 1_000_000

OUT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("accepted", T.BooleanType()),
        T.StructField("window_start_us", T.LongType()),
        T.StructField("count_in_window", T.LongType()),
    ]
)


def _run(ts: np.ndarray, limit: np.ndarray, window_us: int, refresh: bool, expiry: int, count: int, start: int):
    """The state machine over sorted events; returns outputs and the final state."""
    n = len(ts)
    acc = np.zeros(n, dtype=bool)
    starts = np.zeros(n, dtype=np.int64)
    counts = np.zeros(n, dtype=np.int64)
    for i in range(n):
        t = int(ts[i])
        if t >= expiry:
            count = 0
        if count < int(limit[i]):
            if count == 0:
                expiry, start = t + window_us, t
            elif refresh:
                expiry = t + window_us
            count += 1
            acc[i] = True
        starts[i], counts[i] = start, count
    return acc, starts, counts, expiry, count, start


def _countable(t: str = "t") -> Column:
    return F.coalesce(F.col(t).isNotNull() & (F.col("lim") > 0), F.lit(False))


def _uncounted(e: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Verdicts of the events that no window counts."""
    return e.filter(~_countable()).select(
        "id", "key", F.lit(False).alias("accepted"), F.lit(None).cast("bigint").alias("window_start_us"),
        F.lit(0).cast("bigint").alias("count_in_window"), *carry,
    )


def _events(events: DataFrame, key: Column, ts: Column, id_col: str, limit: Column | int, carry: Sequence[str]) -> DataFrame:
    lim = limit if isinstance(limit, Column) else F.lit(int(limit))
    return events.select(
        F.col(id_col).cast("bigint").alias("id"), key.cast("string").alias("key"),
        F.unix_micros(ts.cast("timestamp")).alias("t"), lim.cast("bigint").alias("lim"), *carry,
    ).withColumn("k", F.coalesce(F.concat(F.lit("="), "key"), F.lit("")))


def rate_limit(
    events: DataFrame,
    key: Column,
    ts: Column,
    id_col: str,
    limit: Column | int,
    window_seconds: int = RATE_WINDOW_SECONDS,
    refresh_on_accept: bool = False,
    carry: Sequence[str] = (),
) -> DataFrame:
    """W1/W2 batch: ``id, key, accepted, window_start_us, count_in_window`` per event, and
    the columns ``carry`` of it (none of them named like those or ``k, t, lim, slice, idx, rank``)."""
    e = _events(events, key, ts, id_col, limit, carry)
    inside = ranked(e.filter(_countable()), int(window_seconds) * US, refresh_on_accept).select(
        "id", "key", (F.col("rank") <= F.col("lim")).alias("accepted"), F.col("opened").alias("window_start_us"),
        F.least("rank", "lim").alias("count_in_window"), *carry,
    )
    return inside.unionByName(_uncounted(e, carry))


def admission_keys(requests: DataFrame, ip: Column, max_per_hour: int = 10, ai_per_hour: int = 5) -> DataFrame:
    """W3/W4 inputs: key ``ip`` (analyses) or ``'ai-' + ip`` (model reviews) with its limit."""
    return requests.select(
        "*",
        F.when(F.col("is_ai"), F.concat(F.lit("ai-"), ip)).otherwise(ip).alias("rl_key"),
        F.when(F.col("is_ai"), F.lit(ai_per_hour)).otherwise(F.lit(max_per_hour)).alias("rl_limit"),
    )


# ---------------------------------------------------------------- streaming

STATE_SCHEMA = T.StructType(
    [T.StructField("expiry", T.LongType()), T.StructField("count", T.LongType()), T.StructField("start", T.LongType())]
)


class WindowLimiter(StatefulProcessor):
    """The state machine of one key; events of a micro-batch in ``(ts, id)`` order."""

    def __init__(self, window_us: int, refresh: bool, event_time: bool, carry: Sequence[str]):
        self.window_us, self.refresh, self.event_time, self.carry = window_us, refresh, event_time, list(carry)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # in processing time a window lives exactly as long as its state may be needed
        self.window = handle.getValueState("window", STATE_SCHEMA, None if self.event_time else self.window_us // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["t", "id"], kind="mergesort")
        known = self.window.get() if self.window.exists() else None
        expiry, count, start = known if known is not None else (-(2**62), 0, 0)
        acc, starts, counts, expiry, count, start = _run(
            pdf["t"].to_numpy(), pdf["lim"].to_numpy(), self.window_us, self.refresh, int(expiry), int(count), int(start)
        )
        self.window.update((int(expiry), int(count), int(start)))
        if self.event_time:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            # a window that has passed already (a late event) goes at the next watermark
            self.handle.registerTimer(max(int(expiry // 1000), timerValues.getCurrentWatermarkInMs()) + 1)
        out = {"id": pdf["id"].to_numpy(), "key": pdf["key"].to_numpy(), "accepted": acc, "window_start_us": starts, "count_in_window": counts}
        yield pd.DataFrame(out | {c: pdf[c].to_numpy() for c in self.carry})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.window.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_rate_limit(
    stream: DataFrame,
    key: Column,
    ts_col: str,
    id_col: str,
    limit: Column | int,
    window_seconds: int = RATE_WINDOW_SECONDS,
    refresh_on_accept: bool = False,
    watermark: str = "2 hours",
    event_time: bool = True,
    carry: Sequence[str] = (),
) -> DataFrame:
    """W1 on a stream: keyed state ``(expiry, count, start)``.

    Within a micro-batch events of a key are ordered by ``(ts, id)``; across
    micro-batches arrival order counts, as in the reference.  With ``event_time`` a
    timer removes a key's state when the watermark passes its window; without, the
    state has the window's length to live on the clock (for live traffic, whose
    times are the present).
    """
    # a column of its own bears the watermark, so that carried ones stay plain
    timed = stream.withColumn("_event_time", F.col(ts_col).cast("timestamp"))
    timed = timed.withWatermark("_event_time", watermark) if event_time else timed
    e = _events(timed, key, F.col(ts_col), id_col, limit, ["_event_time", *carry])
    rows = e.filter(_countable())
    out = T.StructType([*OUT_SCHEMA.fields, *[e.schema[c] for c in carry]])
    counted = rows.groupBy("k").transformWithStateInPandas(
        statefulProcessor=WindowLimiter(int(window_seconds) * US, refresh_on_accept, event_time, carry),
        outputStructType=out, outputMode="Append", timeMode="EventTime" if event_time else "ProcessingTime",
    )
    return counted.unionByName(_uncounted(e, carry))
