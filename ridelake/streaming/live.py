"""Live projections of event streams: counters, last values, surge, funnels.

Each works on a table and on a stream alike where Spark allows it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ridelake.functions.market import LEAST, REPORT, TAU_S, surge_step, told_step


def counters(events: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of lifecycle events (column topic) by ``keys``, and what is pending and active by them. The order of events does not matter."""
    n = lambda t: F.count(F.when(F.col("topic") == t, 1))
    made = events.groupBy(*keys).agg(
        *[n(f"trip.{k}").alias(k) for k in ("requested", "matched", "picked_up", "completed", "cancelled", "abandoned")]
    )
    pending = F.col("requested") - F.col("matched") + F.col("cancelled") - F.col("abandoned")
    active = F.col("matched") - F.col("cancelled") - F.col("completed")
    return made.withColumn("pending", pending).withColumn("active", active)


def last_values(events: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """The values of the last event of every key."""
    last = F.max(F.struct(order, *values)).alias("last")
    return events.groupBy(key).agg(last).select(key, "last.*")


def per_minute(events: DataFrame, keys: list[str], ts: str, watermark: str | None = None) -> DataFrame:
    """Events by key and minute; on a stream, minutes are closed once the watermark passes."""
    rows = events.withWatermark(ts, watermark) if watermark else events
    counted = rows.groupBy(F.window(ts, "1 minute"), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("minute"), *keys, "n")


def without_repeats(events: DataFrame, keys: list[str], ts: str, watermark: str) -> DataFrame:
    """A stream without events that come again; keys are remembered for the length of the watermark."""
    return events.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)


def funnel(requested: DataFrame, matched: DataFrame, within: str = "1 hour", watermark: str | None = None) -> DataFrame:
    """Requests (request_id, requested_at) joined with their match (request_id, matched_at) within a time."""
    if watermark:
        requested, matched = requested.withWatermark("requested_at", watermark), matched.withWatermark("matched_at", watermark)
    m = matched.withColumnRenamed("request_id", "m_request_id")
    near = F.expr(f"m_request_id = request_id AND matched_at >= requested_at AND matched_at <= requested_at + INTERVAL {within}")
    return requested.join(m, near).drop("m_request_id")


#: After so many time constants without a tick nothing is left of a cell's average: the next tick counts in full, as a first one does.
FADED = 21


def surge_stream(ticks: DataFrame, epsilon: float = REPORT, late: str = "1 minute", tau_s: float = TAU_S) -> DataFrame:
    """(cell, ts, surge) of a stream (cell, ts in seconds since 1970, raw): smoothed multipliers, reported when they have changed enough.

    State of a cell: its average, the time of its last tick, and what was last reported (nothing at first, and again after a
    return to 1 has been told once). Once the watermark (``late`` behind the newest tick) is ``FADED`` time constants past a cell's last tick, its state
    leaves; a cell that was last reported above 1 is then reported at 1. Ticks behind the watermark are left out, ticks of one batch are taken in order.
    """
    fade_ms = round(FADED * tau_s * 1000)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ema, last, told = state.get if state.exists else (None, None, None)
        out = []
        if state.hasTimedOut:
            state.remove()
            if told is not None:
                out.append((key[0], last + FADED * tau_s, LEAST))
        else:
            rows = pd.concat(list(parts)).sort_values("ts")
            for ts, raw in zip(rows["ts"], rows["raw"], strict=True):
                ema = surge_step(ema, last, ts, raw, tau_s)
                last = ts if last is None else max(last, ts)
                tell, told = told_step(told, ema, LEAST, epsilon, None)
                if tell:
                    out.append((key[0], ts, ema))
            state.update((ema, last, told))
            state.setTimeoutTimestamp(max(round(last * 1000) + fade_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["cell", "ts", "surge"])

    timed = ticks.select("cell", "ts", "raw", F.timestamp_millis(F.round(F.col("ts") * 1000).cast("long")).alias("at")).withWatermark("at", late)
    return timed.groupBy("cell").applyInPandasWithState(
        step, "cell string, ts double, surge double", "ema double, last double, told double", "append", GroupStateTimeout.EventTimeTimeout
    )
