"""Surge, cancellation and matching costs as column expressions, and folds over ordered observations."""

from __future__ import annotations

from collections.abc import Callable
from math import exp

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, MOST = 1.0, 3.0
#: Seconds of the surge average, and the excess at which a cell is forgotten.
TAU_S, GONE = 60.0, 1e-3
#: Change since the last report at which a multiplier is reported again.
REPORT = 0.05


def raw_surge(requests: Column, drivers: Column) -> Column:
    """Open requests by idle drivers (one at least), between 1 and 3."""
    return F.least(F.greatest(requests / F.greatest(drivers, F.lit(1)), F.lit(LEAST)), F.lit(MOST))


def cancel_probability(rate_per_minute: Column, seconds: Column) -> Column:
    """Chance to cancel within some seconds; splitting them changes nothing."""
    return 1 - F.exp(-rate_per_minute * seconds / 60)


def match_cost(eta_s: Column, surge: Column, trip_s: Column, surge_premium: float = 0.0, eta_weight: float = 0.0) -> Column:
    return eta_s - F.lit(surge_premium) * (surge - 1) + F.lit(eta_weight) * trip_s


def surge_step(ema: float | None, last: float | None, ts: float, raw: float, tau_s: float = TAU_S) -> float:
    """The multiplier after one more observation; 1 once it is as good as gone."""
    before = LEAST if ema is None else ema
    alpha = 1.0 if last is None else (1 - exp(-(ts - last) / tau_s) if ts > last else 0.0)
    blended = before + alpha * (raw - before)
    return LEAST if blended <= LEAST + GONE else blended


def told_step(last: float | None, value: float, base: float, absolute: float | None, relative: float | None) -> tuple[bool, float | None]:
    """Whether a value is to be reported after ``last``, and what counts as the last report from then on."""
    free = value <= base * 1.0001
    if absolute is not None:
        told = last is not None if free else last is None or abs(value - last) > absolute
    else:
        before = base if last is None else last
        told = before > 0 and abs(value - before) / before > relative
    return told, None if free else value if told else last


def walked(rows: DataFrame, key: str, schema: str, step: Callable) -> DataFrame:
    """Go through the rows (key, ts, value) of each key in order of ts.

    ``step(state, ts, value)`` gets the key's state (None at first) and returns the next one and a tuple to emit after the key, or None.
    A task takes its keys one after the other and holds a batch of rows and one state, however many rows a key has.
    """
    dealt = rows.repartition(key).sortWithinPartitions(*rows.columns)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(parts):
        now, state = object(), None
        for part in parts:
            out = []
            for k, ts, value in part.itertuples(index=False, name=None):
                if k != now and not (k != k and now != now):  # a missing number is not equal to itself
                    now, state = k, None
                state, made = step(state, ts, value)
                if made is not None:
                    out.append((k, *made))
            yield pd.DataFrame(out, columns=names)

    return dealt.mapInPandas(run, schema)


def smoothed(ticks: DataFrame, key: str, tau_s: float = TAU_S) -> DataFrame:
    """(key, ts, raw, surge) from (key, ts in seconds, raw): the multiplier after each of a cell's observations.

    An exponential average whose weight depends on the time since the observation before; the first one
    counts in full. A cell whose average falls back to 1 is forgotten and starts again from 1. The rule
    depends on its own state, so each cell's ticks are walked through in order.
    """

    def step(state, ts, raw):
        ema = surge_step(*(state or (None, None)), ts, raw, tau_s)
        return (ema, ts), (ts, raw, ema)

    rows = ticks.select(key, F.col("ts").cast("double").alias("ts"), F.col("raw").cast("double").alias("raw"))
    return walked(rows, key, f"{key} {rows.schema[key].dataType.simpleString()}, ts double, raw double, surge double", step)


def reported(rows: DataFrame, key: str, ts: str, value: str, base: float, absolute: float | None, relative: float | None) -> DataFrame:
    """Of each key's values in order those that differ enough from the last one reported.

    ``absolute``: report when the change exceeds it; ``relative``: when it exceeds this share of the last
    report. What came before the first report is ``base``. A value back at ``base`` is reported once, then forgotten.
    """

    def step(last, at, v):
        told, last = told_step(last, v, base, absolute, relative)
        return last, (at, v) if told else None

    rows = rows.select(key, F.col(ts).cast("double").alias(ts), F.col(value).cast("double").alias(value))
    return walked(rows, key, f"{key} {rows.schema[key].dataType.simpleString()}, {ts} double, {value} double", step)
