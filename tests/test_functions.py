"""Expressions against values worked out by hand."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ridelake.functions import geo, histograms, market, rates, roads, stats
from ridelake.operators import demand, ordered
from ridelake.plans import reports


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_summary_of_known_values(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(1, 11)] + [("b", None)], "k string, v double")
    got = {r.k: (r.n, r["mean"], r.p50, r.p95) for r in stats.summary(df, ["k"], "v").collect()}
    assert got["a"] == (10, 5.5, 5.5, pytest.approx(9.55)) and got["b"] == (0, 0, 0, 0)


def test_t_interval(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 3.0, 4.0)] + [("b", 7.0)], "k string, v double")
    got = {r.k: (r.lo, r.hi) for r in stats.t_interval(df, ["k"], "v").collect()}
    half = 3.182446 * math.sqrt(5 / 3) / 2
    assert got["a"] == (pytest.approx(2.5 - half), pytest.approx(2.5 + half)) and got["b"] == (7.0, 7.0)
    assert one(spark, stats.t975(F.lit(60)))[0] == pytest.approx(2.000298, abs=1e-4)


@pytest.mark.parametrize("wins,n,p", [(10, 10, 2 / 1024), (0, 10, 2 / 1024), (9, 10, 22 / 1024), (5, 10, 1), (0, 0, 1)])
def test_sign_test(spark, wins, n, p):
    assert one(spark, stats.sign_test(F.lit(wins), F.lit(n)))[0] == pytest.approx(p)


def test_sign_test_of_many_trials_is_finite(spark):
    assert 0 < one(spark, stats.sign_test(F.lit(1100), F.lit(2000)))[0] < 1e-4


def test_nice_ceil(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.3, 1.0, 11.0, 20.0, 21.0, 501.0)], "x double")
    assert [r[0] for r in df.select(stats.nice_ceil(F.col("x"))).collect()] == pytest.approx([1, 0.5, 1, 20, 20, 50, 1000])


def test_paired_differences_leave_out_runs_without_riders(spark):
    w = spark.createDataFrame([(1, "a", 10.0), (1, "a", 20.0), (1, "b", 12.0), (2, "a", 5.0), (3, "b", 5.0)], "seed int, policy string, wait_seconds double")
    assert [(r.seed, r["diff"]) for r in stats.paired_differences(w, "a", ["seed"]).collect()] == [(1, -3.0)]


def test_histogram_and_quantile(spark):
    df = spark.createDataFrame([("x", v) for v in (0.5, 5.0, 5.5, 700.0)] + [("x", None)], "k string, v double")
    hist = histograms.buckets(df, ["k"], "v", histograms.WAIT)
    got = {r.le: r["count"] for r in hist.collect()}
    assert got[1] == 1 and got[5] == 2 and got[10] == 3 and got[600] == 3 and got[float("inf")] == 4
    assert histograms.quantile(hist, ["k"], 0.5).first()["quantile"] == pytest.approx(5.0)
    assert histograms.quantile(hist, ["k"], 0.99).first()["quantile"] == 600


@pytest.mark.parametrize(
    "text,want",
    [("50", 50 / 3.6), ("30 mph", 30 * 0.44704), ("25mph", 25 * 0.44704), ("40 km/h", 40 / 3.6), ("60kph", 60 / 3.6), ("70kmh", 70 / 3.6), (" 35.5 ", 35.5 / 3.6),
     ("none", 0), ("signals", 0), ("RU:urban", 0), ("", 0), ("-5", 0), ("0", 0), (None, 0)],
)
def test_max_speed(spark, text, want):
    assert one(spark, roads.max_speed(F.lit(text).cast("string")))[0] == pytest.approx(want)


@pytest.mark.parametrize(
    "tags,one_way,want",
    [({"lanes": "3"}, False, (2, 1)), ({"lanes": "3"}, True, (3, 0)), ({}, False, (1, 1)), ({"lanes": "1"}, False, (1, 1)), ({"lanes": "x"}, True, (1, 0)),
     ({"lanes": "4", "lanes:forward": "3", "lanes:backward": "1"}, False, (3, 1)), ({"lanes": "5", "lanes:forward": "-1"}, False, (3, 2))],
)
def test_lanes(spark, tags, one_way, want):
    df = spark.createDataFrame([(tags,)], "tags map<string,string>")
    assert tuple(df.select(*roads.lanes("tags", F.lit(one_way))).first()) == want


def test_delays(spark):
    got = one(
        spark,
        roads.delay_factor(F.lit(20.0), F.lit(40.0)),
        roads.delay_factor(F.lit(1.0), F.lit(0.0)),
        roads.delay_factor(F.lit(900.0), F.lit(5.0)),
        roads.link_factor(F.lit(1), F.lit(5.0)),
        roads.link_factor(F.lit(3), F.lit(5.0)),
        roads.base_weight(F.lit(140.0), F.lit(10.0)),
        roads.base_weight(F.lit(140.0), F.lit(0.0)),
    )
    assert tuple(got) == (1.25, 1.0, 5.0, 1.0, pytest.approx(1.16), 14.0, float("inf"))


def test_rates(spark):
    segments = [(10.0, 1.0), (20.0, 3.0), (40.0, 2.0)]
    df = spark.createDataFrame([(x,) for x in (0.0, 10.0, 15.0, 30.0, 99.0)], "t double")
    assert [r[0] for r in df.select(demand.rate_at(F.col("t"), segments)).collect()] == [1, 1, 2, 2.5, 2]


def test_distances_and_cells(spark):
    a, b = (37.7749, -122.4194), (37.7849, -122.4094)
    c = [F.lit(x) for x in (*a, *b)]
    hav, eq, flat = one(spark, geo.haversine(*c), geo.equirectangular(*c), geo.planar(*c))
    assert hav == pytest.approx(1417, abs=3) and eq == pytest.approx(hav, rel=0.01) and flat == pytest.approx(hav, rel=0.01)
    df = spark.range(200).select((37.7 + F.col("id") / 900).alias("lat"), (-122.5 + (F.col("id") * 7 % 200) / 900).alias("lon"))
    df = df.withColumn("cell", geo.cell("lat", "lon", 461.0))
    mid = geo.centre(F.col("cell"))
    far = df.select(F.max(geo.planar("lat", "lon", *mid)), F.min(F.col("cell") == geo.cell(*mid, 461.0))).first()
    assert far[0] <= 461.0 + 1e-6 and far[1] is True
    assert one(spark, geo.cell(F.lit(None).cast("double"), F.lit(1.0), 461.0))[0] is None
    disk = one(spark, geo.disk(F.lit("461:2:-3"), 2))[0]
    assert len(set(disk)) == 19 and disk[0] == "461:2:-3" and set(disk[1:7]) == {"461:3:-3", "461:1:-3", "461:2:-2", "461:2:-4", "461:3:-4", "461:1:-2"}


def test_surge_average(spark):
    ticks = spark.createDataFrame([("a", 0.0, 3.0), ("a", 60.0, 1.0), ("a", 5000.0, 1.0), ("a", 5010.0, 2.0), ("b", 0.0, 1.0)], "cell string, ts double, raw double")
    got = {(r.cell, r.ts): r.surge for r in market.smoothed(ticks, "cell").collect()}
    assert got[("a", 0.0)] == 3.0 and got[("a", 60.0)] == pytest.approx(1 + 2 * math.exp(-1)) and got[("a", 5000.0)] == 1.0
    assert got[("a", 5010.0)] == pytest.approx(2 - math.exp(-1 / 6)) and got[("b", 0.0)] == 1.0


def test_reports_count_from_the_last_one(spark):
    values = [1.0, 1.04, 1.2, 1.24, 1.26, 1.0, 1.0, 1.3]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, ts int, v double")
    assert rows(market.reported(df, "k", "ts", "v", 1.0, 0.05, None).select("ts", "v")) == [(0.0 + i, values[i]) for i in (1, 2, 4, 5, 7)]
    weights = [10.5, 11.5, 12.0, 12.7, 10.0, 10.05, 11.2]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(weights)], "k string, ts int, v double")
    assert rows(market.reported(df, "k", "ts", "v", 10.0, None, 0.1).select("ts", "v")) == [(0.0 + i, weights[i]) for i in (1, 3, 4, 6)]


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_percentiles_of_groups(spark, monkeypatch, few):
    monkeypatch.setattr(ordered, "FEW", few)
    r = random.Random(8)
    data = [(k, r.choice([None, float(r.randrange(30)), r.random()])) for k in ["a"] * 200 + ["b"] * 7 + [None] * 20 + ["c"]] + [("d", None)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {x.k: x for x in stats.summary(df, ["k"], "v").collect()}
    want = df.groupBy("k").agg(F.count("v").alias("n"), F.percentile("v", 0.5).alias("p50"), F.percentile("v", 0.95).alias("p95")).collect()
    assert len(got) == len(want) == 5
    for w in want:
        assert got[w.k].n == w.n and got[w.k].p50 == pytest.approx(w.p50 or 0.0) and got[w.k].p95 == pytest.approx(w.p95 or 0.0)


def test_splitting_time_does_not_change_cancellations(spark):
    whole, part = one(spark, market.cancel_probability(F.lit(1.2), F.lit(60.0)), market.cancel_probability(F.lit(1.2), F.lit(6.0)))
    assert 1 - (1 - part) ** 10 == pytest.approx(whole)


def plain_rate(samples, t, window):
    """A rate over (t - window, t] in seconds and milliseconds, sample by sample."""
    s = sorted({(a, v) for a, v in samples if t - window < a <= t})
    if len(s) < 2:
        return None
    grown = sum(v - p if v >= p else v for (_, p), (_, v) in zip(s, s[1:]))
    length = s[-1][0] - s[0][0]
    usual = length / (len(s) - 1)
    before, after = s[0][0] - (t - window), t - s[-1][0]
    before = usual / 2 if before >= 1.1 * usual else before
    after = usual / 2 if after >= 1.1 * usual else after
    if grown > 0:
        before = min(before, length * s[0][1] / grown)
    return grown * (length + before + after) / length / (window / 1000)


def test_rates_of_counters(spark):
    """Ten a minute over a full window; a restart; one sample alone; a gap longer than the window; null, repeated and clashing columns."""
    even = [("even", 60_000 + 10_000 * i, 100.0 + 10 * i) for i in range(12)]
    df = spark.createDataFrame([*even, even[0], ("even", None, 3.0), ("even", 70_000, None), ("alone", 60_000, 1.0)], "k string, ts_ms long, value double")
    got = {(r.k, r.t_ms): r.rate for r in rates.rates(df.withColumn("n", F.lit(1)), ["k"], window_ms=60_000, step_ms=60_000).collect()}
    assert got == {("even", 120_000): pytest.approx(1.0), ("even", 180_000): pytest.approx(1.0)}  # both ends are a usual distance away
    r = random.Random(3)
    series = {}
    for name in "abc":
        at, value = r.randrange(1000), 0.0
        for _ in range(200):
            at += r.choice([500, 1000, 1000, 7000, 90_000])
            value = float(r.randrange(5)) if r.random() < 0.1 else value + r.randrange(9)
            series.setdefault(name, []).append((at, value))
    df = spark.createDataFrame([(k, *x) for k, s in series.items() for x in s], "k string, ts_ms long, value double")
    for window, step in ((30_000, 10_000), (10_000, 25_000)):
        got = {(x.k, x.t_ms): x.rate for x in rates.rates(df, ["k"], window_ms=window, step_ms=step).collect()}
        last = max(a for s in series.values() for a, _ in s) + window
        want = {(k, t): v for k, s in series.items() for t in range(0, last + step, step) if (v := plain_rate(s, t, window)) is not None}
        assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)
    assert rates.rates(df.limit(0), ["k"]).count() == 0


def test_summed_rates_never_fall(spark):
    df = spark.createDataFrame([("p", 1.0, 2.0), ("p", 5.0, 1.0), ("p", 5.0, 0.5), ("p", math.inf, 4.0)], "k string, le double, rate double")
    assert rows(rates.summed(df, ["k"])) == [("p", 1.0, 2.0), ("p", 5.0, 2.0), ("p", math.inf, 4.0)]


def test_means_between_two_roundings_do_not_hang_on_the_order_of_rows(spark, tmp_path):
    """Runs of 16 trips whose mean wait lies in the middle between two thousandths: means are those of exact sums."""
    r, made = random.Random(5), []
    wait = lambda c, k: (c * 31) % 60000 + 10000 + (k * 37) % 300000
    for c in range(30):
        for parity in (0, 1):
            run = [(c + 30 * r.randrange(5000), 2 * r.randrange(100_000) + parity) for _ in range(15)]
            last = c + 30 * r.randrange(5000)
            run.append((last, next(k for k in itertools.count(2 * r.randrange(100_000) + parity, 2) if sum(wait(*x) for x in [*run, (last, k)]) % 16 == 8)))
            made += run
    spark.createDataFrame(made, "o_custkey long, o_orderkey long").repartition(3).write.parquet(f"{tmp_path}/orders.parquet")
    sums = {}
    for c, k in made:
        at = (f"scn_{c % 3}", "greedy" if k % 2 == 0 else "batch", 1 + c % 10)
        sums[at] = sums.get(at, 0) + wait(c, k)
    want = {at: math.floor(x / 1000 / 16 * 1000 + 0.5) / 1000 for at, x in sums.items()}
    got = reports.metrics_summary(spark, str(tmp_path))
    assert {(x.scenario, x.policy, x.seed): x.avg_wait_s for x in got.collect()} == want
    pairs = {(f"scn_{int(2 * x.demand - 2)}", x.seed): (x.base_wait_s, x.alt_wait_s) for x in reports.paired_diffs(spark, str(tmp_path)).collect()}
    assert pairs == {(s, n): (want[s, "greedy", n], want[s, "batch", n]) for s, _, n in want}
