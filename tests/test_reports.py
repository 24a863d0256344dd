"""Scenario files, rendered reports, text formats, ride states, repositioning, training pairs, replays."""

from __future__ import annotations

import json
import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from ridelake import rendering, tables
from ridelake.functions import exposition, geo, histograms, times
from ridelake.operators import eta, matching, rides, roads
from ridelake.sources import scenarios, traces
from ridelake.streaming import sinks, topics
from conftest import rows

SF = "/root/testdata/sf0.001"
GOOD = {
    "name": "downtown", "duration_s": 3600, "seed": 7, "vehicles": {"count": 50},
    "arrivals": {"rate_segments": [{"t": 0, "rate": 0.2}, {"t": 900, "rate": 0.6}], "pickup_hotspots": [{"lat": 37.7, "lon": -122.4, "radius_m": 500, "weight": 2}]},
}


def changed(**deep):
    made = json.loads(json.dumps(GOOD))
    for path, value in deep.items():
        at, *rest = path.split("__")
        of = made
        while rest:
            of, (at, *rest) = of[int(at) if at.isdigit() else at], rest
        of[int(at) if isinstance(of, list) else at] = value
    return json.dumps(made)


def test_scenario(tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps(GOOD))
    s = scenarios.load(str(path))
    assert s.vehicles.spawn == "random" and s.arrivals.segments() == [(0, 0.2), (900, 0.6)] and s.arrivals.hotspots("pickup")[0][0] == "pickup_0"


@pytest.mark.parametrize("bad", [
    {"name": ""}, {"duration_s": 0}, {"vehicles__count": 0}, {"vehicles__spawn": "here"}, {"vehicles__cuont": 3}, {"arrivals__rate_segments": []},
    {"arrivals__rate_segments__1__t": 0}, {"arrivals__rate_segments__1__rate": -1}, {"arrivals__rate_segments__1__rate": float("nan")},
    {"arrivals__pickup_hotspots__0__lat": 91}, {"arrivals__pickup_hotspots__0__weight": 0}, {"arrivals__pickup_hotspots__0__radius_m": float("inf")},
    {"more": 1}, {"vehicles": 3},
])
def test_bad_scenarios(bad):
    with pytest.raises(ValueError):
        scenarios.parse(changed(**bad))


def test_demand_levels():
    assert scenarios.demand_levels("2, 1,1.5") == [1.0, 1.5, 2.0]
    for bad in ("", "1,x", "0", "-1", "inf", "nan", "1,1.0"):
        with pytest.raises(ValueError):
            scenarios.demand_levels(bad)


def test_report(spark):
    data = [(1.0, p, s, w + (20.0 if p == "greedy" else 0.0), True) for p in ("batch", "greedy") for s in (1, 2, 3) for w in (10.0, 20.0 + s)]
    waits = spark.createDataFrame([*data, (1.0, "batch", 4, 9.0, False)], "demand double, policy string, seed int, wait_seconds double, picked_up boolean")
    text = rendering.report(waits, "greedy", "A | B", rendering.Provenance("grid", "s.json", "run", "abc"))
    assert "| greedy | 6 | 6 (100.0%) | 36.0 |" in text and "| batch | 7 | 6 (85.7%) |" in text and "| 2 | 36.0 | 16.0 | -20.0 |" in text
    assert "batch is lower in 3 of 3 runs (sign test, p = 0.25)" in text and "wait_cdf.svg" in text and "| 4 |" not in text
    alone = rendering.report(waits.where("policy = 'greedy' OR seed = 4"), "greedy", "x", rendering.Provenance("", "", "", ""))
    assert "No run has riders under both policies." in alone


def test_charts(spark):
    waits = tables.waits(spark, SF)
    end, points = rendering.cdf_points(waits, 50)
    assert end == rendering.nice_ceil(end) and points.count() <= 100
    for p in points.collect():
        of = waits.where(F.col("policy") == p.policy)
        assert p.share == pytest.approx(of.where(F.col("wait_seconds") <= p.x + 1e-9).count() / of.count())
        break
    for svg in (rendering.wait_cdf_svg(waits), rendering.demand_svg(waits), rendering.wait_cdf_svg(waits.limit(0))):
        assert ET.fromstring(svg).tag.endswith("svg")


def test_histogram_text(spark):
    df = spark.createDataFrame([('a"b\\c\n', 3.0), ('a"b\\c\n', 700.5)], "policy string, v double")
    lines = [x.line for x in exposition.histogram_lines(histograms.buckets(df, ["policy"], "v", [1, 5]), "m", ["policy"]).collect()]
    of = 'policy="a\\"b\\\\c\\n"'
    assert sorted(lines) == sorted([f'm_bucket{{{of},le="1"}} 0', f'm_bucket{{{of},le="5"}} 1', f'm_bucket{{{of},le="+Inf"}} 2', f"m_sum{{{of}}} 703.500", f"m_count{{{of}}} 2"])


def test_times_do_not_depend_on_the_zone(spark):
    df = spark.createDataFrame([(1_700_001_800_123,), (None,)], "ms long")
    for zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            got = df.select(times.rfc3339("ms"), times.hour("ms")).collect()
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert [tuple(r) for r in got] == [("2023-11-14T22:43:20Z", "2023-11-14T22"), (None, None)]


def test_ride_states(spark):
    df = spark.createDataFrame([(i, 10, 20, 30, 40) for i in range(1)], "ride_id int, request_ts_unix_ms int, match_ts_unix_ms int, pickup_ts_unix_ms int, dropoff_ts_unix_ms int")
    assert [df.select(rides.state_at(t)).first()[0] for t in (9, 10, 20, 30, 40)] == [None, *rides.STATES]
    near = rides.with_surge(spark.createDataFrame([("a",), ("b",), (None,)], "cell string"), spark.createDataFrame([("a", 2.0)], "cell string, surge double"))
    assert rows(near) == sorted([("a", 2.0), ("b", 1.0), (None, 1.0)], key=repr)


def test_repositioning_moves(spark):
    r = random.Random(2)
    cell = lambda: f"461:{r.randrange(5)}:{r.randrange(5)}"
    pickups = [(f, cell()) for f in ("x", "y") for _ in range(60)] + [("x", None)]
    cars = [(f, d, cell(), r.random() < 0.7) for f in ("x", "y") for d in range(30)] + [("y", 99, None, True)]
    want = []
    for f in ("x", "y"):
        gap = {}
        for c in [c for g, c in pickups if g == f and c]:
            gap[c] = gap.get(c, 0) + 1
        for c in [c for g, _, c, _ in cars if g == f and c]:
            gap[c] = gap.get(c, 0) - 1
        for _, d, here, ready in sorted((x for x in cars if x[0] == f and x[2] and x[3]), key=lambda x: x[1]):
            best = here
            for a, b in geo.ring_offsets(2):
                _, q, s = here.split(":")
                c = f"461:{int(q) + a}:{int(s) + b}"
                if gap.get(c, 0) > gap.get(best, 0):
                    best = c
            if best != here and gap[best] > 0 and gap[best] - gap.get(here, 0) >= 2:
                gap[best], gap[here] = gap[best] - 1, gap.get(here, 0) + 1
                want.append((f, d, here, best))
    got = matching.reposition_moves(spark.createDataFrame(pickups, "fleet string, cell string"), spark.createDataFrame(cars, "fleet string, driver_id long, cell string, ready boolean"), 2)
    assert len(want) > 10 and rows(got) == sorted(want, key=repr)


def test_ways_that_do_not_exist(spark):
    """1 <-> 2 -> 3, and 4 alone: from 3 nothing is reached, and 4 neither way."""
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "node_id long")
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "from_node long, to_node long")
    pairs = spark.createDataFrame([(a, b) for a in (1, 2, 3, 4) for b in (1, 2, 3, 4)] + [(1, 9)], "from_node long, to_node long")
    assert rows(roads.unroutable(pairs, nodes, edges)) == sorted([(1, 4), (2, 4), (3, 1), (3, 2), (3, 4), (4, 1), (4, 2), (4, 3), (1, 9)])


def test_training_pairs(spark):
    nodes = spark.createDataFrame([(i, 37.7 + i / 1000, -122.4) for i in range(6)], "node_id long, lat double, lon double")
    line = [(i * 10 + j, i, j, 5.0) for i in range(4) for j in (i - 1, i + 1) if 0 <= j < 4]  # 4 and 5 can't be reached
    edges = spark.createDataFrame(line, "edge_id long, from_node long, to_node long, base_weight_s double")
    got = eta.routed_pairs(nodes, edges, 12, 3).collect()
    assert len(got) == 12 and len({x.attempt for x in got}) == 12
    for x in got:
        assert x.from_node != x.to_node and max(x.from_node, x.to_node) < 4 and 0 <= x.hour < 24
        assert x.trip_duration_s == 5.0 * abs(x.from_node - x.to_node) and x.dist_m == pytest.approx(111 * abs(x.from_node - x.to_node))
    assert eta.routed_pairs(nodes, edges.limit(0), 3, 3, attempts=2).count() == 0


def test_replay_difference(spark):
    of = lambda data: spark.createDataFrame(data, "k int, v string")
    got = topics.replay_difference(of([(1, "a"), (2, "b"), (3, None)]), of([(1, "a"), (2, "x"), (4, "d")]), ["k"])
    assert rows(got) == [(2, "changed"), (3, "added"), (4, "missing")]


def test_snapshot_is_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/live"
    for n in (3, 2):
        sinks.snapshot_json(spark.range(n), path)
    assert [json.loads(r.value) for r in spark.read.text(path).collect()] == [{"id": 0}, {"id": 1}]


def test_newest_files(spark, tmp_path):
    import os

    path = f"file://{tmp_path}/trips"
    for i in range(3):
        t = spark.createDataFrame([(i * 10 + j, "s", "p", 1) for j in range(2)], "ride_id long, scenario string, policy string, seed long")
        traces.conform(t).coalesce(1).write.mode("append").parquet(path)
    files = {f: min(r.ride_id for r in spark.read.parquet(str(f)).collect()) // 10 for f in (tmp_path / "trips").glob("*.parquet")}
    for f, i in files.items():
        os.utime(f, (1_700_000_000 + i * 100,) * 2)
    found = lambda most: sorted(r.ride_id for r in traces.newest(spark, path, most).collect())
    assert found(1) == found(2) == [20, 21] and found(3) == [10, 11, 20, 21] and len(found(99)) == 6
