"""Operators against brute force and small cases with known results."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from ridelake.functions import geo
from ridelake.operators import demand, eta, matching, ordered, roads
from ridelake.sources import graphs, traces
from ridelake.streaming import live, sinks, topics

EDGES = "edge_id long, from_node long, to_node long, length double, lanes int, speed_limit double"


def edges(spark, pairs, **more):
    return spark.createDataFrame([(i, a, b, 7.0, 1, 10.0) for i, (a, b) in enumerate(pairs)], EDGES)


def test_running_totals(spark):
    r = random.Random(1)
    data = [(i * 3, r.choice("ab"), float(r.randrange(9))) for i in range(300)]
    df = spark.createDataFrame(data, "i long, k string, v double").repartition(5)
    got = {x.i: (x.t, x.u) for x in ordered.running_total(ordered.running_total(df, "i", "v", "t", ranges=7), "i", "v", "u", ("k",), ranges=7).collect()}
    total, own = 0.0, {"a": 0.0, "b": 0.0}
    for i, k, v in data:
        total += v
        own[k] += v
        assert got[i] == (total, own[k])
    assert [x.d for x in ordered.dense_ids(df, "i", "d").orderBy("i").collect()] == list(range(300))


def test_components(spark):
    nodes = spark.range(12).select(F.col("id").alias("node_id"))
    pairs = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3), (5, 6), (6, 7), (7, 8), (8, 9), (9, 6), (10, 10)]
    got = {x.node_id: x.component for x in roads.strong_components(nodes, edges(spark, pairs), hops=2).collect()}
    assert got == {0: 2, 1: 2, 2: 2, 3: 5, 4: 5, 5: 5, 6: 9, 7: 9, 8: 9, 9: 9, 10: 10, 11: 11}
    own, cut = roads.largest_component(nodes, edges(spark, pairs))
    assert rows(own) == [(6,), (7,), (8,), (9,)] and sorted(cut.select("edge_id").collect()) == [(8,), (9,), (10,), (11,)]


def test_links(spark):
    both = [(a, b) for a, b in ((0, 1), (1, 2), (2, 3), (2, 4))] + [(b, a) for a, b in ((0, 1), (1, 2), (2, 3), (2, 4))]
    loop = [(10, 11), (11, 12), (12, 10)]
    e = edges(spark, both + loop)
    got = {x.edge_id: (x.link_id, x.pos) for x in roads.links(e).collect()}
    # 0-1-2 is one road in either direction, node 2 is a junction; the loop begins at its smallest edge
    assert got[0] == (0, 0) and got[1] == (0, 1) and got[5] == (5, 0) and got[4] == (5, 1)
    assert [got[i] for i in (8, 9, 10)] == [(8, 0), (8, 1), (8, 2)]
    assert sorted(got) == list(range(11))
    store = {x.link_id: (x.n_edges, x.storage) for x in roads.link_storage(roads.links(e), e).collect()}
    assert store[0] == (2, 2.0) and store[8] == (3, 3.0)


def test_long_loops_and_chains(spark):
    """A loop of 37 edges and a chain of 21, numbered in disorder, and the way along the chain."""
    ids = list(range(100, 158))
    random.Random(6).shuffle(ids)
    loop = [(ids[i], i, (i + 1) % 37) for i in range(37)]
    chain = [(ids[37 + i], 50 + i, 51 + i) for i in range(21)]
    df = spark.createDataFrame([(*e, 1.0) for e in loop + chain], "edge_id long, from_node long, to_node long, base_weight_s double")
    first = min(range(37), key=lambda i: ids[i])
    want = [(ids[(first + i) % 37], ids[first], i) for i in range(37)] + [(ids[37 + i], ids[37], i) for i in range(21)]
    assert rows(roads.links(df)) == sorted(want)
    assert rows(roads.links(df.where("from_node < 40"))) == sorted(want[:37])
    start = spark.createDataFrame([(50,)], "source long")
    found = roads.route_edges(roads.routes(df, start), df, spark.createDataFrame([(50, 71), (50, 60), (50, 50), (50, 3)], "source long, target long"))
    assert rows(found) == sorted([(50, 71, 20 - i, ids[37 + i]) for i in range(21)] + [(50, 60, 9 - i, ids[37 + i]) for i in range(10)], key=repr)


def test_routes_take_the_detour(spark):
    w = spark.createDataFrame([(0, 1, 2, 900.0), (1, 2, 4, 900.0), (2, 1, 3, 250.0), (3, 3, 4, 250.0)], "edge_id long, from_node long, to_node long, base_weight_s double")
    found = roads.routes(w, spark.createDataFrame([(1,)], "source long"))
    assert {x.node: (x.cost, x.via) for x in found.collect()} == {1: (0.0, None), 2: (900.0, 0), 3: (250.0, 2), 4: (500.0, 3)}
    path = roads.route_edges(found, w, spark.createDataFrame([(1, 4)], "source long, target long"))
    assert rows(path.select("pos", "edge_id")) == [(0, 3), (1, 2)]


def test_graph_csv(spark, tmp_path):
    (tmp_path / "nodes.csv").write_text("node_id,lat,lon\n1,37.5,-122.5\n2,37.6,-122.4\n")
    (tmp_path / "edges.csv").write_text("edge_id,from_node,to_node,length,lanes,speed_limit\n1,1,2,111.0,2,13.89\n2,2,1,0,2,13.89\n")
    n, e = graphs.graph(spark, f"file://{tmp_path}/nodes.csv", f"file://{tmp_path}/edges.csv")
    assert n.count() == 2
    with pytest.raises(Exception, match="length must be positive"):
        e.collect()
    (tmp_path / "bad.csv").write_text("node_id,lat,lon\n1,x,-122.5\n")
    with pytest.raises(Exception):  # noqa: B017
        graphs.nodes(spark, f"file://{tmp_path}/bad.csv").collect()


def test_assignment_matches_brute_force():
    r = np.random.default_rng(3)
    for n in [1, 2, 3, 4, 5] * 12:
        cost = r.integers(-20, 20, (n, n)).astype(float)
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        chosen = matching.assign([list(enumerate(row)) for row in cost.tolist()])
        assert sorted(chosen) == list(range(n)) and cost[np.arange(n), chosen].sum() == best


def test_sparse_assignment_matches_brute_force():
    """Not every pair is a candidate, there may be fewer drivers than requests, costs tie and may be negative."""
    r = np.random.default_rng(5)
    for _ in range(300):
        n, m = r.integers(1, 6, 2)
        options = [[(d, float(r.integers(-5, 6))) for d in range(m) if r.random() < 0.5] for _ in range(n)]
        of = [{None: matching.NEVER} | dict(o) for o in options]
        ways = (p for p in itertools.product(*of) if len(s := [d for d in p if d is not None]) == len(set(s)))
        best = min(sum(o[d] for o, d in zip(of, p, strict=True)) for p in ways)
        taken = matching.assign(options)
        drivers = [o[t][0] for o, t in zip(options, taken, strict=True) if t >= 0]
        assert len(drivers) == len(set(drivers))
        assert sum(o[t][1] if t >= 0 else matching.NEVER for o, t in zip(options, taken, strict=True)) == best


def candidates(spark, data):
    return spark.createDataFrame(data, "batch int, region string, request_id long, request_ts long, driver_id long, rank int, cost double")


def test_greedy_and_batch(spark):
    c = candidates(spark, [(0, "a", 1, 0, 1, 2, 5.0), (0, "a", 1, 0, 2, 1, 1.0), (0, "a", 2, 1, 1, 2, 6.0), (0, "a", 2, 1, 2, 1, 10.0)])
    total = lambda df: df.agg(F.sum("cost")).first()[0]
    assert total(matching.greedy_match(c, ["batch"])) == 7.0 and total(matching.batch_match(c, ["batch"])) == 7.0
    c = candidates(spark, [(0, "a", 1, 0, 1, 2, 5.0), (0, "a", 1, 0, 2, 1, 1.0), (0, "a", 2, 1, 1, 2, 20.0), (0, "a", 2, 1, 2, 1, 2.0)])
    assert total(matching.greedy_match(c, ["batch"])) == 21.0 and total(matching.batch_match(c, ["batch"])) == 7.0


def test_batches_do_not_mix(spark):
    r = random.Random(4)
    data = [(b, "a", q + 100 * b, q, d, 1, float(r.randrange(50))) for b in range(40) for q in range(4) for d in range(4)]
    got = matching.batch_match(candidates(spark, data), ["batch"]).collect()
    for b in range(40):
        cost = np.array([[next(x[6] for x in data if x[0] == b and x[3] == q and x[4] == d) for d in range(4)] for q in range(4)])
        best = min(sum(cost[i, p[i]] for i in range(4)) for p in itertools.permutations(range(4)))
        own = [x for x in got if x.batch == b]
        assert len({x.driver_id for x in own}) == 4 and sum(x.cost for x in own) == best


def test_regions_share_no_driver(spark):
    data = [(0, "a", 1, 0, 7, 1, 5.0), (0, "b", 2, 0, 7, 1, 1.0), (0, "b", 2, 0, 8, 2, 9.0), (0, "c", 3, 0, 8, 1, 1.0), (1, "c", 4, 0, 8, 1, 2.0)]
    got = matching.region_match(candidates(spark, data), ["batch"])
    assert rows(got.select("request_id", "driver_id")) == [(1, 7), (2, 8), (4, 8)]


def test_nearest_matches_brute_force(spark):
    r = random.Random(5)
    place = lambda: (37.7 + r.random() / 10, -122.5 + r.random() / 10)
    requests = [(i, *place()) for i in range(60)] + [(60, None, None)]
    drivers = [(i, *place()) for i in range(40)] + [(40, 37.75, -122.45), (41, 37.75, -122.45), (42, 38.4, -121.0)]
    got = matching.nearest(spark.createDataFrame(requests, "request_id long, lat double, lon double"), spark.createDataFrame(drivers, "driver_id long, lat double, lon double"), 5)
    found = {(x.request_id, x["rank"]): x.driver_id for x in got.collect()}
    for i, lat, lon in requests[:60]:
        d = sorted((((lat - a) * 111_000) ** 2 + ((lon - b) * 87_750) ** 2, j) for j, a, b in drivers)
        assert [found[(i, k)] for k in range(1, 6)] == [j for _, j in d[:5]]
    few = matching.nearest(spark.createDataFrame(requests[:2], "request_id long, lat double, lon double"), spark.createDataFrame(drivers[:2], "driver_id long, lat double, lon double"), 5)
    assert few.count() == 4


def test_nearest_follows_density(spark):
    """A depot with many drivers at one place and one town beside it, far-off drivers, borders of squares, requests at one place; empty tables; extra columns."""
    r = random.Random(11)
    drivers = [(i, 37.75, -122.45) for i in range(300)] + [(300 + i, 37.75 + r.random() / 500, -122.45 + r.random() / 500) for i in range(200)]
    drivers += [(500 + i, r.uniform(-80, 80), r.uniform(-179, 179)) for i in range(60)] + [(600, None, 1.0)]
    lat0, lon0 = geo.CENTRE
    edge = [(lat0 + a * 125.0 / geo.LAT_M, lon0 + b * 125.0 / geo.LON_M) for a in (-1, 0, 1, 8) for b in (-8, 0, 4)]
    places = edge + [(37.75, -122.45)] * 5 + [(37.75 + r.gauss(0, 0.05), -122.45 + r.gauss(0, 0.05)) for _ in range(60)] + [(r.uniform(-80, 80), r.uniform(-179, 179)) for _ in range(60)]
    frame = lambda data, id_: spark.createDataFrame(data, f"{id_} long, lat double, lon double").withColumn("level", F.lit("x"))
    requests, cars = frame([(i, *p) for i, p in enumerate(places)], "request_id"), frame(drivers, "driver_id")
    at = lambda lat, lon: ((lon - lon0) * geo.LON_M, (lat - lat0) * geo.LAT_M)
    where = [(j, *at(a, b)) for j, a, b in drivers if a is not None]
    for k in (1, 5):
        found = {}
        for x in matching.nearest(requests, cars, k).collect():
            found.setdefault(x.request_id, {})[x["rank"]] = (round(x.dist_m, 6), x.driver_id)
        for i, p in enumerate(places):
            x, y = at(*p)
            want = sorted((math.sqrt((x - a) ** 2 + (y - b) ** 2), j) for j, a, b in where)[:k]
            assert [found[i][n] for n in range(1, k + 1)] == [(round(d, 6), j) for d, j in want]
    assert matching.nearest(requests.limit(0), cars).count() == 0 and matching.nearest(requests, cars.limit(0)).count() == 0


def test_windows_and_waits(spark):
    df = spark.createDataFrame([("r", 1000), ("r", 1001), ("r", 4000), ("r", 4001)], "run string, ts long")
    assert [x.batch_ms for x in matching.windows(df, ["run"], "ts", 3000).orderBy("ts").collect()] == [1000, 4000, 4000, 7000]
    q = spark.createDataFrame([(1, 90.0), (2, 90.5)], "id int, waited double")
    assert rows(matching.abandoned(q, F.col("waited"), 90.0).select("id")) == [(2,)]


def test_declined_offers_are_not_repeated(spark):
    offers = spark.range(4000).select(F.col("id").alias("request_id"), (F.col("id") % 7).alias("driver_id"), F.lit(1).alias("attempt"))
    taken = matching.accepted(offers, 42, 0.2)
    assert 0.77 < taken.count() / 4000 < 0.83 and rows(taken.limit(5)) == rows(matching.accepted(offers, 42, 0.2).limit(5))
    assert matching.not_declined(offers, offers.where("driver_id = 3")).where("driver_id = 3").count() == 0


def test_sampling_and_arrivals(spark):
    weights = spark.createDataFrame([(i, 1.0 + (i == 3) * 6) for i in range(4)], "node_id long, weight double")
    draws = spark.range(1000).select(F.col("id").alias("d"), (F.col("id") / 1000).alias("u"))
    got = {x.node_id: x["count"] for x in demand.sample_nodes(draws, demand.cumulative(weights)).groupBy("node_id").count().collect()}
    assert sum(got.values()) == 1000 and got[3] == pytest.approx(700, abs=2) and got[0] == pytest.approx(100, abs=2)
    runs = spark.createDataFrame([(s, 1.0) for s in range(20)], "seed long, demand double")
    made = demand.arrivals(runs, [(0.0, 0.5), (600.0, 0.5)], 600.0)
    assert made.count() / 20 == pytest.approx(300, rel=0.1)
    assert rows(made.where("seed = 3")) == rows(demand.arrivals(runs.repartition(3), [(0.0, 0.5), (600.0, 0.5)], 600.0).where("seed = 3"))
    with pytest.raises(ValueError, match="no road nodes"):
        demand.node_weights(spark.createDataFrame([(1, 0.0, 0.0)], "node_id long, lat double, lon double"), [("x", 50.0, 8.0, 10.0, 1.0)])


def test_eta_recovers_the_signal(spark, tmp_path):
    data = [(float(d), s, h) for d in range(200, 8001, 200) for s in (1.0, 1.5, 2.0, 2.5) for h in range(0, 22, 3)]
    df = spark.createDataFrame(data, "dist_m double, surge double, h int").withColumn("match_ts_unix_ms", F.col("h").cast("long") * 3_600_000)
    df = eta.features(df.withColumn("trip_duration_s", 0.1 * F.col("dist_m") + 60 * F.col("surge") + 20 * F.sin(F.col("h") * 3.141592653589793 / 12)))
    model = eta.fit(df, ridge=0.1)
    assert model.train_r2 > 0.999 and model.train_n == len(data)
    model.save(spark, f"file://{tmp_path}/m")
    assert eta.Model.load(spark, f"file://{tmp_path}/m") == model
    with pytest.raises(ValueError):
        eta.Model.load(spark, f"file://{tmp_path}/m", ["other"])
    flat = eta.fit(df.withColumn("surge", F.lit(1.0)).withColumn("trip_duration_s", F.col("dist_m") * 0.1 + 30), ridge=0.0)
    assert flat.weights[2] == pytest.approx(0, abs=1e-6)
    p = spark.createDataFrame([(1000.0, 1.0, 0.0, 1.0), (-1e7, 1.0, 0.0, 1.0)], "dist_m double, surge double, hour_sin double, hour_cos double")
    assert [x[0] for x in p.select(flat.predict()).collect()] == [pytest.approx(130), 0.0]
    with pytest.raises(ValueError, match="rows"):
        eta.fit(df.limit(3))


TRIP = ("s", "greedy", 7, 1, 0, 100)
KEYED = "scenario string, policy string, seed long, ride_id long, request_ts_unix_ms long, dropoff_ts_unix_ms long, wait_time_s double"


def test_trip_sink_is_idempotent(spark, tmp_path):
    trips = spark.createDataFrame([(*TRIP, 1.0), (*TRIP, 1.0), ("s", "batch", *TRIP[2:], 1.0), ("s", "greedy", 7, 1, 5, 100, 2.0)], KEYED)
    path = f"file://{tmp_path}/store"
    sinks.append_new(trips.limit(2), path, 0)
    sinks.append_new(trips, path, 1)
    sinks.append_new(trips, path, 1)  # tried again after a failure
    sinks.append_new(trips, path, 2)  # delivered again
    assert spark.read.parquet(path).count() == 3


def test_trip_stream(spark, tmp_path):
    src, out = f"file://{tmp_path}/src", f"file://{tmp_path}/out"
    trips = traces.conform(spark.createDataFrame([(*TRIP, 1.0), ("s", "batch", *TRIP[2:], 1.0)], KEYED))
    trips.write.parquet(src)
    read = spark.readStream.schema(trips.schema).parquet(src)
    sinks.trip_sink(read, out, f"{out}.ck").awaitTermination()
    trips.write.mode("append").parquet(src)  # the same trips once more
    sinks.trip_sink(spark.readStream.schema(trips.schema).parquet(src), out, f"{out}.ck").awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_retries():
    calls = []

    def write():
        calls.append(1)
        if len(calls) < 3:
            raise OSError

    sinks.retried(write, first_s=0.001)
    assert len(calls) == 3
    with pytest.raises(OSError):
        sinks.retried(lambda: (_ for _ in ()).throw(OSError()), tries=2, first_s=0.001)


def test_topics_and_dead_letters(spark, tmp_path):
    base = f"file://{tmp_path}/bus"
    events = spark.createDataFrame([(1, 5, "a"), (2, 6, "b")], "driver_id long, n int, state string")
    topics.publish(topics.records(events, topics.partition_key("driver", "driver_id"), F.timestamp_millis(F.lit(1000))), base, "driver.location")
    bad = spark.createDataFrame([("k", "{broken"), ("k", None)], "key string, value string").withColumn("timestamp", F.timestamp_millis(F.lit(1)))
    topics.publish(bad, base, "driver.location")
    got, dead = topics.decode(topics.replay(spark, base, "driver.location"), events.schema)
    assert rows(got.select("key", "driver_id", "state")) == [("driver:1", 1, "a"), ("driver:2", 2, "b")]
    assert dead.count() == 2
    sinks.decoded_sink(topics.subscribe(spark, base, "driver.location", 1), events.schema, f"{base}/done", "x", f"{base}/ck").awaitTermination()
    assert spark.read.parquet(f"{base}/done/x.decoded").count() == 2 and spark.read.parquet(f"{base}/done/dead.x").count() == 2


def test_counters_ignore_order(spark):
    e = spark.createDataFrame([("trip.requested",)] * 5 + [("trip.matched",)] * 4 + [("trip.cancelled",), ("trip.completed",), ("trip.abandoned",)], "topic string")
    got = live.counters(e.withColumn("run", F.lit(1)), ["run"]).first()
    assert (got.pending, got.active) == (5 - 4 + 1 - 1, 4 - 1 - 1)


def test_surge_stream_equals_the_table(spark, tmp_path):
    from ridelake.functions import market

    r = random.Random(6)
    data = [(c, float(t * 20), r.choice([1.0, 1.0, 1.5, 3.0])) for c in "abc" for t in range(1, 41)]
    ticks = spark.createDataFrame(data, "cell string, ts double, raw double")
    path = f"file://{tmp_path}/ticks"
    for a, b in ((0, 300), (300, 900)):
        ticks.where(f"ts >= {a} and ts < {b}").coalesce(1).write.mode("append").parquet(path)
    stream = live.surge_stream(spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(path))
    query = stream.writeStream.format("memory").queryName("surge_out").outputMode("append").option("checkpointLocation", f"{path}.ck").trigger(availableNow=True).start()
    query.awaitTermination()
    want = market.reported(market.smoothed(ticks, "cell").select("cell", "ts", "surge"), "cell", "ts", "surge", 1.0, market.REPORT, None)
    near = lambda df: [(c, t, round(s, 9)) for c, t, s in rows(df.select("cell", "ts", "surge"))]
    assert near(spark.table("surge_out")) == near(want)


def test_funnel_stream(spark, tmp_path):
    asked = spark.createDataFrame([(1, 10_000), (2, 10_000)], "request_id long, s long").select("request_id", F.timestamp_seconds("s").alias("requested_at"))
    matched = spark.createDataFrame([(1, 10_060), (2, 17_200)], "request_id long, s long").select("request_id", F.timestamp_seconds("s").alias("matched_at"))
    assert rows(live.funnel(asked, matched).select("request_id")) == [(1,)]
    asked.write.parquet(f"{tmp_path}/a")
    matched.write.parquet(f"{tmp_path}/m")
    joined = live.funnel(spark.readStream.schema(asked.schema).parquet(f"{tmp_path}/a"), spark.readStream.schema(matched.schema).parquet(f"{tmp_path}/m"), watermark="10 minutes")
    q = joined.writeStream.format("memory").queryName("funnel_out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [x.request_id for x in spark.table("funnel_out").collect()] == [1]


def test_weighted_draws_without_replacement(spark):
    """Over many seeds the heavy node comes first as often as its weight says, and nodes come once until none is left."""
    weights = spark.createDataFrame([(1, 6.0), (2, 3.0), (3, 1.0), (4, 0.0)], "node_id long, weight double")
    firsts = [demand.spawn_by_weight(weights, 3, seed).orderBy("vehicle_id").collect() for seed in range(12)]
    assert all(sorted(x.node_id for x in drawn) == [1, 2, 3] and [x.vehicle_id for x in drawn] == [0, 1, 2] for drawn in firsts)
    many = spark.range(20_000).select((F.col("id") % 2).alias("kind"), F.col("id").alias("node_id"), F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0).alias("weight"))
    ahead = demand.spawn_by_weight(many.select("node_id", "weight"), 1000, 5).where("node_id % 2 = 0").count()
    assert 740 < ahead < 850  # four of five
    more = demand.spawn_by_weight(weights, 9, 1).collect()
    assert sorted(x.vehicle_id for x in more) == list(range(9)) and {x.node_id for x in more} == {1, 2, 3}
    assert demand.spawn_by_weight(weights.limit(0), 5).count() == 0


def test_ends_are_drawn_once_more_where_they_meet(spark):
    cum = spark.createDataFrame([(10, 1.0, 1.0), (20, 1.0, 2.0)], "node_id long, weight double, cum double")
    draws = spark.createDataFrame([(1, 0.1, 0.2, 0.9), (2, 0.1, 0.9, 0.1), (3, 0.9, 0.8, 0.7), (1, 0.1, 0.2, 0.9)], "k long, u_pickup double, u_dropoff double, u_again double")
    got = rows(demand.with_ends(draws, cum, cum).select("k", "pickup_node", "dropoff_node"))
    assert got == [(1, 10, 20), (1, 10, 20), (2, 10, 20), (3, 20, 20)]


def test_continuations_join_nothing(spark):
    """Edges made from a small table look small to Spark, whatever they grow to, and would be gathered on the driver to be broadcast."""
    i = F.col("id")
    made = spark.range(40).select(F.explode(F.sequence(F.lit(0), F.lit(1))).alias("back"), i)
    e = made.select((i * 2 + F.col("back")).alias("edge_id"), (i + F.col("back")).alias("from_node"), (i + 1 - F.col("back")).alias("to_node"))
    found = roads.continuations(e)
    assert "Join" not in found._jdf.queryExecution().toString()
    # a two-way street of 40 parts: each goes on in its own direction, and ends at the border
    assert rows(found) == sorted([(2 * k, 2 * k + 2 if k < 39 else None) for k in range(40)] + [(2 * k + 1, 2 * k - 1 if k else None) for k in range(40)], key=repr)


def test_a_draw_meets_few_nodes_however_many_there_are(spark):
    """Of 20 000 nodes a bin of 256 held 79."""
    i = F.col("id")
    cum = spark.range(20_000).select(i.alias("node_id"), F.lit(1.0).alias("weight"), (i + 1).cast("double").alias("cum"))
    draws = spark.range(5_000).select(i.alias("draw"), ((i * 7919 % 5_000 + 0.3) / 5_000).alias("u"))
    placed, listed = demand.binned(draws, cum)
    assert placed.join(listed, "bin").count() <= 3 * 5_000
    got = {x.draw: x.node_id for x in demand.sample_nodes(draws, cum).collect()}
    assert got == {k: k * 7919 % 5_000 * 4 + 1 for k in range(5_000)}
