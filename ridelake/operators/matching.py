"""Requests and drivers: the nearest drivers of each request, and assignments.

The search for the nearest is a join on cells whose size follows the density of drivers. Assignments depend on the order within one matching
window, so each window (and region) is a group of its own and Spark works on all of them at once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelake.functions.geo import REGION_M, cell, plane, ring_offsets
from ridelake.functions.market import match_cost
from ridelake.operators import floods, search
from ridelake.storage import counted, kept

#: Cost of a pair that must not be matched.
NEVER = 1e9
#: Straight-line metres per second of a driver on the way to a pickup.
DRIVER_MPS = 11.0


def available(drivers: DataFrame, active_rides: DataFrame) -> DataFrame:
    """Drivers that are idle or repositioning and hold no active ride."""
    return drivers.where(F.col("state").isin("idle", "repositioning")).join(active_rides.select("driver_id"), "driver_id", "left_anti")


#: Side in metres of the finest squares that drivers are counted in, and how often it is doubled: the last squares span the earth.
FINEST_M, LEVELS = 125.0, 20


def _at_levels(cells: DataFrame, levels: int) -> DataFrame:
    """Fine cells (fx, fy) with the cells (level, cx, cy) that hold them."""
    each = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    return each.withColumn("cx", F.expr("shiftright(fx, level)")).withColumn("cy", F.expr("shiftright(fy, level)"))


def _around(df: DataFrame) -> DataFrame:
    """Every row once for its own cell (cx, cy) and each of its eight neighbours."""
    step = F.explode(F.expr("flatten(transform(sequence(-1, 1), a -> transform(sequence(-1, 1), b -> struct(a, b))))"))
    return df.withColumn("__c", step).withColumn("cx", F.col("cx") + F.col("__c.a")).withColumn("cy", F.col("cy") + F.col("__c.b")).drop("__c")


def nearest(requests: DataFrame, drivers: DataFrame, k: int = 5, size: float = FINEST_M, levels: int = LEVELS) -> DataFrame:
    """(request_id, driver_id, dist_m, rank): the ``k`` nearest drivers of each request, ties by driver_id; rows without a position are left out.

    Drivers are counted in squares of every level. Each request takes the finest level at which its square and the eight around it hold ``k``
    drivers, so these are less than three sides away, and is joined once with the drivers in squares of that size and their
    neighbours: none nearer lies outside. Where drivers are dense the squares are small, where they are sparse large, and no request is
    searched twice. Positions that many requests share are searched once, and of drivers at one position the first ``k`` are enough.
    """
    rx, ry = plane("lat", "lon")
    spots = requests.select("request_id", rx.alias("x"), ry.alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    fine = lambda x, y: (F.floor(F.col(x) / size).alias("fx"), F.floor(F.col(y) / size).alias("fy"))
    left = kept(spots.select("x", "y").distinct().select("x", "y", *fine("x", "y")))
    placed = drivers.select("driver_id", rx.alias("dx"), ry.alias("dy")).where(F.col("dx").isNotNull() & F.col("dy").isNotNull())
    same = F.row_number().over(Window.partitionBy("dx", "dy").orderBy("driver_id"))
    cars = kept(placed.withColumn("__n", same).where(F.col("__n") <= k).select("driver_id", "dx", "dy"))

    held = _at_levels(cars.groupBy(*fine("dx", "dy")).agg(F.count("*").alias("n")), levels).groupBy("level", "cx", "cy").agg(F.sum("n").alias("n"))
    enough = _around(held).groupBy("level", "cx", "cy").agg(F.sum("n").alias("n")).where(F.col("n") >= k).drop("n")
    levelled = _at_levels(left.select("fx", "fy").distinct(), levels).join(enough, ["level", "cx", "cy"]).groupBy("fx", "fy").agg(F.min("level").alias("level"))
    asked = left.join(levelled, ["fx", "fy"], "left").select("x", "y", F.coalesce("level", F.lit(levels - 1)).alias("level"))
    asked, seen = counted(asked, used=F.collect_set("level"))  # no more than there are levels

    side = F.expr("shiftleft(1L, level)") * (3 * size)
    square = lambda x, y: {"cx": F.floor(F.col(x) / side), "cy": F.floor(F.col(y) / side)}
    by_level = cars.withColumn("level", F.explode(F.array(*map(F.lit, sorted(seen["used"]))).cast("array<int>"))).withColumns(square("dx", "dy"))
    met = _around(asked.withColumns(square("x", "y"))).join(by_level, ["level", "cx", "cy"])
    d = F.sqrt((F.col("x") - F.col("dx")) * (F.col("x") - F.col("dx")) + (F.col("y") - F.col("dy")) * (F.col("y") - F.col("dy")))
    order = Window.partitionBy("x", "y").orderBy("dist_m", "driver_id")
    ranked = met.select("x", "y", "driver_id", d.alias("dist_m")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return spots.join(ranked, ["x", "y"]).select("request_id", "driver_id", "dist_m", "rank")


def cost_matrix(
    candidates: DataFrame, surge_premium: float = 0.0, surge: Column | None = None, trip_s: Column | None = None, eta_weight: float = 0.0
) -> DataFrame:
    """(request_id, driver_id, rank, cost): straight-line seconds to the pickup, less a premium for surge, and a share of the trip's seconds."""
    one, none = F.lit(1.0), F.lit(0.0)
    cost = match_cost(F.col("dist_m") / DRIVER_MPS, one if surge is None else surge, none if trip_s is None else trip_s, surge_premium, eta_weight)
    return candidates.select("request_id", "driver_id", "rank", cost.alias("cost"))


def routed(
    candidates: DataFrame, requests: DataFrame, drivers: DataFrame, edges: DataFrame, near: DataFrame | None = None, weight: str = "weight_s", within: float = 1.0
) -> DataFrame:
    """(request_id, driver_id, rank, cost): ``candidates`` with the seconds that a driver needs by road; those without a way are left out.

    ``requests`` have pickup_node, ``drivers`` node and, if they are on an edge, edge_id and the share of it that lies behind them (progress): it is
    finished first. Each pair of nodes is searched once, however many candidates share it: with ``near``, the table of ``search.bounds``, towards its
    goal (``search.between``), else in floods that the pairs of a pickup or of a driver's place share (``floods.costs``).
    """
    on = edges.select("edge_id", F.col("to_node").alias("ahead"), F.col(weight).alias("edge_s"))
    cars = drivers.join(on, "edge_id", "left").select(
        "driver_id", F.coalesce("ahead", "node").cast("long").alias("from_node"), F.coalesce((1 - F.col("progress")) * F.col("edge_s"), F.lit(0.0)).alias("lead_s")
    )
    asked = candidates.select("request_id", "driver_id", "rank").join(cars, "driver_id")
    asked = kept(asked.join(requests.select("request_id", F.col("pickup_node").cast("long").alias("to_node")), "request_id"))
    found = floods.costs(edges, asked, weight) if near is None else search.between(edges, asked, near, weight, within)[0]
    cost = F.round(F.col("lead_s") + F.col("cost"), 6)  # sums in another order are the same cost
    return asked.join(found.where("cost IS NOT NULL").select("from_node", "to_node", "cost"), ["from_node", "to_node"]).select("request_id", "driver_id", "rank", cost.alias("cost"))


def assign(options: Sequence[Sequence[tuple[object, float]]]) -> list[int]:
    """Which of its options (driver, cost) each request takes, -1 for none: as many are served as can be, at the least total cost.

    Requests enter one by one. The new one looks for the nearest way, by costs less the drivers' prices, to a free driver or to a
    request that can give up its own (at the cost NEVER); the drivers on the way change hands and those that were passed become dearer.
    Only drivers that are linked with the new request are looked at, so parts of a window that share no driver don't meet.
    """
    price: dict = defaultdict(float)
    holder: dict = {}
    taken = [-1] * len(options)
    for new in range(len(options)):
        heap, reach, via, passed = [], {}, {}, {}
        at, base, quits, quit_cost = new, 0.0, new, float("inf")
        while True:
            if base + NEVER < quit_cost:
                quits, quit_cost = at, base + NEVER
            for place, (driver, cost) in enumerate(options[at]):
                far = base + cost - price[driver]
                if driver not in passed and far < reach.get(driver, float("inf")):
                    reach[driver], via[driver] = far, (at, place)
                    heappush(heap, (far, place, at, driver))
            while heap and heap[0][3] in passed:
                heappop(heap)
            if not heap or heap[0][0] >= quit_cost:
                driver, total = None, quit_cost
                break
            total, _, _, driver = heappop(heap)
            if driver not in holder:
                break
            passed[driver] = total
            at = holder[driver]
            own = options[at][taken[at]]
            base = total - (own[1] - price[driver])
        for d, far in passed.items():
            price[d] += far - total
        if driver is None:
            at, place = quits, -1
        else:
            at, place = via[driver]
        while True:
            before = options[at][taken[at]][0] if at != new else None
            taken[at] = place
            if driver is not None:
                holder[driver] = at
            if at == new:
                break
            driver = before
            at, place = via[driver]
    return taken


def _best(request: np.ndarray, driver: np.ndarray, cost: np.ndarray) -> list[int]:
    """Places of the candidates that make up the least total cost within one group."""
    places: dict = {}
    for i, r in enumerate(request.tolist()):
        places.setdefault(r, []).append(i)
    drivers, costs = driver.tolist(), cost.tolist()
    chosen = assign([[(drivers[i], costs[i]) for i in of] for of in places.values()])
    return [of[c] for of, c in zip(places.values(), chosen, strict=True) if c >= 0]


def _greedy(request: np.ndarray, driver: np.ndarray, cost: np.ndarray) -> list[int]:
    """Places of the candidates taken when each request in turn takes its cheapest driver that is still free. Rows come in
    the order of requests and then of cost."""
    taken, served, out = set(), set(), []
    for i, (r, d) in enumerate(zip(request.tolist(), driver.tolist(), strict=True)):
        if r not in served and d not in taken:
            served.add(r)
            taken.add(d)
            out.append(i)
    return out


def _by_batch(candidates: DataFrame, batch: list[str], match) -> DataFrame:
    """Apply ``match`` to every batch. Batches are small and many, so a task walks through its batches in order and holds one at a time."""
    columns = [*batch, "request_id", "driver_id", "cost"]
    order = [*batch, *[c for c in ("request_ts",) if c in candidates.columns], "request_id", "cost", *[c for c in ("rank",) if c in candidates.columns]]
    dealt = candidates.repartition(*batch).sortWithinPartitions(*order).select(*columns)

    def solved(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        request, driver, cost = (rows[c].to_numpy() for c in ("request_id", "driver_id", "cost"))
        picked: list[int] = []
        for a, b in zip(starts, [*starts[1:], len(rows)], strict=True):
            picked += [int(a) + i for i in match(request[a:b], driver[a:b], cost[a:b])]
        return rows.iloc[picked]

    def run(parts):
        held = None
        for rows in parts:
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            if not len(rows):
                continue
            starts = np.flatnonzero((rows[batch] != rows[batch].shift()).any(axis=1).to_numpy())
            held = rows.iloc[starts[-1] :]
            if len(starts) > 1:
                yield solved(rows.iloc[: starts[-1]], starts[:-1])
        if held is not None:
            yield solved(held, np.array([0]))

    return dealt.mapInPandas(run, dealt.schema)


def greedy_match(candidates: DataFrame, batch: list[str]) -> DataFrame:
    """(batch, request_id, driver_id, cost) from candidates (batch, request_id, request_ts, driver_id, rank, cost)."""
    return _by_batch(candidates, batch, _greedy)


def batch_match(candidates: DataFrame, batch: list[str]) -> DataFrame:
    """Least total cost within every batch; a request without a candidate left stays unmatched."""
    return _by_batch(candidates, batch, _best)


def region_match(candidates: DataFrame, batch: list[str]) -> DataFrame:
    """Least total cost within every region of a batch (column region), each driver used once in a batch.

    All regions are solved at once. Where several took one driver, the first region in order keeps it; the others
    lose that candidate and are solved again, until no driver is taken twice. A region's result depends on its own candidates
    only, so regions without a conflict are settled. Each round takes a candidate from somebody, so the rounds end.
    """
    open_ = kept(candidates)
    settled: DataFrame | None = None
    while True:
        made = kept(batch_match(open_, [*batch, "region"]))
        first = made.groupBy(*batch, "driver_id").agg(F.min("region").alias("first"))
        lost = kept(made.join(first, [*batch, "driver_id"]).where("region != first").select(*batch, "region", "driver_id"))
        if not lost.limit(1).count():
            return made if settled is None else settled.unionByName(made)
        again = lost.select(*batch).distinct()
        calm = made.join(again, batch, "left_anti")
        settled = calm if settled is None else settled.unionByName(calm)
        open_ = kept(open_.join(again, batch, "left_semi").join(lost, [*batch, "region", "driver_id"], "left_anti"))


def region(lat, lon) -> Column:
    """The region of a position; positions without one share region ''."""
    return F.coalesce(cell(lat, lon, REGION_M), F.lit(""))


def windows(requests: DataFrame, run: list[str], ts_ms: str, window_ms: int) -> DataFrame:
    """``requests`` with batch_ms, the moment at which the batch policy matches them.

    It fires with the first request of a run, and then once a window has passed: requests wait for the next multiple of the
    window after that first moment.
    """
    first = requests.groupBy(*run).agg(F.min(ts_ms).alias("__first"))
    since = F.col(ts_ms) - F.col("__first")
    batch = F.col("__first") + F.ceil(since / window_ms) * window_ms
    return requests.join(first, run).withColumn("batch_ms", batch).select(*requests.columns, "batch_ms")


def uniform(seed: int, *cols: str) -> Column:
    """A number in [0, 1) drawn from a seed and identifiers, equal wherever it is computed."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 53)) / float(1 << 53)


def accepted(offers: DataFrame, seed: int, decline: float) -> DataFrame:
    """Offers (request_id, driver_id, attempt) that the driver takes."""
    return offers.where(uniform(seed, "request_id", "driver_id", "attempt") >= decline)


def not_declined(candidates: DataFrame, declined: DataFrame) -> DataFrame:
    """Candidates without those whose driver has declined the request before."""
    return candidates.join(declined.select("request_id", "driver_id"), ["request_id", "driver_id"], "left_anti")


def abandoned(requests: DataFrame, waited_s: Column, max_wait_s: float) -> DataFrame:
    """Requests that waited longer than the limit; those that waited exactly as long stay."""
    return requests.where(waited_s > max_wait_s)


def gaps(pickups: DataFrame, cars: DataFrame) -> DataFrame:
    """(cell, gap): recent pickups of each cell minus the cars in it or on the way to it."""
    moves = pickups.select("cell", F.lit(1).cast("long").alias("d")).unionByName(cars.select("cell", F.lit(-1).cast("long").alias("d")))
    return moves.where(F.col("cell").isNotNull()).groupBy("cell").agg(F.sum("d").alias("gap"))


def reposition_targets(gap: DataFrame, disk_of, lead: int = 2) -> DataFrame:
    """(cell, target, target_gap): for each cell the neighbour with the largest gap, where that is above nothing and
    at least ``lead`` above its own. Ties go to the nearer ring, then the cell's name."""
    own = gap.select("cell", F.col("gap").alias("here"), F.posexplode(disk_of(F.col("cell"))).alias("pos", "target"))
    far = own.join(gap.select(F.col("cell").alias("target"), F.col("gap").alias("target_gap")), "target")
    best = far.groupBy("cell", "here").agg(F.max(F.struct("target_gap", (-F.col("pos")).alias("near"), "target")).alias("b"))
    return best.where((F.col("b.target") != F.col("cell")) & (F.col("b.target_gap") > 0) & (F.col("b.target_gap") - F.col("here") >= lead)).select(
        "cell", F.col("b.target").alias("target"), F.col("b.target_gap").alias("target_gap")
    )


def reposition_moves(pickups: DataFrame, cars: DataFrame, rings: int, lead: int = 2) -> DataFrame:
    """(fleet, driver_id, cell, target): which cars move, from recent pickups (fleet, cell) and cars (fleet, driver_id, cell, ready).

    The cars of a fleet that are ready choose in the order of driver_id: the cell with the largest gap (pickups less cars) within
    ``rings``, the nearer ring first among equals, where the gap is above nothing and at least ``lead`` above that of the car's own
    cell. A move takes one from the target's gap and adds one to the own. Each choice depends on those before, so a fleet's cars pass
    through one task, batch by batch; what is kept is a number for each cell.
    """
    keys = ["fleet", "cell"]
    moves = pickups.select(*keys, F.lit(1).alias("d")).unionByName(cars.select(*keys, F.lit(-1).alias("d"))).where("cell IS NOT NULL")
    schema = "fleet string, driver_id long, cell string, gap long"
    gap = moves.groupBy(*keys).agg(F.sum("d").alias("gap")).select("fleet", F.lit(None).cast("long").alias("driver_id"), "cell", "gap")
    ready = cars.where(F.col("ready") & F.col("cell").isNotNull()).select("fleet", F.col("driver_id").cast("long"), "cell", F.lit(0).cast("long").alias("gap"))
    # gaps have no driver_id and sort before the cars
    dealt = gap.unionByName(ready).repartition("fleet").sortWithinPartitions("fleet", F.asc_nulls_first("driver_id")).select("fleet", "driver_id", "cell", "gap")
    offsets = ring_offsets(rings)

    def near(name: str) -> list[str]:
        size, q, r = name.split(":")
        return [f"{size}:{int(q) + a}:{int(r) + b}" for a, b in offsets]

    def run(parts):
        fleet, held = None, {}
        for rows in parts:
            out = []
            for f, driver, here, n in zip(*(rows[c] for c in rows.columns), strict=True):
                if f != fleet:
                    fleet, held = f, {}
                if pd.isna(driver):
                    held[here] = int(n)
                    continue
                best = max(near(here), key=lambda c: held.get(c, 0))  # the first of equals
                if held.get(best, 0) > 0 and held.get(best, 0) - held.get(here, 0) >= lead:
                    held[best] -= 1
                    held[here] = held.get(here, 0) + 1
                    out.append((f, int(driver), here, best))
            yield pd.DataFrame(out, columns=["fleet", "driver_id", "cell", "target"])

    return dealt.mapInPandas(run, schema.replace("gap long", "target string"))
