"""Road graphs: edges from map ways, links between junctions, components and routes.

Iterative operators run as joins over the edge table, several steps to a job, and keep each state in
the shared folder; nothing is gathered on the driver but a count for each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridelake.functions import roads
from ridelake.functions.geo import haversine
from ridelake.operators.components import looked_back, strong_components
from ridelake.operators.floods import costs, routes  # noqa: F401 (roads.routes)
from ridelake.operators.ordered import dense_ids, running_total
from ridelake.storage import kept


def validated(edges: DataFrame) -> DataFrame:
    """``edges``; a row without positive length, speed and lanes ends the query with an error that names it."""
    bad = lambda c, what: F.when(F.coalesce(F.col(c) <= 0, F.lit(True)), F.concat(F.lit("edge "), F.col("edge_id").cast("string"), F.lit(f": {what}")))
    fault = F.coalesce(bad("length", "length must be positive"), bad("speed_limit", "speed must be positive"), bad("lanes", "lanes must be positive"))
    return edges.where(F.when(fault.isNull(), F.lit(True)).otherwise(F.raise_error(fault).cast("boolean")))


def with_weights(edges: DataFrame) -> DataFrame:
    given = F.col("base_weight_s") if "base_weight_s" in edges.columns else None
    return edges.withColumn("base_weight_s", roads.base_weight(F.col("length"), F.col("speed_limit"), given))


def drivable(ways: DataFrame) -> DataFrame:
    """(way_id, nodes, speed_limit, lanes, lanes_back, oneway) of the ways (way_id, nodes, tags) that cars may use."""
    highway, one = roads.tag("tags", "highway"), roads.one_way("tags")
    known = ways.where(roads.class_speed(highway).isNotNull() & (roads.tag("tags", "access") != "no"))
    posted = roads.max_speed(roads.tag("tags", "maxspeed"))
    ahead, back = roads.lanes("tags", one)
    nodes = F.when(roads.tag("tags", "oneway") == "-1", F.reverse("nodes")).otherwise(F.col("nodes"))
    speed = F.when(posted > 0, posted).otherwise(roads.class_speed(highway))
    return known.select("way_id", nodes.alias("nodes"), speed.alias("speed_limit"), ahead.alias("lanes"), back.alias("lanes_back"), one.alias("oneway"))


def used_nodes(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """The map nodes that some way needs."""
    return nodes.join(ways.select(F.explode("nodes").alias("osm_id")), "osm_id", "left_semi")


def segments(ways: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a road graph from drivable ways and map nodes (osm_id, lat, lon).

    Nodes get dense ids in the order of their map ids. Each pair of following nodes of a way is an edge, and on a
    two-way road also one back; pairs with a missing node or no length are left out. Edges are numbered in the
    order of way, place and direction.
    """
    own = kept(dense_ids(used_nodes(ways, nodes), "osm_id", "node_id"))
    steps = ways.withColumn("step", F.explode(F.filter(F.sequence(F.lit(0), F.size("nodes") - 1), lambda i: i < F.size("nodes") - 1)))
    steps = steps.withColumn("a", F.col("nodes")[F.col("step")]).withColumn("b", F.col("nodes")[F.col("step") + 1])
    end = lambda side: own.select(*[F.col(c).alias(f"{side}_{c}") for c in own.columns])
    placed = steps.join(end("a"), F.col("a") == F.col("a_osm_id")).join(end("b"), F.col("b") == F.col("b_osm_id"))
    placed = placed.withColumn("length", haversine("a_lat", "a_lon", "b_lat", "b_lon")).where("length > 0")
    both = F.array(
        F.struct(F.lit(0).alias("back"), F.col("a_node_id").alias("from_node"), F.col("b_node_id").alias("to_node"), F.col("lanes").alias("n")),
        F.struct(F.lit(1).alias("back"), F.col("b_node_id").alias("from_node"), F.col("a_node_id").alias("to_node"), F.col("lanes_back").alias("n")),
    )
    edges = placed.select("way_id", "step", "speed_limit", "length", F.inline(F.filter(both, lambda x: (x.back == 0) | ~F.col("oneway"))))
    # edges of the ways before, then the place within the way: a way's edges are counted, so it may have any number of steps
    edges = kept(edges)
    counts = edges.groupBy("way_id").agg(F.count("*").alias("n_edges"))
    starts = running_total(counts, "way_id", "n_edges", "ends")
    within = F.row_number().over(Window.partitionBy("way_id").orderBy("step", "back"))
    numbered = edges.join(starts, "way_id").withColumn("edge_id", (F.col("ends") - F.col("n_edges") + within - 1).cast("long"))
    return (
        own.select("node_id", "osm_id", "lat", "lon"),
        numbered.select("edge_id", "from_node", "to_node", "length", F.col("n").cast("int").alias("lanes"), "speed_limit"),
    )


def continuations(edges: DataFrame) -> DataFrame:
    """(edge_id, next): the one edge that carries on from each, null at a junction.

    An edge carries on where, turning back aside, a single edge leaves its end and no other comes in there.
    """
    e = edges.select("edge_id", "from_node", "to_node")
    # all that an edge must know meets at its end, so nothing is joined: what Spark might take for small and broadcast
    side = lambda at, far, out: F.struct(F.col(at).alias("at"), F.col("edge_id"), F.col(far).alias("far"), F.lit(out).alias("out"))
    both = e.select(F.inline(F.array(side("to_node", "from_node", False), side("from_node", "to_node", True))))
    of = lambda out: F.collect_list(F.when(F.col("out") == out, F.struct("edge_id", "far")))
    met = both.groupBy("at").agg(of(False).alias("ins"), of(True).alias("outs")).select("at", "ins", "outs", F.inline("ins"))
    met = met.withColumn("onward", F.filter("outs", lambda f: f.far != F.col("far"))).withColumn("f", F.try_element_at("onward", F.lit(1)))
    merging = F.filter("ins", lambda g: (g.edge_id != F.col("edge_id")) & (g.far != F.col("f.far")))
    return met.select("edge_id", F.when(F.col("at").isNotNull() & (F.size("onward") == 1) & (F.size(merging) == 0), F.col("f.edge_id")).alias("next"))


def links(edges: DataFrame) -> DataFrame:
    """(edge_id, link_id, pos): the chain of edges between junctions each lies on, named by its first edge.

    A chain that bites its own tail begins at its smallest edge: it is cut open there and looked back over once more.
    """
    ahead = kept(continuations(edges))
    behind = ahead.where("next IS NOT NULL").groupBy(F.col("next").alias("edge_id")).agg(F.min("edge_id").alias("prev"))
    back = kept(ahead.select("edge_id").join(behind, "edge_id", "left").withColumnRenamed("edge_id", "item"))
    heads = back.where("prev IS NULL").select(F.col("item").alias("to"))
    placed = lambda state: state.select(F.col("item").alias("edge_id"), F.col("to").alias("link_id"), F.col("steps").alias("pos"))
    state = looked_back(back)
    chained = placed(state.join(heads, "to", "left_semi"))
    loops = kept(state.join(heads, "to", "left_anti").select("item", "least"))
    if not loops.limit(1).count():
        return chained
    cut = back.join(loops, "item").select("item", F.when(F.col("item") != F.col("least"), F.col("prev")).alias("prev"))
    return chained.unionByName(placed(looked_back(cut)))


def link_storage(links_: DataFrame, edges: DataFrame) -> DataFrame:
    """(link_id, n_edges, storage): cars that a link holds, by its lanes' length."""
    joined = links_.join(edges.select("edge_id", "lanes", "length"), "edge_id")
    return joined.groupBy("link_id").agg(F.count("*").alias("n_edges"), (F.sum(F.col("lanes") * F.col("length")) / roads.CAR_M).alias("storage"))


def effective_weights(edges: DataFrame, overrides: DataFrame) -> DataFrame:
    """``edges`` with weight_s: the override (edge_id, weight) where there is one, else free flow."""
    return edges.join(overrides, "edge_id", "left").withColumn("weight_s", F.coalesce("weight", "base_weight_s")).drop("weight")


def largest_component(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the largest strongly connected component; of equal ones that with the smallest node."""
    parts = kept(strong_components(nodes, edges))
    sizes = parts.groupBy("component").agg(F.count("*").alias("n"), F.min("node_id").alias("first"))
    best = sizes.orderBy(F.desc("n"), "first").limit(1).select("component")
    own = parts.join(F.broadcast(best), "component", "left_semi").select("node_id")  # one row
    ends = lambda c: own.withColumnRenamed("node_id", c)
    return nodes.join(own, "node_id", "left_semi"), edges.join(ends("from_node"), "from_node", "left_semi").join(ends("to_node"), "to_node", "left_semi")


def unroutable(pairs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The distinct pairs (from_node, to_node) without any way between them.

    Nodes of one strong component reach each other. For other pairs it is looked up which components the first node's component
    reaches, over the far smaller graph of components.
    """
    parts = kept(strong_components(nodes, edges))
    of = lambda c, name: parts.select(F.col("node_id").alias(c), F.col("component").alias(name))
    asked = pairs.select("from_node", "to_node").where("from_node != to_node").distinct()
    placed = asked.join(of("from_node", "a"), "from_node", "left").join(of("to_node", "b"), "to_node", "left")
    apart = kept(placed.where("NOT coalesce(a = b, false)"))
    between = edges.join(of("from_node", "a"), "from_node").join(of("to_node", "b"), "to_node").where("a != b").select("a", "b").distinct()
    steps = between.select(F.col("a").alias("from_node"), F.col("b").alias("to_node"), F.lit(1.0).alias("step"), F.lit(0).cast("long").alias("edge_id"))
    steps = kept(steps)
    # only where something leads out of the one and into the other is there a way to look for
    asked = apart.select(F.col("a").alias("from_node"), F.col("b").alias("to_node"))
    for end in ("from_node", "to_node"):
        asked = asked.join(steps.select(end), end, "left_semi")
    found = costs(steps, asked, "step")
    ways = found.where("cost IS NOT NULL").select(F.col("from_node").alias("a"), F.col("to_node").alias("b"))
    return apart.join(ways, ["a", "b"], "left_anti").select("from_node", "to_node")


def route_edges(found: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source, target, pos, edge_id): the edges of each routed pair (source, target), the last one first (pos 0).

    Tables of steps of 1, 2, 4, ... edges back are made by doubling. From the longest step down each halves the distance between
    the places found so far, so a way of n edges takes about 2 log n joins.
    """
    ends = edges.select(F.col("edge_id").alias("via"), F.col("from_node").alias("before"))
    asked = found.join(pairs.select("source").distinct(), "source", "left_semi")
    last = kept(asked.join(ends, "via").select("source", "node", "via", "before"))
    steps = [last.select("source", "node", F.col("before").alias("up"))]
    while True:
        onward = steps[-1].select("source", F.col("node").alias("up"), F.col("up").alias("up2"))
        longer = kept(steps[-1].join(onward, ["source", "up"]).select("source", "node", F.col("up2").alias("up")))
        if not longer.limit(1).count():
            break
        steps.append(longer)
    places = pairs.select("source", "target").distinct().select("*", F.col("target").alias("node"), F.lit(0).cast("long").alias("pos"))
    for k in reversed(range(len(steps))):
        back = places.join(steps[k], ["source", "node"]).select("source", "target", F.col("up").alias("node"), (F.col("pos") + (1 << k)).alias("pos"))
        places = kept(places.unionByName(back))
    return places.join(last, ["source", "node"]).select("source", "target", "pos", F.col("via").alias("edge_id"))


def congestion(links_: DataFrame, storage: DataFrame, cars: DataFrame, total_edges: int) -> DataFrame:
    """One row: total edges, edges of links over half full, mean and largest slowdown over the edges of occupied
    links, and the first edge of the slowest."""
    held = cars.join(links_.select("edge_id", "link_id"), "edge_id").groupBy("link_id").agg(F.sum("cars").alias("cars"))
    on = held.join(storage.where("storage > 0"), "link_id").withColumn("factor", roads.link_factor(F.col("cars"), F.col("storage")))
    heads = links_.where("pos = 0").select("link_id", F.col("edge_id").alias("head"))
    on = on.join(heads, "link_id")
    made = on.agg(
        F.coalesce(F.sum(F.when(F.col("cars") / F.col("storage") > 0.5, F.col("n_edges"))), F.lit(0)).alias("congested_edges"),
        F.coalesce(F.sum(F.col("factor") * F.col("n_edges")) / F.sum("n_edges"), F.lit(1.0)).alias("mean_factor"),
        F.coalesce(F.greatest(F.max("factor"), F.lit(1.0)), F.lit(1.0)).alias("max_factor"),
        F.max(F.when(F.col("factor") > 1, F.struct("factor", (-F.col("head")).alias("h")))).alias("worst"),
    )
    return made.select(
        F.lit(total_edges).cast("long").alias("total_edges"), "congested_edges", "mean_factor", "max_factor", F.coalesce(-F.col("worst.h"), F.lit(-1).cast("long")).alias("max_edge")
    )
