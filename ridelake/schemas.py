"""Schemas of road graphs, trips, waits and the eight event payloads. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T
from pyspark.sql.types import StructType

_KINDS = {
    "LONG": T.LongType(), "INT": T.IntegerType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType(), "BOOLEAN": T.BooleanType(),
    "TIMESTAMP": T.TimestampType(),
}


def fields(text: str, *first: T.StructField) -> StructType:
    """A schema from a list of names and types; unlike the DDL parser it needs no session."""
    made = []
    for part in text.split(","):
        name, kind = part.split()
        made.append(T.StructField(name, _KINDS[kind]))
    return StructType([*first, *made])


NODES = fields("node_id LONG, lat DOUBLE, lon DOUBLE")
EDGES = fields("edge_id LONG, from_node LONG, to_node LONG, length DOUBLE, lanes INT, speed_limit DOUBLE")
TRIPS = fields(
    "ride_id LONG, scenario STRING, policy STRING, seed LONG, request_ts_unix_ms LONG, match_ts_unix_ms LONG, "
    "pickup_ts_unix_ms LONG, dropoff_ts_unix_ms LONG, pickup_node LONG, dropoff_node LONG, pickup_h3_r9 STRING, "
    "dropoff_h3_r9 STRING, surge_at_match DOUBLE, eta_predicted_s DOUBLE, eta_actual_s DOUBLE, wait_time_s DOUBLE, "
    "trip_duration_s DOUBLE"
)
WAITS = fields("demand DOUBLE, policy STRING, seed LONG, wait_seconds STRING, picked_up BOOLEAN")
#: What makes two trip rows the same trip.
TRIP_KEY = ["scenario", "policy", "seed", "ride_id", "request_ts_unix_ms", "dropoff_ts_unix_ms"]

META = T.StructField("meta", fields("event_id LONG, time TIMESTAMP, scenario STRING, policy STRING, seed LONG, partition_key STRING"))
_TIMES = "request_time TIMESTAMP, match_time TIMESTAMP, pickup_time TIMESTAMP, dropoff_time TIMESTAMP"
_PLACES = "pickup_node LONG, dropoff_node LONG, pickup_lat DOUBLE, pickup_lon DOUBLE, dropoff_lat DOUBLE, dropoff_lon DOUBLE"
#: Payload of each topic.
TOPICS = {
    topic: fields(text, META)
    for topic, text in {
        "trip.requested": "request_id LONG, pickup_node LONG, destination_node LONG",
        "trip.matched": "ride_id LONG, request_id LONG, driver_id LONG, pickup_node LONG, surge_at_match DOUBLE, eta_cost_seconds DOUBLE",
        "trip.picked_up": "ride_id LONG, driver_id LONG",
        "trip.completed": f"ride_id LONG, request_id LONG, driver_id LONG, {_TIMES}, {_PLACES}, surge_at_match DOUBLE, eta_predicted_s DOUBLE",
        "trip.abandoned": "request_id LONG, pickup_node LONG, waited_s DOUBLE",
        "trip.cancelled": "ride_id LONG, request_id LONG, driver_id LONG",
        "driver.location": "driver_id LONG, lat DOUBLE, lon DOUBLE, state STRING",
        "surge.updated": "h3_cell STRING, multiplier DOUBLE",
    }.items()
}
