"""Queries on event streams and on stored trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridelake import tables
from ridelake.functions import stats
from ridelake.functions.exact import r3
from ridelake.operators.ordered import dense_ids
from ridelake.plans.reports import r
from ridelake.schemas import TRIP_KEY, fields
from ridelake.sources import traces
from ridelake.storage import shared_dir
from ridelake.streaming import live, log, sinks, topics
from ridelake.tables import with_tables

SQL: dict[str, str] = {}

#: A field of the events' JSON.
FIELD, PROPS = "k", "k LONG"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = tables.read(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def stream_trip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type, counted by a streaming query over what is there."""
    counted = _stream(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"))
    path = shared_dir(spark)
    return sinks.snapshot(counted, f"{path}/out", f"{path}/checkpoint")


SQL["stream_trip_counts"] = "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"


#: A moment within the events, from which they are replayed.
SINCE = "2024-01-15T12:00:00+00:00"


def replay_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events put into a log, keyed by user, and read again from a moment on: each with its place among the user's replayed events."""
    path = shared_dir(spark)
    events = tables.read(spark, sf_dir, "events").select("event_id", "user_id", F.timestamp_millis(tables.epoch_ms("ts")).alias("at"))
    made = topics.records(events, topics.partition_key("user", "user_id"), F.col("at"))
    log.append(made, path)
    found = log.replay(spark, path, SINCE)
    event = F.get_json_object("value", "$.event_id").cast("long")
    place = F.row_number().over(Window.partitionBy("key").orderBy("offset"))
    return found.select(event.alias("event_id"), "key", F.unix_millis("timestamp").alias("ts_ms"), place.cast("long").alias("place"))


SQL["replay_since"] = f"""SELECT event_id, 'user:' || user_id AS key, epoch_us(ts) // 1000 AS ts_ms,
    row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS place
    FROM events WHERE epoch_us(ts) // 1000 >= epoch_ms(TIMESTAMPTZ '{SINCE}')"""


def decode_props_dlq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose JSON can be read, with a field of it; the others as dead letters. Every seventh payload is cut short."""
    cut = F.when(F.col("event_id") % 7 == 0, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    rows = tables.read(spark, sf_dir, "events").select("event_id", cut.alias("value"))
    good, dead = topics.decode(rows, fields(PROPS))
    return good.select("event_id", F.lit("decoded").alias("went_to"), F.col(FIELD).cast("string").alias("field")).unionByName(
        dead.select("event_id", F.lit(f"{topics.DEAD}events").alias("went_to"), F.lit(None).cast("string").alias("field"))
    )


SQL["decode_props_dlq"] = f"""SELECT event_id, CASE WHEN ok THEN 'decoded' ELSE 'dead.events' END AS went_to,
    CASE WHEN ok THEN json_extract_string(v, '$.{FIELD}') END AS field
    FROM (SELECT event_id, v, json_valid(v) AS ok FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN substr(props, 1, length(props) - 1) ELSE props END AS v FROM events))"""


def scan_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips written as partitioned Parquet and scanned; the filter reads the folders of one policy."""
    path = shared_dir(spark)
    traces.write(tables.trips(spark, sf_dir), path)
    t = traces.scan(spark, path).where(F.col("policy") == "batch")
    return t.groupBy("scenario", "policy").agg(F.count("*").alias("n"), r3(stats.mean("wait_time_s", 3)).alias("avg_wait_s"))


SQL["scan_trips"] = with_tables(
    f"SELECT scenario, policy, count(*) AS n, {r('avg(wait_time_s)')} AS avg_wait_s FROM trips WHERE policy = 'batch' GROUP BY ALL", "trips"
)


def dedup_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips delivered twice are kept once. The same ride of another run is another trip."""
    t = tables.trips(spark, sf_dir)
    return t.unionByName(t.where(F.col("seed") > 5)).dropDuplicates(TRIP_KEY).select(*TRIP_KEY)


SQL["dedup_trips"] = with_tables(
    f"SELECT DISTINCT {', '.join(TRIP_KEY)} FROM (SELECT * FROM trips UNION ALL SELECT * FROM trips WHERE seed > 5)", "trips"
)


def sink_anti_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second batch adds to stored trips: the first held one policy, the second holds all."""
    path, t = shared_dir(spark), tables.trips(spark, sf_dir)
    sinks.append_new(t.where(F.col("policy") == "greedy"), path, 0)
    sinks.append_new(t, path, 1)
    return spark.read.parquet(f"{path}/batch=1").select(*TRIP_KEY)


SQL["sink_anti_dedup"] = with_tables(f"SELECT {', '.join(TRIP_KEY)} FROM trips WHERE policy <> 'greedy'", "trips")


def live_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.counters(tables.trip_events(spark, sf_dir), ["scenario", "policy"])


SQL["live_counters"] = with_tables(
    """+ c AS (SELECT scenario, policy, count(*) FILTER (topic = 'trip.requested') AS requested, count(*) FILTER (topic = 'trip.matched') AS matched,
      count(*) FILTER (topic = 'trip.picked_up') AS picked_up, count(*) FILTER (topic = 'trip.completed') AS completed,
      count(*) FILTER (topic = 'trip.cancelled') AS cancelled, count(*) FILTER (topic = 'trip.abandoned') AS abandoned FROM trip_events GROUP BY ALL)
    SELECT *, requested - matched + cancelled - abandoned AS pending, matched - cancelled - completed AS active FROM c""",
    "trip_events",
)


def match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches by policy and minute, which are cut towards 1970: the minute 0 has the matches of both sides."""
    e = tables.trip_events(spark, sf_dir).where(F.col("topic") == "trip.matched")
    return e.groupBy("policy", F.expr("ts_ms div 60000 * 60000").alias("minute_ms")).agg(F.count("*").alias("matches"))


SQL["match_rate"] = with_tables(
    "SELECT policy, (ts_ms // 60000) * 60000 AS minute_ms, count(*) AS matches FROM trip_events WHERE topic = 'trip.matched' GROUP BY ALL", "trip_events"
)


def event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events numbered from 1 within their run, in the order of the log."""
    e = tables.trip_events(spark, sf_dir).select("event_id", "scenario", "policy")
    return dense_ids(e, "event_id", "number", ("scenario", "policy")).withColumn("number", F.col("number") + 1)


SQL["event_ids"] = with_tables(
    "SELECT event_id, scenario, policy, row_number() OVER (PARTITION BY scenario, policy ORDER BY event_id) AS number FROM trip_events", "trip_events"
)


def trip_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and the first match of the same rider within a day, by policy of the request."""
    e = tables.trip_events(spark, sf_dir)
    asked = e.where(F.col("topic") == "trip.requested").select(F.col("rider_id").alias("request_id"), "event_id", "policy", F.col("ts").alias("requested_at"))
    matched = e.where(F.col("topic") == "trip.matched").select(F.col("rider_id").alias("request_id"), F.col("ts").alias("matched_at"))
    joined = live.funnel(asked, matched, "24 hours").groupBy("event_id", "policy").agg(F.min("matched_at").alias("first"))
    return joined.groupBy("policy").agg(F.count("*").alias("matched"))


SQL["trip_funnel"] = with_tables(
    """SELECT policy, count(*) AS matched FROM trip_events a WHERE topic = 'trip.requested' AND EXISTS (SELECT 1 FROM trip_events b
    WHERE b.topic = 'trip.matched' AND b.rider_id = a.rider_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 24 HOUR) GROUP BY policy""",
    "trip_events",
)

QUERIES = [
    replay_since, stream_trip_counts, decode_props_dlq, scan_trips, dedup_trips, sink_anti_dedup, live_counters, match_rate, event_ids, trip_funnel,
]
