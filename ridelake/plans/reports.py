"""Reports on trips and experiments: summaries, histograms, paired comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridelake import tables
from ridelake.functions import histograms, rates, stats
from ridelake.functions.exact import r3, total
from ridelake.operators.ordered import FEW, percentiles, running_total
from ridelake.storage import counted
from ridelake.tables import with_tables

R = "floor({} * 1000 + 0.5) / 1000"
SQL: dict[str, str] = {}
#: Times of trips are in seconds with as many decimals.
MS = 3


def r(x: str) -> str:
    return f"floor(({x}) * 1000 + 0.5) / 1000"


def readme_wait_by_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stats.summary(tables.trips(spark, sf_dir), ["policy"], "wait_time_s", MS)
    return t.select("policy", F.col("n").alias("trips"), r3("mean").alias("avg_wait_s"), r3("p50").alias("p50_wait_s"), r3("p95").alias("p95_wait_s"))


SQL["readme_wait_by_policy"] = with_tables(
    f"""SELECT policy, count(*) AS trips, {r('avg(wait_time_s)')} AS avg_wait_s, {r('quantile_cont(wait_time_s, 0.5)')} AS p50_wait_s,
    {r('quantile_cont(wait_time_s, 0.95)')} AS p95_wait_s FROM trips GROUP BY policy""",
    "trips",
)


def wait_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stats.summary(tables.trips(spark, sf_dir), ["scenario", "policy"], "wait_time_s", MS)
    return t.select("scenario", "policy", "n", r3("mean").alias("mean_s"), r3("p50").alias("p50_s"), r3("p95").alias("p95_s"))


SQL["wait_summary"] = with_tables(
    f"""SELECT scenario, policy, count(*) AS n, {r('avg(wait_time_s)')} AS mean_s, {r('quantile_cont(wait_time_s, 0.5)')} AS p50_s,
    {r('quantile_cont(wait_time_s, 0.95)')} AS p95_s FROM trips GROUP BY ALL""",
    "trips",
)


def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each run: waits, durations, and trips per hour between the first request and the last dropoff."""
    rides, run = tables.trips(spark, sf_dir), ["scenario", "policy", "seed"]
    also = {
        "n": (F.count("*"), F.sum("n")),
        "waited": (total("wait_time_s", MS), F.sum("waited")),
        "rode": (total("trip_duration_s", MS), F.sum("rode")),
        "until": (F.max("dropoff_ts_unix_ms"), F.max("until")),
        "since": (F.min("request_ts_unix_ms"), F.min("since")),
    }
    t = percentiles(rides, run, "wait_time_s", {"p50": 0.5, "p95": 0.95}, also)
    mean = lambda c: F.col(c).cast("double") / F.col("n")
    t = t.select("*", mean("waited").alias("avg_wait"), mean("rode").alias("avg_duration"), (F.col("until") - F.col("since")).alias("span"))
    per_hour = F.when(F.col("span") > 0, F.col("n") / (F.col("span") / 3_600_000)).otherwise(0.0)
    return t.select(
        "scenario", "policy", "seed", "n", r3("avg_wait").alias("avg_wait_s"), r3("p50").alias("p50_wait_s"), r3("p95").alias("p95_wait_s"),
        r3("avg_duration").alias("avg_duration_s"), r3(per_hour).alias("trips_per_hour"),
    )


SQL["metrics_summary"] = with_tables(
    f"""SELECT scenario, policy, seed, count(*) AS n, {r('avg(wait_time_s)')} AS avg_wait_s, {r('quantile_cont(wait_time_s, 0.5)')} AS p50_wait_s,
    {r('quantile_cont(wait_time_s, 0.95)')} AS p95_wait_s, {r('avg(trip_duration_s)')} AS avg_duration_s,
    CASE WHEN max(dropoff_ts_unix_ms) > min(request_ts_unix_ms)
         THEN {r('count(*) / ((max(dropoff_ts_unix_ms) - min(request_ts_unix_ms))::DOUBLE / 3600000)')} ELSE 0 END AS trips_per_hour
    FROM trips GROUP BY scenario, policy, seed""",
    "trips",
)


def _hist(value: str, bounds: list[int]):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = tables.trips(spark, sf_dir).withColumn("scenario", histograms.label("scenario")).withColumn("policy", histograms.label("policy"))
        made = histograms.buckets(t, ["scenario", "policy"], value, bounds)
        return made.select("scenario", "policy", F.when(F.col("le") == float("inf"), -1.0).otherwise(F.col("le")).alias("le"), "count", r3("sum").alias("sum"), "n")

    values = ", ".join(f"({b}::DOUBLE)" for b in bounds)
    sql = with_tables(
        f"""SELECT scenario, policy, le, sum(CASE WHEN le < 0 OR {value} <= le THEN 1 ELSE 0 END)::BIGINT AS count,
        {r(f'sum({value}::DECIMAL(18, 3))::DOUBLE')} AS sum, count(*) AS n
        FROM trips CROSS JOIN (VALUES {values}, (-1::DOUBLE)) b(le) GROUP BY ALL""",
        "trips",
    )
    return query, sql


hist_wait, SQL["hist_wait"] = _hist("wait_time_s", histograms.WAIT)
hist_duration, SQL["hist_duration"] = _hist("trip_duration_s", histograms.DURATION)


def hist_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """95th percentile of waits by policy and five-minute window, read from the buckets."""
    t = tables.trips(spark, sf_dir).withColumn("window_ms", F.floor(F.col("pickup_ts_unix_ms") / 300_000) * 300_000)
    made = histograms.buckets(t, ["policy", "window_ms"], "wait_time_s", histograms.WAIT)
    found = histograms.quantile(made, ["policy", "window_ms"], 0.95)
    return found.select("policy", "window_ms", r3("quantile").alias("p95_s"))


SQL["hist_quantile"] = with_tables(
    f"""+ b AS (SELECT policy, (pickup_ts_unix_ms // 300000) * 300000 AS window_ms, le, sum(CASE WHEN wait_time_s <= le THEN 1 ELSE 0 END)::DOUBLE AS c
        FROM trips CROSS JOIN (VALUES {', '.join(f'({x}::DOUBLE)' for x in histograms.WAIT)}, ('inf'::DOUBLE)) v(le) GROUP BY ALL),
      l AS (SELECT *, lag(le, 1, 0) OVER w AS lo, lag(c, 1, 0) OVER w AS below, 0.95::DOUBLE * max(c) OVER (PARTITION BY policy, window_ms) AS rank
        FROM b WINDOW w AS (PARTITION BY policy, window_ms ORDER BY le)),
      h AS (SELECT * FROM l WHERE c >= rank AND c > 0 QUALIFY row_number() OVER (PARTITION BY policy, window_ms ORDER BY le) = 1)
    SELECT policy, window_ms, CASE WHEN isinf(le) THEN {r('lo')} ELSE {r('lo + (le - lo) * (rank - below) / (c - below)')} END AS p95_s FROM h""",
    "trips",
)


#: Counters of waits are noted every 15 seconds in which they moved, and begin again every 17 minutes.
SCRAPE_MS, LIFE_MS = 15_000, 1_020_000
RATE_MS, STEP_MS = 120_000, 60_000


def rate_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """95th percentile of waits by policy and minute, from the rates of cumulative bucket counters of every scenario over two minutes."""
    t = tables.trips(spark, sf_dir).withColumn("ts_ms", (F.ceil(F.col("pickup_ts_unix_ms") / SCRAPE_MS) * SCRAPE_MS).cast("long"))
    moved = histograms.buckets(t, ["scenario", "policy", "ts_ms"], "wait_time_s", histograms.WAIT)
    life = Window.partitionBy("scenario", "policy", "le", F.floor(F.col("ts_ms") / LIFE_MS)).orderBy("ts_ms")  # 68 notes at most
    counters = moved.select("scenario", "policy", "le", "ts_ms", F.sum("count").over(life).alias("value"))
    made = rates.rates(counters, ["scenario", "policy", "le"], window_ms=RATE_MS, step_ms=STEP_MS)
    found = histograms.quantile(rates.summed(made, ["policy", "t_ms"]), ["policy", "t_ms"], 0.95)
    return found.select("policy", "t_ms", r3("quantile").alias("p95_s"))


SQL["rate_quantile"] = with_tables(
    f"""+ v AS (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in histograms.WAIT)}, 'inf'::DOUBLE]) AS le),
      moved AS (SELECT scenario, policy, le, ceil(pickup_ts_unix_ms / {SCRAPE_MS})::BIGINT * {SCRAPE_MS} AS ts_ms, count(*) FILTER (wait_time_s <= le) AS c
        FROM trips CROSS JOIN v GROUP BY ALL),
      counters AS (SELECT scenario, policy, le, ts_ms, (sum(c) OVER (PARTITION BY scenario, policy, le, ts_ms // {LIFE_MS} ORDER BY ts_ms))::DOUBLE AS v FROM moved),
      spread AS (SELECT *, unnest(range(ceil(ts_ms / {STEP_MS})::BIGINT * {STEP_MS}, ts_ms + {RATE_MS}, {STEP_MS})) AS t_ms FROM counters),
      lagged AS (SELECT *, lag(v) OVER (PARTITION BY scenario, policy, le, t_ms ORDER BY ts_ms) AS p FROM spread),
      met AS (SELECT scenario, policy, le, t_ms, count(*) AS n, min(ts_ms) AS a, max(ts_ms) AS b, arg_min(v, ts_ms) AS began,
        sum(CASE WHEN p IS NULL THEN 0 WHEN v < p THEN v ELSE v - p END) AS grown FROM lagged GROUP BY ALL HAVING count(*) > 1),
      gaps AS (SELECT *, (b - a)::DOUBLE AS len, (b - a)::DOUBLE / (n - 1) AS usual, (a - (t_ms - {RATE_MS}))::DOUBLE AS lead, (t_ms - b)::DOUBLE AS tail FROM met),
      ends AS (SELECT *, CASE WHEN lead >= usual * 1.1::DOUBLE THEN usual / 2 ELSE lead END AS l, CASE WHEN tail >= usual * 1.1::DOUBLE THEN usual / 2 ELSE tail END AS r FROM gaps),
      rates AS (SELECT policy, t_ms, le, grown * ((len + CASE WHEN grown > 0 AND len * began / grown < l THEN len * began / grown ELSE l END + r) / len) / {RATE_MS / 1000}::DOUBLE AS rate FROM ends),
      total AS (SELECT policy, t_ms, le, round(sum(rate), 9) AS c FROM rates GROUP BY ALL),
      rising AS (SELECT policy, t_ms, le, max(c) OVER (PARTITION BY policy, t_ms ORDER BY le) AS c FROM total),
      l AS (SELECT *, lag(le, 1, 0) OVER w AS lo, lag(c, 1, 0) OVER w AS below, 0.95::DOUBLE * max(c) OVER (PARTITION BY policy, t_ms) AS rank
        FROM rising WINDOW w AS (PARTITION BY policy, t_ms ORDER BY le)),
      h AS (SELECT * FROM l WHERE c >= rank AND c > 0 QUALIFY row_number() OVER (PARTITION BY policy, t_ms ORDER BY le) = 1)
    SELECT policy, t_ms, CASE WHEN isinf(le) THEN {r('lo')} ELSE {r('lo + (le - lo) * (rank - below) / (c - below)')} END AS p95_s FROM h""",
    "trips",
)


def wait_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of trips with at most each wait, by policy. Equal waits are summed up first; ranges of waits share the work."""
    t, seen = counted(tables.trips(spark, sf_dir).groupBy("policy", "wait_time_s").agg(F.count("*").alias("c")), n=F.count("*"))
    if seen["n"] <= FEW:
        own = Window.partitionBy("policy")
        upto = t.select("*", F.sum("c").over(own.orderBy("wait_time_s")).alias("upto"), F.sum("c").over(own).alias("whole"))
    else:
        upto = running_total(t, "wait_time_s", "c", "upto", by=("policy",)).join(t.groupBy("policy").agg(F.sum("c").alias("whole")), "policy")
    return upto.select("policy", "wait_time_s", r3(F.col("upto") / F.col("whole")).alias("cdf"))


SQL["wait_cdf"] = with_tables(
    f"""SELECT DISTINCT policy, wait_time_s, {r('cume_dist() OVER (PARTITION BY policy ORDER BY wait_time_s)')} AS cdf FROM trips""", "trips"
)


def waits_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the waits file."""
    w = tables.waits(spark, sf_dir)
    return w.select("demand", "policy", "seed", F.format_string("%.4f", "wait_seconds").alias("wait_seconds"), "picked_up")


SQL["waits_export"] = with_tables("SELECT demand, policy, seed, printf('%.4f', wait_seconds) AS wait_seconds, picked_up FROM waits", "waits")


def policy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By demand and policy: riders, picked up in number and percent, and their pooled waits."""
    w = tables.waits(spark, sf_dir)
    also = {
        "requested": (F.count("*"), F.sum("requested")),
        "up": (F.sum(F.col("picked_up").cast("long")), F.sum("up")),
        "total": (total("wait_seconds", MS), F.sum("total")),
    }
    t = percentiles(w, ["demand", "policy"], "wait_seconds", {"p50": 0.5, "p95": 0.95}, also)
    t = t.select("*", F.col("up").alias("picked_up"), (F.col("total").cast("double") / F.col("requested")).alias("mean"))
    share = F.when(F.col("requested") == 0, 0.0).otherwise(100 * F.col("picked_up") / F.col("requested"))
    return t.select(
        "demand", "policy", "requested", "picked_up", r3(share).alias("picked_up_percent"), r3("mean").alias("mean_s"),
        r3("p50").alias("p50_s"), r3("p95").alias("p95_s"),
    )


SQL["policy_table"] = with_tables(
    f"""SELECT demand, policy, count(*) AS requested, count(*) FILTER (picked_up) AS picked_up,
    {r('100 * (count(*) FILTER (picked_up)) / count(*)::DOUBLE')} AS picked_up_percent, {r('avg(wait_seconds)')} AS mean_s,
    {r('quantile_cont(wait_seconds, 0.5)')} AS p50_s, {r('quantile_cont(wait_seconds, 0.95)')} AS p95_s FROM waits GROUP BY demand, policy""",
    "waits",
)


def arrivals_per_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests per run and per three-second matching window of a one-hour run, from the first policy."""
    w = tables.waits(spark, sf_dir).where(F.col("policy") == "greedy")
    t = w.groupBy("demand", "seed").count().groupBy("demand").agg(F.avg("count").alias("per_run"))
    return t.select("demand", r3("per_run").alias("per_run"), r3(F.col("per_run") / 3600 * 3).alias("per_window"))


SQL["arrivals_per_window"] = with_tables(
    f"""SELECT demand, {r('avg(c)')} AS per_run, {r('avg(c) / 3600 * 3')} AS per_window
    FROM (SELECT demand, seed, count(*) AS c FROM waits WHERE policy = 'greedy' GROUP BY ALL) GROUP BY demand""",
    "waits",
)


def reposition_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves made empty and their share of all driving; a ping's value stands for the metres driven."""
    p = tables.pings(spark, sf_dir).where(F.col("value").isNotNull())
    empty = F.col("state") == "repositioning"
    metres = F.col("value").cast("decimal(18,4)")
    t = p.groupBy((F.col("driver_id") % 3).alias("fleet")).agg(
        F.sum(empty.cast("long")).alias("moves"), F.sum(F.when(empty, metres)).cast("double").alias("empty"), F.sum(metres).cast("double").alias("driven")
    )
    share = F.when(F.col("driven") == 0, 0.0).otherwise(100 * F.col("empty") / F.col("driven"))
    return t.select("fleet", "moves", r3(F.col("empty") / 1000).alias("empty_km"), r3(share).alias("empty_percent"))


SQL["reposition_share"] = with_tables(
    f"""+ m AS (SELECT driver_id % 3 AS fleet, state = 'repositioning' AS empty, value::DECIMAL(18, 4) AS v FROM pings WHERE value IS NOT NULL),
      s AS (SELECT fleet, count(*) FILTER (empty) AS moves, (sum(v) FILTER (empty))::DOUBLE AS e, sum(v)::DOUBLE AS d FROM m GROUP BY fleet)
    SELECT fleet, moves, {r('e / 1000')} AS empty_km, {r('100 * e / d')} AS empty_percent FROM s""",
    "pings",
)

_PAIRS = """m AS (SELECT demand, seed, policy, avg(wait_seconds) AS w FROM waits GROUP BY ALL),
      d AS (SELECT b.demand, b.seed, a.policy, b.w AS base_wait, a.w AS alt_wait, a.w - b.w AS diff
            FROM m a JOIN m b ON a.demand = b.demand AND a.seed = b.seed AND a.policy <> 'greedy' AND b.policy = 'greedy')"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.paired_differences(tables.waits(spark, sf_dir), "greedy", ["demand", "seed"], MS)


def paired_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("demand", "seed", "policy", r3("base_wait").alias("base_wait_s"), r3("alt_wait").alias("alt_wait_s"), r3("diff").alias("diff_s"))


SQL["paired_diffs"] = with_tables(
    f"+ {_PAIRS} SELECT demand, seed, policy, {r('base_wait')} AS base_wait_s, {r('alt_wait')} AS alt_wait_s, {r('diff')} AS diff_s FROM d", "waits"
)


def t_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = stats.t_interval(_pairs(spark, sf_dir), ["demand", "policy"], "diff")
    return made.select("demand", "policy", "n", r3("mean").alias("mean_s"), r3("lo").alias("lo_s"), r3("hi").alias("hi_s"))


_T = f"CASE WHEN count(*) <= 31 THEN list_extract({stats.T975}, (count(*) - 1)::INT) ELSE {stats.Z975} + ({stats.Z975**3 + stats.Z975}) / (4 * (count(*) - 1)) + ({5 * stats.Z975**5 + 16 * stats.Z975**3 + 3 * stats.Z975}) / (96 * (count(*) - 1) * (count(*) - 1)) END"
_HALF = f"CASE WHEN count(*) < 2 THEN 0 ELSE ({_T})::DOUBLE * stddev_samp(diff) / sqrt(count(*)) END"
SQL["t_interval"] = with_tables(
    f"""+ {_PAIRS} SELECT demand, policy, count(*) AS n, {r('avg(diff)')} AS mean_s, {r(f'avg(diff) - {_HALF}')} AS lo_s, {r(f'avg(diff) + {_HALF}')} AS hi_s
    FROM d GROUP BY demand, policy""",
    "waits",
)


def sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _pairs(spark, sf_dir).groupBy("demand", "policy")
    d = d.agg(F.count(F.when(F.col("diff") < 0, 1)).alias("wins"), F.count(F.when(F.col("diff") != 0, 1)).alias("n"))
    return d.select("demand", "policy", "wins", "n", r3(stats.sign_test(F.col("wins"), F.col("n"))).alias("p"))


SQL["sign_test"] = with_tables(
    f"""+ {_PAIRS}, c AS (SELECT demand, policy, count(*) FILTER (diff < 0) AS wins, count(*) FILTER (diff <> 0) AS n FROM d GROUP BY ALL),
      k AS (SELECT *, greatest(wins, n - wins) AS k FROM c),
      s AS (SELECT demand, policy, wins, n, sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) - n * ln(2.0))) AS tail
            FROM k, unnest(range(k, n + 1)) u(i) GROUP BY ALL)
    SELECT demand, policy, wins, n, {r('least(1.0, 2 * tail)')} AS p FROM s
    UNION ALL SELECT demand, policy, wins, n, 1.0 FROM k WHERE n = 0""",
    "waits",
)


def lgamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ln of the factorial of every quantity on an order line."""
    q = tables.read(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("long").alias("n")).distinct()
    return q.select("n", r3(stats.log_factorial(F.col("n"))).alias("log_factorial"))


SQL["lgamma"] = f"SELECT DISTINCT l_quantity::BIGINT AS n, {r('lgamma(l_quantity::BIGINT + 1.0)')} AS log_factorial FROM lineitem"


def nice_ceil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of a chart's axis for each run's longest wait."""
    t = tables.trips(spark, sf_dir).groupBy("scenario", "policy", "seed").agg(F.max("wait_time_s").alias("longest"))
    return t.select("scenario", "policy", "seed", r3("longest").alias("longest_s"), stats.nice_ceil(F.col("longest")).alias("axis_s"))


_B = "pow(10.0, floor(log10(x)))"
SQL["nice_ceil"] = with_tables(
    f"""SELECT scenario, policy, seed, {r('x')} AS longest_s, CASE WHEN x <= 0 THEN 1.0 WHEN {_B} >= x THEN {_B} WHEN 2 * {_B} >= x THEN 2 * {_B}
      WHEN 5 * {_B} >= x THEN 5 * {_B} ELSE 10 * {_B} END AS axis_s
    FROM (SELECT scenario, policy, seed, max(wait_time_s) AS x FROM trips GROUP BY ALL)""",
    "trips",
)

#: Requests per second at moments of a run, between which the rate is linear.
SEGMENTS = [(0.0, 0.25), (900.0, 0.6), (2400.0, 0.35), (3600.0, 0.1)]


def scaled_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate segments of a scenario at every demand level, one row for each moment."""
    from ridelake.operators import demand

    levels = tables.waits(spark, sf_dir).select("demand").distinct()
    return demand.scaled(levels, "downtown", SEGMENTS).select("scenario", "demand", "t", r3("rate").alias("rate"))


_SEG = ", ".join(f"({t}::DOUBLE, {x}::DOUBLE)" for t, x in SEGMENTS)
SQL["scaled_rates"] = with_tables(
    f"""SELECT 'downtown_' || CASE WHEN demand = floor(demand) THEN demand::INT::VARCHAR ELSE demand::VARCHAR END || 'x' AS scenario, demand, t,
    {r('demand * rate')} AS rate FROM (SELECT DISTINCT demand FROM waits) CROSS JOIN (VALUES {_SEG}) s(t, rate)""",
    "waits",
)


def rate_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request rate at the moment of every request of the trips."""
    from ridelake.operators import demand

    t = tables.trips(spark, sf_dir)
    at = (F.col("request_ts_unix_ms") - 1_700_000_000_000) / 1000
    return t.select("ride_id", r3(demand.rate_at(at, SEGMENTS)).alias("rate"))


_CASES = " ".join(
    f"WHEN t < {t1} THEN {a}::DOUBLE + ({b}::DOUBLE - {a}::DOUBLE) * (t - {t0}::DOUBLE) / {t1 - t0}::DOUBLE"
    for (t0, a), (t1, b) in zip(SEGMENTS, SEGMENTS[1:], strict=False)
)
SQL["rate_at"] = with_tables(
    f"""SELECT ride_id, {r(f'CASE {_CASES} ELSE {SEGMENTS[-1][1]} END')} AS rate
    FROM (SELECT ride_id, (request_ts_unix_ms - 1700000000000)::DOUBLE / 1000 AS t FROM trips)""",
    "trips",
)

QUERIES = [
    readme_wait_by_policy, wait_summary, metrics_summary, hist_quantile, rate_quantile, wait_cdf, waits_export, policy_table, arrivals_per_window,
    reposition_share, paired_diffs, t_interval, sign_test, lgamma, nice_ceil, scaled_rates, rate_at,
]
NAMED = {"hist_wait": hist_wait, "hist_duration": hist_duration}
