"""Travel times: a ridge regression on standardised features, fitted by two aggregates.

Only sums reach the driver: means and deviations, then the products of the standardised columns. The system to be
solved there has five rows whatever the table's size.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from math import pi

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelake.functions.geo import equirectangular
from ridelake.operators.ordered import dense_ids
from ridelake.operators.roads import routes
from ridelake.storage import kept

FEATURES = ["dist_m", "surge", "hour_sin", "hour_cos"]


def features(trips: DataFrame) -> DataFrame:
    """Features of rows with distance, surge and the match time in milliseconds (UTC hour); rows without a
    positive duration or with a missing or negative distance can't be trained on and go."""
    hour = F.floor(F.col("match_ts_unix_ms") / 3_600_000) % 24
    angle = hour * (2 * pi / 24)
    usable = trips.where((F.col("trip_duration_s") > 0) & (F.col("dist_m") >= 0) & F.col("surge").isNotNull())
    return usable.withColumn("hour_sin", F.sin(angle)).withColumn("hour_cos", F.cos(angle))


@dataclass(frozen=True)
class Model:
    feature_names: list[str]
    mean: list[float]
    std: list[float]
    weights: list[float]  # the first is the intercept
    train_n: int = 0
    train_rmse_s: float = 0.0
    train_r2: float = 0.0

    def __post_init__(self):
        d = len(self.feature_names)
        if len(self.weights) != d + 1 or len(self.mean) != d or len(self.std) != d:
            raise ValueError(f"{len(self.weights)} weights, {len(self.mean)} means and {len(self.std)} deviations for {d} features")

    def predict(self) -> Column:
        """The prediction as a column expression, never negative."""
        out = F.lit(self.weights[0])
        for name, m, s, w in zip(self.feature_names, self.mean, self.std, self.weights[1:], strict=True):
            if s != 0:
                out = out + F.lit(w) * (F.col(name) - F.lit(m)) / F.lit(s)
        return F.greatest(F.lit(0.0), out)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, names: list[str] = FEATURES) -> Model:
        model = cls(**json.loads(spark.read.text(path).first().value))
        if model.feature_names != names:
            raise ValueError(f"model features {model.feature_names}, want {names}")
        return model


def moments(df: DataFrame, names: list[str] = FEATURES) -> DataFrame:
    """One row: n, and mean and population deviation of each feature."""
    return df.agg(
        F.count("*").alias("n"),
        *[f(n).alias(f"{k}_{n}") for n in names for k, f in (("mean", F.avg), ("std", F.stddev_pop))],
    )


def fit(df: DataFrame, target: str = "trip_duration_s", names: list[str] = FEATURES, ridge: float = 1.0) -> Model:
    """Ridge weights on standardised features; the intercept is not held back. A feature that never varies
    gets deviation 1 and weight 0."""
    m = moments(df, names).first()
    if m.n < len(names) + 2:
        raise ValueError(f"need at least {len(names) + 2} rows to fit {len(names)} features, got {m.n}")
    mean, std = [m[f"mean_{n}"] for n in names], [m[f"std_{n}"] for n in names]
    constant = [s <= 1e-12 * max(1.0, abs(a)) for a, s in zip(mean, std, strict=True)]
    std = [1.0 if c else s for s, c in zip(std, constant, strict=True)]
    z = [F.lit(1.0)] + [(F.col(n) - a) / s for n, a, s in zip(names, mean, std, strict=True)]
    d = len(z)
    products = [F.sum(z[i] * z[j]).alias(f"a_{i}_{j}") for i in range(d) for j in range(i, d)]
    row = df.agg(*products, *[F.sum(z[i] * F.col(target)).alias(f"b_{i}") for i in range(d)]).first()
    a = np.array([[row[f"a_{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
    for i in range(1, d):
        a[i, i] += ridge + constant[i - 1]
    if np.linalg.matrix_rank(a, tol=1e-12) < d:
        raise ValueError("singular system")
    weights = np.linalg.solve(a, np.array([row[f"b_{i}"] for i in range(d)]))
    bare = Model(list(names), mean, std, weights.tolist(), int(m.n))
    q = quality(df, bare, target).first()
    return Model(bare.feature_names, bare.mean, bare.std, bare.weights, bare.train_n, q.rmse, q.r2)


def quality(df: DataFrame, model: Model, target: str = "trip_duration_s") -> DataFrame:
    """One row: n, rmse and r2 of the model's predictions."""
    error = F.col(target) - model.predict()
    sse, n = F.sum(error * error), F.count("*")
    sst = F.var_pop(target) * n
    return df.agg(n.alias("n"), F.sqrt(sse / n).alias("rmse"), F.when(sst > 0, 1 - sse / sst).otherwise(0.0).alias("r2"))


def routed_pairs(nodes: DataFrame, edges: DataFrame, n: int, seed: int, attempts: int = 20) -> DataFrame:
    """(attempt, from_node, to_node, dist_m, surge, hour, trip_duration_s): up to ``n`` training rows of random trips on a road graph.

    A pair's ends and its hour are drawn from the seed and the attempt's number. Pairs of one node, without a way, or without a
    duration are passed over, and further ones are drawn, ``n`` at a time, up to ``attempts`` times ``n``. The duration is that of the
    quickest way on empty streets (base_weight_s); the distance is straight.
    """
    spark = nodes.sparkSession
    own = kept(dense_ids(nodes.select("node_id", "lat", "lon"), "node_id", "place"))
    size = own.count()
    draw = lambda what, many: F.pmod(F.xxhash64(F.lit(seed), F.lit(what), "attempt"), F.lit(many))
    end = lambda side: own.select(*[F.col(c).alias(f"{side}_{c}") for c in own.columns])
    made, have = None, 0
    for i in range(attempts if size else 1):
        drawn = spark.range(i * n, (i + 1) * n).withColumnRenamed("id", "attempt").select(
            "attempt", draw("from", max(size, 1)).alias("from_place"), draw("to", max(size, 1)).alias("to_place"), draw("hour", 24).alias("hour")
        )
        pairs = kept(drawn.where("from_place != to_place").join(end("from"), "from_place").join(end("to"), "to_place"))
        found = routes(edges, pairs.select(F.col("from_node_id").alias("source")).distinct())
        cost = found.select(F.col("source").alias("from_node_id"), F.col("node").alias("to_node_id"), F.col("cost").alias("trip_duration_s"))
        rows = kept(
            pairs.join(cost, ["from_node_id", "to_node_id"]).where("trip_duration_s > 0").select(
                "attempt", F.col("from_node_id").alias("from_node"), F.col("to_node_id").alias("to_node"),
                equirectangular("from_lat", "from_lon", "to_lat", "to_lon").alias("dist_m"), F.lit(1.0).alias("surge"), "hour", "trip_duration_s",
            )
        )
        made, have = rows if made is None else made.unionByName(rows), have + rows.count()
        if have >= n:
            break
    return made.orderBy("attempt").limit(n)
