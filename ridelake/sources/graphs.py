"""Road graphs from CSV files: a header, fixed columns, and an error for every malformed row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ridelake.operators.roads import validated
from ridelake.schemas import EDGES, NODES


def _scan(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def nodes(spark: SparkSession, path: str) -> DataFrame:
    return _scan(spark, path, NODES)


def edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges with positive length, speed and lanes; any other row ends the query."""
    return validated(_scan(spark, path, EDGES))


def graph(spark: SparkSession, nodes_path: str, edges_path: str) -> tuple[DataFrame, DataFrame]:
    return nodes(spark, nodes_path), edges(spark, edges_path)
