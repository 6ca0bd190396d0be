"""The driver's tables seen as bags, points, records, pairs, runs and atoms; each view in Spark expressions and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of bags: an order's lines, with a score that has ties, a target, an area and a validity."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("owner"), (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey") % 10000).alias("point"),
        ((F.col("l_partkey") * 7 + F.col("l_suppkey") * 3) % 101 / F.lit(100.0)).alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("target"),
        F.col("l_quantity").alias("area"), (F.col("l_linestatus") == "F").alias("valid"), F.col("l_returnflag").alias("region"), ((F.col("l_suppkey") * 11 + F.col("l_partkey")) % 103 / F.lit(102.0)).alias("q"),
    )


POINTS = """points AS (SELECT l_orderkey AS owner, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 10000 + l_suppkey % 10000 AS point, CAST((l_partkey * 7 + l_suppkey * 3) % 101 AS DOUBLE) / 100.0::DOUBLE AS p,
 CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS target, l_quantity AS area, l_linestatus = 'F' AS valid, l_returnflag AS region, CAST((l_suppkey * 11 + l_partkey) % 103 AS DOUBLE) / 102.0::DOUBLE AS q FROM lineitem)"""


def bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bags: orders with a target, a probability and strata."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("owner"), (F.col("o_orderstatus") == "F").cast("int").alias("target"), ((F.col("o_custkey") * 13 + F.col("o_orderkey")) % 101 / F.lit(100.0)).alias("p"),
        F.col("o_orderpriority").alias("phenotype"), F.col("o_totalprice").alias("size"), F.col("o_custkey").alias("family"), (F.col("o_orderkey") % 10).alias("slice"), ((F.col("o_orderkey") * 31) % 97 / F.lit(96.0)).alias("u"),
    )


BAGS = """bags AS (SELECT o_orderkey AS owner, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS target, CAST((o_custkey * 13 + o_orderkey) % 101 AS DOUBLE) / 100.0::DOUBLE AS p, o_orderpriority AS phenotype,
 o_totalprice AS size, o_custkey AS family, o_orderkey % 10 AS slice, CAST((o_orderkey * 31) % 97 AS DOUBLE) / 96.0::DOUBLE AS u FROM orders)"""


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions: the first three coordinates of an embedding, scaled, its next three as a normal; label names the owner."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("atom"), F.col("label").alias("owner"), *((F.round(e[i].cast("double") * 10, 4)).alias(c) for i, c in enumerate("xyz")), *(e[i + 3].cast("double").alias(c) for i, c in enumerate(("nx", "ny", "nz"))),
        (F.lit(0.2) + F.col("vec_id") % 5 * F.lit(0.05)).alias("radius"), ((F.col("vec_id") * 37) % 101 / F.lit(100.0)).alias("p"),
    )


ATOMS = """atoms AS (SELECT vec_id AS atom, label AS owner, round(CAST(embedding[1] AS DOUBLE) * 10, 4) AS x, round(CAST(embedding[2] AS DOUBLE) * 10, 4) AS y, round(CAST(embedding[3] AS DOUBLE) * 10, 4) AS z,
 CAST(embedding[4] AS DOUBLE) AS nx, CAST(embedding[5] AS DOUBLE) AS ny, CAST(embedding[6] AS DOUBLE) AS nz, 0.2::DOUBLE + CAST(vec_id % 5 AS DOUBLE) * 0.05::DOUBLE AS radius, CAST((vec_id * 37) % 101 AS DOUBLE) / 100.0::DOUBLE AS p FROM embeddings)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair scores: (query, target) of documents' numbers with identity, coverages in per cent and an e-value, from lines."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 400).alias("query"), (F.col("l_orderkey") % 400).alias("target"), ((F.col("l_suppkey") * 7) % 101).cast("double").alias("fident"), ((F.col("l_partkey") * 3) % 101).cast("double").alias("qcov"),
        ((F.col("l_orderkey") * 5) % 101).cast("double").alias("tcov"), (F.col("l_tax") / 10).alias("evalue"),
    )


PAIRS = """pairs AS (SELECT l_partkey % 400 AS query, l_orderkey % 400 AS target, CAST((l_suppkey * 7) % 101 AS DOUBLE) AS fident, CAST((l_partkey * 3) % 101 AS DOUBLE) AS qcov,
 CAST((l_orderkey * 5) % 101 AS DOUBLE) AS tcov, l_tax / 10 AS evalue FROM lineitem)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records: events of a user as attempts of runs, with a status, a trial, a seed and metrics."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("attempt"), (F.col("user_id") % 30).alias("trial"), (F.col("event_id") % 7).alias("seed"), F.col("event_type").alias("status"), F.col("value").alias("metric"),
        F.get_json_object("props", "$.k").cast("int").alias("k"), "ts",
    )


RUNS = """runs AS (SELECT user_id AS run, event_id AS attempt, user_id % 30 AS trial, event_id % 7 AS seed, event_type AS status, value AS metric, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, ts FROM events)"""
