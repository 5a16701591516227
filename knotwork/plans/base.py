"""Registering a query with its SQL twin, and the frames that several queries start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotwork.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated function under its name."""
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Canonical name in SQL; %s is the column.
CANON = """('"' || trim(trim(trim(upper(%s), '"'), ''''), ' ' || chr(9) || chr(10) || chr(13) || chr(160)) || '"')"""


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as tokens of a sequence: reward, value, mask and log-probabilities from the line's numbers."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("row_id"), (F.row_number().over(w) - 1).alias("t"), F.col("l_discount").alias("reward"), F.col("l_tax").alias("value"),
        F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("mask"), (-F.col("l_quantity") / 50).alias("logp"), (-F.col("l_quantity") / 60 - F.col("l_tax")).alias("ref_logp"),
        (-F.col("l_quantity") / 50 + F.col("l_discount") - 0.05).alias("old_logp"), (F.col("l_discount") - F.col("l_tax")).alias("advantage"), F.lit(0.05).alias("baseline"),
        (F.col("l_tax") * 10).alias("value_new"), (F.col("l_discount") * 10).alias("ret"), F.col("l_discount").alias("score"),
    )


TOKENS = """tok AS (SELECT l_orderkey AS row_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INTEGER) AS t,
  l_discount AS reward, l_tax AS value, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS mask, -l_quantity / 50 AS logp, -l_quantity / 60 - l_tax AS ref_logp,
  -l_quantity / 50 + l_discount - 0.05 AS old_logp, l_discount - l_tax AS advantage, 0.05 AS baseline, l_tax * 10 AS value_new, l_discount * 10 AS ret, l_discount AS score FROM lineitem)"""


def sequences(spark: SparkSession, d: str) -> DataFrame:
    """Line numbers of an order as a token sequence, and 1 for each as its mask."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))).alias("x"))
    return lines.select("row_id", F.transform("x", lambda y: y["l_linenumber"]).alias("tokens"), F.transform("x", lambda y: F.when(y["l_returnflag"] == "R", 0).otherwise(1)).alias("mask"))


SEQUENCES = """seq AS (SELECT l_orderkey AS row_id, list(l_linenumber ORDER BY l_linenumber, l_partkey, l_suppkey) AS tokens,
  list(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END ORDER BY l_linenumber, l_partkey, l_suppkey) AS mask FROM lineitem GROUP BY 1)"""


def batch(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a batch: ``row_id`` from 0, key and price."""
    from knotwork.operators.records import numbered

    return numbered(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", name="row_id")


BATCH = "b AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, o_orderkey, o_totalprice FROM orders)"


def params(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as parameters: label is the client, the vector's group the parameter."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("idx", "val"))
    return e.groupBy(F.concat(F.lit("client_"), F.col("label").cast("string")).alias("client_id"), F.concat(F.lit("p"), F.pmod("vec_id", F.lit(4)).cast("string")).alias("param"), "idx").agg(
        F.round(F.sum(F.col("val").cast("double")), 4).alias("val"), F.max("vec_id").alias("num_samples")
    )


PARAMS = """par AS (SELECT 'client_' || label AS client_id, 'p' || (vec_id % 4) AS param, CAST(i - 1 AS INTEGER) AS idx, round(sum(CAST(embedding[i] AS DOUBLE)), 4) AS val, max(vec_id) AS num_samples
  FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i) GROUP BY 1, 2, 3)"""
