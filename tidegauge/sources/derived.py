"""Daily series derived from the star schema: bars by order status, a rate by ship date, drivers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, date, open, high, low, close, px, n) of order totals, a series for each order status."""
    price = "o_totalprice"
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderstatus").alias("series_id"), F.to_date("o_orderdate").alias("date"))
        .agg(
            F.min_by(price, "o_orderkey").alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, "o_orderkey").alias("close"),
            F.avg(price).alias("px"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, fx): a daily rate from line items."""
    each = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg((F.avg(each) / 1000).alias("fx"))


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, observed): average urgent order, absent on most days."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return urgent.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("observed"))


BARS_SQL = """bars AS (
    SELECT o_orderstatus AS series_id, CAST(o_orderdate AS DATE) AS date, min_by(o_totalprice, o_orderkey) AS open,
           max(o_totalprice) AS high, min(o_totalprice) AS low, max_by(o_totalprice, o_orderkey) AS close,
           avg(o_totalprice) AS px, count(*) AS n
    FROM orders GROUP BY 1, 2)"""
RATE_SQL = "rate AS (SELECT CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice / l_quantity) / 1000 AS fx FROM lineitem GROUP BY 1)"
OBSERVED_SQL = """observed AS (
    SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS observed FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)"""
