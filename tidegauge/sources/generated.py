"""A deterministic geometric walk on business days: the same numbers on any cluster."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.paths import MODULUS, lcg


def generated_walk(spark: SparkSession, start: dt.date, end: dt.date, seeds: list[int], anchor: float = 100.0, drift: float = 0.0, sigma: float = 0.01) -> DataFrame:
    """(series_id, date, close): a series for each seed; steps are sums of twelve uniforms less six."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date")).where(F.weekday("date") < 5)
    ids = F.explode(F.array(*[F.lit(s).cast("long") for s in seeds]))
    rows = days.withColumn("seed", ids).withColumn("day", F.unix_date("date").cast("long"))
    u = sum((lcg(F.col("day") * 97 + k, F.col("day") * 31 + k * k, F.col("seed") + k) / float(MODULUS) for k in range(12)), F.lit(0.0)) - 6.0
    w = Window.partitionBy("seed").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walk = F.sum(drift + sigma * u).over(w)
    return rows.select(F.concat(F.lit("walk"), F.col("seed")).alias("series_id"), "date", (anchor * F.exp(walk)).alias("close")).where(F.col("close") < math.inf)
