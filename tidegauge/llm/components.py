"""Connected components of a link table, by alternating large and small stars; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v): one row per node that has a link to another, with the smallest node it reaches.

    No neighbourhood is ever gathered: each round takes minima by key and joins them back, so a
    node with any number of links is split like any skewed join. Every round is staged.
    """
    now = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = None
    while True:
        # large star: larger neighbours of a node move to the least of its neighbourhood
        links = _both(now)
        least = links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        now = links.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours move to the least of them
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        now = now.join(least, "u").select(F.col("v").alias("a"), "u", "m")
        now = now.select(F.col("a").alias("u"), F.col("m").alias("v")).union(now.select("u", F.col("m").alias("v")))
        now = stage(now.where("u <> v").distinct(), "cc")
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (mark["n"], mark["h"]) == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = (mark["n"], mark["h"])
