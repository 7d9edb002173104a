"""Dated schedules and as-of joins.

A schedule is a step function: a row holds from its date until the next row's. Small schedules
(counted first) are broadcast as intervals; otherwise the as-of join is a union sorted within
each key, one shuffle on the key and no blow-up, whatever the sizes. Without a key the months take
its place: each begins with the entry carried over from the months before. Of entries with one
start the one that is last as text holds; overlapping gaps are one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ScheduleError

SMALL = 10_000  # rows of a schedule that may be broadcast


def schedule(spark: SparkSession, rows: list[tuple], schema: str, source: str = "source_url", confidence: str = "confidence") -> DataFrame:
    """A schedule from literal rows, each with its provenance."""
    df = spark.createDataFrame(rows, schema)
    names = df.columns
    for row in rows:
        got = dict(zip(names, row, strict=True))
        if source in got and not got[source]:
            raise ScheduleError(f"row {row} names no source")
        if confidence in got and got[confidence] not in ("primary", "secondary"):
            raise ScheduleError(f"row {row} has confidence {got[confidence]!r}")
    return df


def intervals(sched: DataFrame, start: str = "valid_from") -> DataFrame:
    """valid_to: the day the next entry takes over (null: none yet)."""
    text = F.struct(*sched.columns).cast("string")
    return sched.withColumn("valid_to", F.lead(start).over(Window.orderBy(start, text)))


def asof_schedule(df: DataFrame, sched: DataFrame, cols: list[str], on: str = "date", start: str = "valid_from", gaps: DataFrame | None = None) -> DataFrame:
    """The entry in force on each day; null before the first, and inside a declared gap (both ends inclusive)."""
    small = sched.count() <= SMALL and (gaps is None or gaps.count() <= SMALL)
    if not small:
        out = asof_join(df, sched.select(F.col(start).alias(on), *cols), on, [], cols)
    else:
        iv = F.broadcast(intervals(sched, start).select(F.col(start).alias("_from"), F.col("valid_to").alias("_to"), *cols))
        hit = (F.col(on) >= F.col("_from")) & (F.col("_to").isNull() | (F.col(on) < F.col("_to")))
        out = df.join(iv, hit, "left").drop("_from", "_to")
    if gaps is not None:
        spans = merged_gaps(gaps).select(F.col("gap_from").alias("_gf"), F.col("gap_until").alias("_gu"))
        keys = out.join(F.broadcast(spans) if small else spans, F.col(on).between(F.col("_gf"), F.col("_gu")), "left")
        none = F.col("_gf").isNotNull()
        out = keys.select(*df.columns, *[F.when(none, F.lit(None)).otherwise(F.col(c)).alias(c) for c in cols])
    return out


def merged_gaps(gaps: DataFrame) -> DataFrame:
    """Gaps that overlap or touch as one, so that a day lies in one at most. Gaps are declared by hand: few rows."""
    before = Window.orderBy("gap_from", "gap_until").rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce(F.col("gap_from") > F.max("gap_until").over(before), F.lit(True)).cast("int")
    parts = gaps.select("gap_from", "gap_until", new.alias("_new"))
    parts = parts.withColumn("_part", F.sum("_new").over(Window.orderBy("gap_from", "gap_until").rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy("_part").agg(F.min("gap_from").alias("gap_from"), F.max("gap_until").alias("gap_until")).drop("_part")


def _by_month(left: DataFrame, right: DataFrame, on: str, cols: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both sides with their month, and for each month the entry carried into it: the window over months has
    one row for each, however many rows they hold."""
    month = F.date_trunc("month", F.col(on)).alias("_month")
    left, right = left.select("*", month), right.select("*", month)
    hit = F.struct(*cols)
    lasts = right.groupBy("_month").agg(F.max_by(hit, F.struct(on, hit.cast("string"))).alias("_hit"))
    months = left.select("_month").unionByName(right.select("_month")).distinct().join(lasts, "_month", "left")
    earlier = Window.orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    carried = months.select("_month", F.last("_hit", ignorenulls=True).over(earlier).alias("_hit")).where("_hit IS NOT NULL")
    kind = dict(left.dtypes)[on]
    return left, right, carried.select("_month", F.col("_month").cast(kind).alias(on), F.lit(-1).alias("_side"), "_hit")


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], cols: list[str], strict: bool = False) -> DataFrame:
    """For each left row the latest right row of its key at or before it (before it, if strict)."""
    first, second = (0, 1) if not strict else (1, 0)
    carried, key = None, by
    if not by:
        left, right, carried = _by_month(left, right, on, cols)
        by = ["_month"]
    width = [c for c in left.columns if c not in by + [on]]
    a = left.select(*by, on, F.lit(second).alias("_side"), F.struct(*[F.col(c) for c in width]).alias("_row") if width else F.lit(1).alias("_row"), F.lit(None).alias("_hit"))
    a = a.drop("_hit")
    b = right.select(*by, on, F.lit(first).alias("_side"), F.struct(*cols).alias("_hit"))
    both = a.unionByName(b, allowMissingColumns=True)
    if carried is not None:
        both = both.unionByName(carried, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(on, "_side", F.col("_hit").cast("string")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("_last", F.last("_hit", ignorenulls=True).over(w)).where(F.col("_side") == second)
    return out.select(*key, on, *[F.col(f"_row.{c}").alias(c) for c in width], *[F.col(f"_last.{c}").alias(c) for c in cols])
