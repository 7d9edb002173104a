"""Freshness, the forecast record, and scoring of what was published."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ElapsedForecastError, StaleDataError


def freshness(last: DataFrame, policy: DataFrame, run: dt.date) -> DataFrame:
    """A verdict for each series of the policy or the data, in the order: unavailable, empty, undeclared, stale, fresh.

    ``last``: (series_id, resolved, last_date); ``policy``: (series_id, max_lag, blocking)."""
    both = policy.join(last, "series_id", "full")
    lag = F.datediff(F.lit(run), F.col("last_date"))
    verdict = (
        F.when(~F.coalesce("resolved", F.lit(False)), "unavailable")
        .when(F.col("last_date").isNull(), "empty")
        .when(F.col("max_lag").isNull(), "undeclared")
        .when(lag > F.col("max_lag"), "stale")
        .otherwise("fresh")
    )
    return both.select("series_id", F.coalesce("blocking", F.lit(False)).alias("blocking"), "last_date", lag.cast("long").alias("lag_days"), verdict.alias("verdict"))


def refusal(verdicts: DataFrame) -> DataFrame:
    """Blocking series that are not fresh, grouped by verdict."""
    bad = verdicts.where("blocking AND verdict <> 'fresh'")
    return bad.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("series_id")), ", ").alias("series"))


def require_fresh(verdicts: DataFrame) -> None:
    bad = refusal(verdicts).collect()
    if bad:
        raise StaleDataError("; ".join(f"{r['verdict']}: {r['series']}" for r in bad))


def earliest_elapse(as_of: Column, sessions: Column) -> Column:
    """The first day on which so many sessions can have passed: whole weeks, then days."""
    return F.date_add(as_of, (F.floor(sessions / 5) * 7 + sessions % 5).cast("int"))


def status(as_of: Column, shortest: Column, readable: Column, run: dt.date) -> Column:
    """frozen once its shortest horizon can have elapsed, or when it cannot be read; open otherwise."""
    return F.when(~readable, "frozen").when(shortest.isNull(), "open").when(F.lit(run) >= earliest_elapse(as_of, shortest), "frozen").otherwise("open")


def require_open(as_of: dt.date, shortest: int, run: dt.date) -> None:
    if run >= as_of + dt.timedelta(days=shortest // 5 * 7 + shortest % 5):
        raise ElapsedForecastError(f"the forecast of {as_of} may have elapsed by {run}")


def gaps(published: DataFrame, skips: DataFrame, first: Column, last: Column) -> DataFrame:
    """Weekdays between first and last without a forecast, and the recorded reason if there is one."""
    span = published.agg(first.alias("a"), last.alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("date")).where(F.weekday("date") < 5)
    return days.join(published.select("date").distinct(), "date", "left_anti").join(skips, "date", "left")


def sessions_ahead(calendar: DataFrame, by: list[str], anchors: DataFrame, horizon: int) -> DataFrame:
    """The session so many after the last one at or before each anchor, on the series' own calendar."""
    from .schedules import asof_join

    at = calendar.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy("date")).cast("long"))
    placed = asof_join(anchors, at.select(*by, "date", "pos"), "date", by, ["pos"])
    target = at.select(*by, (F.col("pos") - horizon).alias("pos"), F.col("date").alias("scored_on"), *[c for c in calendar.columns if c not in by + ["date"]])
    return placed.join(target, [*by, "pos"]).drop("pos")


def interpolated_pit(quantiles: Column, probs: list[float], y: Column) -> Column:
    """Linear interpolation on a published grid; null outside it."""
    cells = [
        F.when((quantiles[i] <= y) & (y <= quantiles[i + 1]), F.when(quantiles[i + 1] == quantiles[i], F.lit(probs[i])).otherwise(
            probs[i] + (y - quantiles[i]) / (quantiles[i + 1] - quantiles[i]) * (probs[i + 1] - probs[i])))
        for i in range(len(probs) - 1)
    ]
    return F.coalesce(*cells)


def thinned_count(anchors: Column, horizon: int) -> Column:
    """How many windows do not overlap: from the earliest on, skip what starts before the last kept ends."""
    init = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("date").alias("until"))

    def step(a: Column, d: Column) -> Column:
        free = a["until"].isNull() | (d >= a["until"])
        return F.struct((a["n"] + free.cast("long")).alias("n"), F.when(free, earliest_elapse(d, F.lit(horizon))).otherwise(a["until"]).alias("until"))

    return F.aggregate(F.array_sort(anchors), init, step)["n"]
