"""Lenses: a base price seen in another unit, currency and tax regime."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .schedules import asof_schedule

COLUMNS = ["price", "price_ex_consumption_tax", "base_quote_per_unit", "fx_rate", "duty", "consumption_tax", "confidence"]


def native_lens(base: DataFrame, units: float = 1.0, price: str = "px") -> DataFrame:
    """The base price times units: no rate, no duty, no tax."""
    per_unit = F.col(price) * units
    keep = [c for c in base.columns if c in ("series_id", "date")]
    return base.select(
        *keep, per_unit.alias("price"), per_unit.alias("price_ex_consumption_tax"), per_unit.alias("base_quote_per_unit"),
        F.lit(1.0).alias("fx_rate"), F.lit(0.0).alias("duty"), F.lit(0.0).alias("consumption_tax"), F.lit("high").alias("confidence"),
    )


def taxed_import_lens(
    base: DataFrame, fx: DataFrame, duty: DataFrame, tax: DataFrame, units: float, confident_from: str, price: str = "px", gaps: DataFrame | None = None
) -> DataFrame:
    """Base x units x rate x (1 + duty) x (1 + tax); days without a duty have no price, tax defaults to 0."""
    keep = [c for c in base.columns if c in ("series_id", "date")]
    joined = base.select(*keep, F.col(price).alias("_px")).join(fx.select("date", "fx"), "date").where("_px IS NOT NULL AND fx IS NOT NULL")
    joined = asof_schedule(joined, duty, ["duty"], gaps=gaps)
    joined = asof_schedule(joined, tax, ["tax"]).where("duty IS NOT NULL").withColumn("tax", F.coalesce("tax", F.lit(0.0)))
    per_unit = F.col("_px") * units
    ex_tax = per_unit * F.col("fx") * (1 + F.col("duty"))
    return joined.select(
        *keep, (ex_tax * (1 + F.col("tax"))).alias("price"), ex_tax.alias("price_ex_consumption_tax"), per_unit.alias("base_quote_per_unit"),
        F.col("fx").alias("fx_rate"), "duty", F.col("tax").alias("consumption_tax"),
        F.when(F.col("date") >= F.lit(confident_from).cast("date"), "high").otherwise("low").alias("confidence"),
    )


def premium_bps(seen: Column, modelled: Column) -> Column:
    """Basis points of an observed price over the modelled one; null where either is missing."""
    return (seen / F.nullif(modelled, F.lit(0.0)) - 1) * 10_000


def local_premium(modelled: DataFrame, seen: DataFrame) -> DataFrame:
    """Keyed on the modelled dates; a missing observation stays missing."""
    return modelled.join(seen, "date", "left").withColumn("premium_bps", premium_bps(F.col("observed"), F.col("price")))


def held_constant_factor(lens: DataFrame, by: list[str]) -> DataFrame:
    """Latest price over latest base times rate."""
    at = lambda c: F.max_by(c, "date")
    return lens.groupBy(*by).agg((at("price") / (at("base_quote_per_unit") * at("fx_rate"))).alias("factor"), F.max("date").alias("date"))


def passthrough(premium: DataFrame, breaks: DataFrame, by: list[str], n: int = 10) -> DataFrame:
    """Mean premium of the n observations on each side of every break, and the shift."""
    seen = premium.where("premium_bps IS NOT NULL").select(*by, "date", "premium_bps")
    both = seen.join(F.broadcast(breaks.select(F.col("date").alias("break_date"))), F.lit(True))
    both = both.withColumn("after", F.col("date") >= F.col("break_date"))
    gap = F.abs(F.datediff("date", "break_date"))
    rank = F.row_number().over(Window.partitionBy(*by, "break_date", "after").orderBy(gap))
    near = both.withColumn("rank", rank).where(F.col("rank") <= n)
    side = lambda flag: F.avg(F.when(F.col("after") == flag, F.col("premium_bps")))
    out = near.groupBy(*by, "break_date").agg(side(False).alias("mean_before"), side(True).alias("mean_after"))
    return out.withColumn("shift", F.col("mean_after") - F.col("mean_before"))
