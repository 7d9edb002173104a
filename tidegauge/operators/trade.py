"""Friction, breakevens, routes and their rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import RouteError


def physical(premium: Column, tax: Column, buyback: Column) -> Column:
    """Breakeven of something bought and sold over a counter; it does not accrue."""
    return (1 + premium) * (1 + tax) / (1 - buyback)


def accruing(spread: Column, expense: Column, roll: Column, days: Column) -> Column:
    """Breakeven of something that costs by the year."""
    return (1 + spread) * (1 + (expense + roll) * days / 365) / (1 - spread)


def breakeven(friction: DataFrame, horizons: list[int]) -> DataFrame:
    """Every friction (kind physical or roll) at every horizon of a short literal list."""
    each = friction.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    value = F.when(F.col("kind") == "physical", physical(F.col("premium"), F.col("tax"), F.col("buyback"))).otherwise(
        accruing(F.col("spread"), F.col("expense"), F.col("roll"), F.col("horizon"))
    )
    return each.withColumn("multiple", value)


def breakeven_pivot(df: DataFrame, horizons: list[int]) -> DataFrame:
    """Percent by horizon, two places, a column for each."""
    pct = df.withColumn("pct", F.round((F.col("multiple") - 1) * 100, 2))
    return pct.groupBy("id").pivot("horizon", horizons).agg(F.first("pct")).select("id", *[F.col(str(h)).alias(f"h{h}") for h in horizons])


def hurdle_events(df: DataFrame) -> DataFrame:
    """One event where the friction does not depend on the horizon, one for each horizon otherwise."""
    accrues = F.col("kind") != "physical"
    return df.select("id", "multiple", F.when(accrues, F.col("horizon")).alias("horizon")).distinct()


def violations(jurisdictions: DataFrame, blocs: DataFrame, routes: DataFrame, terms: DataFrame) -> DataFrame:
    """(rule, subject): every breach of the route book's rules; an empty table is a sound book."""
    member = blocs.select("bloc", F.explode("members").alias("code"))
    offered = routes.select("route", F.explode("available_in").alias("code"))
    rule = lambda name, df, subject: df.select(F.lit(name).alias("rule"), F.col(subject).cast("string").alias("subject"))
    cells = terms.withColumn("cell", F.concat_ws("/", "route", "code"))
    out = [
        rule("code_shape", jurisdictions.where(~F.col("code").rlike("^[A-Z]{3}$")), "code"),
        rule("bloc_is_jurisdiction", blocs.join(jurisdictions, blocs["bloc"] == jurisdictions["code"], "left_semi"), "bloc"),
        rule("unknown_member", member.join(jurisdictions.select("code"), "code", "left_anti"), "code"),
        rule("empty_bloc", blocs.where(F.size("members") == 0), "bloc"),
        rule("member_not_listed", jurisdictions.where("bloc IS NOT NULL").join(member, ["bloc", "code"], "left_anti"), "code"),
        rule("bloc_not_named", member.join(jurisdictions.select("code", "bloc"), ["code", "bloc"], "left_anti"), "code"),
        rule("unknown_availability", offered.join(jurisdictions.select("code"), "code", "left_anti"), "code"),
        rule("terms_not_offered", cells.join(offered, ["route", "code"], "left_anti"), "cell"),
        rule("cell_without_terms", offered.join(terms, ["route", "code"], "left_anti").withColumn("cell", F.concat_ws("/", "route", "code")), "cell"),
        rule("cell_twice", cells.groupBy("cell").count().where("count > 1"), "cell"),
        rule("leverage", cells.where("leverage IS NOT NULL AND leverage <= 1"), "cell"),
        rule("spread_without_basis", cells.where("spread > 0 AND spread_basis IS NULL"), "cell"),
    ]
    found = out[0]
    for df in out[1:]:
        found = found.unionByName(df)
    return found


def require_sound(*book: DataFrame) -> None:
    bad = violations(*book).collect()
    if bad:
        raise RouteError("; ".join(f"{r['rule']}: {r['subject']}" for r in bad))


def restricted_in(jurisdictions: DataFrame, routes: DataFrame) -> DataFrame:
    """Known jurisdictions where a route is not offered; derived, never declared."""
    offered = routes.select("route", F.explode("available_in").alias("code"))
    every = routes.select("route").join(F.broadcast(jurisdictions.select("code")), F.lit(True))
    return every.join(offered, ["route", "code"], "left_anti")


def interpolate(grid: DataFrame, by: list[str], level: float) -> DataFrame:
    """A probability at a level between grid points; null outside the grid."""
    from .returns import in_order

    w = in_order(by, "move")
    seg = grid.select(*by, F.col("move").alias("x0"), F.col("p").alias("p0"), F.lead("move").over(w).alias("x1"), F.lead("p").over(w).alias("p1"))
    hit = seg.where(f"x0 <= {level!r} AND x1 > {level!r}")
    return hit.select(*by, (F.col("p0") + (level - F.col("x0")) / (F.col("x1") - F.col("x0")) * (F.col("p1") - F.col("p0"))).alias("p"))


def book(spark: SparkSession, jurisdictions: list, blocs: list, routes: list, terms: list) -> tuple[DataFrame, ...]:
    return (
        spark.createDataFrame(jurisdictions, "code string, label string, bloc string"),
        spark.createDataFrame(blocs, "bloc string, members array<string>"),
        spark.createDataFrame(routes, "route string, available_in array<string>"),
        spark.createDataFrame(terms, "route string, code string, leverage double, spread double, spread_basis string"),
    )
