"""Return transforms as column expressions, their inverses, and the domain check."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..errors import TransformDomainError


def in_order(by: list[str], order: str = "date") -> WindowSpec:
    return Window.partitionBy(*by).orderBy(order)


def so_far(by: list[str], order: str = "date") -> WindowSpec:
    return in_order(by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


@dataclass(frozen=True)
class ShiftedLog:
    """ln(price + shift) differences; shift 0 is the plain log return."""

    shift: float = 0.0

    def level(self, price: Column) -> Column:
        return F.ln(price + F.lit(self.shift))

    def returns(self, price: Column, w: WindowSpec) -> Column:
        return self.level(price) - F.lag(self.level(price), 1).over(w)

    def prices(self, anchor: Column, total_return: Column) -> Column:
        return (anchor + F.lit(self.shift)) * F.exp(total_return) - F.lit(self.shift)

    def advance(self, price: Column, r: Column) -> Column:
        return self.prices(price, r)

    def step_return(self, price: Column, following: Column) -> Column:
        return self.level(following) - self.level(price)

    def require(self, df: DataFrame, price: str, order: str = "date") -> None:
        """Refuse prices that have no logarithm, naming how many and the first."""
        bad = df.where(F.col(price) + F.lit(self.shift) <= 0).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).first()
        if bad["n"]:
            raise TransformDomainError(f"{bad['n']} prices of {price} are not above {-self.shift}, the first on {bad['first']}")


@dataclass(frozen=True)
class Difference:
    """Plain differences."""

    def returns(self, price: Column, w: WindowSpec) -> Column:
        return price - F.lag(price, 1).over(w)

    def prices(self, anchor: Column, total_return: Column) -> Column:
        return anchor + total_return

    def advance(self, price: Column, r: Column) -> Column:
        return price + r

    def step_return(self, price: Column, following: Column) -> Column:
        return following - price

    def require(self, df: DataFrame, price: str, order: str = "date") -> None:
        """Any price will do."""


Log = ShiftedLog()


def with_returns(df: DataFrame, transform: ShiftedLog | Difference, price: str, by: list[str], order: str = "date") -> DataFrame:
    """The series with column r; the first row of each, which has none, is dropped."""
    return df.withColumn("r", transform.returns(F.col(price), in_order(by, order))).where(F.col("r").isNotNull())


def round_trip(df: DataFrame, transform: ShiftedLog | Difference, price: str, by: list[str], order: str = "date") -> DataFrame:
    """By series: how many prices the returns rebuild, and the largest error."""
    w = in_order(by, order)
    anchor = F.first(price).over(so_far(by, order))
    total = F.sum("r").over(so_far(by, order))
    with_r = df.withColumn("r", transform.returns(F.col(price), w))
    rebuilt = with_r.withColumn("back", transform.prices(anchor, total)).where(F.col("r").isNotNull())
    return rebuilt.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("back") - F.col(price))).alias("error"))
