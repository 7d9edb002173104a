"""Readers of outside layouts: delimited series, fix lists, bars, risk sheets, bullion reports; source chains."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataUnavailableError
from .cache import CacheStore, keep_last


def clip(df: DataFrame, start: dt.date | None, end: dt.date | None, date: str = "date") -> DataFrame:
    if start:
        df = df.where(F.col(date) >= F.lit(start))
    return df.where(F.col(date) <= F.lit(end)) if end else df


def delimited_series(spark: SparkSession, path: str, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """First two columns of a CSV as (date, value); a lone dot is no value."""
    raw = spark.read.csv(path, header=True)
    a, b = raw.columns[:2]
    df = raw.select(F.expr(f"try_cast(`{a}` AS date)").alias("date"), F.expr(f"try_cast(nullif(`{b}`, '.') AS double)").alias("value")).na.drop()
    return clip(df, start, end)


def fix_list(rows: DataFrame, column: str, slot: int) -> DataFrame:
    """[{d, v: [..]}] JSON to (date, value) by currency slot; short or null entries are skipped, the last of a date stays."""
    parsed = F.from_json(column, "array<struct<d:string,v:array<double>>>")
    each = rows.select(F.posexplode(parsed).alias("seq", "x")).select("seq", F.expr("try_cast(x.d AS date)").alias("date"), F.get("x.v", F.lit(slot)).alias("value"))
    return keep_last(each.na.drop(), ["date"], "seq").select("date", "value")


def ohlc_bars(df: DataFrame, seq: str) -> DataFrame:
    """Bars with lower-case names by day; rows without any price go, the last of a day stays."""
    named = df.select(*[F.col(c).alias(c.lower()) for c in df.columns])
    day = named.withColumn("date", F.to_date("date")).na.drop("all", subset=["open", "high", "low", "close"])
    return keep_last(day, ["date"], seq.lower())


def risk_sheet(df: DataFrame, names: dict[str, str], day: str = "DAY") -> DataFrame:
    """The named columns of a wide sheet; other columns, even a dictionary beside the rows, are not read."""
    if missing := [c for c in [day, *names] if c not in df.columns]:
        raise DataUnavailableError(f"the sheet lacks {missing}")
    date = F.expr(f"try_to_date(cast(`{day}` AS string), 'yyyyMMdd')").alias("date")
    values = [F.expr(f"try_cast(`{c}` AS double)").alias(n) for c, n in names.items()]
    return df.select(date, *values).na.drop()


# The layout of the bullion report.
DAY = r"(\d{1,2}(?:st|nd|rd|th) [A-Z][a-z]+ \d{4})"
GOLD_ROW = r"Gold\s+999\s+([\d,]+)\s+([\d,]+)"
HOLDING_ROW = r"SPDR\s+Gold\s+([\d,]+\.\d+)\s+(-?[\d,]+\.\d+)"
REPORT = {  # pattern, group
    "report_date": (r"Date:\s*" + DAY, 1),
    "gold_am": (GOLD_ROW, 1),
    "gold_pm": (GOLD_ROW, 2),
    "spdr_tonnes": (HOLDING_ROW, 1),
    "spdr_change": (HOLDING_ROW, 2),
    "london_pm": (r"Gold\s+London\s+PM\s+Fix\(\$/oz\)\s+([\d,]+\.?\d*)", 1),
}
HISTORY = DAY + r"\s+([\d,]+)\s+[\d,]+"


def number(text: Column) -> Column:
    """A number with grouping commas; anything else is absent."""
    return F.regexp_replace(text, ",", "").try_cast("double")


def day_of(text: Column) -> Column:
    plain = F.regexp_replace(text, r"^(\d{1,2})(st|nd|rd|th)", "$1")
    return F.coalesce(F.call_function("try_to_date", plain, F.lit("d MMMM yyyy")))


def report_fields(reports: DataFrame, text: str = "text") -> DataFrame:
    """One row by report; what the layout lacks is null."""
    found = {n: F.nullif(F.regexp_extract(text, r, group), F.lit("")) for n, (r, group) in REPORT.items()}
    keep = [c for c in reports.columns if c != text]
    return reports.select(*keep, day_of(found["report_date"]).alias("report_date"), *[number(found[n]).alias(n) for n in list(REPORT)[1:]])


def report_history(reports: DataFrame, text: str = "text") -> DataFrame:
    """(.., date, value) of the dated rows inside each report."""
    keep = [c for c in reports.columns if c != text]
    rows = F.arrays_zip(F.regexp_extract_all(text, F.lit(HISTORY), F.lit(1)).alias("d"), F.regexp_extract_all(text, F.lit(HISTORY), F.lit(2)).alias("v"))
    each = reports.select(*keep, F.explode(rows).alias("x"))
    return each.select(*keep, day_of(F.col("x.d")).alias("date"), number(F.col("x.v")).alias("value")).where("date IS NOT NULL")


def report_series(reports: DataFrame) -> DataFrame:
    """A date's own report wins; embedded history only fills gaps, the newest report first."""
    own = report_fields(reports).where("report_date IS NOT NULL AND gold_pm IS NOT NULL").select(F.col("report_date").alias("date"), F.col("gold_pm").alias("value"), F.lit(1).alias("own"), F.col("report_date").alias("seen"))
    dated = reports.join(report_fields(reports).select("report_id", "report_date"), "report_id").select("report_id", "report_date", "text")
    old = report_history(dated).select("date", "value", F.lit(0).alias("own"), F.col("report_date").alias("seen"))
    return own.unionByName(old).groupBy("date").agg(F.max_by("value", F.struct("own", "seen")).alias("value"))


@dataclass
class SourceChain:
    """The first loader that answers, else the cache, else a refusal; who failed is recorded."""

    series_id: str
    loaders: list[tuple[str, Callable[[dt.date, dt.date], DataFrame]]]
    cache: CacheStore | None = None
    fallbacks: list[str] = field(default_factory=list)

    def load(self, start: dt.date, end: dt.date, offline: bool = False) -> DataFrame:
        for name, loader in [] if offline else self.loaders:
            try:
                df = loader(start, end)
                if df.limit(1).count():
                    return df
                self.fallbacks.append(f"{name}: no rows")
            except (DataUnavailableError, OSError) as error:
                self.fallbacks.append(f"{name}: {error}")
        if self.cache and (df := self.cache.rows_only(self.series_id)) is not None:
            self.fallbacks.append("cache")
            return clip(df, start, end)
        raise DataUnavailableError(f"{self.series_id}: " + ("; ".join(self.fallbacks) or "no source"))


def wanted(chains: dict[str, SourceChain], referenced: set[str]) -> dict[str, SourceChain]:
    """Only the chains that something refers to."""
    return {k: v for k, v in chains.items() if k in referenced}


def price_column(df: DataFrame) -> str:
    """close, else value, else the first number."""
    numeric = [c for c, t in df.dtypes if t in ("double", "float", "bigint", "int") or t.startswith("decimal")]
    for name in ("close", "value", *numeric):
        if name in df.columns:
            return name
    raise DataUnavailableError("no numeric column")
