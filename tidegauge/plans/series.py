"""Bars, returns, schedules and lenses."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import lens, returns, schedules
from ..sources import cache, derived
from ..sources.derived import BARS_SQL, OBSERVED_SQL, RATE_SQL
from .registry import query

BY = ["series_id"]
D = dt.date
#: Invented schedules inside the tables' dates.
DUTY = [(D(1995, 1, 1), 0.04, "u:1", "primary"), (D(1996, 7, 1), 0.06, "u:2", "primary"), (D(1998, 3, 15), 0.10, "u:3", "secondary"), (D(2000, 1, 1), 0.075, "u:4", "primary")]
TAX = [(D(1997, 7, 1), 0.03, "u:5", "primary"), (D(1999, 10, 1), 0.05, "u:6", "primary")]
EXCISE = [(D(1995, 6, 1), 9.48, "u:7", "primary"), (D(1997, 1, 1), 19.48, "u:8", "primary"), (D(1999, 2, 1), 21.48, "u:9", "secondary")]
GAPS = [(D(1996, 5, 1), D(1996, 8, 31)), (D(1996, 7, 15), D(1996, 10, 31)), (D(1998, 11, 10), D(1998, 12, 20))]
BREAKS = [D(1996, 7, 1), D(1998, 3, 15), D(2000, 1, 1)]
UNITS = 0.32


def _values(rows: list[tuple]) -> str:
    show = lambda x: f"DATE '{x}'" if isinstance(x, dt.date) else f"'{x}'" if isinstance(x, str) else f"CAST({x!r} AS DOUBLE)"
    return "VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


DUTY_SQL = f"duty AS (SELECT * FROM ({_values(DUTY)}) t(valid_from, duty, source_url, confidence))"
TAX_SQL = f"tax AS (SELECT * FROM ({_values(TAX)}) t(valid_from, tax, source_url, confidence))"
EXCISE_SQL = f"excise AS (SELECT * FROM ({_values(EXCISE)}) t(valid_from, excise, source_url, confidence))"
GAPS_SQL = f"gaps AS (SELECT * FROM ({_values(GAPS)}) t(gap_from, gap_until))"
BREAKS_SQL = f"breaks AS (SELECT * FROM ({_values([(b,) for b in BREAKS])}) t(break_date))"
RET_SQL = "ret AS (SELECT *, ln(px) - lag(ln(px)) OVER (PARTITION BY series_id ORDER BY date) AS r FROM bars)"
LENS_SQL = f"""lens AS (
    SELECT b.series_id, b.date, b.px * {UNITS} * f.fx * (1 + d.duty) * (1 + coalesce(t.tax, 0)) AS price,
           b.px * {UNITS} * f.fx * (1 + d.duty) AS price_ex_consumption_tax, b.px * {UNITS} AS base_quote_per_unit, f.fx AS fx_rate,
           d.duty, coalesce(t.tax, 0) AS consumption_tax, CASE WHEN b.date >= DATE '1997-07-01' THEN 'high' ELSE 'low' END AS confidence
    FROM bars b JOIN rate f ON f.date = b.date ASOF JOIN duty d ON b.date >= d.valid_from ASOF LEFT JOIN tax t ON b.date >= t.valid_from)"""


def duty(spark: SparkSession) -> DataFrame:
    return schedules.schedule(spark, DUTY, "valid_from date, duty double, source_url string, confidence string")


def tax(spark: SparkSession) -> DataFrame:
    return schedules.schedule(spark, TAX, "valid_from date, tax double, source_url string, confidence string")


def taxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens.taxed_import_lens(derived.bars(spark, sf_dir), derived.rate(spark, sf_dir), duty(spark), tax(spark), UNITS, "1997-07-01")


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles to so many places: sums differ in their last bits by order."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"WITH {BARS_SQL} SELECT series_id, date, open, high, low, close, round(px, 8) AS px, n FROM bars")
def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(derived.bars(spark, sf_dir))


@query(f"WITH {BARS_SQL}, {RET_SQL} SELECT series_id, date, round(r, 8) AS r FROM ret WHERE r IS NOT NULL")
def log_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(returns.with_returns(derived.bars(spark, sf_dir), returns.Log, "px", BY).select("series_id", "date", "r"))


@query(f"""WITH {BARS_SQL}, x AS (SELECT series_id, date, ln(px + 25) - lag(ln(px + 25)) OVER (PARTITION BY series_id ORDER BY date) AS r FROM bars)
    SELECT series_id, date, round(r, 8) AS r FROM x WHERE r IS NOT NULL""")
def shifted_log_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(returns.with_returns(derived.bars(spark, sf_dir), returns.ShiftedLog(25.0), "px", BY).select("series_id", "date", "r"))


@query(f"""WITH {BARS_SQL}, x AS (SELECT series_id, date, px - lag(px) OVER (PARTITION BY series_id ORDER BY date) AS r FROM bars)
    SELECT series_id, date, round(r, 6) AS r FROM x WHERE r IS NOT NULL""")
def diff_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(returns.with_returns(derived.bars(spark, sf_dir), returns.Difference(), "px", BY).select("series_id", "date", "r"), 6)


@query(f"""WITH {BARS_SQL}, {RET_SQL},
    x AS (SELECT *, first_value(px) OVER w * exp(sum(r) OVER w) AS back FROM ret WINDOW w AS (PARTITION BY series_id ORDER BY date))
    SELECT series_id, count(*) AS n, max(abs(back - px)) < 0.001 AS exact FROM x WHERE r IS NOT NULL GROUP BY 1""")
def return_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = returns.round_trip(derived.bars(spark, sf_dir), returns.Log, "px", BY)
    return out.select("series_id", "n", (F.col("error") < 0.001).alias("exact"))


@query("""WITH raw AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey AS seq, o_totalprice AS value FROM orders),
    old AS (SELECT date, seq, value FROM raw WHERE date < DATE '1998-06-01'),
    new AS (SELECT date, seq, value + 1 AS value FROM raw WHERE date >= DATE '1998-01-01'),
    u AS (SELECT *, 0 AS fresh FROM old UNION ALL SELECT *, 1 AS fresh FROM new)
    SELECT date, arg_max(value, fresh * 1000000000000 + seq) AS value FROM u GROUP BY date""")
def merge_upsert_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = derived.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("value"))
    old = raw.where("date < '1998-06-01'")
    new = raw.where("date >= '1998-01-01'").withColumn("value", F.col("value") + 1)
    return cache.merge_upsert(old, new, ["date"], "seq").select("date", "value")


@query(f"WITH {BARS_SQL}, {DUTY_SQL}, x AS (SELECT DISTINCT date FROM bars) SELECT x.date, d.duty FROM x ASOF LEFT JOIN duty d ON x.date >= d.valid_from")
def schedule_asof_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedules.asof_schedule(derived.bars(spark, sf_dir).select("date").distinct(), duty(spark), ["duty"])


@query(f"""WITH {BARS_SQL}, {RET_SQL}, s AS (SELECT series_id, date, sign(r) AS s FROM ret WHERE r <> 0), b AS (SELECT series_id, s, lag(s) OVER (PARTITION BY series_id ORDER BY date) AS b FROM s)
    SELECT series_id, count(*) FILTER (WHERE b <> s) AS changes, count(*) AS n FROM b GROUP BY 1""")
def return_sign_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.factors import sign_changes

    return sign_changes(returns.with_returns(derived.bars(spark, sf_dir), returns.Log, "px", ["series_id"]), ["series_id"], "r", "date")


@query(f"""WITH {BARS_SQL}, {EXCISE_SQL}, {GAPS_SQL}, x AS (SELECT DISTINCT date FROM bars)
    SELECT x.date, CASE WHEN EXISTS (SELECT 1 FROM gaps g WHERE x.date BETWEEN g.gap_from AND g.gap_until) THEN NULL ELSE e.excise END AS excise
    FROM x ASOF LEFT JOIN excise e ON x.date >= e.valid_from""")
def schedule_asof_with_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    excise = schedules.schedule(spark, EXCISE, "valid_from date, excise double, source_url string, confidence string")
    gaps = spark.createDataFrame(GAPS, "gap_from date, gap_until date")
    return schedules.asof_schedule(derived.bars(spark, sf_dir).select("date").distinct(), excise, ["excise"], gaps=gaps)


@query("""WITH t AS (SELECT event_id, user_id, ts, value FROM events), q AS (SELECT user_id, ts, value AS last_click FROM events WHERE event_type = 'click')
    SELECT t.event_id, max(q.last_click) AS last_click FROM t ASOF LEFT JOIN q ON t.user_id = q.user_id AND t.ts >= q.ts GROUP BY 1""")
def asof_join_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = derived.table(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").select("user_id", "ts", F.col("value").alias("last_click"))
    return schedules.asof_join(events.select("event_id", "user_id", "ts"), clicks, "ts", ["user_id"], ["last_click"]).select("event_id", "last_click")


@query(f"""WITH {BARS_SQL} SELECT series_id, date, round(px * {UNITS}, 8) AS price, round(px * {UNITS}, 8) AS price_ex_consumption_tax,
    round(px * {UNITS}, 8) AS base_quote_per_unit, CAST(1 AS DOUBLE) AS fx_rate, CAST(0 AS DOUBLE) AS duty, CAST(0 AS DOUBLE) AS consumption_tax, 'high' AS confidence FROM bars""")
def lens_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lens.native_lens(derived.bars(spark, sf_dir), UNITS))


@query(f"""WITH {BARS_SQL}, {RATE_SQL}, {DUTY_SQL}, {TAX_SQL}, {LENS_SQL}
    SELECT series_id, date, round(price, 6) AS price, round(price_ex_consumption_tax, 6) AS price_ex_consumption_tax,
           round(base_quote_per_unit, 6) AS base_quote_per_unit, round(fx_rate + 1e-9, 6) AS fx_rate, duty, CAST(consumption_tax AS DOUBLE) AS consumption_tax, confidence FROM lens""")
def lens_taxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(taxed(spark, sf_dir).withColumn("fx_rate", F.col("fx_rate") + 1e-9), 6)  # off the ties of short decimals


PREMIUM_SQL = f"""{BARS_SQL}, {RATE_SQL}, {DUTY_SQL}, {TAX_SQL}, {LENS_SQL}, {OBSERVED_SQL},
    premium AS (SELECT l.series_id, l.date, (o.observed * 0.3 / nullif(l.price, 0) - 1) * 10000 AS premium_bps FROM lens l LEFT JOIN observed o ON o.date = l.date)"""


def _premium(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = derived.observed(spark, sf_dir).withColumn("observed", F.col("observed") * 0.3)
    return lens.local_premium(taxed(spark, sf_dir), seen)


@query(f"WITH {PREMIUM_SQL} SELECT series_id, date, round(premium_bps, 5) AS premium_bps FROM premium")
def local_premium_bps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_premium(spark, sf_dir).select("series_id", "date", "premium_bps"), 5)


@query(f"""WITH {PREMIUM_SQL}, {BREAKS_SQL},
    x AS (SELECT p.*, b.break_date, date >= break_date AS after,
                 row_number() OVER (PARTITION BY series_id, break_date, date >= break_date ORDER BY abs(date_diff('day', break_date, date))) AS k
          FROM premium p, breaks b WHERE premium_bps IS NOT NULL),
    m AS (SELECT series_id, break_date, avg(premium_bps) FILTER (WHERE NOT after) AS mean_before, avg(premium_bps) FILTER (WHERE after) AS mean_after
          FROM x WHERE k <= 10 GROUP BY 1, 2)
    SELECT series_id, break_date, round(mean_before, 5) AS mean_before, round(mean_after, 5) AS mean_after, round(mean_after - mean_before, 5) AS shift FROM m""")
def passthrough_diagnostic(spark: SparkSession, sf_dir: str) -> DataFrame:
    breaks = spark.createDataFrame([(b,) for b in BREAKS], "date date")
    return rounded(lens.passthrough(_premium(spark, sf_dir), breaks, BY), 5)


@query(f"""WITH {BARS_SQL}, {RATE_SQL}, {DUTY_SQL}, {TAX_SQL}, {LENS_SQL}
    SELECT series_id, max(date) AS date, round(arg_max(price, date) / (arg_max(base_quote_per_unit, date) * arg_max(fx_rate, date)), 8) AS factor FROM lens GROUP BY 1""")
def lens_constant_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lens.held_constant_factor(taxed(spark, sf_dir), BY))


@query(f"""WITH {PREMIUM_SQL} SELECT l.series_id, count(*) AS rows, max(l.date) AS last_date, round(arg_max(l.price, l.date), 6) AS last_price,
    count(p.premium_bps) AS premium_rows, max(CASE WHEN p.premium_bps IS NOT NULL THEN p.date END) AS premium_last_date,
    min(CASE WHEN p.premium_bps IS NOT NULL THEN p.date END) AS premium_first_date
    FROM lens l JOIN premium p ON p.series_id = l.series_id AND p.date = l.date GROUP BY 1""")
def lens_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = F.when(F.col("premium_bps").isNotNull(), F.col("date"))
    return rounded(
        _premium(spark, sf_dir).groupBy("series_id").agg(
            F.count(F.lit(1)).alias("rows"), F.max("date").alias("last_date"), F.max_by("price", "date").alias("last_price"),
            F.count("premium_bps").alias("premium_rows"), F.max(seen).alias("premium_last_date"), F.min(seen).alias("premium_first_date"),
        ), 6,
    )


@query(f"""WITH {BARS_SQL}, {RET_SQL}, {BREAKS_SQL} SELECT series_id, date, round(r, 8) AS r FROM ret
    WHERE r IS NOT NULL AND date NOT IN (SELECT break_date FROM breaks)""")
def break_excluded_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    breaks = spark.createDataFrame([(b,) for b in BREAKS], "date date")
    return log_returns(spark, sf_dir).join(breaks, "date", "left_anti").select("series_id", "date", "r")


@query(f"""WITH {BARS_SQL}, p AS (SELECT series_id, date, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n FROM bars)
    SELECT series_id, date, pos FROM p WHERE pos >= 250 AND (pos - 250) % 20 = 0 AND pos + 5 < n""")
def asof_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = returns.in_order(BY)
    p = derived.bars(spark, sf_dir).withColumn("pos", F.row_number().over(w).cast("long") - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*BY)))
    return p.where("pos >= 250 AND (pos - 250) % 20 = 0 AND pos + 5 < n").select("series_id", "date", "pos")


@query(f"""WITH {BARS_SQL}, x AS (SELECT series_id, date, px, lead(px, 5) OVER w AS terminal,
        min(px) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS run_min,
        max(px) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS run_max FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY date))
    SELECT series_id, date, round(terminal, 6) AS terminal, round(run_min, 6) AS run_min, round(run_max, 6) AS run_max FROM x WHERE terminal IS NOT NULL""")
def realised_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    ahead = returns.in_order(BY).rowsBetween(1, 5)
    x = derived.bars(spark, sf_dir).select("series_id", "date", F.lead("px", 5).over(returns.in_order(BY)).alias("terminal"), F.min("px").over(ahead).alias("run_min"), F.max("px").over(ahead).alias("run_max"))
    return rounded(x.where("terminal IS NOT NULL"), 6)
