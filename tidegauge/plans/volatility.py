"""Volatility queries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import returns, volatility
from ..sources import derived
from ..sources.derived import BARS_SQL
from .registry import query
from .series import RET_SQL, rounded

BY = ["series_id"]
WINDOW = 60
VAR_Z = -1.6448536269514722
THETA = (2e-6, 0.04, 0.08, 0.88)
LN2 = math.log(2.0)
PARK_SQL = f"park AS (SELECT *, CASE WHEN ln(high / low) <> 0 THEN ln(high / low) ** 2 / (4 * {LN2!r}) END AS v FROM bars)"
ROLL_SQL = f"""{BARS_SQL}, {RET_SQL}, k AS (SELECT series_id, date, r FROM ret WHERE r IS NOT NULL),
    roll AS (SELECT *, CASE WHEN count(r) OVER w = {WINDOW} THEN stddev_samp(r) OVER w END AS sigma, avg(r) OVER (PARTITION BY series_id) AS mu
             FROM k WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING))"""


def log_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns.with_returns(derived.bars(spark, sf_dir), returns.Log, "px", BY).select("series_id", "date", "r")


def parkinson_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.bars(spark, sf_dir).withColumn("v", volatility.parkinson(F.col("high"), F.col("low")))


@query(f"WITH {BARS_SQL}, {PARK_SQL} SELECT series_id, date, round(v, 8) AS v FROM park")
def parkinson_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(parkinson_frame(spark, sf_dir).select("series_id", "date", "v"))


@query(f"""WITH {BARS_SQL}, x AS (SELECT series_id, date, 0.5 * ln(high / low) ** 2 - {2 * LN2 - 1!r} * ln(close / open) ** 2 AS v FROM bars)
    SELECT series_id, date, CASE WHEN v > 0 THEN round(v, 8) END AS v FROM x""")
def garman_klass_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = volatility.garman_klass(F.col("open"), F.col("high"), F.col("low"), F.col("close"))
    return rounded(derived.bars(spark, sf_dir).select("series_id", "date", v.alias("v")))


@query(f"WITH {ROLL_SQL} SELECT series_id, date, round(sigma, 8) AS sigma, round(CASE WHEN sigma > 0 THEN (r - mu) / sigma END, 7) AS z FROM roll")
def rolling_sigma_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = volatility.rolling_sigma(log_r(spark, sf_dir), BY, WINDOW)
    return got.select("series_id", "date", F.round("sigma", 8).alias("sigma"), F.round("z", 7).alias("z"))


@query(f"""WITH {BARS_SQL}, {RET_SQL}, k AS (SELECT * FROM ret WHERE r IS NOT NULL), x AS (SELECT series_id, date, CASE WHEN count(r) OVER w = {WINDOW} THEN stddev_samp(r) OVER w END AS sigma
        FROM k WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW))
    SELECT series_id, max(date) AS date, round(max_by(sigma, date), 8) AS sigma FROM x GROUP BY 1""")
def rolling_next_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(volatility.next_sigma(log_r(spark, sf_dir), BY, WINDOW))


@query(f"""WITH {BARS_SQL}, {RET_SQL} SELECT series_id, date, round(stddev_samp(r) OVER (PARTITION BY series_id ORDER BY date), 8) AS sigma FROM ret""")
def expanding_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = derived.bars(spark, sf_dir).withColumn("r", returns.Log.returns(F.col("px"), returns.in_order(BY)))
    return rounded(df.select("series_id", "date", F.stddev_samp("r").over(returns.so_far(BY)).alias("sigma")))


HAR_SQL = f"""{BARS_SQL}, {PARK_SQL}, m AS (SELECT series_id, date, v FROM park WHERE v > 0),
    h AS (SELECT series_id, date, ln(v) AS y, ln(lag(v) OVER (PARTITION BY series_id ORDER BY date)) AS x_d,
                 CASE WHEN count(v) OVER a = 5 THEN ln(avg(v) OVER a) END AS x_w, CASE WHEN count(v) OVER b = 22 THEN ln(avg(v) OVER b) END AS x_m
          FROM m WINDOW a AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
                        b AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 22 PRECEDING AND 1 PRECEDING)),
    har AS (SELECT * FROM h WHERE x_d IS NOT NULL AND x_w IS NOT NULL AND x_m IS NOT NULL)"""


@query(f"WITH {HAR_SQL} SELECT series_id, date, round(y, 7) AS y, round(x_d, 7) AS x_d, round(x_w, 7) AS x_w, round(x_m, 7) AS x_m FROM har")
def har_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(volatility.har_design(parkinson_frame(spark, sf_dir).select("series_id", "date", "v"), BY), 7)


_NAMES = ["one", "x_d", "x_w", "x_m"]
_GRAM = ", ".join(
    [f"round(sum({a} * {b}), 5) AS {a}_{b}" for i, a in enumerate(_NAMES) for b in _NAMES[i:]]
    + [f"round(sum({a} * y), 5) AS {a}_y" for a in _NAMES]
    + ["round(sum(y * y), 5) AS y_y", "count(*) AS n"]
)


@query(f"WITH {HAR_SQL}, g AS (SELECT *, CAST(1 AS DOUBLE) AS one FROM har) SELECT series_id, {_GRAM} FROM g GROUP BY 1")
def har_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    design = volatility.har_design(parkinson_frame(spark, sf_dir).select("series_id", "date", "v"), BY)
    return rounded(volatility.gram(design, BY, _NAMES[1:], "y"), 5)


@query()
def har_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients by series and the sigmas 1 to 10 sessions ahead."""
    v = parkinson_frame(spark, sf_dir).select("series_id", "date", "v")
    last = v.where("v > 0").withColumn("k", F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("date")))).where("k <= 22")
    recent = last.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "v"))), lambda x: x["v"]).alias("recent"))
    fits = volatility.har_fit(v, BY).drop("n").join(recent, "series_id")

    def ahead(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for f in batch.itertuples(index=False):
                beta = (f.const, f.day, f.week, f.month)
                rows += [(f.series_id, h, *beta, f.smearing, s) for h, s in enumerate(volatility.har_forward(beta, f.smearing, f.recent, 10), 1)]
            yield pd.DataFrame(rows, columns=["series_id", "horizon", "const", "day", "week", "month", "smearing", "sigma"])

    return fits.mapInPandas(ahead, "series_id string, horizon int, const double, day double, week double, month double, smearing double, sigma double")


GJR_SQL = f"""{BARS_SQL}, {RET_SQL}, k AS (SELECT series_id, date, r, row_number() OVER (PARTITION BY series_id ORDER BY date) AS i FROM ret WHERE r IS NOT NULL),
    e AS (SELECT series_id, i, r AS e FROM k),
    b AS (SELECT series_id, var_pop(e) AS v0 FROM e GROUP BY 1),
    g AS (SELECT series_id, CAST(1 AS BIGINT) AS i, v0 AS v FROM b
          UNION ALL SELECT g.series_id, g.i + 1, {THETA[0]!r} + ({THETA[1]!r} + CASE WHEN e.e < 0 THEN {THETA[2]!r} ELSE 0 END) * e.e * e.e + {THETA[3]!r} * g.v
          FROM g JOIN e ON e.series_id = g.series_id AND e.i = g.i)"""


def _gjr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, eps, v): the returns by series, and the variances under a fixed theta."""
    numbered = log_r(spark, sf_dir).withColumn("i", F.row_number().over(returns.in_order(BY)))
    packed = numbered.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "r"))), lambda x: x["r"]).alias("eps"), F.var_pop("r").alias("v0"))
    return packed.withColumn("v", volatility.gjr_variances(F.col("eps"), *THETA, F.col("v0")))


def _variances(gjr: DataFrame) -> DataFrame:
    got = gjr.select("series_id", F.posexplode("v").alias("i", "v"))
    return got.select("series_id", (F.col("i") + 1).cast("long").alias("i"), F.round("v", 9).alias("v"))


@query(f"WITH RECURSIVE {GJR_SQL} SELECT series_id, i, round(v, 9) AS v FROM g")
def gjr_fixed_theta_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On every return of each series."""
    return _variances(_gjr(spark, sf_dir))


def _likelihood(gjr: DataFrame) -> DataFrame:
    each = gjr.select("series_id", F.explode(F.arrays_zip("eps", "v")).alias("x")).where("x.eps IS NOT NULL")
    e, v = F.col("x.eps"), F.col("x.v")
    return rounded(each.groupBy("series_id").agg(F.sum(0.5 * (math.log(2 * math.pi) + F.ln(v) + e * e / v)).alias("nll")), 6)


@query(f"""WITH RECURSIVE {GJR_SQL} SELECT g.series_id, round(sum(0.5 * ({math.log(2 * math.pi)!r} + ln(g.v) + e.e * e.e / g.v)), 6) AS nll
    FROM g JOIN e ON e.series_id = g.series_id AND e.i = g.i GROUP BY 1""")
def gjr_fixed_theta_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On every return of each series."""
    return _likelihood(_gjr(spark, sf_dir))


_P = THETA[1] + THETA[2] / 2 + THETA[3]
_LEVEL = THETA[0] / (1 - _P)


def _forward(gjr: DataFrame) -> DataFrame:
    last = gjr.select("series_id", F.element_at("v", -1).alias("v"), F.explode(F.sequence(F.lit(1), F.lit(21))).alias("h"))
    sigma = F.sqrt(_LEVEL + F.pow(F.lit(_P), F.col("h") - 1) * (F.col("v") - _LEVEL))
    return last.select("series_id", F.col("h").cast("long").alias("h"), F.round(sigma, 8).alias("sigma"))


@query(f"""WITH RECURSIVE {GJR_SQL}, l AS (SELECT series_id, max_by(v, i) AS v FROM g GROUP BY 1)
    SELECT series_id, h, round(sqrt({_LEVEL!r} + pow({_P!r}, h - 1) * (v - {_LEVEL!r})), 8) AS sigma FROM l, range(1, 22) t(h)""")
def gjr_forward_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On every return of each series."""
    return _forward(_gjr(spark, sf_dir))


@query()
def gjr_fit_walkforward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GJR-t fits on expanding windows; the history reaches a task once for each group of as-of dates."""
    r = log_r(spark, sf_dir).where("r IS NOT NULL")
    packed = r.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "r"))), lambda x: x["r"]).alias("rs"))
    return volatility.gjr_fit_asofs(packed, BY, "rs", first=500, step=5)


BREACH_SQL = f"{ROLL_SQL}, breach AS (SELECT series_id, date, r < {VAR_Z!r} * sigma AS breach FROM roll WHERE sigma IS NOT NULL)"


def breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = volatility.rolling_sigma(log_r(spark, sf_dir), BY, WINDOW).where("sigma IS NOT NULL")
    return got.select("series_id", "date", (F.col("r") < VAR_Z * F.col("sigma")).alias("breach"))


@query(f"WITH {BREACH_SQL} SELECT * FROM breach")
def var_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breaches(spark, sf_dir)
