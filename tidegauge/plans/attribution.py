"""Weekly designs, projections and chains."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import attribution, factors
from ..operators.factors import Factor
from ..sources import derived
from .registry import query
from .series import rounded

FRI = "{0} + CAST((5 - isodow({0}) + 7) % 7 AS INTEGER)"


def drivers(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Weekly (week, value) of the target and the drivers."""
    orders = derived.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"), "o_totalprice", "o_orderstatus", "o_orderpriority")
    items = derived.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date"), "l_extendedprice", "l_quantity", "l_returnflag")

    def weekly(df: DataFrame, x: str, mean: bool = False) -> DataFrame:
        daily = df.groupBy("date").agg(F.avg(x).alias("value"))
        return factors.to_weekly(daily, [], "value", mean).select("week", "value")

    return {
        "target": weekly(orders.where("o_orderstatus = 'O'"), "o_totalprice"),
        "finished": weekly(orders.where("o_orderstatus = 'F'"), "o_totalprice"),
        "returned": weekly(items.where("l_returnflag = 'R'"), "l_extendedprice", mean=True),
        "quantity": weekly(items, "l_quantity", mean=True),
        "urgent": weekly(orders.where("o_orderpriority = '1-URGENT' AND date > '2001-01-01'"), "o_totalprice"),
    }


FACTORS = [Factor("finished", "diff"), Factor("returned", "pct_change"), Factor("quantity", "diff", lag=1), Factor("urgent", "diff", required=False)]


def _weekly(name: str, where: str, tab: str, date: str, x: str, mean: bool) -> str:
    agg = "avg(value)" if mean else "max_by(value, date)"
    return f"""{name} AS (SELECT {FRI.format('date')} AS week, {agg} AS value
        FROM (SELECT CAST({date} AS DATE) AS date, avg({x}) AS value FROM {tab} WHERE {where} GROUP BY 1) GROUP BY 1)"""


W_SQL = ", ".join([
    _weekly("w_target", "o_orderstatus = 'O'", "orders", "o_orderdate", "o_totalprice", False),
    _weekly("w_finished", "o_orderstatus = 'F'", "orders", "o_orderdate", "o_totalprice", False),
    _weekly("w_returned", "l_returnflag = 'R'", "lineitem", "l_shipdate", "l_extendedprice", True),
    _weekly("w_quantity", "true", "lineitem", "l_shipdate", "l_quantity", True),
])
DESIGN_SQL = f"""{W_SQL}, c_t AS (SELECT week, (value - lag(value) OVER (ORDER BY week)) / nullif(lag(value) OVER (ORDER BY week), 0) AS y FROM w_target),
    c_f AS (SELECT week, value - lag(value) OVER (ORDER BY week) AS finished FROM w_finished),
    c_r AS (SELECT week, (value - lag(value) OVER (ORDER BY week)) / nullif(lag(value) OVER (ORDER BY week), 0) AS returned FROM w_returned),
    c_q0 AS (SELECT week, value - lag(value) OVER (ORDER BY week) AS q FROM w_quantity), c_q AS (SELECT week, lag(q) OVER (ORDER BY week) AS quantity FROM c_q0 WHERE q IS NOT NULL),
    design AS (SELECT t.week, y, finished, returned, quantity FROM c_t t JOIN c_f f ON f.week = t.week JOIN c_r r ON r.week = t.week JOIN c_q q ON q.week = t.week
               WHERE y IS NOT NULL AND finished IS NOT NULL AND returned IS NOT NULL AND quantity IS NOT NULL)"""
COLS = ["finished", "returned", "quantity"]


def the_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The optional driver has a few weeks only, and is left out."""
    return factors.design(drivers(spark, sf_dir), "target", FACTORS)[0]


@query(f"WITH {W_SQL} SELECT 'last' AS how, week, round(value, 6) AS value FROM w_finished UNION ALL SELECT 'mean', week, round(value, 6) FROM w_quantity")
def weekly_last_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = drivers(spark, sf_dir)
    both = d["finished"].select(F.lit("last").alias("how"), "week", "value").unionByName(d["quantity"].select(F.lit("mean").alias("how"), "week", "value"))
    return rounded(both, 6)


@query(f"WITH {DESIGN_SQL} SELECT week, round(y, 7) AS y, round(finished, 5) AS finished, round(returned, 7) AS returned, round(quantity, 7) AS quantity FROM design")
def weekly_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = the_design(spark, sf_dir)
    return d.select("week", F.round("y", 7).alias("y"), F.round("finished", 5).alias("finished"), F.round("returned", 7).alias("returned"), F.round("quantity", 7).alias("quantity"))


STD_SQL = f"{DESIGN_SQL}, std AS (SELECT week, " + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in COLS) + ", y - avg(y) OVER () AS y FROM design)"


@query(f"WITH {STD_SQL} SELECT week, round(y, 7) AS y, " + ", ".join(f"round({c}, 6) AS {c}" for c in COLS) + " FROM std")
def standardised_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = factors.standardised(the_design(spark, sf_dir).withColumn("k", F.lit(1)), ["k"], COLS, "y")
    return got.select("week", F.round("y", 7).alias("y"), *[F.round(c, 6).alias(c) for c in COLS])


@query(f"WITH {STD_SQL} SELECT round(greatest({', '.join(f'abs(sum({c} * y))' for c in COLS)}) / (count(*) * 0.5), 8) AS lambda_max FROM std")
def elastic_net_lambda_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    std = factors.standardised(the_design(spark, sf_dir).withColumn("k", F.lit(1)), ["k"], COLS, "y")
    return rounded(factors.max_penalty(std, ["k"], COLS, "y").drop("k"))


@query(f"""WITH {DESIGN_SQL}, b AS (SELECT week, y, CASE WHEN count(y) OVER w = 156 THEN avg(y) OVER w END AS benchmark FROM design WINDOW w AS (ORDER BY week ROWS BETWEEN 156 PRECEDING AND 1 PRECEDING))
    SELECT week, round(y, 7) AS y, round(benchmark, 8) AS benchmark FROM b WHERE benchmark IS NOT NULL""")
def oos_benchmark_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = factors.rolling_benchmark(the_design(spark, sf_dir).withColumn("k", F.lit(1)), ["k"], 156).where("benchmark IS NOT NULL")
    return got.select("week", F.round("y", 7).alias("y"), F.round("benchmark", 8).alias("benchmark"))


@query()
def elastic_net_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors.loadings(the_design(spark, sf_dir), COLS, draws=100)


def monthly(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    """(month, value): log changes of monthly means; a month without a positive mean has none."""
    orders = derived.table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status)
    m = orders.groupBy(F.trunc("o_orderdate", "MM").alias("month")).agg(F.avg("o_totalprice").alias("m"))
    v = F.when(F.col("m") > 0, F.ln("m"))
    return m.select("month", (v - F.lag(v, 1).over(Window.orderBy("month"))).alias("value")).where("value IS NOT NULL")


def _monthly(name: str, status: str) -> str:
    return f"""{name} AS (SELECT month, v - lag(v) OVER (ORDER BY month) AS value FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, ln(avg(o_totalprice)) AS v FROM orders WHERE o_orderstatus = '{status}' GROUP BY 1))"""


@query(f"WITH {_monthly('a', 'F')} SELECT month, round(value, 8) AS value FROM a WHERE value IS NOT NULL")
def monthly_log_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(monthly(spark, sf_dir, "F"))


def projection(spark: SparkSession, sf_dir: str, horizon: int = 3, lags: int = 2) -> DataFrame:
    shock = monthly(spark, sf_dir, "F").withColumnRenamed("value", "shock")
    response = monthly(spark, sf_dir, "O").withColumnRenamed("value", "response")
    return factors.projection_design(shock, response, horizon, lags)


@query(f"""WITH {_monthly('a', 'F')}, {_monthly('b', 'O')}, j AS (SELECT coalesce(a.month, b.month) AS month, a.value AS shock, b.value AS response
        FROM (SELECT * FROM a WHERE value IS NOT NULL) a FULL JOIN (SELECT * FROM b WHERE value IS NOT NULL) b ON a.month = b.month),
    x AS (SELECT month, CASE WHEN count(response) OVER f = 3 THEN sum(response) OVER f END AS y, shock, lag(shock, 1) OVER w AS shock_1, lag(shock, 2) OVER w AS shock_2,
                 lag(response, 1) OVER w AS response_1, lag(response, 2) OVER w AS response_2
          FROM j WINDOW w AS (ORDER BY month), f AS (ORDER BY month ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))
    SELECT month, round(y, 8) AS y, round(shock, 8) AS shock, round(shock_1, 8) AS shock_1, round(shock_2, 8) AS shock_2, round(response_1, 8) AS response_1, round(response_2, 8) AS response_2
    FROM x WHERE y IS NOT NULL AND shock IS NOT NULL AND shock_1 IS NOT NULL AND shock_2 IS NOT NULL AND response_1 IS NOT NULL AND response_2 IS NOT NULL""")
def local_projection_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(projection(spark, sf_dir))


@query()
def local_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses at horizons 0 to 6 with HAC errors."""
    rows = [(h, *(got[k] for k in ("beta", "se", "n"))) for h in range(7) if (got := factors.project(projection(spark, sf_dir, h), h))]
    return spark.createDataFrame(rows, "horizon int, beta double, se double, n int")


@query()
def chain_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two links multiplied, with the band of a joint bootstrap of months."""
    first, second = projection(spark, sf_dir, 1, 1), factors.projection_design(
        monthly(spark, sf_dir, "O").withColumnRenamed("value", "shock"), monthly(spark, sf_dir, "F").withColumnRenamed("value", "response"), 1, 1
    )
    frames = [df.orderBy("month").drop("month").toPandas().to_numpy(float) for df in (first, second)]
    n = min(map(len, frames))
    frames = [f[-n:] for f in frames]
    point = float(np.prod([factors.ols_hac(np.c_[f[:, 1:], np.ones(n)], f[:, 0])[0][0] for f in frames]))
    stars = factors.chain_bootstrap(frames, point, 200, 6, spark)
    band = stars.agg(F.percentile("product", F.lit(0.025)).alias("low"), F.percentile("product", F.lit(0.975)).alias("high"))
    return band.select(F.lit(point).alias("point"), "low", "high", ((F.col("low") <= 0) & (F.col("high") >= 0)).alias("spans_zero"))


@query()
def rolling_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the loadings vary over windows of 156 weeks refitted every 4, beside the bootstrap's band."""
    d = the_design(spark, sf_dir)
    return attribution.stability(attribution.rolling_loadings(d, COLS), factors.loadings(d, COLS, draws=100))


@query()
def walkforward_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R squared out of sample against the window's mean, drivers of the same week and of the week before."""
    return attribution.both_kinds(the_design(spark, sf_dir), COLS)


@query()
def leave_one_driver_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.leave_one_out(the_design(spark, sf_dir), COLS, [f.name for f in FACTORS if f.required])


IDENTITY_SQL = """m AS (SELECT o_orderstatus AS status, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, ln(sum(o_totalprice)) AS t, ln(avg(o_totalprice)) AS a, ln(count(*)) AS n
        FROM orders GROUP BY 1, 2),
    d AS (SELECT status, month, t - lag(t) OVER w AS total, a - lag(a) OVER w AS price, n - lag(n) OVER w AS orders FROM m WINDOW w AS (PARTITION BY status ORDER BY month)),
    x AS (SELECT *, lag(price) OVER (PARTITION BY status ORDER BY month) AS stale FROM d),
    y AS (SELECT status, 'now' AS of, total AS y, price AS a, orders AS b FROM x WHERE total IS NOT NULL UNION ALL
          SELECT status, 'stale', total, stale, orders FROM x WHERE stale IS NOT NULL),
    c AS (SELECT status, of, count(*) AS months, covar_pop(a, a) AS aa, covar_pop(b, b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS bee, covar_pop(y, y) AS yy FROM y GROUP BY 1, 2 HAVING count(*) >= 24),
    s AS (SELECT *, (ay * bb - bee * ab) / (aa * bb - ab * ab) AS ca, (bee * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM c)"""


@query(f"""WITH {IDENTITY_SQL} SELECT status, of, months, round((ca * ay + cb * bee) / yy, 5) AS r2, part, round(CASE part WHEN 'price' THEN ca ELSE cb END, 4) AS elasticity
    FROM s, (VALUES ('price'), ('orders')) p(part)""")
def identity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month's total is price times orders, so both elasticities are one; with the price of the month before they are not."""
    orders = derived.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.trunc("o_orderdate", "MM").alias("month"), "o_totalprice")
    m = orders.groupBy("status", "month").agg(F.ln(F.sum("o_totalprice")).alias("y"), F.ln(F.avg("o_totalprice")).alias("price"), F.ln(F.count(F.lit(1))).alias("orders"))
    w = Window.partitionBy("status").orderBy("month")
    d = m.select("status", "month", *[(F.col(c) - F.lag(c).over(w)).alias(c) for c in ("y", "price", "orders")])
    both = d.withColumn("of", F.lit("now")).unionByName(d.withColumn("price", F.lag("price").over(w)).withColumn("of", F.lit("stale")))
    got = attribution.identity_check(both, ["status", "of"], ["price", "orders"])
    return got.withColumn("r2", F.round("r2", 5)).withColumn("elasticity", F.round("elasticity", 4))


def orthogonalised(spark: SparkSession, sf_dir: str, horizon: int = 3, lags: int = 1) -> DataFrame:
    """The projection with the monthly change of shipped quantity held constant."""
    items = derived.table(spark, sf_dir, "lineitem").groupBy(F.trunc("l_shipdate", "MM").alias("month")).agg(F.ln(F.avg("l_quantity")).alias("v"))
    held = items.select("month", (F.col("v") - F.lag("v").over(Window.orderBy("month"))).alias("quantity")).where("quantity IS NOT NULL")
    shock = monthly(spark, sf_dir, "F").withColumnRenamed("value", "shock")
    response = monthly(spark, sf_dir, "O").withColumnRenamed("value", "response")
    return factors.projection_design(shock, response, horizon, lags, controls=held)


@query(f"""WITH {_monthly('a', 'F')}, {_monthly('b', 'O')},
    c AS (SELECT month, v - lag(v) OVER (ORDER BY month) AS quantity FROM (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, ln(avg(l_quantity)) AS v FROM lineitem GROUP BY 1)),
    j AS (SELECT month, any_value(shock) AS shock, any_value(response) AS response, any_value(quantity) AS quantity FROM (
        SELECT month, value AS shock, NULL::DOUBLE AS response, NULL::DOUBLE AS quantity FROM a WHERE value IS NOT NULL UNION ALL
        SELECT month, NULL, value, NULL FROM b WHERE value IS NOT NULL UNION ALL SELECT month, NULL, NULL, quantity FROM c WHERE quantity IS NOT NULL) GROUP BY 1),
    x AS (SELECT month, CASE WHEN count(response) OVER f = 3 THEN sum(response) OVER f END AS y, shock, lag(shock) OVER w AS shock_1, lag(response) OVER w AS response_1, quantity
          FROM j WINDOW w AS (ORDER BY month), f AS (ORDER BY month ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))
    SELECT month, round(y, 8) AS y, round(shock, 8) AS shock, round(shock_1, 8) AS shock_1, round(response_1, 8) AS response_1, round(quantity, 8) AS quantity
    FROM x WHERE y IS NOT NULL AND shock IS NOT NULL AND shock_1 IS NOT NULL AND response_1 IS NOT NULL AND quantity IS NOT NULL""")
def orthogonalised_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(orthogonalised(spark, sf_dir))


@query()
def orthogonalised_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses at horizons 0 to 6 with quantity held constant."""
    rows = [(h, *(got[k] for k in ("beta", "se", "n"))) for h in range(7) if (got := factors.project(orthogonalised(spark, sf_dir, h), h))]
    return spark.createDataFrame(rows, "horizon int, beta double, se double, n int")
