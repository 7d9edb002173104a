"""Scores, coverage, reliability, significance and model comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import inference, paths, scoring
from . import ensembles, volatility
from .ensembles import KEY, PATHS_SQL, PROB_SQL, REAL_SQL
from .registry import query
from .series import rounded
from .volatility import BREACH_SQL

SM = ["series_id", "model"]
EDGES = scoring.EDGES
DRAWS, BLOCK = 200, 3
BIN_SQL = "(" + " + ".join(f"(CASE WHEN {{0}} >= {e!r} THEN 1 ELSE 0 END)" for e in EDGES[1:-1]) + ")"

RANKED_SQL = f"""{PATHS_SQL}, {REAL_SQL},
    rk AS (SELECT r.*, t.y, row_number() OVER (PARTITION BY r.series_id, r.pos, r.model ORDER BY terminal) AS i, count(*) OVER (PARTITION BY r.series_id, r.pos, r.model) AS m
           FROM red r JOIN truth t ON t.series_id = r.series_id AND t.pos = r.pos),
    crps AS (SELECT series_id, pos, model, avg(abs(terminal - y)) - sum((2 * i - m - 1) * terminal) / (any_value(m) * (any_value(m) - 1)) AS crps,
                    (count(*) FILTER (WHERE terminal < y) + ((pos * 1103515245 + 7 * 12345 + 11 * 2654435761) % 2147483648) / 2147483648.0::DOUBLE * (count(*) FILTER (WHERE terminal = y) + 1)) / (count(*) + 1) AS pit,
                    any_value(y) < quantile_cont(terminal, 0.05) AS breach
             FROM rk GROUP BY 1, 2, 3)"""


def off_ties(df: DataFrame) -> DataFrame:
    """Rounded, after a nudge: shares of a few paths have short decimals that end on a tie."""
    return rounded(df.select(*[(F.col(c) + 1e-10).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]))


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, pos, model, crps, pit, breach): one row for each forecast."""
    red = paths.reduced(ensembles.ensemble(spark, sf_dir))
    packed = red.groupBy(*KEY).agg(F.collect_list("terminal").alias("v"), F.percentile("terminal", F.lit(0.05)).alias("q"))
    both = packed.join(ensembles.truth(spark, sf_dir).select("series_id", "pos", "y"), ["series_id", "pos"])
    u = paths.lcg(F.col("pos"), F.lit(7).cast("long"), F.lit(11).cast("long")) / 2147483648.0
    return both.select(*KEY, scoring.crps_fair(F.col("v"), F.col("y")).alias("crps"), scoring.pit(F.col("v"), F.col("y"), u).alias("pit"), (F.col("y") < F.col("q")).alias("breach"))


@query(f"WITH {RANKED_SQL} SELECT series_id, pos, model, round(crps, 4) AS crps FROM crps")
def crps_fair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graded(spark, sf_dir).select(*KEY, "crps"), 4)


@query(f"WITH {RANKED_SQL}, x AS (SELECT series_id, model, avg(crps) AS c FROM crps GROUP BY 1, 2) SELECT x.series_id, x.model, round(1 - x.c / b.c, 8) AS skill FROM x JOIN x b ON b.series_id = x.series_id AND b.model = 0 WHERE x.model > 0")
def crps_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = graded(spark, sf_dir).groupBy(*SM).agg(F.avg("crps").alias("c"))
    base = mean.withColumn("b", F.max(F.when(F.col("model") == 0, F.col("c"))).over(Window.partitionBy("series_id")))
    return rounded(base.where("model > 0").select("series_id", "model", (1 - F.col("c") / F.col("b")).alias("skill")))


@query(f"WITH {RANKED_SQL} SELECT series_id, pos, model, round(pit, 9) AS pit FROM crps")
def pit_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graded(spark, sf_dir).select(*KEY, "pit"), 9)


HIST_SQL = f"""hist AS (SELECT k.series_id, k.model, k.bin, count(c.pit) AS n FROM (SELECT DISTINCT series_id, model, bin FROM crps, range(10) t(bin)) k
    LEFT JOIN crps c ON c.series_id = k.series_id AND c.model = k.model AND {BIN_SQL.format("c.pit")} = k.bin GROUP BY 1, 2, 3)"""


@query(f"WITH {RANKED_SQL}, {HIST_SQL} SELECT series_id, model, bin, n FROM hist")
def pit_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.histogram(graded(spark, sf_dir), SM, "pit")


@query(f"""WITH {RANKED_SQL}, x AS (SELECT series_id, model, pit, row_number() OVER (PARTITION BY series_id, model ORDER BY pit) AS i, count(*) OVER (PARTITION BY series_id, model) AS n FROM crps)
    SELECT series_id, model, round(max(greatest(i / CAST(n AS DOUBLE) - pit, pit - (i - 1) / CAST(n AS DOUBLE))), 8) AS d, count(*) AS n FROM x GROUP BY 1, 2""")
def pit_ks_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.ks_distance(graded(spark, sf_dir), SM, "pit"))


@query(f"""WITH {RANKED_SQL}, {HIST_SQL}, x AS (SELECT *, sum(n) OVER (PARTITION BY series_id, model) / 10.0::DOUBLE AS e FROM hist)
    SELECT series_id, model, round(sum((n - e) ** 2 / e), 8) AS statistic, round(any_value(e), 8) AS expected, any_value(e) < 5 AS underpowered FROM x GROUP BY 1, 2""")
def pit_chi2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.chi2_uniform(graded(spark, sf_dir), SM, "pit"))


def _ll(k: str, n: str, p: str) -> str:
    return f"((CASE WHEN {n} - {k} = 0 THEN 0 ELSE ({n} - {k}) * ln(1 - ({p})) END) + (CASE WHEN {k} = 0 THEN 0 ELSE {k} * ln({p}) END))"


K_SQL = f"kc AS (SELECT series_id, count(*) AS n, count_if(breach) AS k FROM breach GROUP BY 1), kup AS (SELECT series_id, n, k AS breaches, greatest(-2 * ({_ll('k', 'n', '0.05')} - {_ll('k', 'n', 'k / CAST(n AS DOUBLE)')}), 0) AS statistic FROM kc)"


@query(f"WITH {BREACH_SQL}, {K_SQL} SELECT series_id, n, CAST(breaches AS BIGINT) AS breaches, round(statistic, 7) AS statistic FROM kup")
def kupiec_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.kupiec(volatility.breaches(spark, sf_dir), ["series_id"], 0.05), 7)


C_SQL = f"""tr AS (SELECT series_id, breach AS now, lag(breach) OVER (PARTITION BY series_id ORDER BY date) AS prev FROM breach),
    cn AS (SELECT series_id, count_if(NOT prev AND NOT now) AS n00, count_if(NOT prev AND now) AS n01, count_if(prev AND NOT now) AS n10, count_if(prev AND now) AS n11
           FROM tr WHERE prev IS NOT NULL GROUP BY 1),
    chr AS (SELECT *, CASE WHEN n10 + n11 > 0 THEN greatest(-2 * ({_ll('(n01 + n11)', '(n00 + n01 + n10 + n11)', '(n01 + n11) / CAST(n00 + n01 + n10 + n11 AS DOUBLE)')}
        - {_ll('n01', '(n00 + n01)', 'CASE WHEN n00 + n01 > 0 THEN n01 / CAST(n00 + n01 AS DOUBLE) ELSE 0 END')} - {_ll('n11', '(n10 + n11)', 'n11 / CAST(nullif(n10 + n11, 0) AS DOUBLE)')}), 0) END AS statistic FROM cn)"""


@query(f"WITH {BREACH_SQL}, {C_SQL} SELECT series_id, CAST(n00 AS BIGINT) AS n00, CAST(n01 AS BIGINT) AS n01, CAST(n10 AS BIGINT) AS n10, CAST(n11 AS BIGINT) AS n11, round(statistic, 7) AS statistic FROM chr")
def christoffersen_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.christoffersen(volatility.breaches(spark, sf_dir), ["series_id"]), 7)


@query(f"WITH {BREACH_SQL}, {K_SQL}, {C_SQL} SELECT k.series_id, round(k.statistic + c.statistic, 7) AS statistic, round(exp(-(k.statistic + c.statistic) / 2), 7) AS p_value FROM kup k JOIN chr c ON c.series_id = k.series_id")
def conditional_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = volatility.breaches(spark, sf_dir)
    k = scoring.kupiec(b, ["series_id"], 0.05).select("series_id", F.col("statistic").alias("k"))
    both = scoring.christoffersen(b, ["series_id"]).select("series_id", F.col("statistic").alias("c")).join(k, "series_id").withColumn("statistic", F.col("k") + F.col("c"))
    return rounded(both.select("series_id", "statistic", scoring.conditional_coverage_p(F.col("statistic")).alias("p_value")), 7)


EV = ["series_id", "model", "event_id"]


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, pos, model, event_id, p, y)."""
    outcome = ensembles.outcome_table(spark, sf_dir).withColumn("y", F.col("occurred").cast("double")).drop("occurred")
    return ensembles.event_table(spark, sf_dir).join(outcome, ["series_id", "pos", "event_id"])


@query(f"WITH {PROB_SQL} SELECT series_id, model, event_id, round(avg((p - y) ** 2) + 1e-10, 8) AS brier FROM ev GROUP BY 1, 2, 3")
def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return off_ties(forecasts(spark, sf_dir).groupBy(*EV).agg(F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2.0))).alias("brier")))


@query(f"""WITH {PROB_SQL}, ok AS (SELECT series_id, model, event_id FROM ev GROUP BY 1, 2, 3 HAVING sum(y) >= 10),
    b AS (SELECT *, {BIN_SQL.format("p")} AS bin FROM ev), k AS (SELECT * FROM ok, range(10) t(bin))
    SELECT k.series_id, k.model, k.event_id, k.bin, count(b.p) AS n, round(avg(b.p) + 1e-10, 8) AS forecast, round(avg(b.y) + 1e-10, 8) AS observed
    FROM k LEFT JOIN b ON b.series_id = k.series_id AND b.model = k.model AND b.event_id = k.event_id AND b.bin = k.bin GROUP BY 1, 2, 3, 4""")
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return off_ties(scoring.reliability_bins(forecasts(spark, sf_dir), EV))


@query(f"""WITH {PROB_SQL}, b AS (SELECT *, {BIN_SQL.format("p")} AS bin, avg(y) OVER (PARTITION BY series_id, model, event_id) AS base FROM ev),
    c AS (SELECT series_id, model, event_id, bin, count(*) AS c, avg(p) AS f, avg(y) AS o, any_value(base) AS base, sum((p - y) ** 2) AS se FROM b GROUP BY 1, 2, 3, 4),
    m AS (SELECT series_id, model, event_id, CAST(sum(c) AS BIGINT) AS n, sum(se) / sum(c) AS brier, sum(c * (f - o) ** 2) / sum(c) AS reliability, sum(c * (o - base) ** 2) / sum(c) AS resolution, any_value(base) AS base_rate FROM c GROUP BY 1, 2, 3)
    SELECT series_id, model, event_id, n, round(brier + 1e-10, 8) AS brier, round(reliability + 1e-10, 8) AS reliability, round(resolution + 1e-10, 8) AS resolution, round(base_rate + 1e-10, 8) AS base_rate,
           round(base_rate * (1 - base_rate) + 1e-10, 8) AS uncertainty, round(brier - (reliability - resolution + base_rate * (1 - base_rate)) + 1e-10, 7) + 0 AS binning_error FROM m""")
def murphy_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scoring.murphy(forecasts(spark, sf_dir), EV, scoring.bin_of(F.col("p")))
    error = got.select(*EV, (F.round(F.col("binning_error") + 1e-10, 7) + F.lit(0.0)).alias("binning_error"))
    return off_ties(got.drop("binning_error")).join(error, EV)


D_SQL = f"{RANKED_SQL}, dd AS (SELECT c.series_id, c.pos, c.model, c.crps - b.crps AS d FROM crps c JOIN crps b ON b.series_id = c.series_id AND b.pos = c.pos AND b.model = 0 WHERE c.model > 0)"


def differentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graded(spark, sf_dir).withColumn("b", F.max(F.when(F.col("model") == 0, F.col("crps"))).over(Window.partitionBy("series_id", "pos")))
    return g.where("model > 0").select(*KEY, (F.col("crps") - F.col("b")).alias("d"))


def _dm(overlap: int, source: str) -> str:
    lag = overlap - 1
    lags = ", ".join(f"c * lag(c, {k}) OVER (PARTITION BY series_id, model ORDER BY pos) AS g{k}" for k in range(lag + 1))
    var = " + ".join(["sum(g0)"] + [f"2 * {1 - k / (lag + 1)!r} * sum(g{k})" for k in range(1, lag + 1)])
    return f"""c AS (SELECT *, d - avg(d) OVER (PARTITION BY series_id, model) AS c FROM {source}), g AS (SELECT *, {lags} FROM c),
        v AS (SELECT series_id, model, count(*) AS n, avg(d) AS mean, ({var}) / count(*) AS var FROM g GROUP BY 1, 2)
        SELECT series_id, model, n, round(mean, 6) AS mean, CASE WHEN var > 0 THEN round(mean / sqrt(var / n) * sqrt((n + 1 - 2 * {overlap} + {overlap * (overlap - 1)} / CAST(n AS DOUBLE)) / n), 7) END AS statistic FROM v"""


def _dm_rounded(df: DataFrame) -> DataFrame:
    return df.select("series_id", "model", "n", F.round("mean", 6).alias("mean"), F.round("statistic", 7).alias("statistic"))


@query(f"WITH {D_SQL}, {_dm(3, 'dd')}")
def dm_stat_hac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dm_rounded(scoring.diebold_mariano(differentials(spark, sf_dir), SM, 3))


@query(f"WITH {D_SQL}, th AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY series_id, model ORDER BY pos) - 1 AS k FROM dd) WHERE k % 3 = 0), {_dm(1, 'th')}")
def dm_stat_thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dm_rounded(scoring.diebold_mariano(scoring.thin(differentials(spark, sf_dir), SM, 3), SM, 1))


@query()
def skill_test_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tests of each model against the first; the p of t(n - 1) is not SQL."""
    return scoring.skill_test(differentials(spark, sf_dir), SM, BLOCK)


HS = [1, 3, 5]
H_SQL = f"""{PATHS_SQL}, hp AS (SELECT series_id, pos, model, path, step + 1 AS h, price AS x FROM walked WHERE step + 1 IN ({", ".join(map(str, HS))})),
    ht AS (SELECT series_id, pos, {", ".join(f"lead(px, {h}) OVER (PARTITION BY series_id ORDER BY date) AS y{h}" for h in HS)} FROM p),
    hr AS (SELECT hp.*, CASE h {" ".join(f"WHEN {h} THEN y{h}" for h in HS)} END AS y, row_number() OVER (PARTITION BY hp.series_id, hp.pos, hp.model, h ORDER BY x) AS i,
                  count(*) OVER (PARTITION BY hp.series_id, hp.pos, hp.model, h) AS m FROM hp JOIN ht ON ht.series_id = hp.series_id AND ht.pos = hp.pos),
    hc AS (SELECT series_id, pos, model, h, avg(abs(x - y)) - sum((2 * i - m - 1) * x) / (any_value(m) * (any_value(m) - 1)) AS crps,
                  (count(*) FILTER (WHERE x < y) + 0.5 * (count(*) FILTER (WHERE x = y) + 1)) / (count(*) + 1) AS pit FROM hr GROUP BY 1, 2, 3, 4)"""


def by_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, pos, model, h, crps, pit) at each of the horizons."""
    e = ensembles.ensemble(spark, sf_dir)
    packed = e.groupBy(*KEY).agg(*[F.collect_list(F.element_at("prices", h)).alias(f"v{h}") for h in HS])
    ahead = ensembles.at(spark, sf_dir).select("series_id", "pos", *[F.element_at("ps", (F.col("pos") + 1 + h).cast("int")).alias(f"y{h}") for h in HS])
    both = packed.join(ahead, ["series_id", "pos"])
    half = F.lit(0.5)
    cells = F.explode(F.array(*[F.struct(F.lit(h).cast("long").alias("h"), scoring.crps_fair(F.col(f"v{h}"), F.col(f"y{h}")).alias("crps"), scoring.pit(F.col(f"v{h}"), F.col(f"y{h}"), half).alias("pit")) for h in HS]))
    return both.select(*KEY, cells.alias("c")).select(*KEY, "c.*")


@query(f"""WITH {H_SQL}, s AS (SELECT series_id, model, h, avg(crps) AS c FROM hc GROUP BY 1, 2, 3),
    k AS (SELECT s.series_id, s.model, s.h, 1 - s.c / b.c AS skill FROM s JOIN s b ON b.series_id = s.series_id AND b.h = s.h AND b.model = 0 WHERE s.model > 0)
    SELECT series_id, model, round(regr_slope(skill, ln(h)), 7) AS slope, round(regr_intercept(skill, ln(h)), 7) AS intercept FROM k GROUP BY 1, 2""")
def skill_decay_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = by_horizon(spark, sf_dir).groupBy("series_id", "model", "h").agg(F.avg("crps").alias("c"))
    s = s.withColumn("b", F.max(F.when(F.col("model") == 0, F.col("c"))).over(Window.partitionBy("series_id", "h"))).where("model > 0")
    s = s.withColumn("skill", 1 - F.col("c") / F.col("b")).withColumn("x", F.ln("h"))
    return rounded(s.groupBy(*SM).agg(F.regr_slope("skill", "x").alias("slope"), F.regr_intercept("skill", "x").alias("intercept")), 7)


@query()
def skill_decay_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decay of each model's skill over the first's, with a bootstrap over dates of the reference's 5000 draws."""
    h = by_horizon(spark, sf_dir).select(*KEY, "h", "crps")
    base = F.max(F.when(F.col("model") == 0, F.col("crps"))).over(Window.partitionBy("series_id", "pos", "h"))
    both = h.withColumn("b", base).withColumnRenamed("crps", "m").where("model > 0")
    return scoring.decay_test(both, SM, 5000, BLOCK)


@query(f"""WITH {H_SQL}, s AS (SELECT series_id, model, h, avg(pit) - 0.5 AS m FROM hc GROUP BY 1, 2, 3)
    SELECT series_id, model, round(sum(m * sqrt(h)) / sum(h), 7) AS slope,
        round(1 - sum((m - b * sqrt(h)) ** 2) / nullif(sum(m * m), 0), 6) AS r2 FROM (SELECT *, sum(m * sqrt(h)) OVER (PARTITION BY series_id, model) / sum(h) OVER (PARTITION BY series_id, model) AS b FROM s) GROUP BY 1, 2""")
def drift_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = by_horizon(spark, sf_dir).groupBy("series_id", "model", "h").agg((F.avg("pit") - 0.5).alias("m"))
    w = Window.partitionBy(*SM)
    s = s.withColumn("b", F.sum(F.col("m") * F.sqrt("h")).over(w) / F.sum("h").over(w)).withColumn("e", F.col("m") - F.col("b") * F.sqrt("h"))
    got = s.groupBy(*SM).agg(F.first("b").alias("slope"), (1 - F.sum(F.col("e") * F.col("e")) / F.nullif(F.sum(F.col("m") * F.col("m")), F.lit(0.0))).alias("r2"))
    return got.select(*SM, F.round("slope", 7).alias("slope"), F.round("r2", 6).alias("r2"))


def binomial_tail(f: DataFrame) -> DataFrame:
    """(series_id, seen, at_least, at_most) of the forecasts (series_id, pos, p, y) of each series."""
    numbered = f.withColumn("i", F.row_number().over(Window.partitionBy("series_id").orderBy("pos")))
    packed = numbered.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda x: x["p"]).alias("ps"), F.sum("y").cast("long").alias("seen"))
    zero = F.array(F.lit(0.0))

    def convolve(pmf: F.Column, p: F.Column) -> F.Column:
        return F.zip_with(F.concat(F.transform(pmf, lambda v: v * (1 - p)), zero), F.concat(zero, F.transform(pmf, lambda v: v * p)), lambda a, b: a + b)

    got = packed.withColumn("pmf", F.aggregate("ps", F.array(F.lit(1.0)), convolve))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    seen = F.col("seen").cast("int")
    return rounded(got.select("series_id", "seen", total(F.slice("pmf", seen + 1, F.size("pmf"))).alias("at_least"), total(F.slice("pmf", F.lit(1), seen + 1)).alias("at_most")))


@query(f"""WITH RECURSIVE {PROB_SQL}, e AS (SELECT series_id, p, row_number() OVER (PARTITION BY series_id ORDER BY pos) AS i FROM ev WHERE model = 1 AND event_id = 'touch_below_0.1'),
    f AS (SELECT series_id, p, i FROM e),
    o AS (SELECT series_id, CAST(sum(y) AS BIGINT) AS seen FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY pos) AS i FROM ev WHERE model = 1 AND event_id = 'touch_below_0.1') GROUP BY 1),
    r AS (SELECT DISTINCT series_id, CAST(0 AS BIGINT) AS i, [CAST(1 AS DOUBLE)] AS pmf FROM f
          UNION ALL SELECT r.series_id, f.i, list_transform(range(0, len(r.pmf) + 1), lambda k: (CASE WHEN k < len(r.pmf) THEN r.pmf[k + 1] * (1 - f.p) ELSE 0 END) + (CASE WHEN k > 0 THEN r.pmf[k] * f.p ELSE 0 END))
          FROM r JOIN f ON f.series_id = r.series_id AND f.i = r.i + 1),
    l AS (SELECT series_id, max_by(pmf, i) AS pmf FROM r GROUP BY 1)
    SELECT l.series_id, o.seen, round(list_sum(l.pmf[o.seen + 1:]), 8) AS at_least, round(list_sum(l.pmf[:o.seen + 1]), 8) AS at_most FROM l JOIN o ON o.series_id = l.series_id""")
def poisson_binomial_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On every forecast of each series."""
    return binomial_tail(forecasts(spark, sf_dir).where("model = 1 AND event_id = 'touch_below_0.1'"))


# many models

N_SQL = f"{D_SQL}, nd AS (SELECT series_id, model, -d AS d, row_number() OVER (PARTITION BY series_id, model ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY series_id, model) AS n FROM dd)"
STUD_SQL = f"""cc AS (SELECT *, d - avg(d) OVER (PARTITION BY series_id, model) AS c FROM nd),
    gg AS (SELECT *, c * c AS g0, {", ".join(f"c * lag(c, {k}) OVER (PARTITION BY series_id, model ORDER BY i) AS g{k}" for k in range(1, BLOCK))} FROM cc),
    sv AS (SELECT series_id, model, any_value(n) AS n, avg(d) AS mean, greatest((sum(g0) + {" + ".join(f"2 * {1 - k / BLOCK!r} * sum(g{k})" for k in range(1, BLOCK))}) / any_value(n), 1e-300) AS var FROM gg GROUP BY 1, 2),
    st AS (SELECT *, sqrt(var / n) AS scale, mean / sqrt(var / n) AS t, CASE WHEN mean >= -sqrt(2 * var * ln(ln(n)) / n) THEN mean ELSE 0 END AS recentred FROM sv)"""


def boot_sql(source: str) -> str:
    return f"""bs AS (SELECT k.series_id, draw, ((draw * 1103515245 + (j // {BLOCK}) * 12345 + 2654435761) % 2147483648 % k.n + j % {BLOCK}) % k.n AS i
        FROM (SELECT DISTINCT series_id, n FROM {source}) k, range({DRAWS}) t(draw), LATERAL (SELECT unnest(range(k.n)) AS j)),
    bm AS (SELECT bs.series_id, draw, v.model, avg(v.d) AS mean FROM bs JOIN {source} v ON v.series_id = bs.series_id AND v.i = bs.i GROUP BY 1, 2, 3)"""


def against_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.numbered(differentials(spark, sf_dir).withColumn("d", -F.col("d")), ["series_id"])


@query(f"WITH {N_SQL}, {STUD_SQL} SELECT series_id, round(greatest(max(t), 0), 7) AS statistic, CASE WHEN max(t) > 0 THEN max_by(model, t) END AS best FROM st GROUP BY 1")
def spa_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = inference.studentised(against_benchmark(spark, sf_dir), ["series_id"], BLOCK)
    got = each.groupBy("series_id").agg(F.round(F.greatest(F.max("t"), F.lit(0.0)), 7).alias("statistic"), F.max("t").alias("top"), F.max_by("model", "t").alias("best"))
    return got.select("series_id", "statistic", F.when(F.col("top") > 0, F.col("best")).alias("best"))


@query(f"""WITH {N_SQL}, {STUD_SQL}, {boot_sql("nd")}, top AS (SELECT series_id, greatest(max(t), 0) AS statistic FROM st GROUP BY 1),
    b AS (SELECT bm.series_id, draw, greatest(max((bm.mean - recentred) / scale), 0) AS c, greatest(max((bm.mean - st.mean) / scale), 0) AS u
          FROM bm JOIN st ON st.series_id = bm.series_id AND st.model = bm.model GROUP BY 1, 2)
    SELECT b.series_id, avg(CASE WHEN c > statistic THEN 1.0 ELSE 0 END)::DOUBLE AS p_consistent, avg(CASE WHEN u > statistic THEN 1.0 ELSE 0 END)::DOUBLE AS p_conservative
    FROM b JOIN top ON top.series_id = b.series_id GROUP BY 1""")
def spa_bootstrap_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.superior_ability(against_benchmark(spark, sf_dir), ["series_id"], DRAWS, BLOCK).select("series_id", "p_consistent", "p_conservative")


L_SQL = f"{RANKED_SQL}, nl AS (SELECT * FROM (SELECT series_id, model, crps AS d, row_number() OVER (PARTITION BY series_id, model ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY series_id, model) AS n FROM crps) WHERE n > 1)"


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = graded(spark, sf_dir).select(*KEY, F.col("crps").alias("d"))
    return inference.numbered(got, ["series_id"]).where("n > 1")  # one window has no variance to studentise by


@query(f"""WITH {L_SQL}, {boot_sql("nl")}, m AS (SELECT series_id, model, avg(d) AS m FROM nl GROUP BY 1, 2), mr AS (SELECT *, m - avg(m) OVER (PARTITION BY series_id) AS rel FROM m),
    s1 AS (SELECT bm.series_id, draw, bm.model, bm.mean - mr.m AS c FROM bm JOIN mr ON mr.series_id = bm.series_id AND mr.model = bm.model),
    s2 AS (SELECT *, c - avg(c) OVER (PARTITION BY series_id, draw) AS rs FROM s1), sc AS (SELECT series_id, model, sqrt(greatest(var_pop(rs), 1e-300)) AS s FROM s2 GROUP BY 1, 2),
    seen AS (SELECT mr.series_id, max(rel / s) AS statistic, max_by(mr.model, rel / s) AS worst FROM mr JOIN sc ON sc.series_id = mr.series_id AND sc.model = mr.model GROUP BY 1),
    nul AS (SELECT s2.series_id, draw, max(rs / s) AS top FROM s2 JOIN sc ON sc.series_id = s2.series_id AND sc.model = s2.model GROUP BY 1, 2)
    SELECT seen.series_id, round(any_value(statistic), 7) AS statistic, any_value(worst) AS worst, avg(CASE WHEN top > statistic THEN 1.0 ELSE 0 END)::DOUBLE AS p
    FROM nul JOIN seen ON seen.series_id = nul.series_id GROUP BY 1""")
def mcs_first_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = inference.elimination_step(losses(spark, sf_dir), ["series_id"], DRAWS, BLOCK)
    return got.select("series_id", F.round("statistic", 7).alias("statistic"), "worst", "p")


@query()
def model_confidence_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.confidence_set(losses(spark, sf_dir), ["series_id"], DRAWS, BLOCK)


UP_SQL = f"{PROB_SQL}, up AS (SELECT series_id, model, pos, p, y FROM ev WHERE event_id = 'direction_up')"
EQ_SQL = "(row_number() OVER (PARTITION BY series_id, model ORDER BY p, pos) - 1) * 10 // count(*) OVER (PARTITION BY series_id, model)"


def up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecasts(spark, sf_dir).where("event_id = 'direction_up'").select(*KEY, "p", "y")


def _resolution_sql(bins: str) -> str:
    return f"""b AS (SELECT *, {bins} AS bin, avg(y) OVER (PARTITION BY series_id, model) AS base FROM up),
        c AS (SELECT series_id, model, bin, count(*) AS c, avg(y) AS o, any_value(base) AS base FROM b GROUP BY 1, 2, 3)
        SELECT series_id, model, round(sum(c * (o - base) ** 2) / sum(c), 8) AS resolution FROM c GROUP BY 1, 2"""


@query(f"WITH {UP_SQL}, {_resolution_sql(BIN_SQL.format('p'))}")
def resolution_equal_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.resolution(up(spark, sf_dir).withColumn("bin", scoring.bin_of(F.col("p"))), SM))


@query(f"WITH {UP_SQL}, {_resolution_sql(EQ_SQL)}")
def resolution_equal_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.resolution(up(spark, sf_dir).withColumn("bin", inference.equal_count_bins(SM, "p", "pos")), SM))


GUARD = 5


def _screen_sql(source: str, by: str) -> str:
    part = ", ".join(f"{{0}}.{b}" for b in by.split(", "))
    join = lambda a, b, keys: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    keys = by.split(", ")
    return f"""rw AS (SELECT *, row_number() OVER (PARTITION BY {by}, model ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY {by}, model) AS n,
            (row_number() OVER (PARTITION BY {by}, model ORDER BY p, pos) - 1) * 10 // count(*) OVER (PARTITION BY {by}, model) AS bin, avg(y) OVER (PARTITION BY {by}, model) AS base FROM {source}),
        sh AS (SELECT DISTINCT {part.format("rw")}, rw.model, rw.n, s FROM rw, LATERAL (SELECT 0 AS s UNION ALL SELECT unnest(range({GUARD}, greatest(rw.n - {GUARD}, {GUARD}) + 1))) WHERE s = 0 OR (s > 0 AND s < rw.n)),
        al AS (SELECT {part.format("a")}, a.model, sh.s, a.bin, b.y, a.base FROM rw a JOIN sh ON {join("sh", "a", [*keys, "model"])} JOIN rw b ON {join("b", "a", [*keys, "model"])} AND b.i = (a.i + sh.s) % a.n),
        ce AS (SELECT {by}, model, s, bin, count(*) AS c, avg(y) AS o, any_value(base) AS base FROM al GROUP BY {by}, model, s, bin),
        ra AS (SELECT {by}, model, s, sum(c * (o - base) ** 2) / sum(c) AS res FROM ce GROUP BY {by}, model, s),
        nu AS (SELECT {by}, model, avg(res) AS centre, stddev_pop(res) AS spread FROM ra WHERE s > 0 GROUP BY {by}, model),
        zz AS (SELECT ra.*, CASE WHEN spread > 1e-12 THEN (res - centre) / spread ELSE 0 END AS z FROM ra JOIN nu ON {join("nu", "ra", [*keys, "model"])}),
        tp AS (SELECT {by}, s, max(z) AS top, min_by(model, struct_pack(z := 0.0 - round(z, 9), m := model)) AS best FROM zz GROUP BY {by}, s),
        se AS (SELECT {by}, top AS statistic, best FROM tp WHERE s = 0)
        SELECT {part.format("se")}, round(any_value(statistic), 6) AS statistic, any_value(se.best) AS best, count(*) AS draws,
               (1.0 + count_if(top >= statistic - 1e-12)) / (1.0 + count(*)) AS p_value
        FROM se JOIN tp ON {join("tp", "se", keys)} AND tp.s > 0 GROUP BY {part.format("se")}"""


@query(f"WITH {UP_SQL}, {_screen_sql('up', 'series_id')}")
def resolution_screen_cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = inference.cyclic_screen(up(spark, sf_dir), ["series_id"], GUARD, equal_count=True)
    return got.withColumn("statistic", F.round("statistic", 6))


YEARS_SQL = f"""{UP_SQL}, yr AS (SELECT up.*, year(a.date) AS yr FROM up JOIN a ON a.series_id = up.series_id AND a.pos = up.pos WHERE model < 2),
    lo AS (SELECT d.left_out, yr.series_id, model, yr.pos, p, y FROM yr JOIN (SELECT DISTINCT series_id, yr AS left_out FROM yr) d ON d.series_id = yr.series_id AND d.left_out <> yr.yr)"""


@query(f"WITH {YEARS_SQL}, {_screen_sql('lo', 'series_id, left_out')}")
def leave_one_year_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = ensembles.at(spark, sf_dir).select("series_id", "pos", F.year(F.element_at("dates", (F.col("pos") + 1).cast("int"))).cast("long").alias("yr"))
    rows = up(spark, sf_dir).where("model < 2").join(dates, ["series_id", "pos"])
    years = rows.select("series_id", F.col("yr").alias("left_out")).distinct()
    held = rows.join(years, "series_id").where("left_out <> yr").select("left_out", *KEY, "p", "y")
    return inference.cyclic_screen(held, ["series_id", "left_out"], GUARD, equal_count=True).withColumn("statistic", F.round("statistic", 6))
