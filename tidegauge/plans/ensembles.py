"""Path ensembles and the events read off them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import paths, returns
from ..operators.paths import Model
from ..sources import derived
from ..sources.derived import BARS_SQL, RATE_SQL
from .registry import query
from .series import RET_SQL, rounded

BY = ["series_id"]
KEY = ["series_id", "pos", "model"]
HORIZON, PATHS, FIRST, STEP = 5, 40, 250, 20
MODELS = [Model(0, 1), Model(1, 5), Model(2, 10)]
MOVES = [0.05, 0.10]

P_SQL = f"""{BARS_SQL}, {RET_SQL},
    p AS (SELECT series_id, date, px, r, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n,
                 first_value(px) OVER (PARTITION BY series_id ORDER BY date) AS px0 FROM ret),
    a AS (SELECT *, (ln(px) - ln(px0)) / pos AS mu FROM p WHERE pos >= {FIRST} AND (pos - {FIRST}) % {STEP} = 0 AND pos + {HORIZON} < n)"""
LCG_SQL = "((path * 1103515245 + (step // block) * 12345 + ((a.pos * 1000 + model) % 2147483648) * 2654435761) % 2147483648)"
PATHS_SQL = f"""{P_SQL},
    models AS (SELECT * FROM (VALUES {", ".join(f"({m.number}, {m.block})" for m in MODELS)}) t(model, block)),
    draws AS (SELECT a.series_id, a.pos, a.px AS anchor, a.mu, CAST(model AS BIGINT) AS model, path, step, 1 + ({LCG_SQL} % a.pos + step % block) % a.pos AS idx
              FROM a, models, range({PATHS}) t1(path), range({HORIZON}) t2(step)),
    shocks AS (SELECT d.*, p.r - d.mu AS shock FROM draws d JOIN p ON p.series_id = d.series_id AND p.pos = d.idx),
    walked AS (SELECT *, anchor * exp(sum(shock) OVER (PARTITION BY series_id, pos, model, path ORDER BY step)) AS price FROM shocks),
    red AS (SELECT series_id, pos, model, path, any_value(anchor) AS anchor, max_by(price, step) AS terminal, min(price) AS run_min, max(price) AS run_max
            FROM walked GROUP BY 1, 2, 3, 4)"""
REAL_SQL = f"""truth AS (SELECT series_id, pos, px AS anchor, lead(px, {HORIZON}) OVER (PARTITION BY series_id ORDER BY date) AS y,
        min(px) OVER w AS y_min, max(px) OVER w AS y_max
    FROM p WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {HORIZON} FOLLOWING))"""


def at(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = paths.series_arrays(derived.bars(spark, sf_dir), BY).repartition("series_id")
    return paths.asofs(arrays, BY, FIRST, STEP, HORIZON)


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, pos, anchor, model, path, shocks, prices)."""
    paths.require_one_drift_policy(MODELS)
    return paths.simulate(at(spark, sf_dir), BY, MODELS, PATHS, HORIZON)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, pos, y, y_min, y_max): what happened over the horizon, read off the same arrays."""
    ahead = F.slice("ps", (F.col("pos") + 2).cast("int"), HORIZON)
    return at(spark, sf_dir).select("series_id", "pos", F.element_at(ahead, -1).alias("y"), F.array_min(ahead).alias("y_min"), F.array_max(ahead).alias("y_max"))


@query(f"WITH {PATHS_SQL} SELECT series_id, pos, model, path, step, idx FROM draws")
def block_bootstrap_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On every as-of date."""
    rows = at(spark, sf_dir).select("series_id", "pos", F.explode(F.array(*[F.struct(F.lit(m.number).cast("long").alias("model"), F.lit(m.block).cast("long").alias("block")) for m in MODELS])).alias("m"))
    rows = rows.select("series_id", "pos", "m.*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PATHS - 1).cast("long"))).alias("path"))
    index = paths._indices(F.col("pos"), F.col("path"), F.col("pos") * 1000 + F.col("model"), F.col("block"), HORIZON)
    return rows.select("series_id", "pos", "model", "path", F.posexplode(index).alias("step", "idx")).withColumn("step", F.col("step").cast("long"))


@query(f"WITH {PATHS_SQL} SELECT series_id, pos, model, path, step, round(shock, 8) AS shock FROM shocks")
def bootstrap_shocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On every as-of date."""
    got = ensemble(spark, sf_dir).select("series_id", "pos", "model", "path", F.posexplode("shocks").alias("step", "shock"))
    return got.withColumn("step", F.col("step").cast("long")).withColumn("shock", F.round("shock", 8))


@query(f"WITH {P_SQL} SELECT series_id, count(r) AS n, round(avg(r), 10) AS removed_mean, round(sum(r - m), 6) + 0 AS residue FROM (SELECT *, avg(r) OVER (PARTITION BY series_id) AS m FROM p) GROUP BY 1")
def residual_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = returns.with_returns(derived.bars(spark, sf_dir), returns.Log, "px", BY)
    mean = F.avg("r").over(returns.Window.partitionBy("series_id"))
    got = r.withColumn("z", F.col("r") - mean).groupBy("series_id").agg(F.count("r").alias("n"), F.round(F.avg("r"), 10).alias("removed_mean"), F.round(F.sum("z"), 6).alias("residue"))
    return got.withColumn("residue", F.col("residue") + F.lit(0.0))


@query(f"WITH {PATHS_SQL} SELECT series_id, pos, model, path, round(terminal, 5) AS terminal, round(run_min, 5) AS run_min, round(run_max, 5) AS run_max FROM red")
def ensemble_paths_reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(paths.reduced(ensemble(spark, sf_dir)).drop("anchor"), 5)


@query(f"WITH {PATHS_SQL} SELECT series_id, pos, model, path, round(anchor * 12.5, 4) AS anchor, round(terminal * 12.5, 4) AS terminal FROM red")
def ensemble_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = paths.reduced(paths.scaled(ensemble(spark, sf_dir), 12.5))
    return rounded(got.select(*KEY, "path", "anchor", "terminal"), 4)


@query(f"""WITH {PATHS_SQL} SELECT series_id, pos, model, path, step, round(shock - avg(shock) OVER (PARTITION BY series_id, pos, model), 8) + 0 AS shock FROM shocks""")
def ensemble_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = paths.centred(ensemble(spark, sf_dir), KEY).select(*KEY, "path", F.posexplode("shocks").alias("step", "shock"))
    return got.withColumn("step", F.col("step").cast("long")).withColumn("shock", F.round("shock", 8) + F.lit(0.0))


QS = [0.05, 0.25, 0.5, 0.75, 0.95]


@query(f"WITH {PATHS_SQL} SELECT series_id, pos, model, " + ", ".join(f"round(quantile_cont(terminal, {q}), 4) AS q{int(q * 100):02d}" for q in QS) + " FROM red GROUP BY 1, 2, 3")
def ensemble_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = paths.reduced(ensemble(spark, sf_dir)).groupBy(*KEY).agg(F.percentile("terminal", F.array(*map(F.lit, QS))).alias("q"))
    return got.select(*KEY, *[F.round(F.col("q")[i], 4).alias(f"q{int(q * 100):02d}") for i, q in enumerate(QS)])


GRID = [round(-0.25 + 0.005 * i, 3) for i in range(101)]
GRID_SQL = "(VALUES " + ", ".join(f"(CAST({m!r} AS DOUBLE))" for m in GRID) + ") g(move)"


@query(f"""WITH {PATHS_SQL}, last AS (SELECT series_id, max(pos) AS pos FROM red GROUP BY 1)
    SELECT r.series_id, r.pos, r.model, move, round(avg(CASE WHEN terminal >= anchor * (1 + move) THEN 1.0 ELSE 0 END), 8) AS p_terminal,
           round(avg(CASE WHEN CASE WHEN move < 0 THEN run_min <= anchor * (1 + move) ELSE run_max >= anchor * (1 + move) END THEN 1.0 ELSE 0 END), 8) AS p_touch
    FROM red r JOIN last l ON l.series_id = r.series_id AND l.pos = r.pos, {GRID_SQL} GROUP BY 1, 2, 3, 4""")
def exceedance_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = F.explode(F.array(*map(F.lit, GRID)))
    red = paths.reduced(ensemble(spark, sf_dir).where("true"))
    last = at(spark, sf_dir).groupBy("series_id").agg(F.max("pos").alias("pos"))
    cells = red.join(last, ["series_id", "pos"]).withColumn("move", grid)
    level = F.col("anchor") * (1 + F.col("move"))
    touch = F.when(F.col("move") < 0, F.col("run_min") <= level).otherwise(F.col("run_max") >= level)
    return rounded(cells.groupBy(*KEY, "move").agg(F.avg((F.col("terminal") >= level).cast("double")).alias("p_terminal"), F.avg(touch.cast("double")).alias("p_touch")))


PASS_SQL = f"""{PATHS_SQL}, hits AS (SELECT series_id, pos, model, path, min(CASE WHEN price <= anchor * 0.95 THEN step + 1 END) AS k, max_by(price, step) AS terminal,
        max_by(price, step) <= any_value(anchor) * 0.95 AS ends FROM walked GROUP BY 1, 2, 3, 4)"""


@query(f"""WITH {PASS_SQL}, x AS (SELECT series_id, pos, model, avg(CASE WHEN k IS NOT NULL THEN 1.0 ELSE 0 END) AS touch, avg(CASE WHEN ends THEN 1.0 ELSE 0 END) AS ends,
        count(k) AS n_touched, avg(k) AS mean_sessions FROM hits GROUP BY 1, 2, 3)
    SELECT series_id, pos, model, round(touch, 8) AS touch, round(ends, 8) AS ends, n_touched, round(touch / nullif(ends, 0), 8) AS ratio, round(mean_sessions, 8) AS mean_sessions FROM x""")
def first_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(paths.first_passage(ensemble(spark, sf_dir), KEY, F.col("anchor") * 0.95).drop("q"))


@query(f"""WITH {PASS_SQL} SELECT series_id, pos, model, round(quantile_cont(terminal, 0.05) FILTER (WHERE k IS NULL), 4) AS q05,
    round(quantile_cont(terminal, 0.5) FILTER (WHERE k IS NULL), 4) AS q50, round(quantile_cont(terminal, 0.95) FILTER (WHERE k IS NULL), 4) AS q95 FROM hits GROUP BY 1, 2, 3""")
def survivor_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = paths.first_passage(ensemble(spark, sf_dir), KEY, F.col("anchor") * 0.95)
    return got.select(*KEY, *[F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("q05", "q50", "q95"))])


@query(f"""WITH RECURSIVE {PATHS_SQL}, s AS (SELECT * FROM shocks),
    t AS (SELECT DISTINCT series_id, pos, model, path, CAST(-1 AS BIGINT) AS step, anchor AS price, CAST(0 AS DOUBLE) AS carry, false AS locked FROM s
          UNION ALL
          SELECT series_id, pos, model, path, step, least(greatest(target, p0 * (1 - c)), p0 * (1 + c)), CASE WHEN least(greatest(target, p0 * (1 - c)), p0 * (1 + c)) <> target
                     THEN ln(target / least(greatest(target, p0 * (1 - c)), p0 * (1 + c))) ELSE 0 END, least(greatest(target, p0 * (1 - c)), p0 * (1 + c)) <> target
          FROM (SELECT t.series_id, t.pos, t.model, t.path, s.step, t.price AS p0, t.price * exp(s.shock + t.carry) AS target, CASE WHEN t.locked THEN 0.06 ELSE 0.04 END::DOUBLE AS c
                FROM t JOIN s ON s.series_id = t.series_id AND s.pos = t.pos AND s.model = t.model AND s.path = t.path AND s.step = t.step + 1))
    SELECT series_id, pos, model, path, step, round(price, 5) AS price FROM t WHERE step >= 0""")
def session_limit_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On every as-of date."""
    got = ensemble(spark, sf_dir).withColumn("l", paths.limited(F.col("shocks"), F.col("anchor"), 0.04, 0.06))
    return got.select(*KEY, "path", F.posexplode("l.prices").alias("step", "price")).select(*KEY, "path", F.col("step").cast("long").alias("step"), F.round("price", 5).alias("price"))


@query(f"""WITH {BARS_SQL}, {RET_SQL}, l AS (SELECT series_id, max_by(px, date) AS px FROM bars GROUP BY 1)
    SELECT series_id, CAST(lev AS DOUBLE) AS leverage, round(px * (1 - (1 - 0.5) / lev), 6) AS long_barrier, round(px * (1 + (1 - 0.5) / lev), 6) AS short_barrier FROM l, (VALUES (2), (5), (10)) t(lev)""")
def margin_barriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = derived.bars(spark, sf_dir).groupBy("series_id").agg(F.max_by("px", "date").alias("px"))
    got = last.withColumn("leverage", F.explode(F.array(F.lit(2.0), F.lit(5.0), F.lit(10.0))))
    return rounded(got.select("series_id", "leverage", (F.col("px") * (1 - 0.5 / F.col("leverage"))).alias("long_barrier"), (F.col("px") * (1 + 0.5 / F.col("leverage"))).alias("short_barrier")), 6)


@query(f"""WITH {PATHS_SQL}, x AS (SELECT series_id, pos, model, avg(CASE WHEN terminal >= anchor * 1.01 THEN 1.0 ELSE 0 END) AS profit,
        avg(CASE WHEN run_min <= anchor * 0.9 THEN 1.0 ELSE 0 END) AS liquidation FROM red GROUP BY 1, 2, 3)
    SELECT series_id, pos, model, CASE WHEN liquidation > profit THEN 'liquidation_probability' WHEN profit < 0.5 THEN 'expected_loss' ELSE 'distribution' END AS headline FROM x""")
def headline_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    red = paths.reduced(ensemble(spark, sf_dir))
    got = red.groupBy(*KEY).agg(F.avg((F.col("terminal") >= F.col("anchor") * 1.01).cast("double")).alias("profit"), F.avg((F.col("run_min") <= F.col("anchor") * 0.9).cast("double")).alias("liquidation"))
    return got.select(*KEY, paths.headline(F.col("profit"), F.col("liquidation")).alias("headline"))


#: id, kind, move: strict above for the terminal, inclusive for touches and hurdles.
EVENTS = [("direction_up", "terminal_above", 0.0)] + [e for m in MOVES for e in ((f"touch_below_{m:g}", "touch_below", m), (f"touch_above_{m:g}", "touch_above", m))] + [("clears_1.02", "clears", 0.02)]
EVENTS_SQL = "(VALUES " + ", ".join(f"('{i}', '{k}', CAST({m!r} AS DOUBLE))" for i, k, m in EVENTS) + ") e(event_id, kind, move)"


def happened_sql(terminal: str, low: str, high: str) -> str:
    return f"""CASE kind WHEN 'terminal_above' THEN {terminal} > anchor * (1 + move) WHEN 'touch_below' THEN {low} <= anchor * (1 - move)
        WHEN 'touch_above' THEN {high} >= anchor * (1 + move) ELSE {terminal} >= anchor * (1 + move) END"""


def happened(terminal: str, low: str, high: str) -> F.Column:
    kind, up, down = F.col("e.kind"), F.col("anchor") * (1 + F.col("e.move")), F.col("anchor") * (1 - F.col("e.move"))
    t = F.col(terminal)
    return F.when(kind == "terminal_above", t > up).when(kind == "touch_below", F.col(low) <= down).when(kind == "touch_above", F.col(high) >= up).otherwise(t >= up)


def events() -> F.Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("event_id"), F.lit(k).alias("kind"), F.lit(m).alias("move")) for i, k, m in EVENTS]))


def event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    red = paths.reduced(ensemble(spark, sf_dir)).withColumn("e", events())
    return red.groupBy(*KEY, F.col("e.event_id").alias("event_id")).agg(F.avg(happened("terminal", "run_min", "run_max").cast("double")).alias("p"))


def outcome_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchor = at(spark, sf_dir).select("series_id", "pos", F.element_at("ps", (F.col("pos") + 1).cast("int")).alias("anchor"))
    t = truth(spark, sf_dir).join(anchor, ["series_id", "pos"]).withColumn("e", events())
    return t.select("series_id", "pos", F.col("e.event_id").alias("event_id"), happened("y", "y_min", "y_max").alias("occurred"))


PROB_SQL = f"""{PATHS_SQL}, {REAL_SQL},
    prob AS (SELECT series_id, pos, model, event_id, avg(CASE WHEN {happened_sql("terminal", "run_min", "run_max")} THEN 1.0 ELSE 0 END) AS p FROM red, {EVENTS_SQL} GROUP BY 1, 2, 3, 4),
    outc AS (SELECT t.series_id, t.pos, event_id, {happened_sql("y", "y_min", "y_max")} AS occurred FROM truth t SEMI JOIN a ON a.series_id = t.series_id AND a.pos = t.pos, {EVENTS_SQL}),
    ev AS (SELECT q.series_id, q.pos, q.model, q.event_id, q.p, CASE WHEN o.occurred THEN 1.0 ELSE 0.0 END::DOUBLE AS y
           FROM prob q JOIN outc o ON o.series_id = q.series_id AND o.pos = q.pos AND o.event_id = q.event_id)"""


@query(f"WITH {PROB_SQL} SELECT series_id, pos, model, event_id, round(p, 8) AS p FROM prob")
def event_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(event_table(spark, sf_dir))


@query(f"WITH {PROB_SQL} SELECT series_id, pos, event_id, occurred FROM outc")
def event_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcome_table(spark, sf_dir)


@query(f"""WITH {PATHS_SQL} SELECT series_id, pos, path, step, round(max(price) FILTER (WHERE model = 0) * max(price) FILTER (WHERE model = 1) * 0.001, 4) AS price
    FROM walked WHERE model IN (0, 1) GROUP BY 1, 2, 3, 4""")
def composed_fx_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On every as-of date."""
    e = ensemble(spark, sf_dir)
    one = e.where("model = 0").select("series_id", "pos", "path", F.col("prices").alias("a"))
    two = e.where("model = 1").select("series_id", "pos", "path", F.col("prices").alias("b"))
    both = one.join(two, ["series_id", "pos", "path"]).select("series_id", "pos", "path", F.posexplode(F.zip_with("a", "b", lambda a, b: a * b * 0.001)).alias("step", "price"))
    return both.select("series_id", "pos", "path", F.col("step").cast("long").alias("step"), F.round("price", 4).alias("price"))


@query(f"""WITH {P_SQL}, x AS (SELECT series_id, date, r, rank() OVER (PARTITION BY series_id ORDER BY r) AS k, count(*) OVER (PARTITION BY series_id) AS m FROM p WHERE r IS NOT NULL)
    SELECT series_id, date, round(k / CAST(m + 1 AS DOUBLE), 8) AS u FROM x""")
def pseudo_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = returns.with_returns(derived.bars(spark, sf_dir), returns.Log, "px", BY)
    return rounded(paths.pseudo_observations(r, BY, "r").select("series_id", "date", "u"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns of the bars and of the rate on common dates."""
    px = returns.with_returns(derived.bars(spark, sf_dir), returns.Log, "px", BY).select("series_id", "date", F.col("r").alias("x"))
    fx = derived.rate(spark, sf_dir).withColumn("k", F.lit(1))
    fx = returns.with_returns(fx, returns.Log, "fx", ["k"]).select("date", F.col("r").alias("y"))
    return px.join(fx, "date")


@query(f"""WITH {P_SQL}, {RATE_SQL}, f AS (SELECT date, ln(fx) - lag(ln(fx)) OVER (ORDER BY date) AS y FROM rate),
    x AS (SELECT p.series_id, p.date, p.r AS x, f.y FROM p JOIN f ON f.date = p.date WHERE p.r IS NOT NULL AND f.y IS NOT NULL),
    t AS (SELECT i.series_id, count(*) AS n2, sum(sign(i.x - j.x) * sign(i.y - j.y)) AS s FROM x i JOIN x j ON j.series_id = i.series_id AND j.date < i.date GROUP BY 1)
    SELECT series_id, round(s / CAST(n2 AS DOUBLE), 8) AS tau FROM t""")
def kendall_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pandas as pd

    from ..functions.stats import kendall_tau as tau

    def one(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"series_id": [group["series_id"].iloc[0]], "tau": [round(tau(group["x"], group["y"]), 8)]})

    return pairs(spark, sf_dir).groupBy("series_id").applyInPandas(one, "series_id string, tau double")


@query()
def tcopula_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.tcopula_groups(pairs(spark, sf_dir), BY)
