"""Walk-forward runs, published forecasts, generated series, and the smaller inference checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import forecast, inference, walkforward
from ..operators.walkforward import Request
from ..sources import derived, generated
from . import ensembles, scoring
from .ensembles import PATHS_SQL
from .registry import query
from .series import rounded

BY = ["series_id"]
REQUEST = Request(horizons=(5, 21), step=5, first=500, n_paths=4000)


def main_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.bars(spark, sf_dir).where("series_id <> 'P'").select("series_id", "date", "px")


@query()
def walkforward_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GJR-t filtered simulation and a driftless random walk, graded out of sample."""
    return walkforward.walk_forward(main_series(spark, sf_dir), BY, ["random_walk", "gjr_garch"], REQUEST)


@query()
def walkforward_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walkforward.calibration(walkforward.walk_forward(main_series(spark, sf_dir), BY, ["random_walk"], Request(step=5)), BY, "random_walk")


@query()
def tail_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endings more than a twentieth above the anchor, against the driftless Gaussian chances."""
    scores = walkforward.walk_forward(main_series(spark, sf_dir), BY, ["random_walk"], Request(step=5))
    return walkforward.tail_calibration(scores, BY, 1.05)


def latest_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ensembles.ensemble(spark, sf_dir)
    last = ensembles.at(spark, sf_dir).groupBy("series_id").agg(F.max("pos").alias("pos"))
    return forecast.forecast_blocks(e.join(last, ["series_id", "pos"]).drop("pos"), ["series_id", "model"])


def _share(condition: str) -> str:
    return f"avg(CASE WHEN {condition} THEN 1.0 ELSE 0 END)"


@query(f"""WITH {PATHS_SQL}, l AS (SELECT series_id, max(pos) AS pos FROM red GROUP BY 1)
    SELECT r.series_id, r.model, round(quantile_cont(terminal, 0.5), 4) AS q50, round({_share("run_min <= anchor * 0.9")}, 8) AS adverse_touch,
           round({_share("terminal >= anchor * (1 + 0.02)")}, 8) AS up2, count(*) AS n_paths
    FROM red r JOIN l ON l.series_id = r.series_id AND l.pos = r.pos GROUP BY 1, 2""")
def forecast_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published blocks of the latest as-of date, flattened to a few of their fields."""
    b = latest_blocks(spark, sf_dir)
    up = F.filter("exceedance", lambda c: c["move"] == 0.02)[0]["terminal"]
    return b.select(
        "series_id", "model", F.round("quantiles.q50", 4).alias("q50"), F.round("adverse_move.touch", 8).alias("adverse_touch"), F.round(up, 8).alias("up2"), F.col("n_paths").cast("long").alias("n_paths")
    )


@query()
def forecast_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The artifact of each series' latest as-of date."""
    return forecast.as_json(latest_blocks(spark, sf_dir), ["series_id", "model"])


_U = " + ".join(
    f"(((day * 97 + {k}) * 1103515245 + (day * 31 + {k * k}) * 12345 + ((seed + {k}) % 2147483648) * 2654435761) % 2147483648) / 2147483648.0::DOUBLE" for k in range(12)
)


@query(f"""WITH d AS (SELECT CAST(unnest(generate_series(DATE '1999-01-01', DATE '2000-12-31', INTERVAL 1 DAY)) AS DATE) AS date),
    r AS (SELECT date, seed, date_diff('day', DATE '1970-01-01', date) AS day FROM d, (VALUES (CAST(1 AS BIGINT)), (7)) t(seed) WHERE isodow(date) < 6)
    SELECT 'walk' || seed AS series_id, date, round(100.0::DOUBLE * exp(sum(0.01::DOUBLE * ({_U} - 6.0)) OVER (PARTITION BY seed ORDER BY date)), 6) AS close FROM r""")
def generated_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(generated.generated_walk(spark, dt.date(1999, 1, 1), dt.date(2000, 12, 31), [1, 7]), 6)


@query(f"""WITH {scoring.UP_SQL} SELECT series_id, model, pos, round((row_number() OVER (PARTITION BY series_id, model ORDER BY pos) - 1) / CAST(count(*) OVER (PARTITION BY series_id, model) - 1 AS DOUBLE), 8) AS p FROM up""")
def calendar_placebo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forecast that knows nothing but the date."""
    w = Window.partitionBy("series_id", "model")
    rank = (F.row_number().over(w.orderBy("pos")) - 1) / (F.count(F.lit(1)).over(w) - 1)
    return rounded(scoring.up(spark, sf_dir).select("series_id", "model", "pos", rank.alias("p")))


@query()
def minimum_detectable_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest CRPS differential each comparison could have found."""
    each = inference.studentised(scoring.against_benchmark(spark, sf_dir), BY, scoring.BLOCK).collect()
    rows = [(r["series_id"], r["model"], r["n"], inference.minimum_detectable(r["var"], r["n"], scoring.BLOCK)) for r in each]
    return spark.createDataFrame(rows, "series_id string, model long, n long, effect double")


@query(f"""WITH {scoring.RANKED_SQL} SELECT series_id, pos, {", ".join(f"round(max(crps) FILTER (WHERE model = {m.number}), 4) AS m{m.number}" for m in ensembles.MODELS)} FROM crps GROUP BY 1, 2""")
def losses_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of losses for each model."""
    numbers = [m.number for m in ensembles.MODELS]
    wide = scoring.graded(spark, sf_dir).groupBy("series_id", "pos").pivot("model", numbers).agg(F.first("crps"))
    return wide.select("series_id", "pos", *[F.round(F.col(str(k)), 4).alias(f"m{k}") for k in numbers])


@query(f"""WITH {scoring.RANKED_SQL}, s AS (SELECT pos, count(DISTINCT series_id) AS k FROM crps GROUP BY 1) SELECT pos FROM s WHERE k = (SELECT count(DISTINCT series_id) FROM crps)""")
def shared_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of positions that every series was scored on."""
    at = ensembles.at(spark, sf_dir).select("series_id", "pos")
    n = at.agg(F.count_distinct("series_id").alias("n"))
    return at.groupBy("pos").agg(F.count_distinct("series_id").alias("k")).join(n, F.col("k") == F.col("n")).select("pos")
