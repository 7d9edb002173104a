"""Stability of weekly loadings: rolling refits, scores out of sample, drivers withheld.

A design has one row a week, a thousand or so however many observations lie behind it, and is
sent to the tasks as an array. Each refit is a row of a distributed range; what refits return is
put together by DataFrame operations. A window whose target does not move gives no fit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scoring
from .factors import choose_penalty, elastic_net, scale, sign_changes

#: Weeks of a window, weeks between refits.
WINDOW, STEP = 156, 4


def arrays(df: DataFrame, columns: list[str], order: str = "week") -> tuple[np.ndarray, np.ndarray]:
    """The design in order of its weeks, as drivers and target."""
    got = df.orderBy(order).select("y", *columns).toPandas().to_numpy(float).reshape(-1, len(columns) + 1)
    return got[:, 1:], got[:, 0]


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """Standardised coefficients at the chosen penalty, and the predictor they make."""
    lam = choose_penalty(x, y)
    sx, sy, mean, sd = scale(x, y)
    beta = elastic_net(sx.T @ sx / len(sy), sx.T @ sy / len(sy), lam)
    level, unit = y.mean(), np.where(sd > 0, sd, 1)
    return beta, lambda new: level + np.where(sd > 0, (new - mean) / unit, 0.0) @ beta


def moves(y: np.ndarray) -> bool:
    return not np.allclose(y, y[0])


def rolling_loadings(df: DataFrame, columns: list[str], window: int = WINDOW, step: int = STEP) -> DataFrame:
    """(window, driver, beta): standardised loadings of each window that ends ``step`` weeks after
    the one before; no rows unless there are more weeks than a window holds."""
    x, y = arrays(df, columns)
    ends = range(window, len(y) + 1, step) if len(y) > window else range(0)

    def refit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for k in part["id"]:
                piece = slice(ends[k] - window, ends[k])
                if moves(y[piece]):
                    rows += [(int(k), c, float(b)) for c, b in zip(columns, fit(x[piece], y[piece])[0], strict=True)]
            yield pd.DataFrame(rows, columns=["window", "driver", "beta"])

    return df.sparkSession.range(len(ends)).mapInPandas(refit, "window long, driver string, beta double")


def stability(rolled: DataFrame, band: DataFrame | None = None) -> DataFrame:
    """By driver, how its rolling loading varied; ``band`` (driver, low, high) sets the spread in
    proportion to the width of the bootstrap's interval."""
    w = Window.partitionBy("driver")
    half = F.floor(F.count(F.lit(1)).over(w) / 2)
    placed = rolled.withColumn("_early", F.row_number().over(w.orderBy("window")) <= half)
    spread = F.percentile("beta", F.lit(0.75)) - F.percentile("beta", F.lit(0.25))
    out = placed.groupBy("driver").agg(
        F.count(F.lit(1)).alias("windows"), F.count_if(F.col("beta") != 0).alias("selected"), F.min("beta").alias("least"), F.max("beta").alias("most"),
        spread.alias("spread"), F.avg(F.when(F.col("_early"), F.col("beta"))).alias("first_half"), F.avg(F.when(~F.col("_early"), F.col("beta"))).alias("second_half"),
    )
    changes = sign_changes(rolled, ["driver"], "beta", "window").select("driver", "changes")
    out = out.join(changes, "driver", "left").withColumn("changes", F.coalesce("changes", F.lit(0).cast("long")))
    if band is None:
        return out.withColumn("spread_ratio", F.lit(None).cast("double"))
    width = band.select("driver", (F.col("high") - F.col("low")).alias("_width"))
    return out.join(width, "driver", "left").withColumn("spread_ratio", F.col("spread") / F.nullif(F.col("_width"), F.lit(0.0))).drop("_width")


def fit_places(y: np.ndarray, window: int, every: int) -> dict[int, list[int]]:
    """Which weeks are predicted by the fit made at which week. A refit is due every ``every``
    weeks; a week at which one is due but whose window does not move is not scored."""
    places: dict[int, list[int]] = {}
    at = None
    for week in range(window, len(y)):
        if at is None or (week - window) % every == 0:
            if not moves(y[week - window : week]):
                continue
            at = week
        places.setdefault(at, []).append(week)
    return places


def walk_forward(df: DataFrame, columns: list[str], window: int = WINDOW, every: int = STEP) -> DataFrame:
    """(pos, y, prediction, benchmark): each week after the first window, predicted by the last fit
    before it and by the mean of the window before it."""
    x, y = arrays(df, columns)
    places = fit_places(y, window, every)
    fits = list(places)

    def predict(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for k in part["id"]:
                at = fits[k]
                model = fit(x[at - window : at], y[at - window : at])[1]
                rows += [(w, float(y[w]), float(model(x[w])), float(y[w - window : w].mean())) for w in places[at]]
            yield pd.DataFrame(rows, columns=["pos", "y", "prediction", "benchmark"])

    return df.sparkSession.range(len(fits)).mapInPandas(predict, "pos long, y double, prediction double, benchmark double")


def out_of_sample(scored: DataFrame, by: list[str]) -> DataFrame:
    """R squared against the benchmark, and the paired test of squared errors; of two weeks at least."""
    e = scored.withColumn("_m", F.pow(F.col("y") - F.col("prediction"), 2)).withColumn("_b", F.pow(F.col("y") - F.col("benchmark"), 2))
    ratio = 1 - F.sum("_m") / F.nullif(F.sum("_b"), F.lit(0.0))
    r2 = e.groupBy(*by).agg(F.coalesce(ratio, F.lit(0.0)).alias("r2"), F.count(F.lit(1)).alias("weeks")).where("weeks >= 2")
    test = scoring.diebold_mariano(e.withColumn("d", F.col("_m") - F.col("_b")), by, 1)
    joined = r2.join(test.drop("n"), by, "left")
    return joined.withColumn("p", scoring.t_two_sided(F.col("statistic"), F.col("weeks")))


def lagged(df: DataFrame, columns: list[str], order: str = "week") -> DataFrame:
    """The predictive design: every driver one row later against the same target."""
    w = Window.orderBy(order)
    return df.select(order, "y", *[F.lag(c, 1).over(w).alias(c) for c in columns]).na.drop()


def both_kinds(df: DataFrame, columns: list[str], window: int = WINDOW) -> DataFrame:
    """Out of sample, with the drivers of the same week and with those of the week before."""
    now = walk_forward(df, columns, window).withColumn("kind", F.lit("contemporaneous"))
    before = walk_forward(lagged(df, columns), columns, window).withColumn("kind", F.lit("predictive"))
    return out_of_sample(now.unionByName(before), ["kind"])


WITHHELD = "driver string, largest_shift double, flips array<string>"


def leave_one_out(df: DataFrame, columns: list[str], required: list[str], window: int = WINDOW) -> DataFrame:
    """By required driver: how far the others' loadings move without it, whose sign turns, and R
    squared out of sample without and with it. A sole driver cannot be withheld."""
    x, y = arrays(df, columns)
    spark = df.sparkSession
    out = [c for c in columns if c in required and len(columns) > 1]
    full = fit(x, y)[0] if out else np.zeros(0)

    def without(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for k in part["id"]:
                keep = [i for i, c in enumerate(columns) if c != out[k]]
                beta = fit(x[:, keep], y)[0]
                flips = [columns[i] for i, b in zip(keep, beta, strict=True) if b * full[i] < 0]
                rows.append((out[k], float(np.abs(beta - full[keep]).max()), flips))
            yield pd.DataFrame(rows, columns=["driver", "largest_shift", "flips"])

    got = spark.range(len(out)).mapInPandas(without, WITHHELD)
    scored = walk_forward(df, columns, window).withColumn("driver", F.lit(""))
    for c in out:
        scored = scored.unionByName(walk_forward(df, [d for d in columns if d != c], window).withColumn("driver", F.lit(c)))
    r2 = out_of_sample(scored, ["driver"]).select("driver", "r2")
    whole = r2.where("driver = ''").select(F.lit(1).alias("_k"), F.col("r2").alias("r2_with"))
    table = got.join(r2.withColumnRenamed("r2", "r2_without"), "driver", "left").withColumn("_k", F.lit(1))
    return table.join(whole, "_k", "left").drop("_k")


def identity_check(df: DataFrame, by: list[str], parts: list[str], y: str = "y", least: int = 24) -> DataFrame:
    """Least squares of a series on the parts it is said to be made of: (by, months, r2, part, elasticity).

    Only centred cross products leave Spark's aggregation, a small table for each group."""
    names = [*parts, y]
    whole = df.na.drop(subset=names)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    moments = whole.groupBy(*by).agg(F.count(F.lit(1)).alias("months"), *[F.covar_pop(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)]).where(F.col("months") >= least)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                head, cov = row[: len(by) + 1], np.zeros((len(names), len(names)))
                for (a, b), v in zip(pairs, row[len(by) + 1 :], strict=True):
                    cov[names.index(a), names.index(b)] = cov[names.index(b), names.index(a)] = v
                beta = np.linalg.pinv(cov[:-1, :-1]) @ cov[:-1, -1]
                r2 = float(beta @ cov[:-1, -1] / cov[-1, -1]) if cov[-1, -1] > 0 else None
                rows += [(*head, r2, p, float(b)) for p, b in zip(parts, beta, strict=True)]
            yield pd.DataFrame(rows, columns=[*by, "months", "r2", "part", "elasticity"])

    keys = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in by)
    return moments.mapInPandas(solve, keys + "months long, r2 double, part string, elasticity double")
