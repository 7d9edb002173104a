"""Weekly factor designs, penalised and HAC regressions, local projections, compounded chains.

Spark collapses, aligns and lags the series and takes cross products; the p x p problems that
are left (a dozen numbers) are solved in numpy. Bootstraps run as tasks over draw numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DesignError, ProjectionError
from .returns import in_order

#: Share of the required sample an optional driver must leave; solver limits.
COVERAGE, TOLERANCE, SWEEPS = 0.8, 1e-7, 5000


def week_ending_friday(date: Column) -> Column:
    return F.next_day(F.date_sub(date, 1), "FRI")


def to_weekly(df: DataFrame, by: list[str], x: str, mean: bool = False, date: str = "date") -> DataFrame:
    """Last (or mean) observation of each week, weeks named by their Friday; empty weeks are absent."""
    agg = F.avg(x) if mean else F.max_by(x, date)
    return df.where(F.col(x).isNotNull()).groupBy(*by, week_ending_friday(F.col(date)).alias("week")).agg(agg.alias(x))


def changed(kind: str, x: Column, before: Column) -> Column:
    """diff, pct_change or level; a zero base has no percentage."""
    if kind == "diff":
        return x - before
    if kind == "pct_change":
        return (x - before) / F.nullif(before, F.lit(0.0))
    if kind == "level":
        return x
    raise DesignError(f"unknown transform {kind!r}")


@dataclass(frozen=True)
class Factor:
    """A driver: its weekly column, transform, lag in weeks, and whether the design needs it."""

    name: str
    kind: str = "diff"
    lag: int = 0
    required: bool = True


def design(weekly: dict[str, DataFrame], target: str, factors: list[Factor]) -> tuple[DataFrame, dict[str, str]]:
    """The target's and drivers' common weeks, and why optional drivers were left out.

    ``weekly`` maps a name to (week, value). Lags are over the weeks that a series has."""
    if target not in weekly:
        raise DesignError(f"no target {target!r}")
    dropped = {f.name: "no series" for f in factors if f.name not in weekly and not f.required}
    if missing := [f.name for f in factors if f.name not in weekly and f.required]:
        raise DesignError(f"required drivers {missing} have no series")
    w = Window.orderBy("week")

    def column(f: Factor) -> DataFrame:
        v = F.col("value")
        df = weekly[f.name].where(v.isNotNull()).select("week", changed(f.kind, v, F.lag("value", 1).over(w)).alias(f.name))
        df = df.where(F.col(f.name).isNotNull())
        return df.select("week", F.lag(f.name, f.lag).over(w).alias(f.name)).where(F.col(f.name).isNotNull()) if f.lag else df

    out = column(Factor(target, "pct_change")).withColumnRenamed(target, "y")
    for f in (f for f in factors if f.required and f.name not in dropped):
        out = out.join(column(f), "week")
    base = out.count()
    for f in (f for f in factors if not f.required and f.name not in dropped):
        tried = out.join(column(f), "week")
        rows = tried.count()
        if rows < COVERAGE * base:
            dropped[f.name] = f"it would leave {rows} of {base} weeks"
        else:
            out = tried
    return out, dropped


def standardised(df: DataFrame, by: list[str], columns: list[str], y: str) -> DataFrame:
    """Columns less mean over population deviation (constant ones become 0), the target centred."""
    w = Window.partitionBy(*by)
    scaled = [F.when(F.stddev_pop(c).over(w) > 0, (F.col(c) - F.avg(c).over(w)) / F.stddev_pop(c).over(w)).otherwise(0.0).alias(c) for c in columns]
    return df.select(*[c for c in df.columns if c not in columns + [y]], *scaled, (F.col(y) - F.avg(y).over(w)).alias(y))


def max_penalty(std: DataFrame, by: list[str], columns: list[str], y: str, l1_ratio: float = 0.5) -> DataFrame:
    """The least penalty at which all coefficients vanish."""
    if l1_ratio <= 0:
        raise ValueError("without an l1 part no penalty makes coefficients vanish")
    return std.groupBy(*by).agg((F.greatest(*[F.abs(F.sum(F.col(c) * F.col(y))) for c in columns]) / (F.count(F.lit(1)) * l1_ratio)).alias("lambda_max"))


# numpy on small matrices


def scale(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    mean, sd = x.mean(0), x.std(0)
    return np.where(sd > 0, (x - mean) / np.where(sd > 0, sd, 1), 0.0), y - y.mean(), mean, sd


def elastic_net(gram: np.ndarray, xy: np.ndarray, lam: float, l1_ratio: float = 0.5, start: np.ndarray | None = None) -> np.ndarray:
    """Coordinate descent on the Gram matrix X'X/n and X'y/n: a sweep costs p squared, not n p."""
    beta = np.zeros(len(xy)) if start is None else start.copy()
    for _ in range(SWEEPS):
        step = 0.0
        for j in range(len(xy)):
            if gram[j, j] <= 0:
                continue
            rho = xy[j] - gram[j] @ beta + gram[j, j] * beta[j]
            new = math.copysign(max(abs(rho) - lam * l1_ratio, 0.0), rho) / (gram[j, j] + lam * (1 - l1_ratio))
            step, beta[j] = max(step, abs(new - beta[j])), new
        if step < TOLERANCE:
            break
    return beta


def penalty_path(xy: np.ndarray, l1_ratio: float = 0.5, steps: int = 60, eps: float = 1e-4) -> np.ndarray:
    top = float(np.abs(xy).max()) / l1_ratio
    return np.geomspace(top, top * eps, steps) if top > 0 else np.zeros(1)


def choose_penalty(x: np.ndarray, y: np.ndarray, l1_ratio: float = 0.5, folds: int = 5) -> float:
    """Least squared error over contiguous held-out blocks."""
    sx, sy, _, _ = scale(x, y)
    path = penalty_path(sx.T @ sy / len(sy), l1_ratio)
    errors = np.zeros(len(path))
    for block in np.array_split(np.arange(len(y)), folds):
        keep = np.ones(len(y), bool)
        keep[block] = False
        tx, ty, mean, sd = scale(x[keep], y[keep])
        gram, xy, beta = tx.T @ tx / len(ty), tx.T @ ty / len(ty), None
        test = np.where(sd > 0, (x[block] - mean) / np.where(sd > 0, sd, 1), 0.0)
        for i, lam in enumerate(path):
            beta = elastic_net(gram, xy, lam, l1_ratio, beta)
            errors[i] += ((y[block] - y[keep].mean() - test @ beta) ** 2).sum()
    return float(path[int(errors.argmin())])


def automatic_lag(n: int) -> int:
    return math.floor(4 * (n / 100) ** (2 / 9)) if n else 0


def ols_hac(x: np.ndarray, y: np.ndarray, lag: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, Newey-West errors (Bartlett weights), residuals."""
    lag = automatic_lag(len(y)) if lag is None else lag
    bread = np.linalg.pinv(x.T @ x)
    beta = bread @ x.T @ y
    e = y - x @ beta
    xe = x * e[:, None]
    meat = xe.T @ xe
    for k in range(1, min(lag, len(y) - 1) + 1):
        cross = xe[k:].T @ xe[:-k]
        meat += (1 - k / (lag + 1)) * (cross + cross.T)
    return beta, np.sqrt(np.maximum(np.diag(bread @ meat @ bread), 0)), e


def moving_blocks(n: int, block: int, seed: int) -> np.ndarray:
    """One circular moving-block resample of positions."""
    rng = np.random.default_rng(seed)
    starts = rng.integers(0, n, -(-n // block))
    return ((starts[:, None] + np.arange(block)) % n).reshape(-1)[:n]


LOADINGS = "driver string, beta double, ols double, hac_se double, low double, high double, selected double, sign_agreement double, r2 double, penalty double"


def loadings(df: DataFrame, columns: list[str], draws: int = 200, block: int = 8) -> DataFrame:
    """Penalised loadings with their OLS/HAC check and a moving-block bootstrap over draw numbers.

    The weekly design (one row a week) is what every draw resamples, so it is sent to the tasks;
    its size is weeks x drivers, and does not grow with the observations behind it."""
    spark = df.sparkSession
    got = df.orderBy("week").select("y", *columns).toPandas().to_numpy(float)
    y, x = got[:, 0], got[:, 1:]
    if len(y) < 3 * block:
        raise DesignError(f"{len(y)} weeks are too few for blocks of {block}")
    lam = choose_penalty(x, y)
    sx, sy, _, _ = scale(x, y)
    beta = elastic_net(sx.T @ sx / len(sy), sx.T @ sy / len(sy), lam)
    ols, se, _ = ols_hac(sx, sy)
    total = float((sy**2).sum())
    r2 = 1 - float(((sy - sx @ beta) ** 2).sum()) / total if total else 0.0

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for d in part["id"]:
                at = moving_blocks(len(y), block, int(d))
                bx, by, _, _ = scale(x[at], y[at])
                b = elastic_net(bx.T @ bx / len(by), bx.T @ by / len(by), lam)
                rows += [(int(d), c, float(v)) for c, v in zip(columns, b, strict=True)]
            yield pd.DataFrame(rows, columns=["draw", "driver", "b"])

    stars = spark.range(draws).mapInPandas(draw, "draw long, driver string, b double")
    point = spark.createDataFrame([(c, float(b), float(o), float(s), r2, lam) for c, b, o, s in zip(columns, beta, ols, se, strict=True)], "driver string, beta double, ols double, hac_se double, r2 double, penalty double")
    joined = stars.join(F.broadcast(point.select("driver", "beta")), "driver")
    band = joined.groupBy("driver").agg(
        F.percentile("b", F.lit(0.025)).alias("low"), F.percentile("b", F.lit(0.975)).alias("high"), F.avg((F.col("b") != 0).cast("double")).alias("selected"),
        F.avg((F.signum("b") == F.signum("beta")).cast("double")).alias("sign_agreement"),
    )
    return point.join(band, "driver").select(*[c.split()[0] for c in LOADINGS.split(", ")])


def projection_design(shock: DataFrame, response: DataFrame, horizon: int, lags: int, key: str = "month", controls: DataFrame | None = None) -> DataFrame:
    """y = cumulative response over 1..h (its own value at h = 0) on the shock, lags of both and
    the controls (key and their columns) of the same row, which are held constant.

    Outer joins first, lags over the union's rows, incomplete rows last."""
    w = Window.orderBy(key)
    both = shock.join(response, key, "full")
    held = [c for c in controls.columns if c != key] if controls is not None else []
    both = both.join(controls, key, "full") if held else both
    ahead = w.rowsBetween(1, horizon) if horizon else w.rowsBetween(0, 0)
    need = max(horizon, 1)
    y = F.when(F.count("response").over(ahead) == need, F.sum("response").over(ahead))
    lagged = [F.lag(c, k).over(w).alias(f"{c}_{k}") for c in ("shock", "response") for k in range(1, lags + 1)]
    return both.select(key, y.alias("y"), "shock", *lagged, *held).na.drop()


def project(df: DataFrame, horizon: int, key: str = "month") -> dict:
    """The response at one horizon with its HAC error."""
    columns = [c for c in df.columns if c not in (key, "y")]
    got = df.orderBy(key).select("y", *columns).toPandas().to_numpy(float)
    if len(got) <= len(columns) + 3:
        raise ProjectionError(f"{len(got)} rows for {len(columns)} regressors")
    x = np.c_[got[:, 1:], np.ones(len(got))]
    beta, se, _ = ols_hac(x, got[:, 0], max(horizon, automatic_lag(len(got))))
    return {"beta": float(beta[0]), "se": float(se[0]), "n": len(got)}


def chain_bootstrap(frames: list[np.ndarray], point: float, draws: int, block: int, spark) -> DataFrame:
    """(draw, product): the links' coefficients multiplied on the same resampled months."""
    n = min(len(f) for f in frames)

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for d in part["id"]:
                at = moving_blocks(n, block, int(d))
                product = 1.0
                for f in frames:
                    x = np.c_[f[at, 1:], np.ones(n)]
                    product *= float((np.linalg.pinv(x.T @ x) @ x.T @ f[at, 0])[0])
                out.append((int(d), product))
            yield pd.DataFrame(out, columns=["draw", "product"])

    if n < 3 * block:
        return spark.createDataFrame([], "draw long, product double")
    return spark.range(draws).mapInPandas(draw, "draw long, product double")


def sign_changes(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """How often a value changes its sign in order; zeros and nulls are passed over."""
    sign = df.where(F.col(value) != 0).withColumn("_s", F.signum(value))
    before = F.lag("_s").over(in_order(by, order))
    return sign.withColumn("_b", before).groupBy(*by).agg(F.count_if(F.col("_b") != F.col("_s")).alias("changes"), F.count(F.lit(1)).alias("n"))


def rolling_benchmark(df: DataFrame, by: list[str], window: int, order: str = "week") -> DataFrame:
    """The out-of-sample benchmark: the mean of the window strictly before."""
    w = in_order(by, order).rowsBetween(-window, -1)
    return df.withColumn("benchmark", F.when(F.count("y").over(w) == window, F.avg("y").over(w)))
