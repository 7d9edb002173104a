"""Walk-forward scoring: one task for each as-of date, which fits, simulates, grades and returns a few numbers.

The history reaches its task as one array (what was known at the date), and the outcome beside
it; paths never leave the task. Seeds depend on position, horizon and model, not on partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InsufficientDataError
from . import inference, scoring, volatility
from .paths import series_arrays

SCORES = "horizon int, model string, crps double, pit double, var_breach boolean, p_up double, y_up double, terminal_log_sd double, sigma double, growth double"


@dataclass(frozen=True)
class Request:
    """Horizons in sessions, the step between as-of dates, and the sizes of fit and ensemble."""

    horizons: tuple[int, ...] = (5, 21)
    step: int = 100
    first: int = 500
    n_paths: int = 4000
    block: int = 5
    level: float = 0.05
    seed: int = 20260803


def block_index(n: int, n_paths: int, horizon: int, block: int, rng: np.random.Generator) -> np.ndarray:
    """(paths, horizon) positions in circular contiguous blocks."""
    if n < 2:
        raise InsufficientDataError("a pool needs at least 2 residuals")
    starts = rng.integers(0, n, (n_paths, -(-horizon // block)))
    return ((starts[:, :, None] + np.arange(block)) % n).reshape(n_paths, -1)[:, :horizon]


def residual_pool(z: np.ndarray) -> np.ndarray:
    """Finite residuals less their mean."""
    z = z[np.isfinite(z)]
    if not len(z):
        raise InsufficientDataError("a pool needs at least one finite residual")
    return z - z.mean()


def random_walk(returns: np.ndarray, request: Request) -> Callable[[int, int], np.ndarray]:
    """Driftless iid resampling of the history's returns."""
    pool = residual_pool(returns)
    return lambda horizon, seed: pool[block_index(len(pool), request.n_paths, horizon, 1, np.random.default_rng(seed))]


def gjr_simulation(returns: np.ndarray, request: Request) -> Callable[[int, int], np.ndarray]:
    """Filtered historical simulation: fitted variances, bootstrapped standardised residuals."""
    fit = volatility.gjr_fit(returns)
    pool = residual_pool(fit["z"])
    theta = (fit["omega"], fit["alpha"], fit["gamma"], fit["beta"])

    def draw(horizon: int, seed: int) -> np.ndarray:
        shocks = pool[block_index(len(pool), request.n_paths, horizon, request.block, np.random.default_rng(seed))]
        return volatility.gjr_propagate(0.0, theta, fit["next_variance"], shocks)

    return draw


MODELS: dict[str, Callable[[np.ndarray, Request], Callable[[int, int], np.ndarray]]] = {"random_walk": random_walk, "gjr_garch": gjr_simulation}


def grade(paths: np.ndarray, anchor: float, y: float, level: float, u: float) -> tuple:
    """CRPS, randomised PIT, breach, P(up), outcome, spread of the terminal prices."""
    x = np.sort(anchor * np.exp(paths.sum(1)))
    n = len(x)
    crps = np.abs(x - y).mean() - float(((2 * np.arange(1, n + 1) - n - 1) * x).sum()) / (n * (n - 1))
    below, ties = np.searchsorted(x, y, "left"), np.searchsorted(x, y, "right") - np.searchsorted(x, y, "left")
    pit = (below + u * (ties + 1)) / (n + 1)
    return float(crps), float(pit), bool(y < np.quantile(x, level)), float((x > anchor).mean()), float(y > anchor), float(np.log(x[x > 0]).std(ddof=1))


def walk_forward(prices: DataFrame, by: list[str], models: list[str], request: Request, price: str = "px") -> DataFrame:
    """Scores by (key, pos, horizon, model). A date that any model refuses is left out for all."""
    longest = max(request.horizons)
    arrays = series_arrays(prices, by, price)
    last = F.size("ps") - 1 - min(request.horizons)
    at = F.explode(F.sequence(F.lit(request.first), last, F.lit(request.step)))
    windows = arrays.where(last >= request.first).select(*by, "ps", at.alias("pos"))
    cut = windows.select(*by, "pos", F.slice("ps", F.lit(1), F.col("pos") + 1).alias("seen"), F.slice("ps", F.col("pos") + 2, longest).alias("ahead"))
    # later dates have longer histories: spread them evenly, one small group of dates for each task
    spread = cut.repartition(max(64, prices.sparkSession.sparkContext.defaultParallelism * 4), *by, "pos")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                got, pos = row._asdict(), int(row.pos)
                seen, ahead = np.asarray(got["seen"], float), np.asarray(got["ahead"], float)
                returns = np.diff(np.log(seen))
                try:
                    fitted = {m: MODELS[m](returns, request) for m in models}
                except InsufficientDataError:
                    continue
                key = [got[k] for k in by]
                for h in (h for h in request.horizons if h <= len(ahead)):
                    u = np.random.default_rng([request.seed, pos, h]).random()
                    for k, m in enumerate(models):
                        paths = fitted[m](h, request.seed + pos * 1000 + h + 500_000_000 * k)
                        out.append((*key, pos, h, m, *grade(paths, seen[-1], ahead[h - 1], request.level, u), float(returns.std(ddof=1)), float(ahead[h - 1] / seen[-1])))
            yield pd.DataFrame(out, columns=[*by, "pos", *[c.split()[0] for c in SCORES.split(", ")]])

    kinds = dict(prices.dtypes)
    return spread.mapInPandas(score, ", ".join(f"{k} {kinds[k]}" for k in by) + ", pos int, " + SCORES)


def calibration(scores: DataFrame, by: list[str], base: str) -> DataFrame:
    """By horizon and model: mean CRPS, skill against the base model, breach rate, mean PIT, Brier score of the direction."""
    keys = [*by, "horizon"]
    each = scores.groupBy(*keys, "model").agg(
        F.count(F.lit(1)).alias("n"), F.avg("crps").alias("crps"), F.avg(F.col("var_breach").cast("double")).alias("breach_rate"), F.avg("pit").alias("mean_pit"),
        F.avg(F.pow(F.col("p_up") - F.col("y_up"), F.lit(2.0))).alias("brier_up"),
    )
    ref = each.where(F.col("model") == base).select(*keys, F.col("crps").alias("_base"))
    return each.join(ref, keys, "left").withColumn("skill", 1 - F.col("crps") / F.col("_base")).drop("_base")


TAIL = "n long, seen long, expected double, at_least double, at_most double, poisson double"


def tail_calibration(scores: DataFrame, by: list[str], multiple: float) -> DataFrame:
    """By key and horizon: endings above a multiple of the anchor, counted once for each as-of date, against
    the driftless Gaussian chances from each date's own sigma. A group is the dates of one series."""
    each = scores.where("sigma > 0").groupBy(*by, "horizon", "pos").agg(F.max("sigma").alias("sigma"), F.max("growth").alias("growth"))
    kinds = dict(scores.dtypes)

    def tail(group: pd.DataFrame) -> pd.DataFrame:
        h = int(group["horizon"].iloc[0])
        p = [scoring.driftless_gaussian(multiple, s, h) for s in group["sigma"]]
        seen = int((group["growth"] > multiple).sum())
        got = inference.tail_test(p, seen)
        row = {k: group[k].iloc[0] for k in [*by, "horizon"]} | {"n": len(p), "seen": seen} | got
        return pd.DataFrame([row])[[*by, "horizon", *[c.split()[0] for c in TAIL.split(", ")]]]

    schema = ", ".join(f"{k} {kinds[k]}" for k in [*by, "horizon"]) + ", " + TAIL
    return each.groupBy(*by, "horizon").applyInPandas(tail, schema)
