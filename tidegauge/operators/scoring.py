"""Scores of forecast distributions and of event probabilities, and tests of them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import OverlappingWindowsError
from ..functions import stats
from .returns import in_order

EDGES = [float(x) for x in np.linspace(0.0, 1.0, 11)]


def stride(horizon: int, step: int) -> int:
    return -(-horizon // step)


def require_independent(horizon: int, step: int, what: str) -> None:
    if step < horizon:
        raise OverlappingWindowsError(f"{what} on windows of {horizon} sessions taken every {step}")


def thin(df: DataFrame, by: list[str], every: int, order: str = "pos") -> DataFrame:
    """Every stride-th row of each group."""
    return df.withColumn("_k", F.row_number().over(in_order(by, order)) - 1).where(F.col("_k") % every == 0).drop("_k")


def crps_fair(values: Column, y: Column) -> Column:
    """Fair CRPS of an ensemble (array) against an outcome: unbiased in the ensemble's size."""
    n = F.size(values)
    near = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.abs(x - y)) / n
    weighted = F.transform(F.array_sort(values), lambda x, i: (2 * (i + 1) - n - 1) * x)
    spread = F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x)
    return F.when(n > 1, near - spread / (n * (n - 1))).otherwise(near)


def pit(values: Column, y: Column, u: Column) -> Column:
    """Randomised probability integral transform."""
    below = F.size(F.filter(values, lambda x: x < y))
    ties = F.size(F.filter(values, lambda x: x == y))
    return (below + u * (ties + 1)) / (F.size(values) + 1)


def bin_of(p: Column) -> Column:
    """How many interior edges are at or below p; the edges are the literals of an even grid."""
    return sum(((p >= e).cast("long") for e in EDGES[1:-1]), F.lit(0).cast("long"))


def histogram(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """Counts in ten even bins, empty ones too."""
    seen = df.groupBy(*by, bin_of(F.col(x)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))))
    return every.join(seen, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def ks_distance(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """Largest gap between the sample's distribution and the uniform one."""
    w = Window.partitionBy(*by)
    i, n = F.row_number().over(w.orderBy(x)), F.count(F.lit(1)).over(w)
    return df.select(*by, F.greatest(i / n - F.col(x), F.col(x) - (i - 1) / n).alias("gap")).groupBy(*by).agg(F.max("gap").alias("d"), F.count(F.lit(1)).alias("n"))


def chi2_uniform(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """Pearson's statistic of the ten bins; underpowered below five expected in each."""
    h = histogram(df, by, x).withColumn("e", F.sum("n").over(Window.partitionBy(*by)) / 10)
    return h.groupBy(*by).agg(F.sum(F.pow(F.col("n") - F.col("e"), F.lit(2.0)) / F.col("e")).alias("statistic"), F.first("e").alias("expected")).withColumn("underpowered", F.col("expected") < 5)


def xlogy(x: Column, y: Column) -> Column:
    return F.when(x == 0, 0.0).otherwise(x * F.ln(y))


def log_likelihood(k: Column, n: Column, p: Column) -> Column:
    return xlogy(n - k, 1 - p) + xlogy(k, p)


def kupiec(df: DataFrame, by: list[str], rate: float) -> DataFrame:
    """Proportion of failures: n, breaches and the likelihood ratio."""
    got = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if("breach").alias("breaches"))
    k, n = F.col("breaches"), F.col("n")
    return got.withColumn("statistic", F.greatest(-2 * (log_likelihood(k, n, F.lit(rate)) - log_likelihood(k, n, k / n)), F.lit(0.0)))


def christoffersen(df: DataFrame, by: list[str], order: str = "date") -> DataFrame:
    """Independence of successive breaches; undefined if none precedes another observation."""
    now = df.withColumn("prev", F.lag("breach").over(in_order(by, order))).where("prev IS NOT NULL")
    counts = [F.count_if((F.col("prev") == a) & (F.col("breach") == b)).alias(f"n{int(a)}{int(b)}") for a in (False, True) for b in (False, True)]
    got = now.groupBy(*by).agg(*counts)
    n00, n01, n10, n11 = (F.col(c) for c in ("n00", "n01", "n10", "n11"))
    total, hits = n00 + n01 + n10 + n11, n01 + n11
    calm = F.when(n00 + n01 > 0, n01 / (n00 + n01)).otherwise(0.0)
    free = log_likelihood(n01, n00 + n01, calm) + log_likelihood(n11, n10 + n11, n11 / F.nullif(n10 + n11, F.lit(0)))
    stat = F.greatest(-2 * (log_likelihood(hits, total, hits / total) - free), F.lit(0.0))
    return got.withColumn("statistic", F.when(n10 + n11 > 0, stat))


def murphy(df: DataFrame, by: list[str], bins: Column) -> DataFrame:
    """Brier score and its parts; what the bins blur is the binning error."""
    whole = df.withColumn("base", F.avg("y").over(Window.partitionBy(*by))).withColumn("bin", bins)
    cell = whole.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("c"), F.avg("p").alias("f"), F.avg("y").alias("o"), F.first("base").alias("base"), F.sum(F.pow(F.col("p") - F.col("y"), F.lit(2.0))).alias("se"))
    n, gap = F.sum("c"), lambda a, b: F.sum(F.col("c") * F.pow(F.col(a) - F.col(b), F.lit(2.0)))
    out = cell.groupBy(*by).agg(n.alias("n"), (F.sum("se") / n).alias("brier"), (gap("f", "o") / n).alias("reliability"), (gap("o", "base") / n).alias("resolution"), F.first("base").alias("base_rate"))
    out = out.withColumn("uncertainty", F.col("base_rate") * (1 - F.col("base_rate")))
    return out.withColumn("binning_error", F.col("brier") - (F.col("reliability") - F.col("resolution") + F.col("uncertainty")))


def reliability_bins(df: DataFrame, by: list[str], min_positives: int = 10) -> DataFrame:
    """The diagram's ten bins, empty ones kept; withheld where positives are too few."""
    enough = df.groupBy(*by).agg(F.sum("y").alias("positives")).where(F.col("positives") >= min_positives).select(*by)
    seen = df.withColumn("bin", bin_of(F.col("p"))).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("forecast"), F.avg("y").alias("observed"))
    every = enough.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))))
    return every.join(seen, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def diebold_mariano(df: DataFrame, by: list[str], overlap: int, order: str = "pos") -> DataFrame:
    """HAC t-statistic of the loss differential ``d`` with the small-sample factor."""
    lag, w = overlap - 1, Window.partitionBy(*by)
    c = df.withColumn("c", F.col("d") - F.avg("d").over(w))
    terms = [(F.col("c") * F.lag("c", k).over(in_order(by, order))).alias(f"g{k}") for k in range(lag + 1)]
    got = c.select(*by, "d", *terms).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), *[F.sum(f"g{k}").alias(f"g{k}") for k in range(lag + 1)])
    n = F.col("n")
    variance = (F.col("g0") + sum((2 * (1 - k / (lag + 1)) * F.col(f"g{k}") for k in range(1, lag + 1)), F.lit(0.0))) / n
    factor = (n + 1 - 2 * overlap + overlap * (overlap - 1) / n) / n
    stat = F.col("mean") / F.sqrt(variance / n) * F.sqrt(factor)
    return got.select(*by, "n", "mean", F.when(variance > 0, stat).alias("statistic"))


def t_two_sided(statistic: Column, n: Column) -> Column:
    """Two-sided p of a t(n - 1) statistic; null where there is none. For one row a group, not for the hot path."""

    @F.pandas_udf("double")
    def p(x: pd.Series, k: pd.Series) -> pd.Series:
        found = [None if pd.isna(v) or m < 2 else min(1.0, 2 * stats.t_sf(abs(v), m - 1)) for v, m in zip(x, k, strict=True)]
        return pd.Series(found, dtype="float64")

    return p(statistic, n)


def skill_test(df: DataFrame, by: list[str], overlap: int, order: str = "pos", level: float = 0.05) -> DataFrame:
    """The differential ``d`` (model less null) tested twice, over all windows with HAC errors and over disjoint ones
    alone. Significant only if both reject and agree on the sign; a statistic that is undefined never rejects."""

    def one(rows: DataFrame, windows: int, tag: str) -> DataFrame:
        got = diebold_mariano(rows, by, windows, order).withColumn("p", t_two_sided(F.col("statistic"), F.col("n")))
        return got.select(*by, *[F.col(c).alias(f"{c}_{tag}") for c in ("n", "mean", "statistic", "p")])

    both = one(df, overlap, "all").join(one(thin(df, by, overlap, order), 1, "thinned"), by)
    rejects = (F.col("p_all") < level) & (F.col("p_thinned") < level) & ((F.col("mean_all") < 0) == (F.col("mean_thinned") < 0))
    return both.withColumn("significant", F.coalesce(rejects, F.lit(False))).withColumn("favours_model", F.col("mean_all") < 0)


DECAY = "slope double, intercept double, r2 double, p double, low double, high double, dates long, draws long"


def decay_test(df: DataFrame, by: list[str], draws: int, block: int, order: str = "pos", seed: int = 1) -> DataFrame:
    """Slope of skill against the log of the horizon, with the p and band of circular blocks of dates.

    ``df`` has h and the losses ``m`` and ``b`` of model and baseline. Only dates read at every
    horizon count. One group, dates by horizons of one series, is one task's; a draw weighs dates by
    how often it visits them. Fewer than three horizons or two dates give no row, nor do fewer than
    two draws of finite skill; p is never below one over the draws."""
    read = df.where(F.col("m").isNotNull() & F.col("b").isNotNull())
    keys = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    columns = [*by, *[c.split()[0] for c in DECAY.split(", ")]]

    def line(x: np.ndarray, skill: np.ndarray) -> np.ndarray:
        c = x - x.mean()
        return skill @ c / (c @ c)

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        wide = group.pivot(index=order, columns="h", values=["m", "b"])
        n_h = group["h"].nunique()
        wide = wide.dropna().sort_index()
        n = len(wide)
        if n_h < 3 or n < 2 or block < 1:
            return pd.DataFrame(columns=columns)
        x = np.log(wide["m"].columns.to_numpy(float))
        m, b = wide["m"].to_numpy(float), wide["b"].to_numpy(float)
        size = min(block, n)
        rng = np.random.default_rng(seed)
        visits = np.zeros((draws, n))
        for d in range(draws):
            at = (rng.integers(0, n, -(-n // size))[:, None] + np.arange(size)).reshape(-1)[:n] % n
            visits[d] = np.bincount(at, minlength=n)
        with np.errstate(divide="ignore", invalid="ignore"):
            seen, drawn = 1 - m.mean(0) / b.mean(0), 1 - (visits @ m) / (visits @ b)
        slopes = line(x, drawn[np.isfinite(drawn).all(1)])
        if len(slopes) < 2 or not np.isfinite(seen).all():
            return pd.DataFrame(columns=columns)
        slope = float(line(x, seen))
        intercept = float(seen.mean() - slope * x.mean())
        total = float(((seen - seen.mean()) ** 2).sum())
        r2 = 1 - float(((seen - intercept - slope * x) ** 2).sum()) / total if total else 0.0
        tail = min((slopes <= 0).mean(), (slopes >= 0).mean())
        p = max(min(1.0, 2 * float(tail)), 1 / len(slopes))
        low, high = (float(np.quantile(slopes, q)) for q in (0.025, 0.975))
        return pd.DataFrame([(*key, slope, intercept, r2, p, low, high, n, len(slopes))], columns=columns)

    return read.groupBy(*by).applyInPandas(one, f"{keys}, {DECAY}")


def conditional_coverage_p(total: Column) -> Column:
    """Chi-square with two degrees of freedom has a closed form."""
    return F.exp(-total / 2)


def driftless_gaussian(multiple: float, sigma: float, horizon: int) -> float:
    """P(terminal above the multiple) without drift; undefined without volatility."""
    return 0.5 * math.erfc(math.log(multiple) / (sigma * math.sqrt(horizon)) / math.sqrt(2)) if sigma > 0 else math.nan
