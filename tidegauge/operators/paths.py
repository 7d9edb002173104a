"""Path ensembles: deterministic draws, block bootstrap, limits, passage, copulas.

A path is drawn, walked and kept as one array inside one row, from the series' return array that
the row carries along: no join, no shuffle, and the cells of an ensemble never become rows.
Draws are keyed by (path, block, seed), so any partitioning gives the same numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InsufficientDataError, MixedDriftPolicyError
from ..functions import stats

MODULUS = 2147483648


@dataclass(frozen=True)
class Model:
    """A bootstrap forecaster: block length (1: iid) and whether the pool's mean is removed."""

    number: int
    block: int
    demean: bool = True


def require_one_drift_policy(models: list[Model]) -> None:
    if len({m.demean for m in models}) > 1:
        raise MixedDriftPolicyError("models that carry drift and models that do not are not compared")


def lcg(path: Column, block: Column, seed: Column) -> Column:
    """A draw in [0, 2^31), the same in every engine with 64-bit integers."""
    return F.pmod(path * F.lit(1103515245) + block * F.lit(12345) + F.pmod(seed, F.lit(MODULUS)) * F.lit(2654435761), F.lit(MODULUS))


def series_arrays(prices: DataFrame, by: list[str], price: str = "px") -> DataFrame:
    """One row by series: prices and log returns in order of date (the first return is null)."""
    packed = prices.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("date", price))).alias("x"))
    px = F.transform("x", lambda v: v[price])
    before = F.concat(F.array(F.lit(None).cast("double")), F.slice(px, 1, F.size("x") - 1))
    rs = F.transform(F.arrays_zip(px.alias("a"), before.alias("b")), lambda v: F.ln(v["a"]) - F.ln(v["b"]))
    return packed.select(*by, F.transform("x", lambda v: v["date"]).alias("dates"), px.alias("ps"), rs.alias("rs"))


def asofs(arrays: DataFrame, by: list[str], first: int, step: int, horizon: int) -> DataFrame:
    """A row for each as-of position (from 0) whose horizon has elapsed; the arrays ride along."""
    last = F.size("ps") - 1 - horizon
    at = F.explode(F.sequence(F.lit(first), last, F.lit(step)))
    return arrays.where(last >= first).select(*by, "dates", "ps", "rs", at.alias("pos")).withColumn("pos", F.col("pos").cast("long"))


def _indices(pos: Column, path: Column, seed: Column, block: Column, horizon: int) -> Column:
    """Positions 1..pos of the pool that a path visits: circular contiguous blocks."""

    def place(k: Column) -> Column:
        start = F.pmod(lcg(path, F.floor(k / block), seed), pos)
        return F.pmod(start + F.pmod(k, block), pos) + 1

    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(horizon - 1).cast("long")), place)


def simulate(at: DataFrame, by: list[str], models: list[Model], n_paths: int, horizon: int) -> DataFrame:
    """(key, pos, anchor, model, path, prices): prices at sessions 1..horizon of every path."""
    kinds = F.array(*[F.struct(F.lit(m.number).cast("long").alias("model"), F.lit(m.block).cast("long").alias("block"), F.lit(1.0 if m.demean else 0.0).alias("demean")) for m in models])
    anchor = F.element_at("ps", (F.col("pos") + 1).cast("int"))
    mean = (F.ln(anchor) - F.ln(F.element_at("ps", 1))) / F.col("pos")
    rows = at.select(*by, "pos", "rs", anchor.alias("anchor"), mean.alias("mean"), F.explode(kinds).alias("m"))
    rows = rows.select(*by, "pos", "rs", "anchor", "mean", "m.*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_paths - 1).cast("long"))).alias("path"))
    index = _indices(F.col("pos"), F.col("path"), F.col("pos") * 1000 + F.col("model"), F.col("block"), horizon)
    shocks = F.transform(index, lambda i: F.element_at("rs", (i + 1).cast("int")) - F.col("demean") * F.col("mean"))
    init = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("out"))
    walked = F.aggregate("shocks", init, lambda a, r: F.struct((a["s"] + r).alias("s"), F.concat(a["out"], F.array(F.col("anchor") * F.exp(a["s"] + r))).alias("out")))["out"]
    return rows.withColumn("shocks", shocks).select(*by, "pos", "anchor", "model", "path", "shocks", walked.alias("prices"))


def reduced(paths: DataFrame) -> DataFrame:
    """terminal, run_min and run_max of each path: enough for every event."""
    return paths.select(*[c for c in paths.columns if c not in ("prices", "shocks")], F.element_at("prices", -1).alias("terminal"), F.array_min("prices").alias("run_min"), F.array_max("prices").alias("run_max"))


def scaled(paths: DataFrame, factor: float) -> DataFrame:
    """The ensemble in another unit: prices and anchor times a positive factor."""
    if factor <= 0:
        raise ValueError("a scale is positive")
    return paths.withColumns({"anchor": F.col("anchor") * factor, "prices": F.transform("prices", lambda p: p * factor)})


def centred(paths: DataFrame, by: list[str]) -> DataFrame:
    """Shocks less their mean over all paths and steps of an ensemble: one number for each ensemble."""
    total = F.aggregate("shocks", F.lit(0.0), lambda a, r: a + r)
    mean = paths.groupBy(*by).agg((F.sum(total) / F.sum(F.size("shocks"))).alias("_mean"))
    return paths.join(mean, by).withColumn("shocks", F.transform("shocks", lambda r: r - F.col("_mean"))).drop("_mean")


def limited(shocks: Column, anchor: Column, cap: float, relaxed: float, carry_residual: bool = True) -> Column:
    """Prices under a session limit: a move beyond the cap is cut, the rest carried on, and the cap
    is relaxed in the session after a cut. Struct of prices and number of cuts."""
    init = F.struct(anchor.alias("p"), F.lit(0.0).alias("carry"), F.lit(False).alias("locked"), F.array().cast("array<double>").alias("prices"), F.lit(0).cast("long").alias("cuts"))

    def step(a: Column, r: Column) -> Column:
        target = a["p"] * F.exp(r + a["carry"])
        c = F.when(a["locked"], relaxed).otherwise(cap)
        price = F.least(F.greatest(target, a["p"] * (1 - c)), a["p"] * (1 + c))
        cut = price != target
        left = F.when(cut, F.ln(target / price)).otherwise(0.0) if carry_residual else F.lit(0.0)
        return F.struct(price.alias("p"), left.alias("carry"), cut.alias("locked"), F.concat(a["prices"], F.array(price)).alias("prices"), (a["cuts"] + cut.cast("long")).alias("cuts"))

    got = F.aggregate(shocks, init, step)
    return F.struct(got["prices"].alias("prices"), got["cuts"].alias("cuts"))


def first_passage(paths: DataFrame, by: list[str], barrier: Column, down: bool = True) -> DataFrame:
    """Touch and terminal probabilities, sessions to the first touch, survivors' terminal quantiles."""
    hit = (lambda p: p <= barrier) if down else (lambda p: p >= barrier)
    first = F.array_min(F.transform("prices", lambda p, i: F.when(hit(p), i + 1)))
    terminal = F.element_at("prices", -1)
    got = paths.select(*by, first.alias("_first"), terminal.alias("_terminal"), hit(terminal).alias("_ends"))
    touch, ends = F.avg(F.col("_first").isNotNull().cast("double")), F.avg(F.col("_ends").cast("double"))
    alive = F.when(F.col("_first").isNull(), F.col("_terminal"))
    return got.groupBy(*by).agg(
        touch.alias("touch"), ends.alias("ends"), F.count("_first").alias("n_touched"), (touch / F.nullif(ends, F.lit(0.0))).alias("ratio"),
        F.avg("_first").alias("mean_sessions"), F.percentile(alive, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q"),
    )


def margin_barrier(anchor: float, leverage: float, maintenance: float = 0.0, side: str = "long") -> float:
    """The price at which margin is called; an unleveraged long is never called."""
    if leverage <= 0 or maintenance >= 1:
        raise ValueError("leverage must be positive and maintenance below 1")
    if side == "long" and leverage == 1:
        return -math.inf
    return anchor * (1 + (-1 if side == "long" else 1) * (1 - maintenance) / leverage)


def headline(profit: Column, liquidation: Column) -> Column:
    """Which statistic leads: a likelier liquidation, an unlikely profit, or the distribution."""
    return F.when(liquidation > profit, "liquidation_probability").when(profit < 0.5, "expected_loss").otherwise("distribution")


def pseudo_observations(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """rank / (n + 1), strictly inside (0, 1)."""
    whole = Window.partitionBy(*by)
    return df.withColumn("u", F.rank().over(whole.orderBy(x)) / (F.count(F.lit(1)).over(whole) + 1))


# Student-t copula


def _t_quantiles(u: np.ndarray, df: float) -> np.ndarray:
    x = np.sinh(np.linspace(-9, 9, 20_001))
    log_f = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi) - (df + 1) / 2 * np.log1p(x * x / df)
    f = np.exp(log_f)
    cdf = np.concatenate([[0], np.cumsum((f[1:] + f[:-1]) / 2 * np.diff(x))])
    return np.interp(u, cdf / cdf[-1], x)


def fit_t_copula(a: np.ndarray, b: np.ndarray, ceiling: float = 60.0, least: int = 60) -> dict:
    """rho from Kendall's tau, degrees of freedom by maximum likelihood."""
    if len(a) < least:
        raise InsufficientDataError(f"{len(a)} common dates, {least} needed")
    tau = stats.kendall_tau(a, b)
    rho = math.sin(math.pi * tau / 2)
    n = len(a)
    u, v = ((np.argsort(np.argsort(x, kind="stable"), kind="stable") + 1) / (n + 1) for x in (a, b))

    def loss(df: float) -> float:
        x, y = _t_quantiles(u, df), _t_quantiles(v, df)
        q = (x * x - 2 * rho * x * y + y * y) / (df * (1 - rho * rho))
        joint = math.lgamma((df + 2) / 2) + math.lgamma(df / 2) - 2 * math.lgamma((df + 1) / 2) - 0.5 * math.log(1 - rho * rho)
        return -float((joint - (df + 2) / 2 * np.log1p(q) + (df + 1) / 2 * (np.log1p(x * x / df) + np.log1p(y * y / df))).sum())

    low, high, g = math.log(2.1), math.log(ceiling), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = high - g * (high - low), low + g * (high - low)
        low, high = (low, d) if loss(math.exp(c)) < loss(math.exp(d)) else (c, high)
    df = math.exp((low + high) / 2)
    tail = 2 * stats.t_sf(math.sqrt((df + 1) * (1 - rho) / (1 + rho)), df + 1)
    return {"rho": rho, "df": df, "kendall_tau": tau, "n": n, "log_likelihood": -loss(df), "df_at_bound": df > ceiling - 1, "tail_dependence": tail}


def sample_t_copula(rho: float, df: float, n: int, rng: np.random.Generator) -> np.ndarray:
    """Uniform margins joined by the copula."""
    z = rng.standard_normal((n, 2)) @ np.linalg.cholesky(np.array([[1, rho], [rho, 1]])).T
    x = z / np.sqrt(rng.chisquare(df, n) / df)[:, None]
    grid = np.linspace(1e-6, 1 - 1e-6, 20_001)
    return np.interp(x, _t_quantiles(grid, df), grid)


def joint_shocks(a: np.ndarray, b: np.ndarray, rho: float, df: float, n_paths: int, horizon: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shocks of both pools joined by the copula; values stay in each pool."""
    u = sample_t_copula(rho, df, n_paths * horizon, np.random.default_rng(seed))
    pick = lambda pool, v: np.sort(pool)[np.minimum((v * len(pool)).astype(int), len(pool) - 1)].reshape(n_paths, horizon)
    return pick(a, u[:, 0]), pick(b, u[:, 1])


def synchronised_shocks(a: np.ndarray, b: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same dates drawn from both aligned pools."""
    return a[index], b[index]


def tcopula_groups(pairs: DataFrame, by: list[str]) -> DataFrame:
    """A copula for each group of (x, y) rows."""
    kinds = dict(pairs.dtypes)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        got = fit_t_copula(group["x"].to_numpy(), group["y"].to_numpy())
        return pd.DataFrame([{k: group[k].iloc[0] for k in by} | {c: got[c] for c in ("rho", "df", "kendall_tau", "n", "log_likelihood", "tail_dependence")}])

    schema = ", ".join(f"{k} {kinds[k]}" for k in by) + ", rho double, df double, kendall_tau double, n long, log_likelihood double, tail_dependence double"
    return pairs.groupBy(*by).applyInPandas(fit, schema)
