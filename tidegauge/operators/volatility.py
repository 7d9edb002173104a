"""Volatility: range estimators, strictly backward rolling sigma, HAR, asymmetric GARCH."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DeterministicVarianceError, InsufficientDataError
from .returns import in_order

LN2 = math.log(2.0)


def positive(v: Column) -> Column:
    """An unmeasurable variance is absent, not zero."""
    return F.when(v > 0, v)


def parkinson(high: Column, low: Column) -> Column:
    return positive(F.pow(F.ln(high / low), F.lit(2.0)) / (4 * LN2))


def garman_klass(open_: Column, high: Column, low: Column, close: Column) -> Column:
    return positive(0.5 * F.pow(F.ln(high / low), F.lit(2.0)) - (2 * LN2 - 1) * F.pow(F.ln(close / open_), F.lit(2.0)))


def guarded(agg, x: str, by: list[str], first: int, last: int, order: str = "date") -> Column:
    """A framed aggregate that is null unless every row of the frame has a value."""
    w = in_order(by, order).rowsBetween(first, last)
    return F.when(F.count(x).over(w) == last - first + 1, agg(x).over(w))


def rolling_sigma(returns: DataFrame, by: list[str], window: int, order: str = "date") -> DataFrame:
    """Sigma of the window strictly before each row, and the standardised residual where it is positive."""
    df = returns.withColumn("sigma", guarded(F.stddev_samp, "r", by, -window, -1, order))
    mean = F.avg("r").over(Window.partitionBy(*by))
    return df.withColumn("z", F.when(F.col("sigma") > 0, (F.col("r") - mean) / F.col("sigma")))


def next_sigma(returns: DataFrame, by: list[str], window: int, order: str = "date") -> DataFrame:
    """The sigma that the next session faces: of the last window, today included."""
    df = returns.withColumn("sigma", guarded(F.stddev_samp, "r", by, -window + 1, 0, order))
    return df.groupBy(*by).agg(F.max_by("sigma", order).alias("sigma"), F.max(order).alias(order))


def har_design(variances: DataFrame, by: list[str], order: str = "date") -> DataFrame:
    """y, x_d, x_w, x_m on the log scale; unmeasurable days are dropped before any lag."""
    seen = variances.where("v > 0")
    df = seen.select(
        *by, order, F.ln("v").alias("y"), F.ln(F.lag("v", 1).over(in_order(by, order))).alias("x_d"),
        F.ln(guarded(F.avg, "v", by, -5, -1, order)).alias("x_w"), F.ln(guarded(F.avg, "v", by, -22, -1, order)).alias("x_m"),
    )
    return df.where("x_d IS NOT NULL AND x_w IS NOT NULL AND x_m IS NOT NULL")


def require_ohlc(df: DataFrame) -> DataFrame:
    """Range estimators need the whole bar: closes alone are refused when the plan is built."""
    if missing := [c for c in ("open", "high", "low", "close") if c not in df.columns]:
        raise InsufficientDataError(f"a range needs {', '.join(missing)}")
    return df


def gram(df: DataFrame, by: list[str], columns: list[str], y: str) -> DataFrame:
    """Cross products of the design by group, in one pass."""
    names = ["one", *columns]
    base = df.withColumn("one", F.lit(1.0))
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
    sums += [F.sum(F.col(a) * F.col(y)).alias(f"{a}_y") for a in names] + [F.sum(F.col(y) * F.col(y)).alias("y_y"), F.count(F.lit(1)).alias("n")]
    return base.groupBy(*by).agg(*sums)


def solve_gram(row: dict, columns: list[str]) -> tuple[np.ndarray, float]:
    """Least squares from cross products: coefficients (constant first) and residual variance with ddof = p."""
    names = ["one", *columns]
    p = len(names)
    a = np.zeros((p, p))
    for i, x in enumerate(names):
        for j, z in enumerate(names[i:], i):
            a[i, j] = a[j, i] = row[f"{x}_{z}"]
    b = np.array([row[f"{x}_y"] for x in names])
    beta = np.linalg.solve(a, b)
    return beta, float((row["y_y"] - beta @ b) / (row["n"] - p))


def har_fit(variances: DataFrame, by: list[str], least: int = 60) -> DataFrame:
    """OLS of the design by series, a 4 x 4 system in each row of cross products, and the smearing term:
    the key, const, day, week, month, smearing, n. Shorter series give no row."""
    sums = gram(har_design(variances, by), by, ["x_d", "x_w", "x_m"], "y").where(F.col("n") >= least)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for got in batch.to_dict("records"):
                beta, variance = solve_gram(got, ["x_d", "x_w", "x_m"])
                rows.append([*(got[k] for k in by), *map(float, beta), variance / 2, got["n"]])
            yield pd.DataFrame(rows, columns=[*by, "const", "day", "week", "month", "smearing", "n"])

    kinds = dict(variances.dtypes)
    return sums.mapInPandas(solve, ", ".join(f"{k} {kinds[k]}" for k in by) + ", const double, day double, week double, month double, smearing double, n long")


def har_forward(beta: Iterable[float], smearing: float, recent: list[float], horizon: int) -> list[float]:
    """Sigmas ahead: the cascade runs on the log scale; smearing enters what is reported, never the state."""
    const, day, week, month = beta
    history, out = list(recent[-22:]), []
    if len(history) < 22:
        raise InsufficientDataError("the cascade needs 22 measurable variances")
    for _ in range(horizon):
        log_v = const + day * math.log(history[-1]) + week * math.log(np.mean(history[-5:])) + month * math.log(np.mean(history[-22:]))
        out.append(math.sqrt(math.exp(log_v + smearing)))
        history.append(math.exp(log_v))
    return out


# asymmetric GARCH


def gjr_variances(eps: Column, omega: float, alpha: float, gamma: float, beta: float, start: Column) -> Column:
    """Array of n + 1 variances from an array of residuals; a null residual is no news."""
    acc = F.struct(F.array(start).alias("path"), start.alias("v"))

    def step(a: Column, e: Column) -> Column:
        news = F.coalesce(F.when(e < 0, alpha + gamma).otherwise(alpha) * e * e, F.lit(0.0))
        v = F.lit(omega) + news + beta * a["v"]
        return F.struct(F.concat(a["path"], F.array(v)).alias("path"), v.alias("v"))

    return F.aggregate(eps, acc, step)["path"]


def gjr_forward(omega: float, alpha: float, gamma: float, beta: float, following: float, horizon: int) -> list[float]:
    """Sigmas ahead, closed form: the next variance decays to the unconditional one by persistence."""
    p = alpha + gamma / 2 + beta
    level = omega / (1 - p)
    return [math.sqrt(level + p**k * (following - level)) for k in range(horizon)]


def _gjr_path(r: list[float], used: list[bool], th: tuple, start: float) -> list[float]:
    w, a, g, b = th
    v, out = start, [start]
    for x, ok in zip(r, used, strict=True):
        v = w + ((a + g) * x * x if x < 0 else a * x * x if ok else 0.0) * ok + b * v
        out.append(v)
    return out


def gjr_nll(r: list[float], used: list[bool], th: tuple, nu: float | None, start: float) -> float:
    """Negative log-likelihood, normal or scaled Student t; anything not finite is a wall."""
    total = 0.0
    if nu:
        const = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))
    for x, ok, v in zip(r, used, _gjr_path(r, used, th, start), strict=False):
        if v <= 0:
            return 1e12
        if ok:
            if nu:
                total -= const - 0.5 * math.log(v) - (nu + 1) / 2 * math.log1p(x * x / (v * (nu - 2)))
            else:
                total += 0.5 * (math.log(2 * math.pi) + math.log(v) + x * x / v)
    return total if math.isfinite(total) else 1e12


def _unpack(u: np.ndarray, scale: float) -> tuple[tuple, float]:
    """Unconstrained numbers to parameters: persistence below 1, alpha + gamma at least 0."""
    s = lambda x: 1 / (1 + math.exp(-max(-30, min(30, x))))
    p, share, lean = 0.9999 * s(u[1]), s(u[2]), 2 * s(u[3]) - 1
    news = p * share  # alpha + gamma / 2
    alpha, gamma = (news * (1 - lean), 2 * news * lean) if lean >= 0 else (news * (1 - lean / 2), news * lean)
    omega = scale * math.exp(max(-20, min(5, u[0])))
    return (omega, max(alpha, 0.0), gamma, p * (1 - share)), 2.1 + 57.9 * s(u[4])


def simplex(f, x0: np.ndarray, steps: int = 400, tol: float = 1e-7) -> tuple[np.ndarray, float]:
    """Nelder and Mead's method."""
    n = len(x0)
    pts = [np.array(x0, float)] + [x0 + 0.5 * np.eye(n)[i] for i in range(n)]
    vals = [f(p) for p in pts]
    for _ in range(steps):
        order = np.argsort(vals)
        pts, vals = [pts[i] for i in order], [vals[i] for i in order]
        if abs(vals[-1] - vals[0]) < tol * (1 + abs(vals[0])):
            break
        mid = np.mean(pts[:-1], axis=0)
        far = mid + (mid - pts[-1])
        v = f(far)
        if v < vals[0]:
            further = mid + 2 * (mid - pts[-1])
            v2 = f(further)
            pts[-1], vals[-1] = (further, v2) if v2 < v else (far, v)
        elif v < vals[-2]:
            pts[-1], vals[-1] = far, v
        else:
            near = mid + 0.5 * ((far if v < vals[-1] else pts[-1]) - mid)
            v2 = f(near)
            if v2 < min(v, vals[-1]):
                pts[-1], vals[-1] = near, v2
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
                vals = [vals[0]] + [f(p) for p in pts[1:]]
    best = int(np.argmin(vals))
    return pts[best], float(vals[best])


def gjr_fit(r: np.ndarray, used: np.ndarray | None = None, student: bool = True, least: int = 250, zero_mean: bool = False) -> dict:
    """Maximum likelihood of GJR(1,1,1) on returns x 100, from four starts; the mean is a constant or 0."""
    r = np.asarray(r, float) * 100
    used = np.isfinite(r) if used is None else np.asarray(used, bool) & np.isfinite(r)
    if used.sum() < least:
        raise InsufficientDataError(f"{int(used.sum())} usable returns, {least} needed")
    mean = 0.0 if zero_mean else float(r[used].mean())
    x = np.where(used, r - mean, 0.0)
    start = float(np.var(x[used]))
    xs, us = x.tolist(), used.tolist()
    f = lambda u: gjr_nll(xs, us, _unpack(u, start)[0], _unpack(u, start)[1] if student else None, start)
    starts = [(-3.5, 3.0, -2.0, 0.0, -1.5), (-3.0, 2.5, -1.5, 1.0, -2.0), (-2.0, 1.5, -1.0, 0.3, -1.0), (-1.0, 0.0, -2.0, 0.0, 0.0)]
    best = min((simplex(f, np.array(s), steps=120) for s in starts), key=lambda b: b[1])
    best = simplex(f, best[0], steps=400)
    th, nu = _unpack(best[0], start)
    path = _gjr_path(xs, us, th, start)
    z = np.where(used, x / np.sqrt(path[:-1]), np.nan)
    return {"mean": mean / 100, "omega": th[0] / 1e4, "alpha": th[1], "gamma": th[2], "beta": th[3], "nu": nu if student else None,
            "nll": best[1], "next_variance": path[-1] / 1e4, "z": z, "n": int(used.sum())}


FIT = "omega double, alpha double, gamma double, beta double, nu double, nll double, next_sigma double, n long"


def gjr_fit_groups(returns: DataFrame, by: list[str], least: int = 250) -> DataFrame:
    """One fit for each group, in parallel over groups; groups too short give no row."""
    kinds = dict(returns.dtypes)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("date")
        try:
            got = gjr_fit(group["r"].to_numpy(), least=least)
        except InsufficientDataError:
            return pd.DataFrame(columns=[*by, *[c.split()[0] for c in FIT.split(", ")]])
        row = {k: group[k].iloc[0] for k in by} | {c: got[c] for c in ("omega", "alpha", "gamma", "beta", "nu", "nll", "n")}
        return pd.DataFrame([row | {"next_sigma": math.sqrt(got["next_variance"])}])[[*by, "omega", "alpha", "gamma", "beta", "nu", "nll", "next_sigma", "n"]]

    return returns.select(*by, "date", "r").groupBy(*by).applyInPandas(fit, ", ".join(f"{k} {kinds[k]}" for k in by) + ", " + FIT)


DATES_AT_ONCE = 8


def gjr_fit_asofs(arrays: DataFrame, by: list[str], rs: str, first: int, step: int, least: int = 250) -> DataFrame:
    """A fit for each as-of position (a number of returns) of each series. A row carries the returns up to the
    last of its few dates, so a history travels once for each group of dates, and groups spread evenly."""
    kinds = dict(arrays.dtypes)
    n = F.size(rs)
    starts = F.explode(F.sequence(F.lit(first), n, F.lit(step * DATES_AT_ONCE))).alias("start")
    groups = arrays.where(n >= first).select(*by, rs, starts)
    end = F.least(F.size(rs), F.col("start") + step * (DATES_AT_ONCE - 1))
    groups = groups.select(*by, F.sequence("start", end, F.lit(step)).alias("asofs"), F.slice(rs, F.lit(1), end).alias("rs"))
    spread = groups.repartition(max(64, arrays.sparkSession.sparkContext.defaultParallelism * 4), *by, "asofs")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("omega", "alpha", "gamma", "beta", "nu", "nll")
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                for asof in row["asofs"]:
                    try:
                        got = gjr_fit(np.asarray(row["rs"][:asof], float), least=least)
                    except InsufficientDataError:
                        continue
                    rows.append([*(row[k] for k in by), int(asof), *(got[c] for c in names), math.sqrt(got["next_variance"]), got["n"]])
            yield pd.DataFrame(rows, columns=[*by, "asof", *[c.split()[0] for c in FIT.split(", ")]])

    return spread.mapInPandas(fit, ", ".join(f"{k} {kinds[k]}" for k in by) + ", asof int, " + FIT)


#: Whether a model's variance depends on the path simulated.
PER_PATH_VARIANCE = {"gjr_garch": True, "rolling_std": False, "har_rv": False}


def require_per_path_variance(model: str, leveraged: bool) -> None:
    """A leveraged answer needs a model whose variance reacts along the path."""
    if leveraged and not PER_PATH_VARIANCE[model]:
        raise DeterministicVarianceError(f"{model} simulates every path with the same variances")


def har_propagate(mean: float, sigmas: Iterable[float], shocks: np.ndarray) -> np.ndarray:
    """Returns of all paths under one trajectory of sigmas."""
    return mean + np.asarray(list(sigmas))[None, :] * shocks


def gjr_propagate(mean: float, th: tuple, following: float, shocks: np.ndarray) -> np.ndarray:
    """Returns of each path, whose variance follows its own shocks; loops over time, not paths."""
    w, a, g, b = th
    v, out = np.full(len(shocks), following), np.empty_like(shocks)
    for t in range(shocks.shape[1]):
        e = np.sqrt(v) * shocks[:, t]
        out[:, t] = mean + e
        v = w + (a + g * (e < 0)) * e * e + b * v
    return out
