"""Queries act on whole series, not on a prefix of them."""

import json

import numpy as np
import pytest

from tidegauge.functions import stats
from tidegauge.plans import backtests, ensembles, scoring, volatility

SF = "/root/testdata/sf0.001"


def test_poisson_binomial_tail_of_every_forecast(spark):
    rng = np.random.default_rng(3)
    rows = [(s, int(i), float(rng.uniform(0.05, 0.6)), float(rng.integers(2))) for s in "AB" for i in range(45)]
    got = {r["series_id"]: r for r in scoring.binomial_tail(spark.createDataFrame(rows, "series_id string, pos long, p double, y double")).collect()}
    for s in "AB":
        pmf, seen = stats.poisson_binomial([r[2] for r in rows if r[0] == s]), int(sum(r[3] for r in rows if r[0] == s))
        assert got[s]["seen"] == seen
        assert got[s]["at_least"] == pytest.approx(pmf[seen:].sum(), abs=1e-8)
        assert got[s]["at_most"] == pytest.approx(pmf[: seen + 1].sum(), abs=1e-8)


def test_gjr_runs_to_the_last_return(spark):
    omega, alpha, gamma, beta = volatility.THETA
    series = volatility.log_r(spark, SF).where("r IS NOT NULL").toPandas().sort_values("date").groupby("series_id")["r"].apply(list)
    path = {(r["series_id"], r["i"]): r["v"] for r in volatility.gjr_fixed_theta_path(spark, SF).collect()}
    nll = {r["series_id"]: r["nll"] for r in volatility.gjr_fixed_theta_nll(spark, SF).collect()}
    ahead = {(r["series_id"], r["h"]): r["sigma"] for r in volatility.gjr_forward_sigma(spark, SF).collect()}
    assert max(map(len, series)) > 250
    assert len(path) == sum(len(e) + 1 for e in series)
    for s, e in series.items():
        v, total = float(np.var(e)), 0.0
        for i, x in enumerate(e, 1):
            assert path[s, i] == pytest.approx(v, abs=2e-9)
            total += 0.5 * (np.log(2 * np.pi) + np.log(v) + x * x / v)
            v = omega + (alpha + gamma * (x < 0)) * x * x + beta * v
        assert path[s, len(e) + 1] == pytest.approx(v, abs=2e-9)
        assert nll[s] == pytest.approx(total, abs=1e-5)
        for h in range(1, 22):
            assert ahead[s, h] == pytest.approx(np.sqrt(v), abs=1e-7)
            v = omega + (alpha + gamma / 2 + beta) * v


def test_forecast_artifact_is_of_the_latest_date(spark):
    got = {(r["series_id"], r["model"]): json.loads(r["artifact"]) for r in backtests.forecast_artifact(spark, SF).collect()}
    want = {(r["series_id"], r["model"]): r for r in backtests.forecast_block(spark, SF).collect()}
    assert got.keys() == want.keys()
    for k, a in got.items():
        assert round(a["quantiles"]["q50"], 4) == want[k]["q50"]


def test_every_asof_date_has_rows(spark):
    want = {(r["series_id"], r["pos"]) for r in ensembles.at(spark, SF).select("series_id", "pos").collect()}
    assert len({pos for _, pos in want}) > 1
    for query in (ensembles.bootstrap_shocks, ensembles.session_limit_paths, ensembles.composed_fx_paths):
        assert {(r["series_id"], r["pos"]) for r in query(spark, SF).select("series_id", "pos").distinct().collect()} == want


def test_walk_forward_steps_five_sessions():
    assert (backtests.REQUEST.step, backtests.REQUEST.n_paths) == (5, 4000)
