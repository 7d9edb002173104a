"""Refits, scores out of sample and drivers withheld, against plain loops."""

import numpy as np
import pytest

from tidegauge.operators import attribution, factors, scoring
from tidegauge.plans import attribution as plans

COLUMNS = ["a", "b"]


def made(spark, n=40, flat=0, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = 2 * x[:, 0] - 0.5 * x[:, 1] + rng.normal(scale=0.3, size=n)
    y[:flat] = 1.0
    rows = [(i, float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(n)]
    return spark.createDataFrame(rows, "week long, y double, a double, b double").repartition(4), x, y


def test_rolling_and_stability(spark):
    df, x, y = made(spark)
    rolled = attribution.rolling_loadings(df, COLUMNS, 20, 4).cache()
    want = [attribution.fit(x[e - 20 : e], y[e - 20 : e])[0] for e in range(20, 41, 4)]
    got = {(r["window"], r["driver"]): r["beta"] for r in rolled.collect()}
    assert got == {(k, c): pytest.approx(b[i]) for k, b in enumerate(want) for i, c in enumerate(COLUMNS)}
    band = spark.createDataFrame([("a", 1.0, 3.0), ("b", 0.5, 0.5)], "driver string, low double, high double")
    s = {r["driver"]: r for r in attribution.stability(rolled, band).collect()}
    path = np.array(want)[:, 0]
    assert (s["a"]["windows"], s["a"]["changes"]) == (6, 0)
    assert s["a"]["spread"] == pytest.approx(np.subtract(*np.percentile(path, [75, 25])))
    assert s["a"]["spread_ratio"] == pytest.approx(s["a"]["spread"] / 2) and s["b"]["spread_ratio"] is None
    assert (s["a"]["first_half"], s["a"]["second_half"]) == (pytest.approx(path[:3].mean()), pytest.approx(path[3:].mean()))


def test_too_few_weeks_give_nothing(spark):
    df, _, _ = made(spark, 20)
    assert attribution.rolling_loadings(df, COLUMNS, 20).count() == 0
    assert attribution.both_kinds(df, COLUMNS, 20).count() == 0


@pytest.mark.parametrize("flat", [0, 23])
def test_walk_forward(spark, flat):
    df, x, y = made(spark, flat=flat)
    want, model = [], None
    for w in range(20, 40):
        if model is None or (w - 20) % 4 == 0:
            if np.allclose(y[w - 20 : w], y[w - 20]):
                continue
            model = attribution.fit(x[w - 20 : w], y[w - 20 : w])[1]
        want.append((w, y[w], float(model(x[w])), y[w - 20 : w].mean()))
    scored = attribution.walk_forward(df, COLUMNS, 20)
    got = sorted(tuple(r) for r in scored.collect())
    assert np.allclose(got, want) and len(got) == (20 if not flat else 16)
    t = np.array(want)
    m, b = (t[:, 1] - t[:, 2]) ** 2, (t[:, 1] - t[:, 3]) ** 2
    r = attribution.out_of_sample(scored.selectExpr("*", "1 AS k"), ["k"]).first()
    d = m - b
    assert r["r2"] == pytest.approx(1 - m.sum() / b.sum())
    assert r["statistic"] == pytest.approx(d.mean() / (d.std(ddof=1) / np.sqrt(len(d))))


def test_leave_one_out(spark):
    df, x, y = made(spark)
    full = attribution.fit(x, y)[0]
    r = {r["driver"]: r for r in attribution.leave_one_out(df, COLUMNS, ["a"], 20).collect()}
    assert set(r) == {"a"}
    alone = attribution.fit(x[:, 1:], y)[0]
    assert r["a"]["largest_shift"] == pytest.approx(abs(alone[0] - full[1]))
    assert r["a"]["flips"] == (["b"] if alone[0] * full[1] < 0 else [])
    assert r["a"]["r2_with"] > 0.8 > r["a"]["r2_without"]
    assert attribution.leave_one_out(df, ["a"], ["a"], 20).count() == 0


def test_identity(spark):
    rng = np.random.default_rng(2)
    rows = [(k, i, float(u + v), float(u), float(v)) for k, n in (("x", 30), ("few", 23)) for i, (u, v) in enumerate(rng.normal(size=(n, 2)))]
    df = spark.createDataFrame([*rows, ("x", 99, None, 1.0, 1.0)], "k string, month long, y double, u double, v double")
    got = attribution.identity_check(df, ["k"], ["u", "v"]).collect()
    assert {(r["k"], r["months"], r["part"], round(r["elasticity"], 9), round(r["r2"], 9)) for r in got} == {("x", 30, "u", 1.0, 1.0), ("x", 30, "v", 1.0, 1.0)}


def test_decay(spark):
    rng = np.random.default_rng(4)
    base = rng.uniform(1, 2, size=60)
    rows = [("falls", i, h, float(base[i] * (0.4 + 0.1 * h + rng.normal(scale=0.02))), float(base[i])) for i in range(60) for h in (1, 3, 5)]
    rows += [("falls", 60, 1, 9.0, 1.0), ("two", 0, 1, 1.0, 2.0), ("two", 1, 3, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "k string, pos long, h long, m double, b double").repartition(3)
    got = {r["k"]: r for r in scoring.decay_test(df, ["k"], 300, 5).collect()}
    assert set(got) == {"falls"}
    r = got["falls"]
    means = [(h, 1 - np.mean([x[3] for x in rows if x[2] == h and x[0] == "falls" and x[1] < 60]) / base.mean()) for h in (1, 3, 5)]
    slope, intercept = np.polyfit(np.log([h for h, _ in means]), [s for _, s in means], 1)
    assert (r["slope"], r["intercept"], r["dates"], r["draws"]) == (pytest.approx(slope), pytest.approx(intercept), 60, 300)
    assert r["p"] == pytest.approx(1 / 300) and r["low"] < slope < r["high"] < 0


def test_queries_of_the_weekly_design(spark):
    sf = "/root/testdata/sf0.001"
    n = plans.the_design(spark, sf).count()
    kinds = {r["kind"]: r for r in plans.walkforward_r2(spark, sf).collect()}
    assert {k: r["weeks"] for k, r in kinds.items()} == {"contemporaneous": n - 156, "predictive": n - 157}
    assert {r["driver"] for r in plans.leave_one_driver_out(spark, sf).collect()} == set(plans.COLS)
    assert {r["windows"] for r in plans.rolling_stability(spark, sf).collect()} == {len(range(156, n + 1, 4))}


def test_a_control_is_held_constant(spark):
    rng = np.random.default_rng(8)
    n = 400
    c = rng.normal(size=n)
    shock = c + rng.normal(size=n)
    response = 3 * c + 0.5 * shock
    frame = lambda name, v: spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], f"month long, {name} double")
    args = frame("shock", shock), frame("response", response), 0, 1
    free = factors.project(factors.projection_design(*args), 0)
    held = factors.project(factors.projection_design(*args, controls=frame("c", c)), 0)
    assert held["beta"] == pytest.approx(0.5) and free["beta"] > 1.5 and held["n"] == n - 1
