"""Facts worked out by hand, known processes, and refusals."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.errors import (
    DeterministicVarianceError,
    ElapsedForecastError,
    InsufficientDataError,
    MixedDriftPolicyError,
    NonFiniteLossError,
    OverlappingWindowsError,
    RouteError,
    ScheduleError,
    StaleDataError,
    TransformDomainError,
)
from tidegauge.functions import stats
from tidegauge.operators import factors, inference, paths, record, returns, schedules, scoring, trade, volatility
from tidegauge.sources import cache, readers, sinks
from tidegauge.streaming import bars as streams

PATHS = [[95.0, 92.0, 90.0], [105.0, 108.0, 110.0], [89.0, 95.0, 120.0], [101.0, 97.0, 88.0]]


def test_first_passage_by_eye(spark):
    df = spark.createDataFrame([(1, p) for p in PATHS], "k int, prices array<double>")
    got = paths.first_passage(df, ["k"], F.lit(90.0)).first()
    assert (got["touch"], got["ends"], got["n_touched"], got["ratio"]) == (0.75, 0.5, 3, 1.5)
    assert got["mean_sessions"] == pytest.approx((3 + 1 + 3) / 3)


def test_margin_barriers():
    assert paths.margin_barrier(100, 10) == 90
    assert paths.margin_barrier(100, 10, 0.5) == 95
    assert paths.margin_barrier(100, 5, side="short") == 120
    assert paths.margin_barrier(100, 1) == -math.inf


def test_limit_carries_the_rest(spark):
    df = spark.createDataFrame([([math.log(1.2), 0.0, 0.0, 0.0],)], "s array<double>")
    got = df.select(paths.limited(F.col("s"), F.lit(100.0), 0.04, 0.06).alias("x")).first()["x"]
    assert got["prices"] == pytest.approx([104, 104 * 1.06, 104 * 1.06**2, 120])
    assert got["cuts"] == 3
    lost = df.select(paths.limited(F.col("s"), F.lit(100.0), 0.04, 0.06, False).alias("x")).first()["x"]
    assert lost["prices"] == pytest.approx([104] * 4)


def test_breakevens():
    assert 1.03 * 1.03 / 0.97 == pytest.approx(1.0937, abs=1e-4)
    assert 1.03 * 1.0 / 0.98 == pytest.approx(1.0510, abs=1e-4)


def test_breakeven_expression(spark):
    got = spark.range(1).select(trade.physical(F.lit(0.03), F.lit(0.03), F.lit(0.03)).alias("x")).first()["x"]
    assert got == pytest.approx(1.03 * 1.03 / 0.97)


def test_pseudo_observations(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 1.0), (1, 2.0)], "k int, x double")
    assert sorted(r["u"] for r in paths.pseudo_observations(df, ["k"], "x").collect()) == [0.25, 0.5, 0.75]


def test_crps_equals_pairwise_form(spark):
    x, y = np.random.default_rng(1).normal(size=30), 0.3
    want = np.abs(x - y).mean() - np.abs(x[:, None] - x[None]).sum() / (2 * 30 * 29)
    df = spark.createDataFrame([(x.tolist(), y)], "v array<double>, y double")
    assert df.select(scoring.crps_fair(F.col("v"), F.col("y")).alias("c")).first()["c"] == pytest.approx(want)
    one = spark.createDataFrame([([2.0], 0.5)], "v array<double>, y double")
    assert one.select(scoring.crps_fair(F.col("v"), F.col("y")).alias("c")).first()["c"] == 1.5


def test_known_gjr_process_is_recovered():
    rng, w, a, g, b = np.random.default_rng(5), 2e-6, 0.04, 0.08, 0.88
    v, out = w / (1 - a - g / 2 - b), []
    for z in rng.standard_normal(3000):
        e = math.sqrt(v) * z
        out.append(e)
        v = w + (a + g * (e < 0)) * e * e + b * v
    got = volatility.gjr_fit(np.array(out), student=False)
    assert got["alpha"] + got["gamma"] / 2 + got["beta"] == pytest.approx(0.96, abs=0.03)
    assert got["gamma"] > 0
    assert got["beta"] == pytest.approx(b, abs=0.06)


def test_gjr_propagation_reacts_to_bad_news():
    shocks = np.array([[-2.0, 1.0], [2.0, 1.0]])
    got = volatility.gjr_propagate(0.0, (2e-6, 0.04, 0.08, 0.88), 1e-4, shocks)
    assert abs(got[0, 1]) > abs(got[1, 1])


def test_copula_recovers_dependence():
    u = paths.sample_t_copula(0.6, 3.0, 1500, np.random.default_rng(2))
    got = paths.fit_t_copula(u[:, 0], u[:, 1])
    assert got["rho"] == pytest.approx(0.6, abs=0.06)
    assert 1.9 < got["df"] < 6
    a, b = paths.joint_shocks(np.arange(50.0), np.arange(50.0), 0.6, 3.0, 20, 4, 1)
    assert set(a.ravel()) <= set(np.arange(50.0)) and a.shape == b.shape == (20, 4)


def test_distributions():
    assert stats.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert stats.chi2_sf(16.918977604620448, 9) == pytest.approx(0.05)
    assert stats.t_sf(2.2281388519649385, 10) == pytest.approx(0.025)
    assert stats.t_isf(0.025, 10) == pytest.approx(2.2281388519649385)
    assert stats.binom_cdf(3, 10, 0.5) == pytest.approx(0.171875)
    assert stats.binom_two_sided(0, 10, 0.5) == pytest.approx(2 / 1024)
    assert stats.poisson_binomial([0.5] * 4) == pytest.approx([1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16])
    assert stats.kendall_tau([1, 2, 3, 4], [1, 3, 2, 4]) == pytest.approx(4 / 6)


def test_elastic_net_limits():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -0.5, 0.0] + rng.normal(size=200) * 0.1
    sx, sy, _, _ = factors.scale(x, y)
    gram, xy = sx.T @ sx / 200, sx.T @ sy / 200
    assert factors.elastic_net(gram, xy, 0.0) == pytest.approx(np.linalg.solve(gram, xy), abs=1e-5)
    top = factors.penalty_path(xy)[0]
    assert not factors.elastic_net(gram, xy, top * 1.0001).any()
    assert factors.elastic_net(gram, xy, top * 0.99).any()


def test_spread_of_equal_count_bins(spark):
    df = spark.createDataFrame([(1, i, 0.5) for i in range(13)], "k int, pos int, p double")
    got = df.withColumn("bin", inference.equal_count_bins(["k"], "p", "pos")).groupBy("bin").count().collect()
    assert sorted(r["count"] for r in got) == [1] * 7 + [2] * 3


def test_asof_forms_agree(spark, monkeypatch):
    days = spark.createDataFrame([(dt.date(2000, 1, d),) for d in range(1, 29)], "date date")
    rows = [(dt.date(2000, 1, 5), 1.0, "u", "primary"), (dt.date(2000, 1, 20), 2.0, "u", "primary")]
    sched = schedules.schedule(spark, rows, "valid_from date, x double, source_url string, confidence string")
    small = schedules.asof_schedule(days, sched, ["x"]).orderBy("date").collect()
    monkeypatch.setattr(schedules, "SMALL", 0)
    assert schedules.asof_schedule(days, sched, ["x"]).orderBy("date").collect() == small
    assert [r["x"] for r in small][3:5] == [None, 1.0]


def test_refusals(spark):
    bad = spark.createDataFrame([(dt.date(2020, 4, 20), -36.98)], "date date, px double")
    with pytest.raises(TransformDomainError, match="1 prices.*2020-04-20"):
        returns.Log.require(bad, "px")
    returns.ShiftedLog(40.0).require(bad, "px")
    with pytest.raises(ScheduleError):
        schedules.schedule(spark, [(1.0, "", "primary")], "x double, source_url string, confidence string")
    with pytest.raises(InsufficientDataError):
        volatility.gjr_fit(np.zeros(10))
    with pytest.raises(DeterministicVarianceError):
        volatility.require_per_path_variance("rolling_std", True)
    with pytest.raises(OverlappingWindowsError):
        scoring.require_independent(21, 5, "a test")
    with pytest.raises(MixedDriftPolicyError):
        paths.require_one_drift_policy([paths.Model(0, 1), paths.Model(1, 5, demean=False)])
    with pytest.raises(NonFiniteLossError, match="b"):
        inference.require_finite(spark.createDataFrame([("a", 1.0), ("b", math.nan)], "model string, loss double"))
    with pytest.raises(ElapsedForecastError):
        record.require_open(dt.date(2020, 1, 1), 5, dt.date(2020, 1, 8))
    stale = spark.createDataFrame([("x", True, "stale")], "series_id string, blocking boolean, verdict string")
    with pytest.raises(StaleDataError, match="x"):
        record.require_fresh(stale)
    book = trade.book(spark, [("INDX", "i", None)], [], [("r", ["IND"])], [])
    with pytest.raises(RouteError, match="code_shape"):
        trade.require_sound(*book)


def test_cache_round_trip(spark, tmp_path):
    store = cache.CacheStore(spark, f"file://{tmp_path}")
    cite = {"cite_as": "a", "licence": None, "source_confidence": "primary", "source_url": "u"}
    one = spark.createDataFrame([(dt.date(2020, 1, 1), 1.0), (dt.date(2020, 1, 2), 2.0)], "date date, value double")
    assert store.read("s") is None and not store.has("s")
    store.write("s", one, cache.build_meta(one, "s", "n", "u", cite))
    two = spark.createDataFrame([(dt.date(2020, 1, 2), 9.0), (dt.date(2020, 1, 3), 3.0)], "date date, value double")
    merged = store.merge_write("s", two, cache.build_meta(two, "s", "n", "u", cite))
    assert [r["value"] for r in merged.orderBy("date").collect()] == [1.0, 9.0, 3.0]
    assert store.meta("s")["rows"] == 3 and store.meta("s")["has_ohlc"] is False
    chain = readers.SourceChain("s", [("down", lambda a, b: (_ for _ in ()).throw(readers.DataUnavailableError("no")))], store)
    assert chain.load(dt.date(2020, 1, 2), dt.date(2020, 1, 3)).count() == 2
    assert chain.fallbacks == ["down: no", "cache"]


def test_delimited_series(spark, tmp_path):
    (tmp_path / "x.csv").write_text("DATE,X\n2020-01-01,1.5\n2020-01-02,.\n2020-01-03,2\n")
    got = readers.delimited_series(spark, str(tmp_path / "x.csv"), end=dt.date(2020, 1, 3))
    assert [r["value"] for r in got.orderBy("date").collect()] == [1.5, 2.0]
    assert readers.price_column(got) == "value"


def test_forecast_log_is_frozen(spark, tmp_path):
    folder, day = f"file://{tmp_path}", dt.date(2020, 1, 1)
    sinks.write_forecast(spark, folder, day, {"a": 1}, 5, dt.date(2020, 1, 2))
    sinks.write_forecast(spark, folder, day, {"a": 2}, 5, dt.date(2020, 1, 2))
    with pytest.raises(ElapsedForecastError):
        sinks.write_forecast(spark, folder, day, {"a": 3}, 5, dt.date(2020, 1, 9))


def test_streamed_bars_equal_batch_bars(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(src)
    stream = streams.tumbling_bars(spark.readStream.schema(events.schema).parquet(src))
    run = stream.writeStream.format("memory").queryName("bars").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    plain = lambda df: sorted(df.withColumn("start", F.col("start").cast("string")).collect())
    assert plain(spark.table("bars")) == plain(streams.tumbling_bars(events))


def test_har_forward_keeps_smearing_out_of_the_state():
    flat = volatility.har_forward([math.log(0.01), 0.0, 0.0, 0.0], 0.5, [0.02] * 22, 3)
    assert flat == pytest.approx([math.sqrt(0.01 * math.exp(0.5))] * 3)
