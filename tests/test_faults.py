"""Damaged caches, readers beside writers, overlapping gaps, large schedules, tails, fits in rows."""

import datetime as dt
import os

import numpy as np
import pytest

from tidegauge.functions import stats
from tidegauge.operators import scoring, schedules, volatility, walkforward
from tidegauge.sources import cache

CITE = {"cite_as": "c", "licence": "l", "source_confidence": "primary", "source_url": "u"}


def days(spark, rows):
    return spark.createDataFrame([(dt.date.fromisoformat(d), float(v)) for d, v in rows], "date date, close double")


def test_a_damaged_series_is_a_miss(spark, tmp_path):
    store = cache.CacheStore(spark, f"file://{tmp_path}")
    (tmp_path / "junk.parquet").write_bytes(b"no parquet at all")
    assert store.has("junk") and store.rows_only("junk") is None and store.read("junk") is None
    df = days(spark, [(f"2024-01-{i:02d}", i) for i in range(1, 29)])
    store.write("s", df, cache.build_meta(df, "s", "n", "u", CITE))
    assert store.rows_only("s").count() == 28
    folder = tmp_path / store._versions("s")[0]
    for f in folder.glob("part-*"):  # the footer stays, the pages go
        raw = f.read_bytes()
        f.write_bytes(raw[:4] + b"\0" * 200 + raw[204:])
    for f in folder.glob(".*.crc"):
        os.remove(f)
    assert store.rows_only("s") is None


def test_a_reader_of_the_old_version_can_end(spark, tmp_path):
    store = cache.CacheStore(spark, f"file://{tmp_path}")
    one, two = days(spark, [("2024-01-01", 1)]), days(spark, [("2024-01-01", 2), ("2024-01-02", 3)])
    store.write("s", one, cache.build_meta(one, "s", "n", "u", CITE))
    old = store.rows_only("s")
    store.write("s", two, cache.build_meta(two, "s", "n", "u", CITE))
    assert [r["close"] for r in old.collect()] == [1.0]
    assert sorted(r["close"] for r in store.rows_only("s").collect()) == [2.0, 3.0]
    store.write("s", one, cache.build_meta(one, "s", "n", "u", CITE))
    assert len(list(tmp_path.glob("s.*.parquet"))) == 2 and store.meta("s")["rows"] == 1


def test_of_fresh_rows_of_a_date_the_last_stays(spark, tmp_path):
    store = cache.CacheStore(spark, f"file://{tmp_path}")
    for _ in range(2):
        new = days(spark, [("2024-01-01", 1), ("2024-01-02", 5), ("2024-01-01", 7)]).coalesce(1)
        merged = store.merge_write("s", new, cache.build_meta(new, "s", "n", "u", CITE))
        assert [(str(r["date"]), r["close"]) for r in merged.orderBy("date").collect()] == [("2024-01-01", 7.0), ("2024-01-02", 5.0)]


def test_overlapping_gaps_do_not_double_rows(spark):
    sched = spark.createDataFrame([(dt.date(2020, 1, 1), 1.0)], "valid_from date, x double")
    spans = [((1, 5), (1, 20)), ((1, 10), (2, 1)), ((1, 12), (1, 13)), ((3, 1), (3, 2))]
    gaps = spark.createDataFrame([(dt.date(2020, *a), dt.date(2020, *b)) for a, b in spans], "gap_from date, gap_until date")
    df = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(i),) for i in range(70)], "date date")
    got = {r["date"]: r["x"] for r in schedules.asof_schedule(df, sched, ["x"], gaps=gaps).collect()}
    assert len(got) == 70 and schedules.asof_schedule(df, sched, ["x"], gaps=gaps).count() == 70
    for d, x in got.items():
        assert (x is None) == any(dt.date(2020, *a) <= d <= dt.date(2020, *b) for a, b in spans)


@pytest.mark.parametrize("strict", [False, True])
def test_large_schedules_are_joined_by_month(spark, monkeypatch, strict):
    rng = np.random.default_rng(1)
    base = dt.date(2020, 1, 1)
    entries = [(base + dt.timedelta(int(i)), float(n)) for n, i in enumerate(rng.choice(900, 40, replace=False))]
    left = [(base + dt.timedelta(int(i)), int(k)) for k, i in enumerate(rng.integers(-30, 1000, 200))]
    sched, df = spark.createDataFrame(entries, "date date, x double"), spark.createDataFrame(left, "date date, k int")
    joined = schedules.asof_join(df, sched, "date", [], ["x"], strict=strict)
    got = {r["k"]: r["x"] for r in joined.collect()}
    for d, k in left:
        seen = [e for e in entries if e[0] < d or (e[0] == d and not strict)]
        assert got[k] == (max(seen)[1] if seen else None)
    monkeypatch.setattr(schedules, "SMALL", 10)
    valid = sched.withColumnRenamed("date", "valid_from")
    again = {r["k"]: r["x"] for r in schedules.asof_schedule(df, valid, ["x"]).collect()}
    if not strict:
        assert again == got


def test_tail_calibration_counts_each_date_once(spark):
    rows = [("A", 5, m, 100 + i, 0.01, 1.06 if i < 3 else 1.0) for i in range(20) for m in ("one", "two")]
    scores = spark.createDataFrame(rows, "series_id string, horizon int, model string, pos int, sigma double, growth double")
    got = walkforward.tail_calibration(scores, ["series_id"], 1.05).collect()[0]
    p = scoring.driftless_gaussian(1.05, 0.01, 5)
    assert (got["n"], got["seen"]) == (20, 3) and got["expected"] == pytest.approx(20 * p)
    assert got["at_least"] == pytest.approx(stats.poisson_binomial([p] * 20)[3:].sum())


def test_har_fits_in_rows_equal_least_squares(spark):
    rng = np.random.default_rng(2)
    v = np.exp(rng.normal(-9, 0.4, 300))
    df = spark.createDataFrame([("A", dt.date(2020, 1, 1) + dt.timedelta(i), float(x)) for i, x in enumerate(v)], "series_id string, date date, v double")
    got = volatility.har_fit(df, ["series_id"]).collect()[0]
    log = np.log(v)
    mean = lambda t, k: np.log(v[t - k + 1 : t + 1].mean())
    x = np.array([[1, log[t], mean(t, 5), mean(t, 22)] for t in range(21, 299)])
    beta, residue, *_ = np.linalg.lstsq(x, log[22:], rcond=None)
    assert [got["const"], got["day"], got["week"], got["month"]] == pytest.approx(beta.tolist(), abs=1e-6)
    assert got["smearing"] == pytest.approx(residue[0] / (278 - 4) / 2, rel=1e-6)


def test_fits_of_groups_of_dates_equal_single_fits(spark):
    r = np.random.default_rng(3).normal(0, 0.01, 330)
    arrays = spark.createDataFrame([("A", r.tolist())], "series_id string, rs array<double>")
    got = {x["asof"]: x["nll"] for x in volatility.gjr_fit_asofs(arrays, ["series_id"], "rs", first=260, step=30).collect()}
    assert set(got) == {260, 290, 320}
    assert got[290] == pytest.approx(volatility.gjr_fit(r[:290])["nll"])


def test_closes_alone_are_refused_and_a_zero_mean_is_kept(spark):
    from tidegauge.errors import InsufficientDataError

    with pytest.raises(InsufficientDataError):
        volatility.require_ohlc(days(spark, [("2024-01-01", 1)]))
    r = np.random.default_rng(5).normal(0.01, 0.01, 260)
    assert volatility.gjr_fit(r, zero_mean=True)["mean"] == 0.0 and volatility.gjr_fit(r)["mean"] == pytest.approx(r.mean())
