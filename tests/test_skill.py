"""The pair of skill tests against numpy."""

import numpy as np
import pytest

from tidegauge.functions import stats
from tidegauge.operators import scoring


def plain(d, overlap):
    n, c = len(d), d - d.mean()
    var = (c @ c + sum(2 * (1 - k / overlap) * (c[k:] @ c[:-k]) for k in range(1, overlap))) / n
    if var <= 0:
        return None
    return d.mean() / np.sqrt(var / n) * np.sqrt((n + 1 - 2 * overlap + overlap * (overlap - 1) / n) / n)


def test_skill_needs_both_tests_and_one_sign(spark):
    rng = np.random.default_rng(5)
    groups = {"better": rng.normal(-1, 0.5, 60), "worse": rng.normal(1, 0.5, 60), "even": rng.normal(0, 1, 60), "flat": np.zeros(60)}
    rows = [(k, i, float(v)) for k, d in groups.items() for i, v in enumerate(d)]
    got = {r["model"]: r for r in scoring.skill_test(spark.createDataFrame(rows, "model string, pos long, d double"), ["model"], 3).collect()}
    for k, d in groups.items():
        for tag, x, overlap in (("all", d, 3), ("thinned", d[::3], 1)):
            want = plain(x, overlap)
            if want is None:
                assert got[k][f"statistic_{tag}"] is None and got[k][f"p_{tag}"] is None
            else:
                assert got[k][f"statistic_{tag}"] == pytest.approx(want)
                assert got[k][f"p_{tag}"] == pytest.approx(2 * stats.t_sf(abs(want), len(x) - 1))
    assert {k: r["significant"] for k, r in got.items()} == {"better": True, "worse": True, "even": False, "flat": False}
    assert got["better"]["favours_model"] and not got["worse"]["favours_model"]
