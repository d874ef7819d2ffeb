"""Quantiles by refinement against sorting."""

import math
import random

import numpy as np
import pytest

from geosweep.operators import quantiles as q


@pytest.fixture
def small_steps(monkeypatch):
    """Few ranges and few rows to sort, so that small keys take many rounds."""
    monkeypatch.setattr(q, "RANGES", 4)
    monkeypatch.setattr(q, "FEW", 3)


def check(spark, groups):
    rows = [(k, v) for k, values in groups.items() for v in values]
    df = spark.createDataFrame([*rows, ("a", None), ("a", float("nan")), ("none", None)], "k string, v double").repartition(3)
    shares = {"q0": 0.0, "q02": 0.02, "q50": 0.5, "q98": 0.98, "q1": 1.0}
    got = {r["k"]: r for r in q.quantiles(df, ["k"], "v", shares, {"p95": 0.95, "p0": 0.0}).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        s = sorted(values)
        assert got[k]["n"] == len(s) and got[k]["p0"] == s[0] and got[k]["p95"] == s[max(1, math.ceil(0.95 * len(s))) - 1]
        for name, share in shares.items():
            at = share * (len(s) - 1)
            a, b = s[math.floor(at)], s[math.ceil(at)]
            want = a if a == b else a + (b - a) * (at - math.floor(at))
            assert got[k][name] == want or got[k][name] == pytest.approx(want, rel=1e-12) or (math.isnan(got[k][name]) and math.isnan(want))


def test_quantiles_in_many_rounds(spark, small_steps):
    rnd = random.Random(3)
    check(
        spark,
        {
            "a": [rnd.gauss(0, 1) for _ in range(300)], "same": [7.0] * 40, "two": [1.0] * 30 + [2.0] * 11, "one": [5.0], "pair": [-1.0, 1.0],
            "scales": [10.0**k for k in range(-30, 31)], "far": [1e308, -1e308, 0.0, 5.0, 5.0, 6.0, 7.0], "ends": [float("inf")] * 3 + [float("-inf")] * 3 + [1.0, 2.0, 3.0],
        },
    )


def test_quantiles_of_one_hot_key(spark):
    rng = np.random.default_rng(1)
    check(spark, {"hot": [float(x) for x in rng.integers(0, 50, 9000) / 7], "b": [1.0, 2.0]})


def test_no_rows(spark):
    assert q.quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", {"m": 0.5}).collect() == []
