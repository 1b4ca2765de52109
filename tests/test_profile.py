"""The tiled matrix profile against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.operators import profile


def plain(x, m, apart):
    """{start: (distance, neighbours at that distance)}"""
    w = {i: np.array(x[i : i + m]) for i in range(len(x) - m + 1) if all(v is not None for v in x[i : i + m])}
    z = {i: (v - v.mean()) / (v.std() if v.std() > 1e-12 else 1) for i, v in w.items()}
    out = {}
    for i in z:
        d = {j: float(np.sqrt(((z[i] - z[j]) ** 2).sum())) for j in z if abs(i - j) > apart}
        if d:
            out[i] = (min(d.values()), d)
    return out


@pytest.mark.parametrize(("m", "block"), [(4, 8), (8, 16), (5, 1024), (8, 3)])
def test_profile_by_brute_force(spark, m, block):
    rnd = random.Random(m)
    series = {k: [rnd.gauss(0, 1) * 10 ** (k % 3) + 50 * k for _ in range(n)] for k, n in enumerate((3, m, 2 * m + 1, 60, 130))}
    series[5] = [1.0] * 20 + [math.sin(i / 3) for i in range(60)] + [1.0] * 15  # constant parts
    series[6] = [None if rnd.random() < 0.05 else rnd.random() for _ in range(90)]
    rows = [(k, i, v) for k, x in series.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "machine long, step long, v double").filter("not (machine = 4 and step = 70)")
    series[4][70] = None  # a gap
    got = {(r.machine, r["at"]): r for r in profile.matrix_profile(df, F.col("v"), m, block=block).collect()}
    want = {(k, i): x for k, s in series.items() for i, x in plain(s, m, m // 2).items()}
    assert got.keys() == want.keys()
    for k, (d, all_) in want.items():
        assert got[k].distance == pytest.approx(d, abs=2e-5)
        assert all_[got[k].neighbour] == pytest.approx(d, abs=2e-5)


def test_discord_of_a_planted_break(spark):
    x = [math.sin(i / 4) for i in range(400)]
    x[200:212] = [math.cos(3 * i) for i in range(12)]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(x)], "machine long, step long, v double")
    found = profile.discord(profile.matrix_profile(df, F.col("v"), 16, block=64))
    assert 186 <= found.first()["at"] <= 211
    assert [r.step for r in profile.discord_votes(found, 16).orderBy("step").collect()] == list(range(found.first()["at"], found.first()["at"] + 16))


def test_no_task_holds_a_series(spark):
    df = spark.range(3000).select(F.lit(0).alias("machine"), F.col("id").alias("step"), F.rand(3).alias("v"))
    plan = profile.matrix_profile(df, F.col("v"), 8, block=100)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "FlatMapGroups" not in plan and "__a" in plan
