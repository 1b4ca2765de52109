"""The localiser against a literal fold over each region."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.operators import localise


def fold(values, base_most, kind, k=1.0, h=5.0, weight=0.15, limit=3.0):
    """The place of the onset in a region, or None."""
    if len(values) < 2:
        return None
    base = values[: max(1, min(base_most or 10**9, len(values) // 4))]
    mu = statistics.median(base)
    if kind == "page":
        sd = statistics.median(abs(x - mu) for x in base) * 1.4826 or 1.0
        g, zero = 0.0, 0
        for i, x in enumerate(values):
            g = max(0.0, g + abs((x - mu) / sd) - k)
            zero = i if g == 0 else zero
            if g > h:
                return min(zero + 1, i)
        return None
    sd, e = float(np.std(base)) or 1.0, mu
    for i, x in enumerate(values):
        e = weight * x + (1 - weight) * e
        if abs(e - mu) > limit * sd * math.sqrt(weight / (2 - weight)):
            return i
    return None


@pytest.fixture(scope="module")
def series():
    rnd = random.Random(7)
    out = {}
    for m in range(12):
        n = rnd.choice([1, 2, 40, 300, 700])
        x = [rnd.gauss(0, 1) for _ in range(n)]
        shift = rnd.randrange(n)
        out[m] = [None if rnd.random() < 0.03 else 1.0 if m == 3 else v + (4 if i >= shift and m % 2 else 0) + (0.05 * (i - shift) if i >= shift and not m % 2 else 0) for i, v in enumerate(x)]
    return out


@pytest.mark.parametrize("region", [localise.BACK, localise.AHEAD, localise.Region(3, 2)])
def test_onsets_like_a_fold(spark, series, region):
    rows = [(m, i, v) for m, x in series.items() for i, v in enumerate(x)]
    rnd = random.Random(8)
    asked = [(m, rnd.randrange(-5, len(series[m]) + 30)) for m in series for _ in range(6)]
    df = spark.createDataFrame(rows, "machine long, step long, v double")
    found = localise.regions(df, spark.createDataFrame(asked + asked[:3], "machine long, fired long"), {"v": F.col("v")}, region)
    found = localise.ewma_onset(localise.page_onset(found, "v", region, out="page"), "v", region, out="ewma")
    got = {(r.machine, r.fired): (r.page, r.ewma, [x.step for x in r.region]) for r in found.collect()}
    some = 0
    for m, at in set(asked):
        at_all = [i for i in range(max(0, at - region.before), min(len(series[m]), at + region.after))]
        if not at_all:
            assert (m, at) not in got
            continue
        held = [i for i in at_all if series[m][i] is not None]
        want = [fold([series[m][i] for i in held], region.base, kind) for kind in ("page", "ewma")]
        assert got[m, at] == (*[None if w is None else held[w] for w in want], at_all), (m, at)
        some += want[0] is not None
    assert some > 5 or region.before < 10


def test_shift_and_ramp_are_found(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, 150), rng.normal(4, 1, 60)])
    y = np.concatenate([rng.normal(0, 1, 150), np.linspace(0, 8, 60)])
    df = spark.createDataFrame([(0, i, float(a), float(b), max(0, i - 149)) for i, (a, b) in enumerate(zip(x, y))], "machine long, step long, x double, y double, c long")
    at = spark.createDataFrame([(0, 170)], "machine long, fired long")
    found = localise.regions(df, at, {c: F.col(c) for c in "xyc"}, localise.BACK)
    r = localise.counter_onset(localise.ewma_onset(localise.page_onset(found, "x", localise.BACK, out="a"), "y", localise.BACK, out="b"), "c", "d").first()
    assert abs(r.a - 150) <= 6 and 150 <= r.b <= 178 and r.d == 150


def test_routes(spark):
    rows = [(m, i, 9.0 if i >= 100 and m > 1 else float(i % 3), max(0, i - 90) if m < 2 else 0) for m in range(4) for i in range(200)]
    series = spark.createDataFrame(rows, "machine long, step long, v double, lag long")
    faults = spark.createDataFrame([(0, "delay", 90, 120), (1, "delay", 150, 150), (2, "drift", 100, 130), (3, "spike", 100, 130)], "machine long, class string, t0 long, t1 long")
    windows = spark.createDataFrame([(m, s, s >= (8 if m == 3 else 40)) for m in range(4) for s in range(0, 190, 8)], "machine long, start long, hot boolean")
    hot = localise.triggers_of(windows, faults, 32, F.col("hot"))
    assert sorted((r.machine, r.fired) for r in hot.collect()) == [(0, 64), (2, 72), (3, 72)]  # an empty fault has none
    got = {r.machine: r for r in localise.routed(series, hot, "v", {"delay": "lag"}, width=32).collect()}
    assert {m: r.onset for m, r in got.items()} == {0: 91, 2: 101, 3: 100} or abs(got[2].onset - 100) <= 2 and got[0].onset == 91 and got[3].onset == 100
    assert got[0].centre == 80 and got[0].centre_error == 10 and got[0].onset_error == 1
