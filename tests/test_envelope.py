"""Block-wise envelopes against transforms of whole series and windows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.operators import envelope, features


def analytic(x):
    n = len(x)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x) * gain))


def frame(spark, series, **more):
    return spark.createDataFrame([(m, t, None if v is None else float(v), 100 * int(v or 0)) for m, x in series.items() for t, v in enumerate(x)], "machine long, step long, v double, cents long")


@pytest.mark.parametrize("block", [50, 128, 1024])
def test_tones_within_the_stated_tolerance(spark, block):
    t = np.arange(1000)
    series = {k: 5 + (1 + 0.3 * np.cos(2 * np.pi * t / 500)) * np.cos(2 * np.pi * f * t + k) for k, f in enumerate((0.04, 0.1, 0.25, 0.4, 0.46))}
    got = envelope.envelope(frame(spark, series), F.col("v"), half=64, block=block).toPandas()
    assert len(got) == 5000
    for k, x in series.items():
        e = got[got.machine == k].sort_values("step").envelope.to_numpy()
        whole = analytic(x - x.mean())
        assert np.abs(e - whole)[100:-100].max() < 0.02  # of about one, the amplitude's own change included


def test_envelope_by_direct_sums(spark):
    rng = np.random.default_rng(1)
    series = {0: list(rng.normal(3, 1, 70)), 1: [4.0], 2: [None if i % 9 == 4 else float(i % 5) for i in range(40)]}
    got = {(r.machine, r.step): r.envelope for r in envelope.envelope(frame(spark, series), F.col("v"), half=7, block=16).collect()}
    h = envelope.taps(7)
    assert len(got) == sum(v is not None for x in series.values() for v in x)
    for m, x in series.items():
        mean = np.mean([v for v in x if v is not None])
        y = [0.0 if v is None else v - mean for v in x]
        for t, v in enumerate(x):
            q = sum(h[k + 7] * y[t - k] for k in range(-7, 8) if 0 <= t - k < len(y))
            assert v is None or got[m, t] == pytest.approx(np.hypot(y[t], q))


@pytest.mark.parametrize(("width", "stride", "block"), [(8, 1, 16), (9, 3, 4), (16, 8, 1024)])
def test_window_statistics(spark, width, stride, block):
    rng = np.random.default_rng(width)
    series = {0: list(rng.normal(0, 1, 90)), 1: [-2.0] * 40, 2: [None if i == 20 else v for i, v in enumerate(rng.random(50))], 3: [1.0] * (width - 1)}
    got = {(r.machine, r.start): tuple(r)[3:] for r in envelope.envelope_statistics(frame(spark, series), F.col("v"), width, stride, block=block).collect()}
    want = {}
    for m, x in series.items():
        for a in range(0, len(x) - width + 1, stride):
            w = x[a : a + width]
            if None in w:
                continue
            if len(set(w)) == 1:
                want[m, a] = (abs(w[0]), abs(w[0]), abs(w[0]), 0.0, 0.0)
                continue
            e = analytic(np.array(w))
            p = np.abs(np.fft.rfft((e - e.mean()) ** 2)) ** 2
            f = np.fft.rfftfreq(width)
            want[m, a] = (e.max(), e.min(), e.mean(), e.std(), p[(f >= 0.1 - 1e-12) & (f <= 0.5 + 1e-12)].sum() / p.sum())
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_rolling_joins_the_bank(spark):
    df = frame(spark, {0: [float(i % 7) for i in range(60)]})
    got = envelope.rolling(df, features.cover_bank(df, (4, 16)), F.col("v"), 16, 0.01).collect()
    assert len(got) == 45 and all(r.lo == 0 and r.hi == 6 and r.envelope_max >= r.envelope_min for r in got)
    assert all(r.mean == pytest.approx(np.mean([(r.start + i) % 7 for i in range(16)])) for r in got)


def test_band_power(spark):
    t = np.arange(64)
    series = {0: np.cos(2 * np.pi * 0.25 * t), 1: np.cos(2 * np.pi * t / 32), 2: [2.0] * 64, 3: [1.0, 2.0]}
    got = {r.machine: r.ratio for r in envelope.band_power(frame(spark, series), F.col("v"), 0.1, 0.5, 32).collect()}
    assert got == {0: pytest.approx(1.0), 1: pytest.approx(0.0, abs=1e-9), 2: 0.0}
