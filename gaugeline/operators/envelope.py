"""Envelopes of long series, block by block: the size of the analytic signal by a filter with a halo, statistics of each window's envelope, and power in a band.

The quadrature of a series is a filter over its odd neighbours, 2 / (pi k), cut off at ``half`` by a Hann taper. A block of steps with a halo of ``half`` on both sides is transformed by
itself (overlap-save), so blocks are spread over tasks. Beyond 2 / half cycles a step, and as much below one half, the envelope of a tone is within one per cent of that by a
transform of the whole series; slower parts are damped. Before and after its ends a series, less its mean, counts as zero.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.operators.scan import with_halo
from gaugeline.operators.sequence import TELEMETRY, Series

BLOCK = 1_024
HALF = 64
#: A window's energy below this counts as none.
NO_ENERGY = 1e-30
BAND = (0.1, 0.5)
STATISTICS = ("envelope_max", "envelope_min", "envelope_mean", "envelope_std", "envelope_band_energy")


def taps(half: int):
    """The filter's weights from -half to half."""
    import numpy as np

    k = np.arange(-half, half + 1)
    odd = k % 2 != 0
    return np.where(odd, 2 / (np.pi * np.where(odd, k, 1)) * (0.5 + 0.5 * np.cos(np.pi * k / (half + 1))), 0.0)


def _blocks(df: DataFrame, value: Column, s: Series, block: int, before: int, after: int) -> DataFrame:
    """(keys, __b, __x): the rows of each block and its halo, array<struct(order, v)>. Null and NaN values are left out."""
    rows = df.select(*s.keys, F.col(s.order).cast("long").alias(s.order), value.cast("double").alias("__v")).filter("__v is not null and not isnan(__v)")
    rows = with_halo(rows, s, block, before, after)
    return rows.groupBy(*s.keys, "__b").agg(F.collect_list(F.struct(F.col(s.order).alias("t"), F.col("__v").alias("v"))).alias("__x"))


def _schema(df: DataFrame, keys: tuple[str, ...], more: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], more])


def envelope(df: DataFrame, value: Column, s: Series = TELEMETRY, half: int = HALF, block: int = BLOCK) -> DataFrame:
    """(keys, order, envelope) of each row with a value: the size of the analytic signal of the series less its mean. Steps without a value count as the mean."""
    keys, order = list(s.keys), s.order
    rows = df.select(*keys, order, value.cast("double").alias("__v"))
    mean = rows.filter("not isnan(__v)").groupBy(*keys).agg(F.avg("__v").alias("__mean"))
    rows = rows.join(mean, keys).withColumn("__v", F.col("__v") - F.col("__mean"))

    def of(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        size = 1 << (block + 2 * half - 1).bit_length()
        held = np.zeros(size)
        weights = taps(half)
        held[: 2 * half + 1] = weights
        spectrum = np.fft.rfft(held)
        for pdf in batches:
            for r in pdf.to_dict("records"):
                first = r["__b"] * block
                x, there = np.zeros(size), np.zeros(size, bool)
                at = np.array([p["t"] for p in r["__x"]], "i8") - (first - half)
                x[at], there[at] = [p["v"] for p in r["__x"]], True
                # place half + i of the product is step i of the block; what wraps around is in the halo
                quadrature = np.fft.irfft(np.fft.rfft(x) * spectrum, size)[2 * half : 2 * half + block]
                own = x[half : half + block]
                some = np.flatnonzero(there[half : half + block])
                yield pd.DataFrame({**{c: [r[c]] * len(some) for c in keys}, order: first + some, "envelope": np.hypot(own, quadrature)[some]})

    return _blocks(rows, F.col("__v"), s, block, half, half).mapInPandas(of, _schema(df, s.keys, f"`{order}` bigint, envelope double"))


def window_statistics(x, band: tuple[float, float] = BAND):
    """STATISTICS of each row of ``x``, windows of one length: of the size of its own analytic signal, and the share of the power of its squared deviations from their mean at frequencies in
    ``band``. A constant window has that size, and no deviation."""
    import numpy as np

    n = x.shape[1]
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    e = np.abs(np.fft.ifft(np.fft.fft(x, axis=1) * gain, axis=1))
    power = np.abs(np.fft.rfft((e - e.mean(1, keepdims=True)) ** 2, axis=1)) ** 2
    f = np.fft.rfftfreq(n)
    total = power.sum(1)
    ratio = np.where(total < NO_ENERGY, 0.0, power[:, (f >= band[0] - 1e-12) & (f <= band[1] + 1e-12)].sum(1) / np.where(total < NO_ENERGY, 1.0, total))
    out = np.column_stack([e.max(1), e.min(1), e.mean(1), e.std(1), ratio])
    flat = (x == x[:, :1]).all(1)
    out[flat] = np.abs(x[flat, :1]) * [1, 1, 1, 0, 0]
    return out


def envelope_statistics(df: DataFrame, value: Column, width: int, stride: int = 1, s: Series = TELEMETRY, block: int = BLOCK) -> DataFrame:
    """(keys, start, w, and STATISTICS) of the windows of ``width`` steps that begin at multiples of ``stride``; those over a gap, a null or an end are left out. A block has the
    windows that begin in it, and the width - 1 steps that follow."""
    keys, order = list(s.keys), s.order
    rows = df.select(*keys, F.col(order).cast("long").alias(order), value.alias("__v"))

    def of(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for r in pdf.to_dict("records"):
                first = r["__b"] * block
                x = np.full(block + width - 1, np.nan)
                at = np.array([p["t"] for p in r["__x"]], "i8") - first
                x[at] = [p["v"] for p in r["__x"]]
                windows = np.lib.stride_tricks.sliding_window_view(x, width)
                starts = np.flatnonzero(~np.isnan(windows).any(1))
                starts = starts[(first + starts) % stride == 0]
                found = window_statistics(windows[starts])
                yield pd.DataFrame({**{c: [r[c]] * len(starts) for c in keys}, "start": first + starts, "w": width, **dict(zip(STATISTICS, found.T, strict=True))})

    return _blocks(rows, F.col("__v"), s, block, 0, width - 1).mapInPandas(of, _schema(df, s.keys, "`start` bigint, w int, " + ", ".join(f"{c} double" for c in STATISTICS)))


def rolling(df: DataFrame, bank: DataFrame, value: Column, width: int, unit: float = 1.0, s: Series = TELEMETRY, block: int = BLOCK) -> DataFrame:
    """(keys, start, w, mean, rms, lo, hi, and STATISTICS) of every full window of ``width`` steps: sums and extremes from a bank of ranges (keys, w, start, n, x, xx, lo, hi; in
    ``unit``s of the value), envelopes from the windows."""
    sums = bank.filter(F.col("w") == width)
    one, n = F.lit(float(unit)), F.col("n").cast("double")
    sums = sums.select(*s.keys, "start", (F.col("x") / n * one).alias("mean"), (F.sqrt(F.col("xx") / n) * one).alias("rms"), (F.col("lo") * one).alias("lo"), (F.col("hi") * one).alias("hi"))
    return envelope_statistics(df, value, width, 1, s, block).join(sums, [*s.keys, "start"])


def band_power(df: DataFrame, value: Column, lo: float, hi: float, segment: int = 64, s: Series = TELEMETRY) -> DataFrame:
    """(keys, ratio): the share of power at frequencies in [lo, hi], from the periodograms of a series' whole segments of ``segment`` steps, each less its mean; 0 for constant ones. Series
    without a whole segment have no row."""
    keys = list(s.keys)

    def of(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        f = np.fft.rfftfreq(segment)
        inside = (f >= lo - 1e-12) & (f <= hi + 1e-12)
        for pdf in batches:
            whole = [r for r in pdf.to_dict("records") if len(r["__x"]) == segment]
            if whole:
                x = np.array([[p["v"] for p in sorted(r["__x"], key=lambda p: p["t"])] for r in whole])
                power = np.abs(np.fft.rfft(x - x.mean(1, keepdims=True), axis=1)) ** 2
                yield pd.DataFrame({**{c: [r[c] for r in whole] for c in keys}, "__in": power[:, inside].sum(1), "__all": power.sum(1)})

    found = _blocks(df, value, s, segment, 0, 0).mapInPandas(of, _schema(df, s.keys, "__in double, __all double"))
    total = F.sum("__all")
    return found.groupBy(*keys).agg(F.when(total > NO_ENERGY, F.sum("__in") / total).otherwise(0.0).alias("ratio"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
