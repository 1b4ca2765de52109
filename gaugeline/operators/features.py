"""Sliding-window features, and a bank of dyadic range aggregates that covers any range exactly.

Sums are over integer cents, so they are exact whatever order they are taken in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.operators.sequence import TELEMETRY, Series


def window_features(df: DataFrame, w: int, stride: int, cents: str = "cents", s: Series = TELEMETRY, off: int | Column = 0) -> DataFrame:
    """(keys, start, mean, std, lo, hi, slope) of the full windows of w rows that begin every ``stride`` rows from ``off`` on, a number or
    a column of the keys."""
    f = s.last(w)
    n, x, xx = F.lit(float(w)), F.sum(cents).over(f), F.sum(F.col(cents) * F.col(cents)).over(f)
    df = df.withColumn("__i", F.row_number().over(s.by()) - 1)
    df = df.select(
        *s.keys,
        (F.col("__i") - (w - 1)).cast("long").alias("start"),
        (x.cast("double") / n / 100).alias("mean"),
        (F.sqrt((w * xx - x * x).cast("double")) / n / 100).alias("std"),
        F.min(cents).over(f).alias("lo"),
        F.max(cents).over(f).alias("hi"),
        (F.col(cents) - F.first(cents).over(f)).alias("slope"),
    )
    return df.filter((F.col("start") >= off) & ((F.col("start") - off) % stride == 0))


def invariant(features: DataFrame, keys: tuple[str, ...], stats: tuple[str, ...]) -> DataFrame:
    """Max, mean and population deviation of each statistic across channels: swapping channels changes nothing."""
    n = F.count("*")
    sd = lambda c: F.sqrt(F.greatest((n * F.sum(F.col(c) * F.col(c)) - F.sum(c) * F.sum(c)).cast("double"), F.lit(0.0))) / n
    return features.groupBy(*keys).agg(*[f for c in stats for f in (F.max(c).alias(f"{c}_max"), (F.sum(c).cast("double") / n).alias(f"{c}_mean"), sd(c).alias(f"{c}_std"))])


def cover_bank(df: DataFrame, widths: tuple[int, ...], cents: str = "cents", s: Series = TELEMETRY) -> DataFrame:
    """(keys, w, start, n, x, xx, lo, hi) of every full range of each width: one stage, one frame for each width."""
    i = F.row_number().over(s.by()) - 1
    parts = []
    for w in widths:
        f = s.last(w)
        part = F.struct(F.lit(w).alias("w"), (i - (w - 1)).cast("long").alias("start"), F.lit(w).alias("n"), F.sum(cents).over(f).alias("x"), F.sum(F.col(cents) * F.col(cents)).over(f).alias("xx"), F.min(cents).over(f).alias("lo"), F.max(cents).over(f).alias("hi"))
        parts.append(part)
    df = df.select(*s.keys, *[p.alias(f"p{k}") for k, p in enumerate(parts)])
    return df.select(*s.keys, F.inline(F.array(*[F.col(f"p{k}") for k in range(len(parts))]))).filter("start >= 0")


def blocks(start, width, largest: int = 64):
    """array<struct(w, start)>: a range as greedy powers of two of at most ``largest``."""
    sizes, size = [], largest
    while size:
        sizes.append(size)
        size //= 2
    begin = F.struct(start.cast("long").alias("at"), width.cast("long").alias("left"), F.array().cast("array<struct<w:int,start:bigint>>").alias("out"))

    def take(a, w):
        n = F.floor(a["left"] / w).cast("int")
        new = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.struct(w.alias("w"), (a["at"] + k * w).cast("long").alias("start")))).otherwise(F.array().cast("array<struct<w:int,start:bigint>>"))
        used = (n * w).cast("long")
        return F.struct((a["at"] + used).alias("at"), (a["left"] - used).alias("left"), F.concat(a["out"], new).alias("out"))

    return F.aggregate(F.array(*map(F.lit, sizes)), begin, take, lambda a: a["out"])


def reconstruct(ranges: DataFrame, bank: DataFrame, keys: tuple[str, ...] = ("machine",)) -> DataFrame:
    """(keys, s, w, mean, rms, lo, hi) of any ranges (keys, s, w) from the bank by an equi-join on blocks."""
    wanted = ranges.select(*keys, F.col("s"), F.col("w").alias("width"), F.inline(blocks(F.col("s"), F.col("w"))))
    got = wanted.join(bank, [*keys, "w", "start"]).groupBy(*keys, "s", F.col("width").alias("w"))
    x, xx, n = F.sum("x").cast("double"), F.sum("xx").cast("double"), F.sum("n")
    return got.agg((x / n / 100).alias("mean"), (F.sqrt(xx / n) / 100).alias("rms"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def detrended(df: DataFrame, fit_on, cents: str = "cents", s: Series = TELEMETRY) -> DataFrame:
    """(keys, order, residual): less the line fitted where ``fit_on`` holds; unchanged with fewer than two such
    rows. Slope and intercept come from exact integer sums."""
    w = Window.partitionBy(*s.keys)
    t, v = F.when(fit_on, F.col(s.order)), F.when(fit_on, F.col(cents))
    n, x, y, xx, xy = (F.sum(c).over(w) for c in (F.when(fit_on, 1).otherwise(0).cast("long"), t, v, t * t, t * v))
    df = df.withColumns({"__n": n, "__x": x, "__y": y, "__d": n * xx - x * x, "__c": n * xy - x * y})
    slope = F.coalesce(F.try_divide(F.col("__c").cast("double"), F.col("__d")), F.lit(0.0))
    level = (F.col("__y").cast("double") - slope * F.col("__x")) / F.col("__n")
    line = F.when(F.col("__n") >= 2, level + slope * F.col(s.order)).otherwise(0.0)
    return df.select(*s.keys, s.order, ((F.col(cents) - line) / 100).alias("residual"))
