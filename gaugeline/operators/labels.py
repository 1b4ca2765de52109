"""Interval labels. A range join is an explosion of the intervals into steps and an equi-join, so it is dealt
out by entity and never compares every row with every interval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exploded(faults: DataFrame, start: str = "t0", end: str = "t1", out: str = "step") -> DataFrame:
    """A row for each step of the half-open intervals."""
    return faults.filter(F.col(start) < F.col(end)).withColumn(out, F.explode(F.sequence(F.col(start), F.col(end) - 1)))


def active(ticks: DataFrame, faults: DataFrame, keys: tuple[str, ...] = ("machine",), step: str = "step") -> DataFrame:
    """All ticks with y and class of the fault active there, of several the one that began first."""
    f = exploded(faults, out=step).groupBy(*keys, step).agg(F.min_by("class", F.struct("t0", "class")).alias("class"))
    return ticks.join(f, [*keys, step], "left").withColumn("y", F.col("class").isNotNull().cast("long"))


def overlap(windows: DataFrame, spans: DataFrame, keys: tuple[str, ...], bin_width: int) -> DataFrame:
    """The pairs of windows (w0, w1) and spans (t0, t1) of the same keys that overlap, once each, with shared, the
    length in common. Both are dealt into bins; a pair meets in the bin where its overlap begins."""
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_width), F.floor((F.col(b) - 1) / bin_width)))
    w = windows.withColumn("__bin", bins("w0", "w1"))
    s = spans.withColumn("__bin", bins("t0", "t1"))
    both = w.join(s, [*keys, "__bin"]).withColumn("shared", F.least("w1", "t1") - F.greatest("w0", "t0"))
    return both.filter((F.col("shared") > 0) & (F.col("__bin") == F.floor(F.greatest("w0", "t0") / bin_width))).drop("__bin")
