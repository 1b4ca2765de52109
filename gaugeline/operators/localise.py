"""Onsets near triggers: each trigger gets a region of its series, and a recurrence that is restarted in it.

A region is so many rows before a trigger and after it, and is joined to the series in bins of steps, so a series' rows
are dealt out by bin, not by series. A region is one short array; what is folded over it carries a few numbers. A Page test's onset is
after the last zero of its sum before the alarm; an EWMA's is where it leaves its limits; a counter's is the first row where it is positive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.operators.sequence import TELEMETRY, Series


@dataclass(frozen=True)
class Region:
    """The rows with an order from trigger - before up to trigger + after, exclusive; the first quarter of them, ``base`` at most, is the baseline."""

    before: int
    after: int
    base: int | None = None


BACK = Region(64, 8)
AHEAD = Region(64, 256, 64)
#: Of a counter ahead of a trigger.
FROM = Region(0, 256)


def regions(series: DataFrame, triggers: DataFrame, values: dict[str, Column], region: Region, s: Series = TELEMETRY) -> DataFrame:
    """(keys, fired, region): for each distinct trigger (keys, fired) its region, array<struct(step, values...)> in order, as far as the series goes. Triggers
    without a row there go. ``values``: names and columns of ``series``."""
    width = region.before + region.after
    bin_of = lambda x: F.floor(x / F.lit(width)).cast("long")
    rows = series.select(*s.keys, F.col(s.order).cast("long").alias("__step"), *[v.alias(k) for k, v in values.items()]).withColumn("__bin", bin_of(F.col("__step")))
    first, last = F.col("fired") - region.before, F.col("fired") + region.after - 1
    asked = triggers.select(*s.keys, F.col("fired").cast("long").alias("fired")).distinct()
    asked = asked.withColumn("__bin", F.explode(F.sequence(bin_of(first), bin_of(last))))
    found = asked.join(rows, [*s.keys, "__bin"]).filter((F.col("__step") >= first) & (F.col("__step") <= last))
    return found.groupBy(*s.keys, "fired").agg(F.sort_array(F.collect_list(F.struct(F.col("__step").alias("step"), *values))).alias("region"))


def _median(values: Column) -> Column:
    n = F.size(values)
    return (F.get(values, F.floor((n - 1) / F.lit(2)).cast("int")) + F.get(values, F.floor(n / F.lit(2)).cast("int"))) / 2.0


_BASELINE = ("__r", "__v", "__median", "__mad", "__sd")


def with_baseline(found: DataFrame, value: str, region: Region) -> DataFrame:
    """``found`` regions with __r, the rows with a value, __v, the values, and __median, __mad (scaled to a deviation) and __sd of the baseline, 1 where that is 0."""
    out = found.withColumn("__r", F.filter("region", lambda x: x[value].isNotNull()))
    n = F.greatest(F.lit(1), F.floor(F.size("__r") / F.lit(4)).cast("int"))
    n = n if region.base is None else F.least(n, F.lit(region.base))
    out = out.withColumn("__v", F.transform("__r", lambda x: x[value].cast("double")))
    out = out.withColumn("__base", F.sort_array(F.slice("__v", 1, n)))
    out = out.withColumn("__median", _median(F.col("__base")))
    out = out.withColumn("__away", F.sort_array(F.transform("__base", lambda x: F.abs(x - F.col("__median")))))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size("__base"), F.lit(1))
    out = out.withColumn("__mean", mean(F.col("__base")))
    sd = F.sqrt(mean(F.transform("__base", lambda x: (x - F.col("__mean")) * (x - F.col("__mean")))))
    or_one = lambda x: F.when(x == 0, 1.0).otherwise(x)
    return out.withColumns({"__mad": or_one(_median(F.col("__away")) * 1.4826), "__sd": or_one(sd)}).drop("__base", "__away", "__mean")


def page_onset(found: DataFrame, value: str, region: Region, k: float = 1.0, h: float = 5.0, out: str = "onset") -> DataFrame:
    """``found`` with ``out``: the step after the last zero of g = max(0, g + |z| - k) before g first exceeds h, or that of the alarm; z is the value in
    robust deviations from the baseline. Null values are left out. Null without an alarm, or for a region of one row. Rows after the alarm change nothing."""
    based = with_baseline(found, value, region)
    start = F.struct(F.lit(0.0).alias("g"), F.lit(0).alias("i"), F.lit(0).alias("zero"), F.lit(-1).alias("alarm"))

    def step(a: Column, x: Column) -> Column:
        g = F.greatest(F.lit(0.0), a["g"] + F.abs((x - F.col("__median")) / F.col("__mad")) - F.lit(float(k)))
        done = a["alarm"] >= 0
        zero = F.when(~done & (g == 0), a["i"]).otherwise(a["zero"])
        return F.struct(g.alias("g"), (a["i"] + 1).alias("i"), zero.alias("zero"), F.when(~done & (g > h), a["i"]).otherwise(a["alarm"]).alias("alarm"))

    based = based.withColumn("__got", F.aggregate("__v", start, step))
    at = F.get("__r", F.least(F.col("__got.zero") + 1, F.col("__got.alarm")))["step"]
    return based.withColumn(out, F.when((F.col("__got.alarm") >= 0) & (F.size("__r") > 1), at)).drop("__got", *_BASELINE)


def ewma_onset(found: DataFrame, value: str, region: Region, weight: float = 0.15, limit: float = 3.0, out: str = "onset") -> DataFrame:
    """``found`` with ``out``: the step where e = weight v + (1 - weight) e, from the baseline's median on, is first over ``limit`` of its own deviations from
    it. Null if it never is, or for a region of one row."""
    based = with_baseline(found, value, region)
    most = limit * (weight / (2 - weight)) ** 0.5
    start = F.struct(F.col("__median").alias("e"), F.lit(0).alias("i"), F.lit(-1).alias("alarm"))

    def step(a: Column, x: Column) -> Column:
        e = F.lit(float(weight)) * x + F.lit(1.0 - weight) * a["e"]
        over = (a["alarm"] < 0) & (F.abs(e - F.col("__median")) > F.lit(most) * F.col("__sd"))
        return F.struct(e.alias("e"), (a["i"] + 1).alias("i"), F.when(over, a["i"]).otherwise(a["alarm"]).alias("alarm"))

    based = based.withColumn("__got", F.aggregate("__v", start, step))
    at = F.get("__r", F.col("__got.alarm"))["step"]
    return based.withColumn(out, F.when((F.col("__got.alarm") >= 0) & (F.size("__r") > 1), at)).drop("__got", *_BASELINE)


def counter_onset(found: DataFrame, value: str, out: str = "onset") -> DataFrame:
    """``found`` with ``out``: the first step of the region where the counter is positive; null if it isn't."""
    return found.withColumn(out, F.get(F.filter("region", lambda x: x[value] > 0), F.lit(0))["step"])


def triggers_of(windows: DataFrame, faults: DataFrame, width: int, hot: Column, s: Series = TELEMETRY) -> DataFrame:
    """``faults`` (keys, t0, t1 and more) with fired: the start of the first ``hot`` window (keys, start) of ``width`` steps that overlaps the fault [t0, t1). A
    hot window ahead of the fault doesn't count; faults without one go."""
    bin_of = lambda x: F.floor(x / F.lit(width)).cast("long")
    of = windows.filter(hot).select(*s.keys, "start", bin_of(F.col("start")).alias("__bin"))
    at = F.explode(F.sequence(bin_of(F.col("t0") - (width - 1)), bin_of(F.col("t1") - 1)))
    of = of.join(faults.filter("t0 < t1").withColumn("__bin", at), [*s.keys, "__bin"]).filter((F.col("start") < F.col("t1")) & (F.col("start") + width > F.col("t0")))
    return of.groupBy(*faults.columns).agg(F.min("start").alias("fired"))


def routed(series: DataFrame, faults: DataFrame, value: str, counters: dict[str, str], gradual: tuple[str, ...] = ("drift",), width: int = 128, ahead: Region = AHEAD, limit: float = 3.5, family: str = "class", s: Series = TELEMETRY) -> DataFrame:
    """(keys, family, t0, fired, centre, onset, centre_error, onset_error) of ``faults`` with triggers (``triggers_of``) that can be localised: by the counter of a
    family that has one (``counters``: {family: column}), by EWMA for the ``gradual`` ones, by the Page test for the others, all from the trigger on."""
    columns = {c: F.col(c) for c in dict.fromkeys([value, *counters.values()])}
    found = regions(series, faults, columns, ahead, s)
    found = page_onset(ewma_onset(found, value, ahead, limit=limit, out="__ewma"), value, ahead, out="__page")
    found = found.withColumn("region", F.filter("region", lambda x: x["step"] >= F.col("fired")))
    for c in dict.fromkeys(counters.values()):
        found = counter_onset(found, c, f"__of_{c}")
    found = faults.join(found.drop("region"), [*s.keys, "fired"])
    onset = F.when(F.col(family).isin(*gradual), F.col("__ewma")).otherwise(F.col("__page"))
    for f, c in counters.items():
        onset = F.when(F.col(family) == f, F.col(f"__of_{c}")).otherwise(onset)
    out = found.withColumns({"onset": onset, "centre": F.col("fired") + width // 2}).filter("onset is not null")
    return out.select(*s.keys, family, "t0", "fired", "centre", "onset", F.abs(F.col("centre") - F.col("t0")).alias("centre_error"), F.abs(F.col("onset") - F.col("t0")).alias("onset_error"))
