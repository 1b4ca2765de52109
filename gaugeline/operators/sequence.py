"""Sequence operators: run lengths, counters, change detectors, frames. Each takes a table with an entity key
and an integer order, adds columns, and needs one partitioning by the key."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Series:
    keys: tuple[str, ...] = ("machine",)
    order: str = "step"

    def by(self, *more: str) -> WindowSpec:
        return Window.partitionBy(*self.keys, *more).orderBy(self.order)

    def last(self, n: int, *more: str) -> WindowSpec:
        """The current row and the n - 1 before it."""
        return self.by(*more).rowsBetween(1 - n, 0)

    def upto(self, *more: str) -> WindowSpec:
        return self.by(*more).rowsBetween(Window.unboundedPreceding, 0)

    def whole(self, *more: str) -> WindowSpec:
        return Window.partitionBy(*self.keys, *more)


TELEMETRY = Series()


def islands(df: DataFrame, value: Column, s: Series = TELEMETRY, out: str = "island") -> DataFrame:
    """Numbers the runs of equal neighbouring values from 1; nulls equal each other."""
    w = s.by()
    df = df.withColumn(f"__{out}", value)
    changed = F.when(F.row_number().over(w) == 1, 1).when(F.lag(f"__{out}").over(w).eqNullSafe(F.col(f"__{out}")), 0).otherwise(1)
    df = df.withColumn(f"__{out}_new", changed)
    return df.withColumn(out, F.sum(f"__{out}_new").over(s.upto())).drop(f"__{out}", f"__{out}_new")


def run_length(df: DataFrame, value: Column, s: Series = TELEMETRY, out: str = "dwell") -> DataFrame:
    """How many rows, this one included, the value has been as it is."""
    df = islands(df, value, s, "__run")
    return df.withColumn(out, F.row_number().over(s.by("__run")).cast("long")).drop("__run")


def run_while(df: DataFrame, held: Column, s: Series = TELEMETRY, out: str = "downrun") -> DataFrame:
    """The run length where a condition holds, else 0."""
    df = run_length(df, held, s, out)
    return df.withColumn(out, F.when(held, F.col(out)).otherwise(0).cast("long"))


def since(df: DataFrame, event: Column, s: Series = TELEMETRY, out: str = "tputlag") -> DataFrame:
    """Rows since the event last held, 0 where it does; before the first one it counts from 1."""
    df = df.withColumn("__seen", F.sum(event.cast("long")).over(s.upto()))
    n = F.row_number().over(s.by("__seen")).cast("long")
    return df.withColumn(out, F.when(F.col("__seen") == 0, n).otherwise(n - 1)).drop("__seen")


def repeats(df: DataFrame, value: str, s: Series = TELEMETRY, out: str = "stale") -> DataFrame:
    """How often in a row the value has repeated exactly; 0 at a new one."""
    df = run_length(df, F.col(value), s, out)
    return df.withColumn(out, F.col(out) - 1)


def anchored_repeats(df: DataFrame, value: str, tolerance: float, s: Series = TELEMETRY, out: str = "stale") -> DataFrame:
    """(keys, order, out): like ``repeats``, but within ``tolerance`` of an anchor that moves only when a value is farther off.
    The anchor depends on all before it: entities are dealt out and sorted by Spark, and a task carries one anchor and
    one count over its batches, whatever a series' length."""
    kinds = dict(df.dtypes)
    # the tasks get plain values, not this module
    columns, named = [*s.keys, s.order], list(s.keys)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in s.keys], f"`{s.order}` bigint", f"`{out}` bigint"])

    def fold(batches):
        import numpy as np

        entity, anchor, n = None, None, 0
        for batch in batches:
            found = np.zeros(len(batch), "i8")
            keys = list(zip(*[batch[c] for c in named], strict=True))
            for i, (k, v) in enumerate(zip(keys, batch["__v"].to_numpy("f8"), strict=True)):
                if k != entity:
                    entity, anchor, n = k, None, 0
                if anchor is not None and abs(v - anchor) <= tolerance:
                    n += 1
                else:
                    anchor, n = v, 0
                found[i] = n
            batch[out] = found
            yield batch[[*columns, out]]

    rows = df.select(*s.keys, F.col(s.order).cast("long").alias(s.order), F.col(value).cast("double").alias("__v"))
    return rows.repartition(*s.keys).sortWithinPartitions(*columns).mapInPandas(fold, schema)


def bernoulli_cusum(df: DataFrame, failed: Column, p0: float, p1: float, h: float, s: Series = TELEMETRY) -> DataFrame:
    """Adds fails, cusum and alarm: s = max(0, s + w), never reset. In closed form the running sum less its
    least value so far; sums are exact counts times weights, so their order doesn't matter."""
    up, down = math.log(p1 / p0), math.log((1 - p1) / (1 - p0))
    df = df.withColumn("fails", F.sum(failed.cast("long")).over(s.upto())).withColumn("__n", F.row_number().over(s.by()).cast("long"))
    df = df.withColumn("__c", F.col("fails") * F.lit(up) + (F.col("__n") - F.col("fails")) * F.lit(down))
    df = df.withColumn("cusum", F.col("__c") - F.least(F.lit(0.0), F.min("__c").over(s.upto())))
    return df.withColumn("alarm", F.col("cusum") >= h).drop("__c", "__n")


def page_cusum(df: DataFrame, z: Column, k: float, h: float, s: Series = TELEMETRY) -> DataFrame:
    """Adds g = max(0, g + |z| - k) in closed form and over = g > h."""
    df = df.withColumn("__n", F.row_number().over(s.by())).withColumn("__c", F.sum(F.abs(z) - F.lit(k)).over(s.upto()))
    df = df.withColumn("g", F.col("__c") - F.least(F.lit(0.0), F.min("__c").over(s.upto())))
    return df.withColumn("over", F.col("g") > h).drop("__c", "__n")


def ewma(df: DataFrame, value: str, weight: float, start: Column, s: Series = TELEMETRY, out: str = "ewma") -> DataFrame:
    """(keys, order, value, ewma): e = (1 - weight) e + weight v from ``start``, an aggregate over the series.

    In a block of rows, e is a running sum of v over a power of (1 - weight), scaled back; blocks are as long as that power stays within a double's range.
    What a block begins with is folded over the entity's blocks, some thousand times fewer than its rows."""
    keep = 1 - weight
    block = max(1, int(230 / -math.log(keep))) if 0 < keep < 1 else 1
    place = F.row_number().over(s.by()) - 1
    rows = df.withColumns({"__b": F.floor(place / F.lit(block)).cast("long"), "__j": place % block})
    up = Window.partitionBy(*s.keys, "__b").orderBy(s.order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__s", F.sum(F.lit(weight) * F.col(value) * F.pow(F.lit(keep), -F.col("__j"))).over(up) * F.pow(F.lit(keep), F.col("__j")))
    ends = rows.groupBy(*s.keys, "__b").agg(F.max("__j").alias("j"), F.max_by("__s", "__j").alias("s"))
    ends = ends.groupBy(*s.keys).agg(F.array_sort(F.collect_list(F.struct("__b", "j", "s"))).alias("ends"))
    ends = ends.join(df.groupBy(*s.keys).agg(start.cast("double").alias("__e")), list(s.keys))
    first = F.array(F.col("__e"))
    begins = F.aggregate("ends", first, lambda a, x: F.concat(a, F.array(F.element_at(a, -1) * F.pow(F.lit(keep), x["j"] + 1) + x["s"])))
    begins = ends.select(*s.keys, F.posexplode(begins).alias("__b", "__begin")).withColumn("__b", F.col("__b").cast("long"))
    rows = rows.join(begins, [*s.keys, "__b"])
    e = F.col("__begin") * F.pow(F.lit(keep), F.col("__j") + 1) + F.col("__s")
    return rows.select(*s.keys, F.col(s.order).cast("long").alias(s.order), F.col(value).cast("double").alias(value), e.alias(out))


def trailing_variance(df: DataFrame, cents: str, n: int, s: Series = TELEMETRY, out: str = "variance") -> DataFrame:
    """The population variance of the last n values in units of 1, from integer cents; null for fewer rows."""
    w = s.last(n)
    x, xx, k = F.sum(cents).over(w), F.sum(F.col(cents) * F.col(cents)).over(w), F.count(F.lit(1)).over(w)
    return df.withColumn(out, F.when(k == n, (n * xx - x * x).cast("double") / F.lit(float(n * n * 10000))))


def confirmed(df: DataFrame, screen: Column, expert: Column, k: int, before: int, s: Series = TELEMETRY, out: str = "confirmed") -> DataFrame:
    """An alarm (screen or expert) that has k alarms among itself and the ``before`` rows before it."""
    df = df.withColumn("__any", screen | expert)
    n = F.sum(F.col("__any").cast("long")).over(s.last(before + 1))
    return df.withColumn(out, F.col("__any") & ((n >= k) if k > 1 else F.lit(True))).drop("__any")


def suppressed(df: DataFrame, alarm: Column, window: int, s: Series = TELEMETRY) -> DataFrame:
    """Adds alarm_no, emitted and reason: an emitted alarm silences the next ``window`` alarms."""
    df = df.withColumn("__a", alarm.cast("long")).withColumn("alarm_no", F.sum("__a").over(s.upto()))
    df = df.withColumn("emitted", (F.col("__a") == 1) & (F.pmod(F.col("alarm_no") - 1, F.lit(window + 1)) == 0))
    reason = F.when(F.col("__a") == 0, "none").when(F.col("emitted"), "emitted").otherwise("suppressed")
    return df.withColumn("reason", reason).drop("__a")


def dilated(df: DataFrame, flag: Column, b: int, s: Series = TELEMETRY, out: str = "dilated") -> DataFrame:
    """Whether the flag holds within b rows before or after."""
    return df.withColumn(out, F.max(flag.cast("int")).over(s.by().rowsBetween(-b, b)).cast("long"))


def segments(df: DataFrame, flag: Column, s: Series = TELEMETRY) -> DataFrame:
    """(keys, start, end, length) of the maximal runs of rows where the flag holds; end is exclusive."""
    df = islands(df.withColumn("__f", flag), F.col("__f"), s, "__i").filter("__f")
    return df.groupBy(*s.keys, "__i").agg(F.min(s.order).alias("start"), (F.max(s.order) + 1).alias("end"), F.count("*").alias("length")).drop("__i")


def held_last(df: DataFrame, value: str, dropped: Column, s: Series = TELEMETRY, out: str = "filled") -> DataFrame:
    """The value, or the last one kept where it is dropped."""
    return df.withColumn(out, F.last(F.when(~dropped, F.col(value)), ignorenulls=True).over(s.upto()))


def decimated(df: DataFrame, value: str, width: int, s: Series = TELEMETRY) -> DataFrame:
    """(keys, bucket, lo, hi): least and greatest value of each of ``width`` parts of a series."""
    n = F.count(F.lit(1)).over(s.whole())
    df = df.withColumn("bucket", F.floor((F.row_number().over(s.by()) - 1) * F.lit(width) / n).cast("long"))
    return df.groupBy(*s.keys, "bucket").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))


def state_edges(df: DataFrame, state: str, watched: tuple[str, ...], s: Series = TELEMETRY) -> DataFrame:
    """(keys, order, event): <state>_ON where a watched state begins and <state>_OFF where it ends."""
    before = F.lag(state).over(s.by())
    df = df.withColumn("__b", before)
    on = F.when(F.col(state).isin(*watched) & ~F.col("__b").eqNullSafe(F.col(state)), F.concat(F.col(state), F.lit("_ON")))
    off = F.when(F.col("__b").isin(*watched) & (F.col("__b") != F.col(state)), F.concat(F.col("__b"), F.lit("_OFF")))
    return df.select(*s.keys, s.order, F.explode(F.array_compact(F.array(off, on))).alias("event"))


def debounced(df: DataFrame, width: int, s: Series = TELEMETRY) -> DataFrame:
    """The first row of each entity in each stretch of ``width`` steps."""
    w = Window.partitionBy(*s.keys, F.floor(F.col(s.order) / F.lit(width))).orderBy(s.order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def bridged_walk(df: DataFrame, noise: str, s: Series = TELEMETRY, out: str = "drift") -> DataFrame:
    """``df`` with the running sum of ``noise``, less the straight line from 0 to its last value, so that it ends at 0."""
    whole = s.whole()
    df = df.withColumns({"__w": F.sum(noise).over(s.upto()), "__k": F.row_number().over(s.by()) - 1, "__n": F.count(F.lit(1)).over(whole), "__last": F.sum(noise).over(whole)})
    line = F.when(F.col("__n") > 1, F.col("__k").cast("double") / (F.col("__n") - 1) * F.col("__last")).otherwise(0.0)
    return df.withColumn(out, F.col("__w") - line).drop("__w", "__k", "__n", "__last")
