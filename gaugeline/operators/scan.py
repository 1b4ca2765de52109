"""Recurrences over long series, block by block: affine maps composed over blocks, wear with resets, a capped exponential carried over
sorted batches, and ranges by a sparse table over blocks with halos."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.operators.sequence import TELEMETRY, Series

BLOCK = 256


def affine_scan(df: DataFrame, keep: Column, add: Column, s: Series = TELEMETRY, start: float = 0.0, out: str = "state", block: int = BLOCK) -> DataFrame:
    """(keys, order, out): x = keep * x + add along each series, from ``start`` before its first row. A reset is a keep of 0; a null keep or add leaves x as it is.

    Such maps compose to one of their kind. A block of steps is composed to one map, the maps of blocks are scanned in the same way, in blocks of blocks, until a
    series is one block; then each block runs through its rows from the state that it begins with. A task holds one block."""
    whole = keep.isNotNull() & add.isNotNull()
    rows = df.select(*s.keys, F.col(s.order).cast("long").alias("__t"), F.when(whole, keep.cast("double")).otherwise(1.0).alias("__k"), F.when(whole, add.cast("double")).otherwise(0.0).alias("__a"))
    lo, hi = rows.agg(F.min("__t"), F.max("__t")).first()
    rows = rows.withColumn("__t", F.col("__t") - F.lit(lo or 0))
    got = _scanned(rows, s.keys, (hi - lo + 1) if lo is not None else 1, start, block)
    return got.select(*s.keys, (F.col("__t") + F.lit(lo or 0)).alias(s.order), F.col("__x").alias(out))


def _scanned(rows: DataFrame, keys: tuple[str, ...], span: int, start: float, block: int) -> DataFrame:
    """(keys, __t, __x) of rows (keys, __t, __k, __a) with __t from 0 up to ``span``."""
    blocks = rows.withColumn("__b", F.floor(F.col("__t") / F.lit(block)).cast("long")).groupBy(*keys, "__b").agg(F.sort_array(F.collect_list(F.struct("__t", "__k", "__a"))).alias("__rows"))
    if span <= block:
        blocks = blocks.withColumn("__x0", F.lit(float(start)))
    else:
        one = F.aggregate("__rows", F.struct(F.lit(1.0).alias("k"), F.lit(0.0).alias("a")), lambda m, r: F.struct((r["__k"] * m["k"]).alias("k"), (r["__k"] * m["a"] + r["__a"]).alias("a")))
        maps = blocks.select(*keys, F.col("__b").alias("__t"), one.alias("m")).select(*keys, "__t", F.col("m.k").alias("__k"), F.col("m.a").alias("__a"))
        ends = _scanned(maps, keys, -(-span // block), start, block)
        # a block begins with what the one before it, wherever that is, ends with
        maps = maps.join(ends, [*keys, "__t"])
        before = F.lag("__x").over(Window.partitionBy(*keys).orderBy("__t"))
        begins = maps.select(*keys, F.col("__t").alias("__b"), F.coalesce(before, F.lit(float(start))).alias("__x0"))
        blocks = blocks.join(begins, [*keys, "__b"])
    step = lambda a, r: F.concat(a, F.array(r["__k"] * F.element_at(a, -1) + r["__a"]))
    run = blocks.select(*keys, "__rows", F.aggregate("__rows", F.array("__x0"), step).alias("__states"))
    run = run.select(*keys, F.explode(F.transform("__rows", lambda r, i: F.struct(r["__t"].alias("__t"), F.get("__states", i + 1).alias("__x")))).alias("y"))
    return run.select(*keys, "y.*")


def wear(df: DataFrame, load: Column, reset: Column, rate: float, knee: float, steeper: float, s: Series = TELEMETRY, out: str = "wear") -> DataFrame:
    """``df`` with ``out``: w = w + rate * load, and ``steeper`` times as much once w is over the knee; a reset makes w 0 before its row's load. In closed form: since the last
    reset all load counts once up to the first sum over the knee, and what follows more."""
    seen = df.withColumn("__part", F.sum(F.coalesce(reset, F.lit(False)).cast("long")).over(s.upto()))
    seen = seen.withColumn("__sum", F.sum(F.coalesce(load.cast("double"), F.lit(0.0))).over(s.upto("__part")))
    over = F.col("__sum") * rate > knee
    first = F.min(F.when(over, F.col("__sum"))).over(s.whole("__part"))
    seen = seen.withColumn("__first", first)
    w = F.when(over, (F.col("__first") + steeper * (F.col("__sum") - F.col("__first"))) * rate).otherwise(F.col("__sum") * rate)
    return seen.withColumn(out, w).drop("__part", "__sum", "__first")


def exponential_wear(df: DataFrame, load: Column, reset: Column, rate: float = 1 / 240, knee: float = 0.1, gain: float = 2.0, cap: float = 0.5, s: Series = TELEMETRY, out: str = "bias") -> DataFrame:
    """(keys, order, out): b = min(cap, b + rate * load * exp(gain * max(0, b - knee))), a reset makes b 0 before its row's load. No closed form is known: series are dealt out and
    sorted by Spark, and a task carries one number over its batches, whatever a series' length. Rows without load are skipped, and after the cap all up to a reset."""
    kinds = dict(df.dtypes)
    columns, named = [*s.keys, s.order], list(s.keys)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in s.keys], f"`{s.order}` bigint", f"`{out}` double"])

    def fold(batches: Iterator) -> Iterator:
        import math

        import numpy as np

        entity, b = None, 0.0
        for batch in batches:
            found = np.zeros(len(batch))
            keys = list(zip(*[batch[c] for c in named], strict=True)) if named else [()] * len(batch)
            news = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            loads, resets = batch["__load"].to_numpy("f8"), batch["__reset"].to_numpy(bool)
            for first, last in zip(news, news[1:], strict=False):
                if keys[first] != entity:
                    entity, b = keys[first], 0.0
                at = first
                for i in first + np.flatnonzero((loads[first:last] != 0) | resets[first:last]):
                    found[at:i] = b
                    at = i
                    b = 0.0 if resets[i] else b
                    b = min(cap, b + rate * loads[i] * math.exp(gain * max(0.0, b - knee)))
                found[at:last] = b
            batch[out] = found
            yield batch[[*columns, out]]

    rows = df.select(*s.keys, F.col(s.order).cast("long").alias(s.order), F.coalesce(load.cast("double"), F.lit(0.0)).alias("__load"), F.coalesce(reset, F.lit(False)).alias("__reset"))
    return rows.repartition(*s.keys).sortWithinPartitions(*columns).mapInPandas(fold, schema)


def with_halo(df: DataFrame, s: Series, block: int, before: int, after: int) -> DataFrame:
    """``df`` with each row in its own block of ``block`` steps, __b, and in those that it is up to ``before`` steps before, or ``after`` steps after; __own says which is
    its own. A block with its halo is all that a task needs."""
    t = F.col(s.order)
    bin_of = lambda x: F.floor(x / F.lit(block)).cast("long")
    out = df.withColumn("__b", F.explode(F.sequence(bin_of(t - after), bin_of(t + before))))
    return out.withColumn("__own", F.col("__b") == bin_of(t))


def sparse_table(df: DataFrame, value: Column, longest: int, s: Series = TELEMETRY, block: int | None = None) -> DataFrame:
    """(keys, level, at, lo, hi): the least and greatest value of the 2 ** level steps from each step on, for all levels up to ``longest`` steps. Each level comes from the one
    before: that of a step and of the one half as far on. Series are cut into blocks with a halo, and all levels share one order. A stretch over a gap has no row; nulls are
    left out, as by min and max."""
    levels = longest.bit_length()
    block = block or max(1_024, 4 * longest)
    rows = df.select(*s.keys, F.col(s.order).cast("long").alias(s.order), value.alias("__lo0"))
    rows = with_halo(rows.withColumn("__hi0", F.col("__lo0")), s, block, 0, (1 << levels) - 1)
    w = Window.partitionBy(*s.keys, "__b").orderBy(s.order)
    rows = rows.withColumn("__ok0", F.lit(True))
    for level in range(1, levels):
        half = 1 << (level - 1)
        there = (F.lead(s.order, half).over(w) == F.col(s.order) + half) & F.lead(f"__ok{level - 1}", half).over(w) & F.col(f"__ok{level - 1}")
        rows = rows.withColumns({f"__ok{level}": F.coalesce(there, F.lit(False)), f"__lo{level}": F.least(f"__lo{level - 1}", F.lead(f"__lo{level - 1}", half).over(w)), f"__hi{level}": F.greatest(f"__hi{level - 1}", F.lead(f"__hi{level - 1}", half).over(w))})
    each = [F.struct(F.lit(k).alias("level"), F.col(s.order).alias("at"), F.col(f"__lo{k}").alias("lo"), F.col(f"__hi{k}").alias("hi"), F.col(f"__ok{k}").alias("ok")) for k in range(levels)]
    return rows.filter("__own").select(*s.keys, F.explode(F.array(*each)).alias("x")).filter("x.ok").select(*s.keys, "x.level", "x.at", "x.lo", "x.hi")


def range_extremes(table: DataFrame, ranges: DataFrame, s: Series = TELEMETRY) -> DataFrame:
    """(keys, first, end, lo, hi) of each distinct range (keys, first, end) of steps, the end exclusive, by two look-ups in a sparse table that overlap. A range over a gap, past an
    end, longer than the table's longest or without a step has no row."""
    span = F.col("end") - F.col("first")
    asked = ranges.select(*s.keys, F.col("first").cast("long").alias("first"), F.col("end").cast("long").alias("end")).distinct().filter(span > 0)
    level = F.floor(F.log2(span.cast("double"))).cast("int")
    # the logarithm of a large number may be rounded up
    level = F.when(F.pow(F.lit(2.0), level) > span, level - 1).otherwise(level)
    asked = asked.withColumn("level", level)
    ats = F.array_distinct(F.array(F.col("first"), F.col("end") - F.pow(F.lit(2.0), F.col("level")).cast("long")))
    asked = asked.withColumn("__n", F.size(ats)).withColumn("at", F.explode(ats))
    found = asked.join(table, [*s.keys, "level", "at"]).groupBy(*s.keys, "first", "end").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n"), F.first("__n").alias("__n"))
    return found.filter(F.col("n") == F.col("__n")).drop("n", "__n")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
