"""Walks on a small edge table. The table is a dimension: its closure is bounded by its own size, not by data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hops(edges: DataFrame, depth: int = 3, directed: bool = False) -> DataFrame:
    """(src, dst, hop): the shortest number of edges, 0 to itself, up to ``depth``; undirected unless told."""
    e = edges.select("src", "dst")
    e = e if directed else e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    at = e.select("src").unionByName(e.select(F.col("dst").alias("src"))).distinct().select("src", F.col("src").alias("dst"), F.lit(0).alias("hop"))
    found = [at]
    for k in range(1, depth + 1):
        at = at.join(e.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst").select("src", F.col("next").alias("dst"), F.lit(k).alias("hop")).distinct()
        found.append(at)
    return reduce(DataFrame.unionByName, found).groupBy("src", "dst").agg(F.min("hop").alias("hop"))


def ranked_walk(hop_table: DataFrame, peaks: DataFrame, k: int) -> DataFrame:
    """(src, hop, dst, peak, rank): of each hop from a source the k highest peaks, ties by name."""
    from pyspark.sql import Window

    w = Window.partitionBy("src", "hop").orderBy(F.col("peak").desc(), "dst")
    got = hop_table.filter("hop > 0").join(peaks.withColumnRenamed("machine", "dst"), "dst")
    return got.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).select("src", "hop", "dst", "peak", "rank")


def echoes(alarms: DataFrame, upstream: DataFrame, window: int) -> DataFrame:
    """The alarms (machine, step, score) that no upstream alarm (src before dst) of at least their score
    explains within ``window`` steps before: alarms explode into the steps they explain, then an anti-join."""
    reach = alarms.join(upstream, alarms.machine == upstream.src).select(F.col("dst").alias("machine"), F.col("score").alias("by"), F.explode(F.sequence(F.col("step"), F.col("step") + window)).alias("step"))
    reach = reach.groupBy("machine", "step").agg(F.max("by").alias("by"))
    return alarms.join(reach, ["machine", "step"], "left").filter(F.col("by").isNull() | (F.col("by") < F.col("score"))).drop("by")


def echo_cascade(ticks: DataFrame, places: int, window: int, line: str = "line", place: str = "place", step: str = "step") -> DataFrame:
    """(line, place, step, score): the alarms that stay when those of a line are taken from its head on. An alarm goes
    if a place u before it, d places up, has an alarm that stays and a score of at least its own, alarmed or not, in the ``window`` + d steps up to its
    own. ``ticks`` has (line, place, step, score, alarm), places from 0. A line's places stand side by side, so that all of it is
    one shuffle by line and frames over steps; ``places`` is the length of a line, not of the data. A null score explains nothing and is not explained;
    of repeated rows the highest score and any alarm count."""
    from pyspark.sql import Window

    here = lambda m, c: F.when(F.col(place) == m, F.col(c))
    wide = ticks.groupBy(line, step).agg(*[F.max(here(m, "score")).alias(f"__s{m}") for m in range(places)], *[F.bool_or(here(m, "alarm")).alias(f"__a{m}") for m in range(places)])
    by = Window.partitionBy(line).orderBy(step)
    for m in range(places):
        stays = F.coalesce(F.col(f"__a{m}"), F.lit(False))
        for u in range(m):
            near = by.rangeBetween(-(window + m - u), 0)
            stays &= ~F.coalesce(F.bool_or(f"__k{u}").over(near) & (F.max(f"__s{u}").over(near) >= F.col(f"__s{m}")), F.lit(False))
        wide = wide.withColumn(f"__k{m}", stays)
    rows = F.array(*[F.struct(F.lit(m).cast("long").alias("place"), F.col(f"__s{m}").alias("score"), F.col(f"__k{m}").alias("kept")) for m in range(places)])
    return wide.select(line, step, F.inline(rows)).filter("kept").select(line, F.col("place").alias(place), step, "score")


def partial_correlation(df: DataFrame, by: tuple[str, ...], x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """(by ..., n, r): the correlation of x and y with z's share taken out of both, for each group, from exact sums of whole numbers; null
    where one of them is constant or z gives another wholly."""
    d = F.count("*")
    sums = {a: F.sum(a) for a in (x, y, z)}
    cross = lambda a, b: (d * F.sum(F.col(a) * F.col(b)) - sums[a] * sums[b]).cast("double")
    names = {"__xx": (x, x), "__yy": (y, y), "__zz": (z, z), "__xy": (x, y), "__xz": (x, z), "__yz": (y, z)}
    g = df.dropna(subset=[x, y, z]).groupBy(*by).agg(d.alias("n"), *[cross(*p).alias(c) for c, p in names.items()])
    r = lambda a, b: F.try_divide(F.col(f"__{a}{b}"), F.sqrt(f"__{a}{a}") * F.sqrt(f"__{b}{b}"))
    g = g.select(*by, "n", r("x", "y").alias("__xy"), r("x", "z").alias("__xz"), r("y", "z").alias("__yz"))
    left = (1 - F.col("__xz") * F.col("__xz")) * (1 - F.col("__yz") * F.col("__yz"))
    return g.select(*by, "n", F.when(left > 1e-12, (F.col("__xy") - F.col("__xz") * F.col("__yz")) / F.sqrt(left)).alias("r"))
