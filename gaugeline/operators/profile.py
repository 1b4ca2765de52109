"""Matrix profiles: for each subsequence of a series the distance to its nearest neighbour, by a tiled join of the series with itself.

A series is cut into blocks of BLOCK starts, each with the m - 1 rows that follow, so every subsequence lies in one block. Each two blocks of a series are
a tile; tiles are dealt out by pairs of blocks, so a series is many tasks, and none holds more than two blocks. Within a tile the dot products of
subsequences run along diagonals: those of a diagonal are differences of one running sum. A tile gives the least distance of each of its
rows and columns, and the least over tiles is the profile.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.operators.sequence import TELEMETRY, Series

BLOCK = 1_024


def tile(a, b, start_a: int, start_b: int, m: int, apart: int):
    """(least squared distance, neighbour) of the subsequences of ``a`` and of ``b``, values from those starts on, NaN where there is none; subsequences
    whose starts are ``apart`` or less are no neighbours, nor are those with a missing value. Without any it is infinite, and -1."""
    import numpy as np

    def parts(x):
        w = np.lib.stride_tricks.sliding_window_view(x, m) if len(x) >= m else np.empty((0, m))
        mean, sd = w.mean(1), w.std(1)
        flat = sd <= 1e-12
        # of normalised subsequences: their squared length, and what a product is divided by
        return mean, np.where(flat, np.inf, sd), np.where(flat, 0.0, float(m)), np.isnan(mean)

    a, b = (np.asarray(x, "f8") for x in (a, b))
    (mean_a, sd_a, long_a, gone_a), (mean_b, sd_b, long_b, gone_b) = parts(a), parts(b)
    na, nb = len(mean_a), len(mean_b)
    whole_a, whole_b = np.flatnonzero(~gone_a), np.flatnonzero(~gone_b)
    best = [np.full(na, np.inf), np.full(nb, np.inf)]
    whose = [np.full(na, -1, "i8"), np.full(nb, -1, "i8")]
    if not len(whole_a) or not len(whole_b):
        return (best[0], whose[0]), (best[1], whose[1])
    # about the middle of both, so that running sums stay small
    middle = np.nanmean(np.concatenate([a, b]))
    xa, xb, ma, mb = np.nan_to_num(a - middle), np.nan_to_num(b - middle), mean_a - middle, mean_b - middle
    from_a, from_b, to_a, to_b = whole_a[0], whole_b[0], whole_a[-1] + 1, whole_b[-1] + 1
    for d in range(from_a - to_b + 1, to_a - from_b):
        i, j = max(from_a, from_b + d), max(from_b, from_a - d)
        n = min(to_a - i, to_b - j)
        if abs(start_a + i - start_b - j) <= apart:
            continue
        run = np.concatenate([[0.0], np.cumsum(xa[i : i + n + m - 1] * xb[j : j + n + m - 1])])
        dot = (run[m:] - run[:-m] - m * ma[i : i + n] * mb[j : j + n]) / (sd_a[i : i + n] * sd_b[j : j + n])
        dist = np.maximum(long_a[i : i + n] + long_b[j : j + n] - 2 * dot, 0.0)
        dist[gone_a[i : i + n] | gone_b[j : j + n]] = np.inf
        for k, (s, first) in enumerate(((i, start_b + j), (j, start_a + i))):
            less = dist < best[k][s : s + n]
            best[k][s : s + n][less] = dist[less]
            whose[k][s : s + n][less] = np.arange(first, first + n)[less]
    return (best[0], whose[0]), (best[1], whose[1])


def matrix_profile(df: DataFrame, value: Column, m: int, apart: int | None = None, s: Series = TELEMETRY, block: int = BLOCK) -> DataFrame:
    """(keys, at, distance, neighbour) of each subsequence of ``m`` neighbouring steps: the distance, z-normalised, to the nearest one whose start is more than ``apart``
    (half of m) away, and its start. The order of ``s`` is a whole number; a subsequence over a gap or a null has no row, nor has one without a neighbour.
    A constant one is normalised to zeros. Of equally near neighbours any may be named."""
    apart = m // 2 if apart is None else apart
    kinds = dict(df.dtypes)
    at = F.col("__at")
    rows = df.select(*s.keys, F.col(s.order).cast("long").alias("__at"), value.cast("double").alias("__v")).filter("__v is not null and not isnan(__v)")
    bin_of = lambda x: F.floor(x / F.lit(block)).cast("long")
    # a row is in the blocks of the subsequences that it is part of
    rows = rows.withColumn("__b", F.explode(F.sequence(bin_of(at - (m - 1)), bin_of(at))))
    blocks = rows.groupBy(*s.keys, "__b").agg(F.collect_list(F.struct("__at", "__v")).alias("__x"))
    spans = blocks.groupBy(*s.keys).agg(F.collect_set("__b").alias("__all"))
    left = blocks.join(spans, list(s.keys)).select(*s.keys, F.col("__b").alias("__a"), F.col("__x").alias("__xa"), F.explode(F.filter("__all", lambda x: x >= F.col("__b"))).alias("__b"))
    tiles = left.join(blocks, [*s.keys, "__b"]).repartition(*s.keys, "__a", "__b")
    columns, schema = list(s.keys), ", ".join([*[f"`{c}` {kinds[c]}" for c in s.keys], "`at` long", "d double", "neighbour long"])

    def least(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        def laid(x, b):
            out = np.full(block + m - 1, np.nan)
            for r in x:
                out[r["__at"] - b * block] = r["__v"]
            return out

        for pdf in batches:
            for r in pdf.to_dict("records"):
                first, second = tile(laid(r["__xa"], r["__a"]), laid(r["__x"], r["__b"]), r["__a"] * block, r["__b"] * block, m, apart)
                for (d, whose), b in ((first, r["__a"]), (second, r["__b"])):
                    some = np.flatnonzero(np.isfinite(d))
                    yield pd.DataFrame({**{c: [r[c]] * len(some) for c in columns}, "at": b * block + some, "d": d[some], "neighbour": whose[some]})

    found = tiles.select(*s.keys, "__a", "__b", "__xa", "__x").mapInPandas(least, schema)
    best = found.groupBy(*s.keys, "at").agg(F.min(F.struct("d", "neighbour")).alias("__m"))
    return best.select(*s.keys, "at", F.sqrt("__m.d").alias("distance"), F.col("__m.neighbour").alias("neighbour"))


def discord(profile: DataFrame, s: Series = TELEMETRY) -> DataFrame:
    """(keys, at, distance): the subsequence of each series whose nearest neighbour is farthest, the first of equals."""
    far = F.max(F.struct("distance", (-F.col("at")).alias("back")))
    return profile.groupBy(*s.keys).agg(far.alias("__m")).select(*s.keys, (-F.col("__m.back")).alias("at"), F.col("__m.distance").alias("distance"))


def discord_votes(discords: DataFrame, m: int, s: Series = TELEMETRY) -> DataFrame:
    """(keys, order): the rows of the discords."""
    return discords.select(*s.keys, F.explode(F.sequence(F.col("at"), F.col("at") + (m - 1))).alias(s.order))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
