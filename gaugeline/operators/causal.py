"""Lagged causal links between variables: conditions chosen by partial correlation, then the momentary conditional independence test.

A row of the system is all variables at a step and at up to 2 * longest steps before it. One pass sums the products of all columns: each task
centres its own rows, and tasks' means and products are merged, first in BUCKETS for each group, then in one. Everything after that works on
the small matrix of products, whatever the number of rows: for each variable the conditions are found among all lagged ones, the
strongest first; and each link is tested given the conditions of both its ends. Groups are tested side by side.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 32


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    import math

    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for k in range(1, 10_000):
        for top in (k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * total


def partial(products, n: int, x: int, y: int, given: list[int]) -> tuple[float, float]:
    """(r, p): the correlation of columns x and y without what ``given`` explain, and how likely one as large is by chance (Student, two-sided). Without
    variation or degrees of freedom it is 0, and p is 1."""
    import numpy as np

    at = [x, y, *given]
    free = n - len(at)
    scale = np.sqrt(np.diag(products)[at])
    if free < 1 or not (scale > 1e-9 * max(1.0, float(np.sqrt(np.diag(products).max())))).all():
        at = [x, y, *[g for g in given if np.sqrt(products[g, g]) > 1e-9]]
        scale = np.sqrt(np.diag(products)[at])
        if free < 1 or not (scale[:2] > 1e-12).all():
            return 0.0, 1.0
    inverse = np.linalg.pinv(products[np.ix_(at, at)] / np.outer(scale, scale), hermitian=True)
    size = inverse[0, 0] * inverse[1, 1]
    r = float(np.clip(-inverse[0, 1] / np.sqrt(size), -1, 1)) if size > 0 else 0.0
    if abs(r) >= 1:
        return r, 0.0
    return r, beta_share(free / 2, 0.5, 1 - r * r)


def conditions(products, n: int, variables: int, longest: int, chosen: float) -> list[list[tuple[int, int]]]:
    """For each variable the (variable, lag) on which it depends given the strongest of the others: those that stay significant at ``chosen`` with more and more
    of them, strongest first."""
    out = []
    column = lambda v, lag: lag * variables + v
    for j in range(variables):
        left = [(i, lag) for lag in range(1, longest + 1) for i in range(variables)]
        weakest = {}
        size = 0
        while len(left) - 1 >= size:
            gone = []
            for link in left:
                given = [x for x in left if x != link][:size]
                r, p = partial(products, n, column(*link), column(j, 0), [column(*x) for x in given])
                weakest[link] = min(weakest.get(link, 1.0), abs(r))
                if p > chosen:
                    gone.append(link)
            left = sorted((x for x in left if x not in gone), key=lambda x: (-weakest[x], x))
            size += 1
        out.append(left)
    return out


def links_of(products, n: int, variables: int, longest: int, chosen: float) -> list[tuple[int, int, int, float, float]]:
    """(cause, effect, lag, r, p) of every lagged link, given the conditions of the effect and, as much earlier, those of the cause."""
    held = conditions(products, n, variables, longest, chosen)
    column = lambda v, lag: lag * variables + v
    out = []
    for j in range(variables):
        for lag in range(1, longest + 1):
            for i in range(variables):
                given = [column(*x) for x in held[j] if x != (i, lag)] + [column(v, k + lag) for v, k in held[i]]
                out.append((i, j, lag, *partial(products, n, column(i, lag), column(j, 0), list(dict.fromkeys(given)))))
    return out


def _merged(parts):
    """(n, means, products) of all rows, of those of parts of them."""
    import numpy as np

    n, mean, products = 0, 0.0, 0.0
    for k, m, q in parts:
        if k:
            away = m - mean
            products = products + q + np.outer(away, away) * (n * k / (n + k))
            mean = mean + away * (k / (n + k))
            n += k
    return n, mean, products


def lagged_links(df: DataFrame, variable: str, order: str, value: Column, names: list[str], longest: int = 2, by: tuple[str, ...] = (), chosen: float = 0.05) -> DataFrame:
    """(by, cause, effect, lag, r, p, n) of every lag from 1 to ``longest`` between the variables ``names``, of ``df`` (by, variable, order), one row each at whole-number
    steps; others aren't read. Steps count for which all variables are known then and 2 * longest steps back; n is their number. Without any there are no rows."""
    import numpy as np

    wide, size = 2 * longest + 1, len(names) * (2 * longest + 1)
    groups = list(by) or ["__all"]
    df = df if by else df.withColumn("__all", F.lit(0))
    kinds = dict(df.dtypes)
    keys = ", ".join(f"`{g}` {kinds[g]}" for g in groups)
    number = F.create_map(*[x for k, name in enumerate(names) for x in (F.lit(name), F.lit(k))])
    rows = df.select(*groups, number[F.col(variable)].alias("__v"), F.col(order).cast("long").alias("__t"), value.cast("double").alias("__x")).filter("__v is not null and __x is not null")
    at = F.explode(F.sequence(F.lit(0), F.lit(wide - 1)))
    cells = rows.withColumn("__lag", at).select(*groups, (F.col("__t") + F.col("__lag")).alias("__t"), (F.col("__lag") * len(names) + F.col("__v")).alias("__c"), "__x")
    system = cells.groupBy(*groups, "__t").agg(F.array_sort(F.collect_list(F.struct("__c", "__x"))).alias("__row")).filter(F.size("__row") == size)
    system = system.select(*groups, F.transform("__row", lambda c: c["__x"]).alias("__row"))

    def packed(n, mean, products):
        return np.concatenate([[n], mean, products.ravel()]).astype("f8").tobytes()

    def unpacked(held):
        x = np.frombuffer(held, "f8")
        return int(x[0]), x[1 : 1 + size], x[1 + size :].reshape(size, size)

    def summed(batches: Iterator) -> Iterator:
        import pandas as pd

        held = {}
        for pdf in batches:
            for key, part in pdf.groupby(groups, dropna=False):
                x = np.stack(part["__row"].to_numpy())
                mean = x.mean(0)
                held[key] = _merged([held.get(key, (0, 0.0, 0.0)), (len(x), mean, (x - mean).T @ (x - mean))])
        for k, (key, parts) in enumerate(held.items()):
            yield pd.DataFrame({**{g: [v] for g, v in zip(groups, key, strict=True)}, "__held": [packed(*parts)]})

    def bucket(pdf):
        return pdf.iloc[:1][groups].assign(__held=packed(*_merged(map(unpacked, pdf["__held"]))))

    def tested(pdf):
        import pandas as pd

        n, _, products = _merged(map(unpacked, pdf["__held"]))
        out = pd.DataFrame(links_of(products, n, len(names), longest, chosen), columns=["cause", "effect", "lag", "r", "p"])
        first = {g: pdf[g].iloc[0] for g in groups}
        return out.assign(**first, n=n, cause=[names[k] for k in out["cause"]], effect=[names[k] for k in out["effect"]])[[*groups, "cause", "effect", "lag", "r", "p", "n"]]

    parts = system.mapInPandas(summed, f"{keys}, `__held` binary")
    parts = parts.withColumn("__bucket", F.pmod(F.xxhash64("__held"), F.lit(BUCKETS)))
    parts = parts.groupBy(*groups, "__bucket").applyInPandas(bucket, f"{keys}, `__held` binary")
    out = parts.groupBy(*groups).applyInPandas(tested, f"{keys}, cause string, effect string, lag long, r double, p double, n long")
    return out if by else out.drop("__all")


def stable_edges(links: DataFrame, group: str, least: int, level: float = 0.01) -> DataFrame:
    """(cause, effect, groups, lags, stable): in how many groups a link is significant at any lag, at how many different lags, and whether that is in ``least`` groups or more."""
    found = links.filter(F.col("p") <= level).groupBy("cause", "effect").agg(F.countDistinct(group).alias("groups"), F.countDistinct("lag").alias("lags"))
    return found.withColumn("stable", F.col("groups") >= least)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
