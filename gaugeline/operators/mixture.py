"""A threshold by a mixture: components by least BIC, and the tail of the highest one by a Gamma distribution with a location."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.operators import ranked
from gaugeline.sources.storage import written

MOST_COMPONENTS = 3
#: A skewness so small counts as none.
LEAST_SKEW = 1e-3


def gamma_share(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        total = term = 1 / a
        k = a
        while abs(term) > 1e-17 * abs(total):
            k += 1
            term *= x / k
            total += term
        return min(1.0, front * total)
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = total = 1 / b
    for k in range(1, 100_000):
        top = k * (a - k)
        b += 2
        d, c = top * d + b, b + top / c
        d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
        total *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return max(0.0, 1 - front * total)


def gamma_quantile(a: float, p: float) -> float:
    """x with gamma_share(a, x) = p, for 0 < p < 1: Newton's steps inside an interval that holds the root, halved where a step leaves it."""
    # the function is at most x ** a / gamma(a + 1)
    least = (math.log(p) + math.lgamma(a + 1)) / a
    if least < -650:  # as good as none
        return 0.0
    lo = math.exp(least)
    z = NormalDist().inv_cdf(p)
    x = a * (1 - 1 / (9 * a) + z / (3 * math.sqrt(a))) ** 3
    hi = max(1.0, 2 * a, x, 2 * lo)
    while gamma_share(a, hi) < p:
        lo, hi = hi, 2 * hi
    # below 1 the function is concave, and Newton's steps from the left stay there
    x = lo if a < 1 and lo > 0 else x if lo < x < hi else (lo + hi) / 2
    for _ in range(400):
        off = gamma_share(a, x) - p
        lo, hi = (lo, x) if off > 0 else (x, hi)
        slope = math.exp((a - 1) * math.log(x) - x - math.lgamma(a))
        to = x - off / slope if slope > 0 else lo
        to = to if lo < to < hi else (lo + hi) / 2
        if abs(to - x) <= 1e-14 * max(to, 1e-300) or hi - lo <= 1e-15 * hi:
            return to
        x = to
    return x


def tail(mean: float, variance: float, skewness: float, p: float) -> float:
    """The p quantile of the Gamma distribution, with a location and mirrored for a negative skew, of those moments; of the normal one without skew."""
    sd = math.sqrt(variance)
    if abs(skewness) < LEAST_SKEW:
        return NormalDist(mean, sd).inv_cdf(p)
    shape = 4 / skewness**2
    away = (gamma_quantile(shape, p if skewness > 0 else 1 - p) - shape) / math.sqrt(shape)
    return mean + sd * (away if skewness > 0 else -away)


def mixture_threshold(df: DataFrame, score: str, fpr: float, most: int = MOST_COMPONENTS, seed: int = 5) -> tuple[float, int]:
    """(tau, k): the score that a share ``fpr`` of the rows exceed by the tail of the highest of k components. k is at most ``most`` and the number of different
    scores; least BIC decides. If the highest component has no more rows than are to exceed tau, or no variance, tau is the quantile of all rows. Null and NaN scores
    don't count; without any other tau is NaN and k 0."""
    x = written(df.select(F.col(score).cast("double").alias("s")).filter("s is not null and not isnan(s)"))
    n, mean, variance, skew = x.agg(F.count("s"), F.avg("s"), F.var_pop("s"), F.skewness("s")).first()
    if not n:
        return math.nan, 0
    different = x.distinct().limit(most).count()
    best = (2 * math.log(n) + n * (math.log(2 * math.pi * max(variance, 1e-12)) + 1), 1, (n, mean, variance, skew))
    vectors = x.select("s", array_to_vector(F.array("s")).alias("features"))
    for k in range(2, min(most, different) + 1):
        model = GaussianMixture(k=k, seed=seed, maxIter=50).fit(vectors)
        bic = (3 * k - 1) * math.log(n) - 2 * model.summary.logLikelihood
        if bic < best[0]:
            top = max(range(k), key=lambda i: model.gaussians[i].mean[0])
            held = model.transform(vectors).filter(F.col("prediction") == top).agg(F.count("s"), F.avg("s"), F.var_pop("s"), F.skewness("s")).first()
            best = (bic, k, tuple(held))
    _, k, (size, mean, variance, skew) = best
    level = 1 - fpr * n / max(size, 1)
    if size <= fpr * n or not 0 < level < 1 or not variance:
        counts = x.groupBy("s").agg(F.count("*").alias("n")).withColumn("all", F.lit(0))
        return float(ranked.quantiles(counts, "s", "n", [1 - fpr], ("all",)).first()["q"]), k
    return tail(mean, variance, skew, level), k
