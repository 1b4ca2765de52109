"""Fitting: per-entity quantiles and fences, threshold pickers, tail models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.operators.ranked import with_running_sums


def tukey_fit(df: DataFrame, good: Column, keys: tuple[str, ...] = ("machine",), value: str = "obs", cents: str = "cents", least: int = 10) -> DataFrame:
    """(keys, q99, q01, q1, q3, fence, low_fence, thr, thr_low, clean_var, n) of the rows where ``good`` holds,
    or of all rows of an entity with fewer than ``least`` such. Variance comes from integer cents."""
    w = Window.partitionBy(*keys)
    df = df.withColumn("__good", good).withColumn("__n", F.sum(F.col("__good").cast("long")).over(w))
    df = df.filter((F.col("__n") < least) | F.col("__good"))
    q = F.percentile(value, F.array(F.lit(0.99), F.lit(0.01), F.lit(0.25), F.lit(0.75)))
    n, x, xx = F.count("*"), F.sum(cents), F.sum(F.col(cents) * F.col(cents))
    fit = df.groupBy(*keys).agg(q.alias("q"), ((n * xx - x * x).cast("double") / (n * n) / 10000).alias("clean_var"), n.alias("n"))
    fit = fit.select(*keys, *[F.get("q", F.lit(k)).alias(c) for k, c in enumerate(("q99", "q01", "q1", "q3"))], "clean_var", "n")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    fit = fit.withColumns({"fence": F.col("q3") + reach, "low_fence": F.col("q1") - reach})
    return fit.withColumns({"thr": F.greatest("q99", "fence"), "thr_low": F.least("q01", "low_fence")})


def median_iqr(df: DataFrame, good: Column, keys: tuple[str, ...] = ("machine",), value: str = "obs") -> DataFrame:
    """(keys, med, iqr) of the good rows, or of all if there are none; an iqr of 0 counts as 1."""
    q = lambda c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    fit = df.groupBy(*keys).agg(q(F.when(good, F.col(value))).alias("a"), q(F.col(value)).alias("b"))
    at = lambda k: F.coalesce(F.get("a", F.lit(k)), F.get("b", F.lit(k)))
    iqr = at(2) - at(0)
    return fit.select(*keys, at(1).alias("med"), F.when(iqr == 0, 1.0).otherwise(iqr).alias("iqr"))


def ranked_counts(df: DataFrame, keys: tuple[str, ...] = (), score: str = "score", y: str = "y") -> DataFrame:
    """For each distinct score: tp and fp if all rows of at least that score are taken, and pos, neg in all.
    Rows are summed by score first, and running sums go by stretches of scores, so no task sees all of them."""
    g = df.groupBy(*keys, score).agg(F.sum(y).alias("__p"), F.count("*").alias("__n"))
    g = with_running_sums(g, score, {"tp": "__p", "__k": "__n"}, keys, descending=True)
    return g.select(*keys, score, "tp", (F.col("__k") - F.col("tp")).alias("fp"), F.col("tp_all").alias("pos"), (F.col("__k_all") - F.col("tp_all")).alias("neg"))


def best_f1(df: DataFrame, keys: tuple[str, ...] = (), score: str = "score", y: str = "y") -> DataFrame:
    """(keys, thr, f1): the threshold of the greatest F1, the least of equal ones."""
    c = ranked_counts(df, keys, score, y)
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("pos")), F.lit(0.0))
    c = c.withColumn("f1", f1)
    top = F.max_by(F.struct(score, "f1"), F.struct(F.col("f1"), -F.col(score)))
    got = c.groupBy(*keys).agg(top.alias("t")) if keys else c.agg(top.alias("t"))
    return got.select(*keys, F.col("t")[score].alias("thr"), F.col("t")["f1"].alias("f1"))


def recall_floor(df: DataFrame, floor: float, keys: tuple[str, ...] = (), score: str = "score", y: str = "y") -> DataFrame:
    """(keys, thr): the highest threshold with at least that recall; the greatest score if nothing is positive,
    the least if the floor can't be reached."""
    c = ranked_counts(df, keys, score, y)
    met = F.max(F.when(F.col("tp") >= F.lit(floor) * F.col("pos"), F.col(score)))
    thr = F.when(F.max("pos") == 0, F.max(score)).otherwise(F.coalesce(met, F.min(score)))
    return c.groupBy(*keys).agg(thr.alias("thr")) if keys else c.agg(thr.alias("thr"))


def peaks_over(df: DataFrame, keys: tuple[str, ...], cents: str, u: Column, q: float) -> DataFrame:
    """(keys, n, xi, sigma, frozen, z): a generalised Pareto tail by moments on what exceeds u (cents). Frozen
    (and z null) with fewer than 20 excesses, no variance, or a shape of .45 or more."""
    e = (F.col(cents) - u).cast("long")
    g = df.groupBy(*keys).agg(F.count(F.when(e > 0, 1)).alias("n"), F.count("*").alias("all"), F.sum(F.when(e > 0, e)).alias("x"), F.sum(F.when(e > 0, e * e)).alias("xx"))
    n = F.col("n")
    m = F.col("x").cast("double") / F.nullif(n, F.lit(0))
    v = (n * F.col("xx") - F.col("x") * F.col("x")).cast("double") / F.nullif(n * (n - 1), F.lit(0))
    xi = 0.5 * (1 - m * m / F.nullif(v, F.lit(0.0)))
    g = g.withColumn("xi", xi).withColumn("sigma", m * (1 - F.col("xi")))
    g = g.withColumn("frozen", F.coalesce((n < 20) | (F.col("xi") >= 0.45), F.lit(True)))
    ratio = F.lit(q) * F.col("all") / n
    z = F.when(F.abs("xi") < 1e-9, -F.col("sigma") * F.log(ratio)).otherwise(F.col("sigma") / F.col("xi") * (F.pow(ratio, -F.col("xi")) - 1))
    return g.select(*keys, "n", "xi", "sigma", "frozen", F.when(~F.col("frozen"), z).alias("z"))


def stability_vote(a: Column, b: Column, c: Column) -> Column:
    """The mean of the two closest of three, or the greatest if those are over 25 % of the median apart."""
    s = F.array_sort(F.array(a, b, c))
    x, y, z = (F.get(s, F.lit(k)) for k in range(3))
    low = (y - x) <= (z - y)
    gap, mean = F.when(low, y - x).otherwise(z - y), F.when(low, (x + y) / 2).otherwise((y + z) / 2)
    return F.when(gap > 0.25 * F.abs(y), z).otherwise(mean)
