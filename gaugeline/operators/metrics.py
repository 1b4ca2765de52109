"""Evaluation: point, range and event metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.operators.ranked import ranks_within, with_running_sums


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """0 where nothing is positive."""
    return F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0))


def counts(dec: Column, y: Column) -> dict[str, Column]:
    return {"tp": F.count_if(dec & y), "fp": F.count_if(dec & ~y), "fn": F.count_if(~dec & y), "tn": F.count_if(~dec & ~y)}


def mcc(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    d = lambda c: c.cast("double")
    below = F.sqrt(d(tp + fp) * d(tp + fn) * d(tn + fp) * d(tn + fn))
    return F.coalesce(F.try_divide(d(tp) * d(tn) - d(fp) * d(fn), below), F.lit(0.0))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Null for n = 0."""
    p = F.try_divide(hits.cast("double"), n)
    below = 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / below, z * F.sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / below
    return F.when(n > 0, mid - half), F.when(n > 0, mid + half)


def auc(df: DataFrame, keys: tuple[str, ...] = (), score: str = "score", y: str = "y") -> DataFrame:
    """(keys, auc) by the Mann-Whitney count over distinct scores, ties a half; null with one class."""
    g = df.groupBy(*keys, score).agg(F.sum(y).alias("p"), F.sum(1 - F.col(y)).alias("q"))
    g = with_running_sums(g, score, {"below": "q"}, keys).withColumn("below", F.col("below") - F.col("q"))
    wins = F.sum(F.col("p") * (2 * F.col("below") + F.col("q"))).cast("double")
    out = F.try_divide(wins, 2.0 * F.sum("p") * F.sum("q"))
    return g.groupBy(*keys).agg(out.alias("auc")) if keys else g.agg(out.alias("auc"))


def early_credit(x: Column, span: Column) -> Column:
    """2 / (1 + e^(5 x / span)) within the span, else 0."""
    return F.when((x >= 0) & (x <= span), 2 / (1 + F.exp(5.0 * x / span))).otherwise(0.0)


def range_pr_auc(df: DataFrame, score: str, y: str, keys: tuple[str, ...], n_thresholds: int = 50) -> DataFrame:
    """(keys, pr_auc): thresholds at quantiles, anchors (0, 1) and (1, 0), each precision raised to the best at
    no less recall, integrated in steps. No row without positives. Distinct scores are ranked by stretches; only the
    thresholds of a key meet in one task."""
    whole = Window.partitionBy(*keys)
    g = df.groupBy(*keys, F.col(score).cast("double").alias("thr")).agg(F.sum(y).alias("p"), F.count("*").alias("n"))
    g = with_running_sums(g, "thr", {"tp": "p", "k": "n"}, keys, descending=True).filter("tp_all > 0")
    at = ranks_within([k / (n_thresholds - 1) for k in range(n_thresholds)], F.col("k_all") - F.col("k"), F.col("n"), F.col("k_all"))
    row = F.struct("thr", "tp", "k")
    x = g.select(*keys, row.alias("row"), F.col("tp_all").alias("pos"), F.explode(at).alias("x")).groupBy(*keys, "x.nth")
    x = x.agg(F.max(F.when(F.col("x.lo"), F.col("row"))).alias("lo"), F.max(F.when(F.col("x.hi"), F.col("row"))).alias("hi"), F.max("x.part").alias("part"), F.max("pos").alias("pos"))
    # a threshold between two scores takes the rows from the higher one on
    q = F.when(F.col("lo.thr") == F.col("hi.thr"), F.col("lo.thr")).otherwise(F.col("lo.thr") + (F.col("hi.thr") - F.col("lo.thr")) * F.col("part"))
    x = x.withColumn("q", q).withColumn("t", F.when(F.col("q") <= F.col("lo.thr"), F.col("lo")).otherwise(F.col("hi"))).dropDuplicates([*keys, "q"])
    pts = x.select(*keys, (F.col("t.tp").cast("double") / F.col("pos")).alias("r"), F.coalesce(F.try_divide(F.col("t.tp").cast("double"), F.col("t.k")), F.lit(1.0)).alias("p"), F.col("q").alias("o"))
    ends = x.select(*keys).distinct().select(*keys, F.inline(F.array(F.struct(F.lit(0.0).alias("r"), F.lit(1.0).alias("p"), F.lit(1e300).alias("o")), F.struct(F.lit(1.0).alias("r"), F.lit(0.0).alias("p"), F.lit(-1e300).alias("o")))))
    pts = pts.unionByName(ends)
    order = whole.orderBy("r", F.col("o").desc())
    pts = pts.withColumn("best", F.max("p").over(order.rowsBetween(0, Window.unboundedFollowing)))
    pts = pts.withColumn("dr", F.col("r") - F.lag("r").over(order))
    return pts.groupBy(*keys).agg(F.sum(F.coalesce(F.col("dr") * F.col("best"), F.lit(0.0))).alias("pr_auc"))


# The weights of a missed fault and of a false alarm in each profile.
PROFILES = {"standard": (1.0, 1.0), "low-fn": (2.0, 1.0), "low-fp": (1.0, 2.0)}


def nab_scores(faults: DataFrame, alarms: DataFrame, clean: DataFrame, profiles: dict[str, tuple[float, float]] = PROFILES) -> DataFrame:
    """(profile, hit_rate, mean_credit, clean_fp_rate, score): event scores of rows ``faults`` (key, t0, end), ``alarms`` (key, step) and
    the alarm-free keys ``clean`` (key). A fault's hit is its first alarm in [t0, end); early ones earn more. Faults explode into
    their steps, so alarms meet them by an equi-join."""
    steps = faults.select("key", "t0", "end", F.explode(F.sequence("t0", F.col("end") - 1)).alias("step"))
    hits = alarms.join(steps, ["key", "step"]).groupBy("key", "t0", "end").agg(F.min("step").alias("hit"))
    got = hits.agg(F.count("*").alias("h"), F.sum(early_credit(F.col("hit") - F.col("t0"), F.col("end") - F.col("t0"))).alias("credit"))
    n = faults.agg(F.count("*").alias("n"))
    quiet = clean.select("key").distinct()
    false = quiet.agg(F.count("*").alias("episodes")).join(F.broadcast(alarms.join(quiet, "key", "left_semi").agg(F.count("*").alias("alarms"))), F.lit(True))
    one = got.join(F.broadcast(n), F.lit(True)).join(F.broadcast(false), F.lit(True))  # one row each
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    one = one.select(share(F.col("h"), F.col("n")).alias("hit_rate"), share(F.col("credit"), F.col("h")).alias("mean_credit"), share(F.col("alarms"), F.col("episodes")).alias("clean_fp_rate"))
    rows = one.select("*", F.inline(F.array(*[F.struct(F.lit(p).alias("profile"), F.lit(a).alias("fn"), F.lit(b).alias("fp")) for p, (a, b) in profiles.items()])))
    score = (F.col("hit_rate") * F.col("mean_credit") * F.col("fn") - F.col("clean_fp_rate") * F.col("fp")) / F.col("fn")
    return rows.select("profile", "hit_rate", "mean_credit", "clean_fp_rate", F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)).alias("score"))


def covering_share(windows: DataFrame, faults: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, w0, share): the largest part of one fault (t0, t1) that a window (w0, w1) covers; no row if it touches none."""
    o = windows.join(faults.select(*keys, "t0", "t1"), list(keys)).withColumn("share", F.greatest(F.lit(0), F.least("w1", "t1") - F.greatest("w0", "t0")).cast("double") / (F.col("t1") - F.col("t0")))
    return o.groupBy(*keys, "w0").agg(F.max("share").alias("share"))


def delays(faults: DataFrame, alarms: DataFrame, key: str, by: str) -> DataFrame:
    """(by, med, p90, worst): from a fault's start t0 to its entity's first alarm (key, step) at or after it."""
    d = alarms.join(faults, key).filter("step >= t0").groupBy(key, by).agg((F.min("step") - F.min("t0")).alias("delay"))
    return d.groupBy(by).agg(F.percentile("delay", F.lit(0.5)).alias("med"), F.percentile("delay", F.lit(0.9)).alias("p90"), F.max("delay").alias("worst"))


def nearest_class(df: DataFrame, value: str, label: str) -> DataFrame:
    """``df`` with predicted: the class whose mean value is nearest, ties by name. The means, one row a class, are gathered into one row."""
    means = df.groupBy(label).agg(F.avg(value).alias("m")).agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("c"), "m"))).alias("__means"))
    near = F.array_min(F.transform("__means", lambda x: F.struct(F.abs(F.col(value) - x["m"]).alias("d"), x["c"].alias("c"))))
    return df.join(F.broadcast(means), F.lit(True)).withColumn("predicted", near["c"]).drop("__means")


def attribution(df: DataFrame, predicted: str, label: str, y: str) -> DataFrame:
    """One row (n, accuracy): how often the predicted class is the true one among positives."""
    p = df.filter(F.col(y) == 1)
    return p.agg(F.count("*").alias("n"), (F.count_if(F.col(predicted) == F.col(label)).cast("double") / F.count("*")).alias("accuracy"))
