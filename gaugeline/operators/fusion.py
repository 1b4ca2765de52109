"""Fusing the scores and decisions of several experts: reliabilities, votes, soft fusion, counters as confirmation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.operators import calibrate as cal
from gaugeline.operators import metrics as me
from gaugeline.operators import ranked
from gaugeline.operators.sequence import TELEMETRY, Series
from gaugeline.sources.storage import written

# The counter that confirms a structural family, and its least value.
CONFIRMING = {"delay": ("cycle_lag", 5), "loss": ("stale_run", 1), "breakdown": ("down_run", 1)}
#: Rows at which a family's own estimate weighs as much as the global one.
SHRINKAGE = 20


def laplace(hits: Column, n: Column) -> Column:
    return (hits + 1.0) / (n + 2)


def shrunk(own: Column, whole: Column, n: Column, c: int = SHRINKAGE) -> Column:
    return n / (n + F.lit(float(c))) * own + F.lit(float(c)) / (n + F.lit(float(c))) * whole


def vote_weights(detected: Column, false_alarm: Column) -> tuple[Column, Column]:
    """The log odds of a vote for and of one against."""
    return F.log(detected / false_alarm), F.log((1 - detected) / (1 - false_alarm))


def weighted_vote(votes: list[tuple[Column, float, float]], threshold: float) -> Column:
    return sum(F.when(v, float(for_)).otherwise(float(against)) for v, for_, against in votes) > threshold


def at_least(votes: list[Column], k: int) -> Column:
    return sum(v.cast("int") for v in votes) >= k


def quantile_arm(clean: DataFrame, score: str, fpr: float = 0.01) -> DataFrame:
    """One row (tau): the upper quantile of clean scores."""
    return ranked.exact_quantiles(clean, [score], [1 - fpr]).select(F.get(score, F.lit(0)).alias("tau"))


def three_arms(clean: DataFrame, score: str, fpr: float = 0.01) -> DataFrame:
    """One row (tau): the vote of the quantile, the mixture and the tail arm on clean scores. The tail's level counts from the 95 %
    quantile on; where its fit doesn't hold, the quantile stands for it."""
    from gaugeline.operators.mixture import mixture_threshold

    q, u = ranked.exact_quantiles(clean, [score], [1 - fpr, 0.95]).first()[0] or (0.0, 0.0)
    tail = clean.select((F.round((F.col(score) - u) * 1e6)).cast("long").alias("e")).filter("e > 0")
    n, m, v, top = tail.agg(F.count("*"), F.avg("e"), F.var_samp("e"), F.max("e")).first()
    pot = q
    if n >= 20 and v:
        xi = 0.5 * (1 - m * m / v)
        if xi < 0.45 and not (xi < 0 and -m * (1 - xi) / xi < top):
            xi = max(-0.5, xi)
            ratio = 1e-3 / 0.03
            pot = (m * (1 - xi) / xi * (ratio**-xi - 1) if abs(xi) > 1e-6 else m * 3.4012) / 1e6
    mixture, _ = mixture_threshold(clean, score, fpr)
    return clean.sparkSession.range(1).select(cal.stability_vote(F.lit(float(q)), F.lit(float(mixture)), F.lit(float(pot))).alias("tau"))


def soft(df: DataFrame, experts: list[str], y: str = "y", episode: str = "ep", family: str = "fam", clean: str = "clean", protected: tuple[str, ...] = (), floor: float = 0.7, arm: Callable[[DataFrame, str], DataFrame] = quantile_arm) -> DataFrame:
    """``df`` with fused_score and fused: the experts' scores, normalised by median and interquartile range within episodes,
    weighted by each family's informedness shrunk to the global one, and decided at a recall floor for each family.

    A family whose decisions don't beat flagging everything by two points of F1 abstains; protected families are always
    flagged. Scores that aren't finite count as 0. Families and episodes are summed up before they meet; the tables of
    weights have one row a family."""
    iqr = lambda q: F.greatest(F.get(q, F.lit(2)) - F.get(q, F.lit(0)), F.lit(1e-9))
    three = lambda c: F.percentile(c, F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    per = df.groupBy(episode).agg(*[three(c).alias(f"__q_{c}") for c in experts])
    rows = df.join(per, episode)
    for c in experts:
        x = F.col(c).cast("double")
        finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
        rows = rows.withColumn(f"__s_{c}", F.when(finite, (x - F.get(f"__q_{c}", F.lit(1))) / iqr(F.col(f"__q_{c}"))).otherwise(0.0)).drop(f"__q_{c}")
    # each part below reads the rows several times, so they are tables of their own
    rows = written(rows)
    quiet = rows.filter(clean)
    whole = F.lit(True)
    mids = ranked.exact_quantiles(quiet, [f"__s_{c}" for c in experts], [0.25, 0.5, 0.75])
    mids = mids.select(*[x for c in experts for x in (F.get(f"__s_{c}", F.lit(1)).alias(f"__m_{c}"), (F.get(f"__s_{c}", F.lit(2)) - F.get(f"__s_{c}", F.lit(0))).alias(f"__i_{c}"))])
    rows = rows.join(F.broadcast(mids), whole)  # one row
    for c in experts:
        tau = arm(quiet, f"__s_{c}").select(F.col("tau").alias(f"__t_{c}"))
        rows = rows.join(F.broadcast(tau), whole)  # one row
        rows = rows.withColumn(f"__d_{c}", F.col(f"__s_{c}") > F.col(f"__t_{c}"))
        width = F.when(F.col(f"__i_{c}") == 0, 1.0).otherwise(F.col(f"__i_{c}"))
        rows = rows.withColumn(f"__z_{c}", (F.col(f"__s_{c}") - F.col(f"__m_{c}")) / (width + 1e-9)).drop(f"__t_{c}", f"__m_{c}", f"__i_{c}")
    rows = written(rows)
    hit = F.col(y) == 1
    sums = [F.count_if(hit).alias("p"), F.count_if(~hit).alias("n")]
    for c in experts:
        sums += [F.count_if(hit & F.col(f"__d_{c}")).alias(f"tp_{c}"), F.count_if(~hit & F.col(f"__d_{c}")).alias(f"fp_{c}")]
    fams = rows.groupBy(family).agg(*sums)
    total = fams.agg(*[F.sum(x).alias(f"all_{x}") for x in fams.columns if x != family])
    fams = fams.join(F.broadcast(total), whole)
    informed = lambda a, c: laplace(F.col(f"{a}tp_{c}"), F.col(f"{a}p")) - laplace(F.col(f"{a}fp_{c}"), F.col(f"{a}n"))
    weights = [F.greatest(F.lit(0.0), shrunk(informed("", c), informed("all_", c), F.col("p") + F.col("n"))).alias(f"__w_{c}") for c in experts]
    rows = rows.join(fams.select(family, *weights), family)
    rows = rows.withColumn("fused_score", sum(F.col(f"__w_{c}") * F.col(f"__z_{c}") for c in experts))
    rows = written(rows.select(*df.columns, "fused_score"))
    rows = rows.join(cal.recall_floor(rows, floor, (family,), "fused_score", y), family)
    rows = rows.withColumn("__dec", F.col("fused_score") >= F.col("thr"))
    c = me.counts(F.col("__dec"), hit)
    rate = F.count_if(hit) / F.count("*")
    ok = rows.groupBy(family).agg((me.f1(c["tp"], c["fp"], c["fn"]) >= F.when(rate > 0, 2 * rate / (1 + rate)).otherwise(0.0) + 0.02).alias("__ok"))
    rows = rows.join(ok, family)
    always = F.col(family).isin(*protected) if protected else F.lit(False)
    return rows.withColumn("fused", always | (F.col("__dec") & F.col("__ok"))).select(*df.columns, "fused_score", "fused")


def hybrid_gate(windows: DataFrame, series: DataFrame, width: int, family: str = "family", dec: str = "dec", s: Series = TELEMETRY, confirming: dict[str, tuple[str, int]] = CONFIRMING) -> DataFrame:
    """``windows`` (keys, start, family, dec) with kept: a structural family's decision needs its counter, a column of ``series``, to reach its least
    value inside [start, start + width); others pass. Each counter's rows are looked up by the windows' steps, not by pairs."""
    steps = windows.filter(F.col(family).isin(*confirming)).select(*s.keys, "start", F.explode(F.sequence(F.col("start"), F.col("start") + width - 1)).alias(s.order))
    reached = series.groupBy(*s.keys, s.order).agg(*[F.max(c).alias(c) for c in {c for c, _ in confirming.values()}])
    seen = steps.join(reached, [*s.keys, s.order]).groupBy(*s.keys, "start").agg(*[F.max(F.col(c) >= least).alias(f"__{f}") for f, (c, least) in confirming.items()])
    out = windows.join(seen, [*s.keys, "start"], "left")
    held = F.lit(True)
    for f in confirming:
        held = F.when(F.col(family) == f, F.coalesce(F.col(f"__{f}"), F.lit(False))).otherwise(held)
    return out.withColumn("kept", F.col(dec) & held).drop(*[f"__{f}" for f in confirming])
