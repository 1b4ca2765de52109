"""Detection: exceedance, structural gates, outliers, kit outcomes, the entity to blame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.operators.sequence import TELEMETRY, Series, repeats


def exceedance(df: DataFrame, fit: DataFrame, suppress: Column, keys: tuple[str, ...] = ("machine",), value: str = "obs") -> DataFrame:
    """Adds score = max(x - thr, thr_low - x) and alarm = score > 0. Suppression clears the alarm, not the score."""
    df = df.join(fit.select(*keys, "thr", "thr_low"), list(keys))
    df = df.withColumn("score", F.greatest(F.col(value) - F.col("thr"), F.col("thr_low") - F.col(value)))
    return df.withColumn("alarm", (F.col("score") > 0) & ~suppress)


def structural_gates(lag: Column, stale: Column, down: Column, running: Column) -> dict[str, Column]:
    # The least counts of each gate.
    return {"delay": (lag >= 10) & running, "loss": stale >= 6, "combo": (lag >= 5) & (stale >= 1), "breakdown": down >= 3}


def kit_outcomes(df: DataFrame) -> DataFrame:
    """The pass or fail stream of rows (part, line, t, flag): a DEGRADE that follows the part's own REJECT is
    its routing and drops out."""
    w = Window.partitionBy("part").orderBy("t", "line", "machine", "flag")
    df = df.withColumn("before", F.lag("flag").over(w))
    return df.filter(~((F.col("flag") == "DEGRADE") & F.coalesce(F.col("before") == "REJECT", F.lit(False)))).withColumn("passed", F.col("flag") != "REJECT").drop("before")


def blamed(peaks: DataFrame, group: tuple[str, ...], entity: str, noisy: Column, factor: float = 2.0) -> DataFrame:
    """(group, entity, peak): the greatest peak, ties by entity; a noisy entity needs ``factor`` times the
    runner-up's, if that is positive, else the runner-up is blamed."""
    w = Window.partitionBy(*group).orderBy(F.col("peak").desc(), entity)
    top = peaks.withColumn("noisy", noisy).withColumn("rk", F.row_number().over(w)).filter("rk <= 2")
    g = top.groupBy(*group).agg(*[F.max(F.when(F.col("rk") == k, F.struct(entity, "peak", "noisy"))).alias(f"r{k}") for k in (1, 2)])
    veto = F.col("r1.noisy") & (F.col("r2.peak") > 0) & (F.col("r1.peak") < factor * F.col("r2.peak"))
    chosen = F.when(F.coalesce(veto, F.lit(False)), F.col("r2")).otherwise(F.col("r1"))
    return g.select(*group, chosen[entity].alias(entity), chosen["peak"].alias("peak"))


def sensor_health(df: DataFrame, value: str, s: Series = TELEMETRY) -> DataFrame:
    """(order, stale, health): at each step the longest run of a repeated value among all entities, DROPOUT from 6 on, SUSPECT from 3."""
    stale = repeats(df, value, s).groupBy(s.order).agg(F.max("stale").alias("stale"))
    return stale.withColumn("health", F.when(F.col("stale") >= 6, "DROPOUT").when(F.col("stale") >= 3, "SUSPECT").otherwise("OK"))


# The tail machines, and the classes that never divert.
TAILS = ("A9", "B9", "C7", "PKG1", "PKG2")
NEVER_DIVERT = ("feed", "form")


def tail_path(asked: DataFrame, roster: DataFrame) -> DataFrame:
    """(machine, path) of each machine asked for: AGV for a tail, never-diverts or SBUF-eligible by class, unknown outside the roster."""
    m = asked.select("machine").join(roster.select("machine", "class"), "machine", "left")
    path = F.when(F.col("machine").isin(*TAILS), "AGV").when(F.col("class").isNull(), "unknown").when(F.col("class").isin(*NEVER_DIVERT), "never-diverts").otherwise("SBUF-eligible")
    return m.select("machine", path.alias("path"))


def tail_order(tails: DataFrame, group: tuple[str, ...], kit: Column, waiting: Column, rework: Column, name: str) -> DataFrame:
    """``tails`` with place: the smallest kit first, a reworked one ten ahead, then the longest queue, then by name."""
    w = Window.partitionBy(*group).orderBy(kit + F.when(rework, -10).otherwise(0), -waiting, name)
    return tails.withColumn("place", F.row_number().over(w).cast("long"))
