"""Plant flow: shares, census, energy, pile-ups, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.operators.sequence import TELEMETRY, Series, islands

STATES = ("RUN", "STARVED", "BLOCKED", "DOWN")


def shares(df: DataFrame, by: tuple[str, ...], state: str = "state") -> DataFrame:
    """(by, n, <state> ...): the share of each state, for each group and, with null keys, overall: one rollup."""
    n = F.count("*")
    return df.rollup(*by).agg(n.alias("n"), *[(F.count_if(F.col(state) == s).cast("double") / n).alias(s.lower()) for s in STATES])


def current(running: Column, idle_ratio: float, amps: Column, load: Column) -> Column:
    """The current law: idle, and while running the load's share of what the rating leaves."""
    idle = amps * idle_ratio
    return F.greatest(F.lit(0.0), idle + F.when(running, load * (amps - idle)).otherwise(0.0))


def energy(amps: Column, volts: float = 400.0, seconds: float = 1.0) -> Column:
    """Watt-hours of a step of three-phase current."""
    return F.sqrt(F.lit(3.0)) * volts * F.greatest(F.lit(0.0), amps) * seconds / 3600


def pile_ups(df: DataFrame, full: Column, starved: Column, least: int, s: Series = TELEMETRY) -> DataFrame:
    """(keys, start, length) of the runs of at least ``least`` full rows in which something starves."""
    df = islands(df.withColumns({"__f": full, "__s": starved}), F.col("__f"), s, "__i").filter("__f")
    g = df.groupBy(*s.keys, "__i").agg(F.min(s.order).alias("start"), F.count("*").alias("length"), F.bool_or("__s").alias("any"))
    return g.filter((F.col("length") >= least) & F.col("any")).select(*s.keys, "start", "length")


def coverage_gaps(facts: DataFrame, grid: DataFrame) -> DataFrame:
    """The cells of the grid without a fact: an anti-join on the grid's columns."""
    return grid.join(facts.select(*grid.columns).distinct(), grid.columns, "left_anti")


def share_of(df: DataFrame, by: tuple, state: str = "state") -> DataFrame:
    """(by, n, <state> ...): the share of each state of each group."""
    n = F.count("*")
    return df.groupBy(*by).agg(n.alias("n"), *[(F.count_if(F.col(state) == s).cast("double") / n).alias(s.lower()) for s in STATES])


def starved_split(df: DataFrame, by: Column, feed: Column, kit: Column, state: str = "state") -> DataFrame:
    """(slot, feed, kit, cell, total): what starves each slot: its feed, else a kit's part, else the cell itself."""
    st = F.col(state) == "STARVED"
    return df.groupBy(by.alias("slot")).agg(F.count_if(st & feed).alias("feed"), F.count_if(st & ~feed & kit).alias("kit"), F.count_if(st & ~feed & ~kit).alias("cell"), F.count_if(st).alias("total"))


def funnel(parts: DataFrame, by: str, part: str, rejected: Column) -> DataFrame:
    """(by, sunk, scrapped, n): distinct parts that came through, those rejected, and all passes."""
    return parts.groupBy(by).agg(F.countDistinct(part).alias("sunk"), F.count_if(rejected).alias("scrapped"), F.count("*").alias("n"))


def funnel_summary(funnels: DataFrame) -> DataFrame:
    """One row (med, p10, p90, scrapped, sunk) over all funnels; the kits of one are its passes less what was scrapped."""
    q = lambda p: F.percentile(F.col("n") - F.col("scrapped"), F.lit(p))
    return funnels.agg(q(0.5).alias("med"), q(0.1).alias("p10"), q(0.9).alias("p90"), F.sum("scrapped").alias("scrapped"), F.sum("sunk").alias("sunk"))


def rated(machine: Column, kind: Column, amps: tuple, loads: tuple) -> tuple[Column, Column]:
    """The rated current by class and the load factor by the last fitting prefix of the name; null for neither."""
    a, k = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, value in amps:
        a = F.when(kind == name, F.lit(value)).otherwise(a)
    for prefix, value in loads:
        k = F.when(machine.startswith(prefix), F.lit(value)).otherwise(k)
    return a, k


def energy_by(df: DataFrame, by: str, running: Column, amps: Column, load: Column, idle_ratio: float = 0.15) -> DataFrame:
    """(by, wh, per_unit): energy of each entity, and by running step, null if it never runs."""
    g = df.groupBy(by).agg(F.sum(energy(current(running, idle_ratio, amps, load))).alias("wh"), F.count_if(running).alias("runs"))
    return g.select(by, "wh", F.try_divide(F.col("wh"), F.col("runs")).alias("per_unit"))


def stationarity(df: DataFrame, by: tuple[str, ...], hit: Column, step: str = "step", early: int = 15, late: int = 30) -> DataFrame:
    """(by, delta): the share of hits in steps [early, late) less that in [0, early); null without late steps."""
    second, first = F.col(step).between(early, late - 1), F.col(step) < early
    share = F.try_divide(F.count_if(second & hit).cast("double"), F.count_if(second)) - F.count_if(first & hit).cast("double") / early
    return df.groupBy(*by).agg(share.alias("delta"))


def fan_out(touched: DataFrame, by: Column, entity: str) -> DataFrame:
    """(grp, fan_out): how many distinct entities each group touches."""
    return touched.groupBy(by.alias("grp")).agg(F.countDistinct(entity).alias("fan_out"))


def coverage_cells(df: DataFrame, by: Column, kind: str) -> DataFrame:
    """(part, classes, n): the distinct kinds of each cell, joined in order. The kinds are few; rows are summed up first."""
    g = df.groupBy(by.alias("part"), kind).agg(F.count("*").alias("n")).groupBy("part").agg(F.array_sort(F.collect_set(kind)).alias("c"), F.sum("n").alias("n"))
    return g.select("part", F.array_join("c", ",").alias("classes"), "n")


def line_kpis(df: DataFrame, step: str = "step") -> DataFrame:
    """(step, tput, down, mean_obs) of all entities at each step, from integer cents."""
    return df.groupBy(step).agg(F.sum("tput").alias("tput"), F.count_if(F.col("state") == "DOWN").alias("down"), (F.sum("cents").cast("double") / F.count("*") / 100).alias("mean_obs"))


def episode_kpis(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, availability, disruption, output): the share not down, the percentage down or blocked, and what was made."""
    n = F.count("*")
    return df.groupBy(*by).agg((F.count_if(F.col("state") != "DOWN").cast("double") / n).alias("availability"), (100.0 * F.count_if(F.col("state").isin("DOWN", "BLOCKED")) / n).alias("disruption"), F.sum("tput").alias("output"))


def utilisation(df: DataFrame, by: str, member: str) -> DataFrame:
    """(by, util, members): the percentage of steps that run, and how many distinct members there are."""
    return df.groupBy(by).agg((100.0 * F.count_if(F.col("state") == "RUN") / F.count("*")).alias("util"), F.countDistinct(member).alias("members"))


def noise_floor(df: DataFrame, by: tuple[str, ...], cents: str = "cents") -> DataFrame:
    """(by, noise): the population deviation of each channel, from integer cents. Sums are of 38 digits: n times the squares of some million rows is beyond a long."""
    v = F.col(cents).cast("decimal(20,0)")
    n, x, xx = F.count("*").cast("decimal(20,0)"), F.sum(v), F.sum(v * v)
    return df.groupBy(*by).agg((F.sqrt((n * xx - x * x).cast("double")) / n / 100).alias("noise"))


def failure_rate(df: DataFrame, by: tuple[str, ...], failed: Column) -> DataFrame:
    """(by, fails, p0): failures and their Laplace rate on clean entities."""
    f = F.count_if(failed)
    return df.groupBy(*by).agg(f.alias("fails"), ((f + 1).cast("double") / (F.count("*") + 2)).alias("p0"))


def class_weights(df: DataFrame, by: str, label: str) -> DataFrame:
    """(by, label, n, weight): n of the group over its number of classes times n of the class."""
    from pyspark.sql import Window

    g = df.groupBy(by, label).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by)
    return g.withColumn("weight", F.sum("n").over(w).cast("double") / (F.count("*").over(w) * F.col("n")))


def buffer_use(levels: DataFrame, level: str = "n", cap: str = "cap", high: float = 0.8) -> DataFrame:
    """``levels`` with util, at most 1, high for the shared buffer at 80 % and more, and the width of its edge."""
    util = F.least(F.lit(1.0), F.col(level).cast("double") / F.col(cap))
    return levels.withColumns({"util": util, "high": (F.col("buffer") == "SBUF") & (F.col(level) >= high * F.col(cap)), "width": 1 + 3 * util})
