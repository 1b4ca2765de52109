"""Checks of rosters, budgets, contracts and sets, each one aggregate or one join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.operators import labels


def gaps_below(faults: DataFrame, by: Column, least: int, key: str = "machine") -> DataFrame:
    """(key, class, gap) of the faults that begin less than ``least`` steps after the one before ended, in their group."""
    w = Window.partitionBy(by).orderBy("t0", key)
    return faults.select(key, "class", (F.col("t0") - F.lag("t1").over(w)).alias("gap")).filter(F.col("gap") < least)


def roster(df: DataFrame, what: str, name: str, bad: Column) -> DataFrame:
    """One row (what, n, repeats, bad): the size of a roster, repeated names, and broken rows."""
    return df.agg(F.lit(what).alias("what"), F.count("*").alias("n"), (F.count("*") - F.countDistinct(name)).alias("repeats"), F.count_if(bad).alias("bad"))


def rate_budget(faults: DataFrame, by: Column, budget: float) -> DataFrame:
    """(ep, steps, total, ok): the union of fault steps of each group against a budget; total counts overlaps twice."""
    s = labels.exploded(faults.select(by.alias("ep"), "t0", "t1"), out="t")
    n = F.countDistinct("t")
    return s.groupBy("ep").agg(n.alias("steps"), F.count("*").alias("total"), (n <= budget).alias("ok"))


def tick_contract(ticks: DataFrame, states: tuple[str, ...]) -> DataFrame:
    """One row (n, states, bad_state, bad_obs, bad_step)."""
    return ticks.agg(F.count("*").alias("n"), F.countDistinct("state").alias("states"), F.count_if(~F.col("state").isin(*states)).alias("bad_state"), F.count_if(F.col("obs").isNull() | (F.col("obs") < 0)).alias("bad_obs"), F.count_if(F.col("step") < 0).alias("bad_step"))


def positive_rate(ticks: DataFrame, faults: DataFrame, by: Column, most: float, key: str = "machine") -> DataFrame:
    """(grp, rate, ok): the share of ticks inside a fault."""
    y = labels.active(ticks, faults, (key,))
    rate = F.sum("y").cast("double") / F.count("*")
    return y.groupBy(by.alias("grp")).agg(rate.alias("rate"), (rate <= most).alias("ok"))


def shared(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (shared): how many distinct rows two tables have in common; 0 if they are disjoint."""
    return a.intersect(b).agg(F.count("*").alias("shared"))


def evidence_floor(df: DataFrame, by: Column, entity: str, least: int = 800, most: int = 10) -> DataFrame:
    """(part, rows_, nodes, enough, small): whether a partition has enough rows and few enough entities."""
    n, k = F.count("*"), F.countDistinct(entity)
    return df.groupBy(by.alias("part")).agg(n.alias("rows_"), k.alias("nodes"), (n >= least).alias("enough"), (k <= most).alias("small"))


def event_keys(events: DataFrame, kinds: tuple[str, ...], prop: str) -> DataFrame:
    """One row (no_key, unknown, negative, no_prop) of what events lack."""
    return events.agg(F.count_if(F.col("event_type").isNull() | F.col("user_id").isNull()).alias("no_key"), F.count_if(~F.col("event_type").isin(*kinds)).alias("unknown"), F.count_if(F.col("value") < 0).alias("negative"), F.count_if(F.get_json_object("props", prop).isNull()).alias("no_prop"))


def symmetric_difference(a: DataFrame, b: DataFrame, key: str = "k") -> DataFrame:
    """(side, key): the keys of ``a`` that ``b`` lacks are missing, those of ``b`` that ``a`` lacks extra."""
    one = lambda x, y, side: x.select(key).distinct().join(y.select(key), key, "left_anti").select(F.lit(side).alias("side"), key)
    return one(a, b, "missing").unionByName(one(b, a, "extra"))


def edge_flips(edges: DataFrame, group: str = "g", edge: str = "e") -> DataFrame:
    """(ga, gb, flip): of each two groups that share an edge, the share of their edges on which they differ. Groups are few; an edge's
    groups, not its rows, are paired."""
    s = edges.select(group, edge).distinct()
    n = s.groupBy(group).agg(F.count("*").alias("n"))
    p = s.select(F.col(group).alias("ga"), edge).join(s.select(F.col(group).alias("gb"), edge), edge).filter("ga < gb").groupBy("ga", "gb").agg(F.count("*").alias("common"))
    p = p.join(n.select(F.col(group).alias("ga"), F.col("n").alias("x")), "ga").join(n.select(F.col(group).alias("gb"), F.col("n").alias("y")), "gb")
    return p.select("ga", "gb", (1 - F.col("common").cast("double") / (F.col("x") + F.col("y") - F.col("common"))).alias("flip"))


def ordered_distinct(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, values): the distinct values of each key in the order in which they first occur. They are few; rows are summed up first."""
    f = df.groupBy(key, value).agg(F.min(order).alias("__p")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__p", value))).alias("s"))
    return f.select(key, F.transform("s", lambda x: x[value]).alias("values"))


def unlisted(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """The distinct values that aren't allowed."""
    return df.select(column).filter(~F.col(column).isin(*allowed)).distinct()


def protected_rows(df: DataFrame, column: str, of: Column) -> DataFrame:
    """The rows whose value occurs among the rows where ``of`` holds."""
    return df.join(df.filter(of).select(column).distinct(), column, "left_semi")
