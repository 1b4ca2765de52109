"""Frames of a replay: ticks as JSON, server-sent events, what a narrator says first, what a full frame drops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ticks(cells: DataFrame, value: str = "n", channel: str = "channel", step: str = "step") -> DataFrame:
    """(step, tick): one JSON object a step, channels in order. Channels are few."""
    g = cells.groupBy(step).agg(F.transform(F.array_sort(F.collect_list(F.struct(channel, value))), lambda x: x[value]).alias(value))
    return g.select(step, F.to_json(F.struct(step, value)).alias("tick"))


def ordered_ticks(cells: DataFrame, values: dict[str, str], keys: tuple[str, ...], order: str, step: str = "step") -> DataFrame:
    """(keys, step, tick): one JSON object a step of each key, with an array of each of ``values`` {name: column} in the order of the machines' index ``order``, whatever order they come in."""
    g = cells.groupBy(*keys, step).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), *[F.col(c).alias(n) for n, c in values.items()]))).alias("x"))
    of = lambda n: F.transform("x", lambda r: r[n]).alias(n)
    return g.select(*keys, step, F.to_json(F.struct(step, *map(of, values))).alias("tick"))


def server_events(rows: DataFrame, event: str, data: Column) -> DataFrame:
    """``rows`` with frame: an event's name and data as a stream sends them."""
    return rows.withColumn("frame", F.concat(F.lit(f"event: {event}\ndata: "), data, F.lit("\n\n")))


def priorities(cells: DataFrame, rules: list[tuple[Column, int]], keys: tuple[str, ...] = (), step: str = "step") -> DataFrame:
    """(keys, step, priority): the first rule that holds over a step's cells, else 1."""
    out = F.lit(1)
    for holds, priority in reversed(rules):
        out = F.when(holds, priority).otherwise(out)
    return cells.groupBy(*keys, step).agg(out.alias("priority"))


def completeness(frames: DataFrame, total: int, budget: int, keys: tuple[str, ...] = ("machine",), step: str = "step", data: str = "tick") -> DataFrame:
    """(keys, rows, last, resume, bytes, complete, budget_ok) of the frames received of each replay, in any order and however often: how many different steps, the last one, the first one that is missing
    (where to resume; ``total`` if none is), and all bytes received against a budget."""
    # steps are numbered from 0, so the first that isn't its own number among them is behind a gap
    by_step = frames.groupBy(*keys, step).agg(F.sum(F.octet_length(data)).alias("__bytes"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(step)) - 1
    by_step = by_step.withColumn("__gap", F.when(F.col(step) != place, place))
    g = by_step.groupBy(*keys).agg(F.count("*").alias("rows"), F.max(step).alias("last"), F.coalesce(F.min("__gap"), F.count("*")).cast("long").alias("resume"), F.sum("__bytes").alias("bytes"))
    return g.withColumns({"complete": F.col("rows") == total, "budget_ok": F.col("bytes") <= budget})


def dropped(cells: DataFrame, batch: Column, budget: int, n: str = "n") -> DataFrame:
    """(batch, n, dropped): what a frame gets, and what is over its budget."""
    total = F.sum(n)
    return cells.groupBy(batch.alias("batch")).agg(total.alias("n"), F.greatest(F.lit(0), total - budget).alias("dropped"))
