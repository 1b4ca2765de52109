"""What a narrator shows: a line stays for a dwell unless a graver one comes. As a fold over stored series, and as state with timers over a stream."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gaugeline.operators.sequence import TELEMETRY, Series


def _shown(held: tuple[int, int] | None, at: int, priority: int, dwell: int) -> tuple[int, int]:
    """(priority, since) after a line of that priority at that time."""
    if held is None or priority > held[0] or at - held[1] >= dwell:
        return priority, at
    return held


def narrated(df: DataFrame, priority: Column, dwell: int, s: Series = TELEMETRY) -> DataFrame:
    """(keys, order, priority, shown): of each replay (keys) the priority of the line that is on show: it is replaced by a graver one at once, by any when it has been there for ``dwell``
    steps. Series are dealt out and sorted by Spark, and a task carries two numbers over its batches. A null priority is 0."""
    kinds = dict(df.dtypes)
    # the tasks get plain values, not this library
    columns, named, order = [*s.keys, s.order], list(s.keys), s.order
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in s.keys], f"`{s.order}` bigint, priority int, shown int"])

    def fold(batches: Iterator) -> Iterator:
        entity, held = None, None
        for batch in batches:
            keys = list(zip(*[batch[c] for c in named], strict=True))
            out = []
            for k, at, p in zip(keys, batch[order].tolist(), batch["priority"].tolist(), strict=True):
                held = _shown(held if k == entity else None, at, p, dwell)
                entity = k
                out.append(held[0])
            batch["shown"] = out
            yield batch[[*columns, "priority", "shown"]]

    rows = df.select(*s.keys, F.col(s.order).cast("long").alias(s.order), F.coalesce(priority, F.lit(0)).cast("int").alias("priority"))
    return rows.repartition(*s.keys).sortWithinPartitions(*columns).mapInPandas(fold, schema)


class Narrator(StatefulProcessor):
    """Keeps what is on show, and the rows that the watermark hasn't passed yet. A timer at each row's time takes it, in order of time, when no earlier one can come any more. So neither the
    order of arrival nor the split into batches changes what is shown, as long as rows are no later than the watermark allows."""

    def __init__(self, dwell: int):
        self.dwell = dwell

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.on_show = handle.getValueState("on_show", "priority int, since long")
        self.waiting = handle.getMapState("waiting", "at long", "step long, priority int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        for pdf in rows:
            for at, step, priority in zip(pdf["at"].tolist(), pdf["step"].tolist(), pdf["priority"].tolist(), strict=True):
                # an equal time again is the same row again
                if not self.waiting.containsKey((at,)):
                    self.waiting.updateValue((at,), (step, priority))
                    self.handle.registerTimer(at)
        return iter([pd.DataFrame({"replay": [], "step": [], "priority": [], "shown": []})])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        at = expiredTimerInfo.getExpiryTimeInMs()
        if not self.waiting.containsKey((at,)):
            return iter([])
        step, priority = self.waiting.getValue((at,))
        self.waiting.removeKey((at,))
        held = _shown(tuple(self.on_show.get()) if self.on_show.exists() else None, step, priority, self.dwell)
        self.on_show.update(held)
        return iter([pd.DataFrame({"replay": [key[0]], "step": [step], "priority": [priority], "shown": [held[0]]})])

    def close(self) -> None:
        pass


def narrated_stream(stream: DataFrame, dwell: int, late: str = "0 seconds") -> DataFrame:
    """(replay, step, priority, shown) of a stream (replay, ts, step, priority), once the watermark has passed a row. Times of a replay differ, and go up with its steps."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = stream.select("replay", "ts", F.col("step").cast("long").alias("step"), F.col("priority").cast("int").alias("priority")).withWatermark("ts", late)
    rows = rows.withColumn("at", F.unix_millis("ts"))
    return rows.groupBy("replay").transformWithStateInPandas(Narrator(dwell), "replay long, step long, priority int, shown int", "Append", "EventTime")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
