"""Structured Streaming over the event files: idempotent ingest, stateful detectors, windows.

State is kept by entity, so it is dealt out like the batch form and grows with the entities, not with the
rows. Every run is checkpointed in the shared folder and ends when what is there has been read.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.sources.storage import shared_folder


def events_stream(spark: SparkSession, folder: str, files_at_once: int = 1, glob: str = "events*.parquet") -> DataFrame:
    schema = spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_at_once).parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What the stream gives for all that is there now. In mode complete or update the last result of each
    batch is kept under its number, and the latest is returned."""
    spark = stream.sparkSession
    base = shared_folder(spark)
    w = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        w.outputMode("append").format("parquet").option("path", f"{base}/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")
    last = []

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out/{batch}")
        last.append(batch)

    w.outputMode(mode).foreachBatch(keep).start().awaitTermination()
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{base}/out/{max(last)}")
    return spark.read.schema(stream.schema).parquet(*[f"{base}/out/{b}" for b in sorted(set(last))])


def ingested(stream: DataFrame, keys: tuple[str, ...] = ("user_id", "event_id"), late: str = "30 days") -> DataFrame:
    """Each event once, however often and in whatever order it comes, within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def cusum_states(stream: DataFrame, p0: float = 1 / 402, p1: float = 0.25) -> DataFrame:
    """(user_id, n, fails, cusum) after each batch: the Bernoulli CUSUM as a one-step update of a user's state.
    A batch's events are taken in order of time; the same events in any batches give the batch form's value."""
    up, down = math.log(p1 / p0), math.log((1 - p1) / (1 - p0))

    def update(key: tuple, batches: Iterator, state) -> Iterator:
        import pandas as pd

        n, fails, low, c = state.get if state.exists else (0, 0, 0.0, 0.0)
        pdf = pd.concat(batches).sort_values(["ts", "event_id"])
        for failed in (pdf["event_type"] == "error").tolist():
            n, fails = n + 1, fails + failed
            c = fails * up + (n - fails) * down
            low = min(low, c)
        state.update((n, fails, low, c))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "fails": [fails], "cusum": [c - low]})

    rows = stream.select("user_id", "ts", "event_id", "event_type").groupBy("user_id")
    return rows.applyInPandasWithState(update, "user_id long, n long, fails long, cusum double", "n long, fails long, low double, c double", "update", "NoTimeout")


def windowed(stream: DataFrame, size: str = "10 days", late: str = "1 day") -> DataFrame:
    """Counts and values in tumbling windows by type; late rows beyond the watermark are left out."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")).select(F.col("window.start").alias("start"), "event_type", "n", "cents")


def sessions(stream: DataFrame, key: str = "user_id", gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """(key, start, end, n): runs of a key's events with less than ``gap`` between neighbours; a session ends ``gap`` after its last event. An extension: the telemetry itself has none."""
    w = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key)
    return w.agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
