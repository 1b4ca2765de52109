"""What is shown, folded and streamed in any batches, with a restart in between."""

import random

import pytest
from pyspark.sql import functions as F

from gaugeline.streaming import narration


def plain(priorities, dwell):
    out, q, since = [], None, None
    for t, p in priorities:
        if q is None or p > q or t - since >= dwell:
            q, since = p, t
        out.append(q)
    return out


@pytest.mark.parametrize("dwell", [0, 1, 3, 10])
def test_fold(spark, dwell):
    rnd = random.Random(dwell)
    rows = [(m, t, rnd.choice([1, 1, 1, 2, 3, 4, 5, None])) for m in range(5) for t in sorted(rnd.sample(range(200), 80))]
    df = spark.createDataFrame(rows, "machine long, step long, p int").repartition(5)
    got = {(r.machine, r.step): r.shown for r in narration.narrated(df, F.col("p"), dwell).collect()}
    for m in range(5):
        mine = [(t, p or 0) for k, t, p in rows if k == m]
        assert [got[m, t] for t, _ in mine] == plain(mine, dwell)


def streamed(spark, base, parts, restart):
    """What a stream of files gives, drained once after each ``restart`` parts; a last row far ahead lets the watermark pass the others."""
    schema = "replay long, ts timestamp, step long, priority int"
    out = f"{base}/out"
    for k, part in enumerate(parts):
        df = spark.createDataFrame(part, "replay long, step long, priority int")
        df.select("replay", F.timestamp_seconds(F.col("step") + 1000).alias("ts"), "step", "priority").coalesce(1).write.mode("append").parquet(f"{base}/in")
        if (k + 1) % restart == 0 or k + 1 == len(parts):
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
            q = narration.narrated_stream(stream, 3, "20 seconds").writeStream.option("checkpointLocation", f"{base}/state").format("parquet").option("path", out)
            q.trigger(availableNow=True).start().awaitTermination()
    return sorted((r.replay, r.step, r.shown) for r in spark.read.parquet(out).collect())


def test_any_batches_and_a_restart_give_the_same(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(m, t, rnd.choice([1, 1, 2, 3, 5])) for t in range(60) for m in (1, 2)]
    want = sorted((m, t, q) for m in (1, 2) for (t, _), q in zip([(t, p) for k, t, p in rows if k == m], plain([(t, p) for k, t, p in rows if k == m], 3)))
    end = [(9, 100_000, 1)]
    # neighbours within the watermark in another order, and a row twice
    mixed = sorted(rows, key=lambda r: r[1] + rnd.randint(0, 15))
    for name, parts, restart in (("a", [rows, end], 99), ("b", [*[mixed[i : i + 40] for i in range(0, 120, 40)], [mixed[-1]], end], 2)):
        got = streamed(spark, tmp_path / name, parts, restart)
        assert [r for r in got if r[0] != 9] == want
