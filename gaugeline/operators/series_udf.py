"""Monte-Carlo runs and a plant generator: a row of its own seed is a run or an episode."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def run_lengths(spark: SparkSession, thresholds: tuple[float, ...], runs: int, p: float, p0: float, p1: float, most: int = 2000, seed: int = 11) -> DataFrame:
    """(h, mean_run): the average number of trials to the first CUSUM alarm, by seeded simulation; each run is
    a row of its own seed, so the split into tasks doesn't matter."""

    def simulate(batches: Iterator) -> Iterator:
        import math

        import numpy as np

        up, down = math.log(p1 / p0), math.log((1 - p1) / (1 - p0))
        for pdf in batches:
            out = []
            for run, h in zip(pdf["run"], pdf["h"], strict=True):
                step = np.where(np.random.default_rng([seed, run]).random(most) < p, up, down)
                c = np.cumsum(step)
                s = c - np.minimum(0, np.minimum.accumulate(c))
                hit = np.flatnonzero(s >= h)
                out.append(int(hit[0]) + 1 if len(hit) else most)
            yield pdf.assign(length=out)

    from pyspark.sql import functions as F

    asked = spark.range(runs).select(F.col("id").alias("run"), F.explode(F.array(*map(F.lit, thresholds))).alias("h"))
    return asked.mapInPandas(simulate, "run long, h double, length long").groupBy("h").agg(F.avg("length").alias("mean_run"))


def plant(spark: SparkSession, episodes: int, steps: int = 120, machines: int = 6, seed: int = 5, partitions: int = 8) -> DataFrame:
    """(episode_id, machine, step, obs, state, tput, level): a serial line with a buffer of 10 after each
    machine, failures and repairs. An episode is a task's row: made from its own seed, alike on every run.
    What a machine has put out less what its successor has taken is always its buffer's level."""

    def simulate(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for episode in pdf["id"]:
                rng = np.random.default_rng([seed, int(episode)])
                level, down = [0] * machines, [0] * machines
                rows = []
                for t in range(steps):
                    fails, noise = rng.random(machines), rng.normal(0, 1, machines)
                    for m in reversed(range(machines)):
                        down[m] = max(0, down[m] - 1) if down[m] else 3 + int(9 * fails[m] * 50) if fails[m] < 0.02 else 0
                        starved, blocked = m > 0 and not level[m - 1], m < machines - 1 and level[m] >= 10
                        state = "DOWN" if down[m] else "BLOCKED" if blocked else "STARVED" if starved else "RUN"
                        made = int(state == "RUN")
                        if made and m:
                            level[m - 1] -= 1
                        level[m] += made
                        rows.append((int(episode), f"M{m}", t, 50.0 + 5 * m + noise[m] - {"RUN": 0, "STARVED": 2, "BLOCKED": 1, "DOWN": 3}[state], state, made))
                    for k in range(machines):
                        rows[-1 - k] += (level[k],)
                yield pd.DataFrame(rows, columns=["episode_id", "machine", "step", "obs", "state", "tput", "level"])

    schema = "episode_id long, machine string, step long, obs double, state string, tput long, level long"
    return spark.range(0, episodes, 1, min(partitions, max(1, episodes))).mapInPandas(simulate, schema)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
