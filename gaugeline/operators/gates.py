"""Gates over named metrics, run logs and budgets, and the verdicts on hypotheses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Gate names with their exit codes, in order of evaluation.
CODES = {"F1": 10, "AC@1": 11, "flip": 12, "p99": 13, "wall": 14, "grounding": 15}
# Spellings of metric names.
F1_NAMES = ("f1", "f_1", "f1_score", "f_score", "f1_macro", "f1_micro")
P99_NAMES = ("p99", "p99_latency", "latency_p99", "p99_s", "p99_sec", "p99_ms")
WALL_NAMES = ("wall", "wall_s", "wall_time", "wall_total_s", "wall_sec", "wall_seconds", "elapsed", "runtime")
GROUND_NAMES = ("grounding", "ground", "grounding_rate", "ground_rate", "grounding_score")


@dataclass(frozen=True)
class Limits:
    f1: float = 0.85
    ac1: float = 0.70
    flip: float = 0.40
    p99: float = 3.0
    wall: float = 600.0
    grounding: float = 0.95


def classified(name: Column) -> Column:
    """struct(gate, part) of a metric's name in any of its spellings; null for an unknown one."""
    given = F.trim(name)
    plain = F.translate(F.lower(given), "@- ", "1__")
    is_ac1 = plain.contains("ac1") | plain.contains("ac_1") | plain.contains("accuracy_1") | plain.contains("accuracy1")
    side = F.when(plain.contains("intra"), "intra").when(plain.contains("cross"), "cross").otherwise("overall")
    rest = F.regexp_replace(F.substring(given, F.lit(5), F.length(given)), r"^[ _()-]+|[ _()-]+$", "")
    none = F.lit(None).cast("string")
    of = lambda gate, part=none: F.struct(F.lit(gate).alias("gate"), part.alias("part"))
    return (
        F.when(plain.isin(*F1_NAMES) | plain.startswith("f1_"), of("F1"))
        .when(is_ac1, of("AC@1", side))
        .when(plain.startswith("flip"), of("flip", F.when(rest == "", "overall").otherwise(rest)))
        .when(plain.isin(*P99_NAMES), of("p99"))
        .when(plain.isin(*WALL_NAMES), of("wall"))
        .when(plain.isin(*GROUND_NAMES) | plain.startswith("grounding_") | plain.startswith("ground_"), of("grounding"))
    )


def evaluated(metrics: DataFrame, limits: Limits = Limits(), name: str = "metric", value: str = "value") -> DataFrame:
    """(gate, part, worst, ok, code) for every gate and part of the rows (name, value): the worst value against its limit, code
    0 if it holds. A gate without values fails with a null; the overall AC@1 stands for a side that isn't there."""
    m = metrics.select(classified(F.col(name)).alias("x"), F.col(value).cast("double").alias("v")).filter("x is not null").groupBy("x.gate", "x.part").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    least, most = F.col("lo"), F.col("hi")
    worst = F.when(F.col("gate").isin("F1", "AC@1", "grounding"), least).otherwise(most)
    ok = (
        F.when(F.col("gate") == "F1", least >= limits.f1).when(F.col("gate") == "AC@1", least >= limits.ac1).when(F.col("gate") == "grounding", least >= limits.grounding)
        .when(F.col("gate") == "flip", most < limits.flip).when(F.col("gate") == "p99", most <= limits.p99).otherwise(most < limits.wall)
    )
    had = m.select("gate", "part", worst.alias("worst"), ok.alias("ok"))
    needed = metrics.sparkSession.createDataFrame([(g, None) for g in CODES if g != "AC@1"] + [("AC@1", "intra"), ("AC@1", "cross")], "gate string, part string")
    has = had.select("gate", F.coalesce("part", F.lit("")).alias("p")).distinct()
    overall = has.filter("gate = 'AC@1' and p = 'overall'").select(F.lit("AC@1").alias("gate"), F.explode(F.array(F.lit("intra"), F.lit("cross"))).alias("p"))
    flips = has.filter("gate = 'flip'").select("gate", F.lit("").alias("p"))
    missing = needed.withColumn("p", F.coalesce("part", F.lit(""))).join(has.unionByName(overall).unionByName(flips), ["gate", "p"], "left_anti")
    # the overall AC@1 is asked only where the intra side isn't given
    sides = had.join(F.broadcast(has.filter("gate = 'AC@1' and p = 'intra'").select("gate").distinct().withColumn("part", F.lit("overall"))), ["gate", "part"], "left_anti")
    rows = sides.unionByName(missing.select("gate", "part", F.lit(None).cast("double").alias("worst"), F.lit(False).alias("ok")))
    code = F.element_at(F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv]), F.col("gate"))
    return rows.withColumn("code", F.when(F.col("ok"), 0).otherwise(code))


def exit_code(gates: DataFrame) -> DataFrame:
    """One row (code): that of the first failed gate, else 0."""
    return gates.agg(F.coalesce(F.min(F.when(~F.col("ok"), F.col("code"))), F.lit(0)).alias("code"))


def run_log_failures(runs: DataFrame, budget: float = 60.0, factor: float = 1.02, most_mb: float = 4096.0) -> DataFrame:
    """(run_id, job_name, category) of what is wrong with each run (run_id, job_name, status, wall_seconds, peak_rss_mb)."""
    wall, rss = F.col("wall_seconds"), F.col("peak_rss_mb")
    bad = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("status") == "success", F.lit(False)), "status"),
            F.when(~F.coalesce((wall > 0) & (wall <= budget * factor), F.lit(False)), "wall"),
            F.when(wall.isNotNull() & ~F.coalesce((rss > 0) & (rss <= most_mb), F.lit(False)), "rss"),
        )
    )
    return runs.select("run_id", "job_name", F.explode(bad).alias("category"))


def over_budget(walls: DataFrame, wall: str = "wall", factor: float = 1.02) -> DataFrame:
    """The rows whose wall time is over ``factor`` times the mean of all, which is one row."""
    mean = walls.agg((F.sum(wall) / F.count(wall)).alias("__mean"))
    return walls.join(F.broadcast(mean), F.col(wall) > F.col("__mean") * factor).drop("__mean")


def adjudicated(wires: DataFrame) -> DataFrame:
    """``wires`` (id, metric, bar, higher_is_better) with status: Survived if the metric meets its bar in its direction."""
    better = F.coalesce(F.col("higher_is_better"), F.lit(True))
    ok = F.when(better, F.col("metric") >= F.col("bar")).otherwise(F.col("metric") <= F.col("bar"))
    return wires.withColumn("status", F.when(ok, "Survived").otherwise("Falsified"))
