"""Queries of the sequence operators."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeline.operators import scan
from gaugeline.operators import sequence as sq
from gaugeline.plans.base import query
from gaugeline.sources.adapters import GRID, TEL, grid, telemetry

S = sq.TELEMETRY
OVER = "OVER (PARTITION BY machine ORDER BY step"
ROWS = OVER + " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
C = sq.Series(keys=("channel",))


def _islands(value: str, name: str = "isl", source: str = "tel") -> str:
    return f"""{name}0 AS (SELECT *, CASE WHEN lag({value}) {OVER}) IS NOT DISTINCT FROM {value} AND row_number() {OVER}) > 1 THEN 0 ELSE 1 END AS nw FROM {source}),
 {name} AS (SELECT *, sum(nw) {ROWS} AS island FROM {name}0)"""


@query(f"WITH {TEL}, {_islands('state')} SELECT machine, step, state, row_number() OVER (PARTITION BY machine, island ORDER BY step) AS dwell FROM isl")
def win_dwell(spark, sf):
    return sq.run_length(telemetry(spark, sf), F.col("state")).select("machine", "step", "state", "dwell")


@query(f"""WITH {TEL}, x AS (SELECT *, (state = 'DOWN') AS d FROM tel), {_islands('d', source='x')}
SELECT machine, step, CASE WHEN d THEN row_number() OVER (PARTITION BY machine, island ORDER BY step) ELSE 0 END AS downrun FROM isl""")
def win_downrun(spark, sf):
    return sq.run_while(telemetry(spark, sf), F.col("state") == "DOWN").select("machine", "step", "downrun")


@query(f"""WITH {TEL}, x AS (SELECT *, sum(tput) {ROWS} AS gt FROM tel)
SELECT machine, step, row_number() OVER (PARTITION BY machine, gt ORDER BY step) - CASE WHEN gt = 0 THEN 0 ELSE 1 END AS tputlag FROM x""")
def win_tputlag(spark, sf):
    return sq.since(telemetry(spark, sf), F.col("tput") > 0).select("machine", "step", "tputlag")


@query(f"""WITH {TEL}, x AS (SELECT *, cents // 10000 AS v FROM tel), {_islands('v', source='x')}
SELECT machine, step, row_number() OVER (PARTITION BY machine, island ORDER BY step) - 1 AS stale FROM isl""")
def win_stale(spark, sf):
    t = telemetry(spark, sf).withColumn("v", F.expr("cents div 10000"))
    return sq.repeats(t, "v").select("machine", "step", "stale")


@query(f"WITH {TEL} SELECT machine, step, CAST(sum(CASE WHEN state = 'DOWN' THEN 1 ELSE 0 END) {OVER} ROWS 14 PRECEDING) AS BIGINT) AS down_15, CAST(sum(CASE WHEN state = 'STARVED' THEN 1 ELSE 0 END) {OVER} ROWS 9 PRECEDING) AS BIGINT) AS starved_10 FROM tel")
def win_trailing_counts(spark, sf):
    n = lambda state, k: F.sum((F.col("state") == state).cast("long")).over(S.last(k))
    return telemetry(spark, sf).select("machine", "step", n("DOWN", 15).alias("down_15"), n("STARVED", 10).alias("starved_10"))


@query(f"WITH {TEL} SELECT machine, step, max(cents) {ROWS} AS max_cents, CAST(sum(CASE WHEN state = 'DOWN' THEN 1 ELSE 0 END) {ROWS} AS BIGINT) AS downs FROM tel")
def win_running(spark, sf):
    w = S.upto()
    return telemetry(spark, sf).select("machine", "step", F.max("cents").over(w).alias("max_cents"), F.sum((F.col("state") == "DOWN").cast("long")).over(w).alias("downs"))


def _recursive(state: str, first: str, columns: str) -> str:
    """A true recurrence, row by row, for the SQL of operators that have blocks or closed forms."""
    return f"""WITH RECURSIVE {TEL}, t AS MATERIALIZED (SELECT *, row_number() {OVER}) AS n FROM tel),
 r AS (SELECT machine, step, n, {first} AS x FROM t WHERE n = 1 UNION ALL SELECT t.machine, t.step, t.n, {state} AS x FROM r JOIN t ON t.machine = r.machine AND t.n = r.n + 1)
SELECT {columns} FROM r"""


_LOAD, _RESET = "CASE WHEN t.state = 'RUN' THEN 1 ELSE 0 END", "t.cents > 15000"
_W0 = f"CASE WHEN {_RESET} THEN CAST(0 AS DOUBLE) ELSE r.x END"
_B0 = f"({_LOAD}) / CAST(240 AS DOUBLE)"


@query(_recursive(f"{_W0} + ({_LOAD}) * CASE WHEN {_W0} > 0.0334 THEN 5 ELSE 1 END / CAST(240 AS DOUBLE)", _B0, "machine, step, round(x, 9) AS wear"))
def win_wear(spark, sf):
    """Wear with a knee and resets at maintenance, in closed form."""
    t = scan.wear(telemetry(spark, sf), (F.col("state") == "RUN").cast("int"), F.col("cents") > 15000, 1 / 240, 0.0334, 5.0)
    return t.select("machine", "step", F.round("wear", 9).alias("wear"))


@query(_recursive(f"least(CAST(0.5 AS DOUBLE), {_W0} + ({_LOAD}) / CAST(24 AS DOUBLE) * exp(2 * greatest(CAST(0 AS DOUBLE), {_W0} - CAST(0.1 AS DOUBLE))))", f"({_LOAD}) / CAST(24 AS DOUBLE)", "machine, step, round(x, 6) AS bias"))
def win_wear_exponential(spark, sf):
    """A capped exponential with resets: a recurrence without a closed form, carried over sorted batches."""
    t = scan.exponential_wear(telemetry(spark, sf), (F.col("state") == "RUN").cast("int"), F.col("cents") > 15000, rate=1 / 24)
    return t.withColumn("bias", F.round("bias", 6))


_ONES = "(t.cents % 7 - 3)"


@query(_recursive(f"CASE WHEN {_RESET} THEN 0 ELSE CAST(0.6 AS DOUBLE) END * r.x + {_ONES}", f"CAST({_ONES} AS DOUBLE)", "machine, step, round(x, 6) AS x"))
def win_ar1(spark, sf):
    """An autoregression with restarts: affine maps, composed over blocks of four rows and blocks of blocks."""
    t = telemetry(spark, sf)
    keep = F.when(F.col("cents") > 15000, 0.0).otherwise(0.6)
    return scan.affine_scan(t, keep, F.col("cents") % 7 - 3, out="x", block=4).withColumn("x", F.round("x", 6))


@query(f"""WITH {TEL}, q AS (SELECT machine, step AS first, step + w AS "end" FROM tel, (VALUES (1), (5), (16), (40), (67)) AS v(w) WHERE step % 4 = 0)
SELECT q.machine, q.first, q."end", min(cents) AS lo, max(cents) AS hi FROM q JOIN tel t ON t.machine = q.machine AND t.step >= q.first AND t.step < q."end" GROUP BY 1, 2, 3 HAVING count(*) = q."end" - q.first""")
def win_range_extremes(spark, sf):
    """Least and greatest values of ranges of any width, by two look-ups each in a sparse table."""
    t = telemetry(spark, sf)
    ranges = t.filter("step % 4 = 0").select("machine", F.col("step").alias("first"), F.explode(F.array(*map(F.lit, (1, 5, 16, 40, 67)))).alias("w"))
    return scan.range_extremes(scan.sparse_table(t, F.col("cents"), 67), ranges.withColumn("end", F.col("first") + F.col("w")))


_VAR = f"CAST(16 * sum(cents * cents) {OVER} ROWS 15 PRECEDING) - (sum(cents) {OVER} ROWS 15 PRECEDING)) * (sum(cents) {OVER} ROWS 15 PRECEDING)) AS DOUBLE) / 2560000"


@query(f"""WITH {TEL}, v AS (SELECT machine, step, CASE WHEN count(*) {OVER} ROWS 15 PRECEDING) = 16 THEN {_VAR} END AS variance FROM tel)
SELECT machine, step, variance, coalesce(variance >= 20000, false) AS high FROM v""")
def win_variance_gate(spark, sf):
    t = sq.trailing_variance(telemetry(spark, sf), "cents", 16)
    return t.select("machine", "step", "variance", F.coalesce(F.col("variance") >= 20000, F.lit(False)).alias("high"))


_UP, _DN = math.log(0.25 * 402), math.log(0.75 / (1 - 1 / 402))


@query(f"""WITH {TEL}, f AS (SELECT machine, step, sum(CASE WHEN state = 'DOWN' THEN 1 ELSE 0 END) {ROWS} AS fails, row_number() {OVER}) AS n FROM tel),
 c AS (SELECT *, fails * CAST({_UP!r} AS DOUBLE) + (n - fails) * CAST({_DN!r} AS DOUBLE) AS c FROM f),
 s AS (SELECT *, c - least(CAST(0 AS DOUBLE), min(c) {ROWS}) AS cusum FROM c)
SELECT machine, step, CAST(fails AS BIGINT) AS fails, round(cusum, 6) AS cusum, cusum >= 3 AS alarm FROM s""")
def win_bernoulli_cusum(spark, sf):
    t = sq.bernoulli_cusum(telemetry(spark, sf), F.col("state") == "DOWN", 1 / 402, 0.25, 3.0)
    return t.select("machine", "step", "fails", F.round("cusum", 6).alias("cusum"), "alarm")


@query(f"""WITH {TEL}, g AS (SELECT machine, CAST(sum(cents) AS DOUBLE) / count(*) / 100 AS mu, list(obs ORDER BY step) AS s FROM tel GROUP BY machine)
SELECT machine, round(list_reduce(list_prepend(mu, s), lambda e, v: CAST(0.85 AS DOUBLE) * e + CAST(0.15 AS DOUBLE) * v), 6) AS ewma FROM g""")
def win_ewma(spark, sf):
    mu = F.sum("cents").cast("double") / F.count("*") / 100
    e = sq.ewma(telemetry(spark, sf), "obs", 0.15, mu)
    return e.groupBy("machine").agg(F.round(F.max_by("ewma", "step"), 6).alias("ewma"))


@query(f"""WITH {TEL}, x AS (SELECT machine, step, coalesce(sum(CASE WHEN state IN ('DOWN', 'STARVED') THEN 1 ELSE 0 END) {OVER} ROWS 5 PRECEDING), 0) AS k, state FROM tel)
SELECT machine, step, state IN ('DOWN', 'STARVED') AND k >= 3 AS confirmed FROM x""")
def win_dwell_confirm(spark, sf):
    t = sq.confirmed(telemetry(spark, sf), F.col("state") == "DOWN", F.col("state") == "STARVED", 3, 5)
    return t.select("machine", "step", "confirmed")


@query(f"""WITH {TEL}, x AS (SELECT machine, step, state = 'DOWN' AS a, CAST(sum(CASE WHEN state = 'DOWN' THEN 1 ELSE 0 END) {ROWS} AS BIGINT) AS alarm_no FROM tel)
SELECT machine, step, alarm_no, a AND (alarm_no - 1) % 3 = 0 AS emitted, CASE WHEN NOT a THEN 'none' WHEN (alarm_no - 1) % 3 = 0 THEN 'emitted' ELSE 'suppressed' END AS reason FROM x""")
def win_suppress(spark, sf):
    return sq.suppressed(telemetry(spark, sf), F.col("state") == "DOWN", 2).select("machine", "step", "alarm_no", "emitted", "reason")


@query(f"""WITH {TEL}, x AS (SELECT *, (state <> 'RUN') AS d FROM tel), {_islands('d', source='x')}
SELECT machine, min(step) AS start, max(step) + 1 AS "end", count(*) AS length FROM isl WHERE d GROUP BY machine, island""")
def win_segments(spark, sf):
    return sq.segments(telemetry(spark, sf), F.col("state") != "RUN")


@query(f"WITH {TEL} SELECT machine, step, CAST(max(CASE WHEN state = 'DOWN' THEN 1 ELSE 0 END) {OVER} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS BIGINT) AS dilated FROM tel")
def win_dilate(spark, sf):
    return sq.dilated(telemetry(spark, sf), F.col("state") == "DOWN", 3).select("machine", "step", "dilated")


@query(f"WITH {TEL} SELECT machine, step, obs FROM (SELECT *, row_number() OVER (PARTITION BY machine, step // 10 ORDER BY step) AS n FROM tel WHERE state <> 'RUN') WHERE n = 1")
def win_debounce(spark, sf):
    return sq.debounced(telemetry(spark, sf).filter("state <> 'RUN'"), 10).select("machine", "step", "obs")


@query(f"WITH {GRID} SELECT channel, step, CAST(sum(n) OVER (PARTITION BY channel ORDER BY step ROWS 19 PRECEDING) AS DOUBLE) / count(*) OVER (PARTITION BY channel ORDER BY step ROWS 19 PRECEDING) AS moving FROM grid")
def win_moving_average(spark, sf):
    w = C.last(20)
    return grid(spark, sf).select("channel", "step", (F.sum("n").over(w).cast("double") / F.count("*").over(w)).alias("moving"))


@query(f"""WITH {GRID}, b AS (SELECT channel, cents, CAST(floor(CAST((row_number() OVER (PARTITION BY channel ORDER BY step) - 1) * 16 AS DOUBLE) / count(*) OVER (PARTITION BY channel)) AS BIGINT) AS bucket FROM grid) SELECT channel, bucket, min(cents) AS lo, max(cents) AS hi FROM b GROUP BY channel, bucket""")
def win_decimate(spark, sf):
    return sq.decimated(grid(spark, sf), "cents", 16, C)


@query(f"""WITH {TEL}, p AS (SELECT machine, step, state, lag(state) {OVER}) AS b FROM tel)
SELECT machine, step, b || '_OFF' AS event FROM p WHERE b IN ('DOWN', 'BLOCKED', 'STARVED') AND b <> state
UNION ALL SELECT machine, step, state || '_ON' AS event FROM p WHERE state IN ('DOWN', 'BLOCKED', 'STARVED') AND b IS DISTINCT FROM state""")
def win_state_edges(spark, sf):
    return sq.state_edges(telemetry(spark, sf), "state", ("DOWN", "BLOCKED", "STARVED"))


@query(f"WITH {TEL} SELECT machine, step, last_value(CASE WHEN state <> 'DOWN' THEN cents END IGNORE NULLS) {ROWS} AS filled FROM tel")
def win_hold_last(spark, sf):
    return sq.held_last(telemetry(spark, sf), "cents", F.col("state") == "DOWN").select("machine", "step", "filled")


@query(f"WITH {TEL} SELECT machine, first_value(state IGNORE NULLS) OVER (PARTITION BY machine ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS family, step FROM tel")
def win_broadcast_family(spark, sf):
    w = S.by().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return telemetry(spark, sf).select("machine", F.first("state", ignorenulls=True).over(w).alias("family"), "step")


@query(f"""WITH {TEL}, f AS (SELECT machine, min(step) FILTER (WHERE state = 'DOWN' AND step BETWEEN 40 AND 52) AS hit, min(step) FILTER (WHERE step >= 40) AS t0 FROM tel GROUP BY machine)
SELECT machine, coalesce(hit - t0, 999) AS latency, hit IS NOT NULL AS found FROM f WHERE t0 IS NOT NULL""")
def win_first_alarm(spark, sf):
    f = telemetry(spark, sf).groupBy("machine").agg(F.min(F.when((F.col("state") == "DOWN") & F.col("step").between(40, 52), F.col("step"))).alias("hit"), F.min(F.when(F.col("step") >= 40, F.col("step"))).alias("t0"))
    return f.filter("t0 is not null").select("machine", F.coalesce(F.col("hit") - F.col("t0"), F.lit(999)).alias("latency"), F.col("hit").isNotNull().alias("found"))
