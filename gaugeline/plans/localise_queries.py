"""Queries of the localiser: onsets near every trigger, and routed by the family of a fault."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.operators import localise, ranked
from gaugeline.operators import sequence as sq
from gaugeline.plans.base import query
from gaugeline.sources.adapters import FAULTS, TEL, faults, telemetry

S = sq.TELEMETRY
#: Regions scaled down to series of some fifty rows.
BACK = localise.Region(16, 8)
AHEAD = localise.Region(16, 40, 16)
WIDTH, STRIDE = 16, 4
COUNTERS = {"delay": "stale", "loss": "stale", "breakdown": "down"}

_TRIG = "trig AS (SELECT machine, step AS fired FROM tel WHERE cents > 15000)"


def _region(name: str, region: localise.Region, source: str = "tel", value: str = "obs", trig: str = "trig") -> str:
    n = "greatest(1, len(r) // 4)" if region.base is None else f"greatest(1, least({region.base}, len(r) // 4))"
    return f"""{name}_r AS (SELECT t.machine, t.fired, list({{'step': s.step, 'v': CAST(s.{value} AS DOUBLE)}} ORDER BY s.step) AS r FROM (SELECT DISTINCT machine, fired FROM {trig}) t
  JOIN {source} s ON s.machine = t.machine AND s.step BETWEEN t.fired - {region.before} AND t.fired + {region.after - 1} GROUP BY 1, 2),
 {name}_n AS (SELECT *, {n} AS n FROM {name}_r),
 {name}_b AS (SELECT *, list_sort(list_transform(r[1:n], lambda x: x.v)) AS b FROM {name}_n),
 {name}_m AS (SELECT *, (b[(n - 1) // 2 + 1] + b[n // 2 + 1]) / 2.0 AS med, list_sum(b) / n AS mean FROM {name}_b),
 {name}_a AS (SELECT *, list_sort(list_transform(b, lambda x: abs(x - med))) AS a, sqrt(list_sum(list_transform(b, lambda x: (x - mean) * (x - mean))) / n) AS dev FROM {name}_m),
 {name} AS (SELECT machine, fired, r, med, coalesce(nullif((a[(n - 1) // 2 + 1] + a[n // 2 + 1]) / 2.0 * 1.4826, 0), 1) AS mad, coalesce(nullif(dev, 0), 1) AS sd FROM {name}_a)"""


def _page(name: str, k: float, h: float) -> str:
    g = f"greatest(CAST(0 AS DOUBLE), a.g + x.z - CAST({k} AS DOUBLE))"
    zero = "{'g': CAST(0 AS DOUBLE), 'i': CAST(0 AS BIGINT), 'zero': CAST(0 AS BIGINT), 'alarm': CAST(-1 AS BIGINT), 'z': "
    return f"""{name}_p AS (SELECT machine, fired, r, list_reduce(list_prepend({zero}CAST(0 AS DOUBLE)}}, list_transform(r, lambda x: {zero}abs((x.v - med) / mad)}})),
   lambda a, x: {{'g': {g}, 'i': a.i + 1, 'zero': CASE WHEN a.alarm < 0 AND {g} = 0 THEN a.i ELSE a.zero END, 'alarm': CASE WHEN a.alarm < 0 AND {g} > {h} THEN a.i ELSE a.alarm END, 'z': x.z}}) AS got FROM {name}),
 {name}_page AS (SELECT machine, fired, CASE WHEN got.alarm >= 0 AND len(r) > 1 THEN r[least(got.zero + 1, got.alarm) + 1].step END AS onset FROM {name}_p)"""


def _ewma(name: str, weight: float, limit: float) -> str:
    first = "{'e': med, 'i': CAST(0 AS BIGINT), 'alarm': CAST(-1 AS BIGINT), 'v': "
    e = f"CAST({weight} AS DOUBLE) * x.v + CAST({1 - weight} AS DOUBLE) * a.e"
    return f"""{name}_q AS (SELECT machine, fired, r, list_reduce(list_prepend({first}CAST(0 AS DOUBLE)}}, list_transform(r, lambda x: {first}x.v}})),
   lambda a, x: {{'e': {e}, 'i': a.i + 1, 'alarm': CASE WHEN a.alarm < 0 AND abs({e} - med) > CAST({limit * (weight / (2 - weight)) ** 0.5!r} AS DOUBLE) * sd THEN a.i ELSE a.alarm END, 'v': x.v}}) AS got FROM {name}),
 {name}_ewma AS (SELECT machine, fired, CASE WHEN got.alarm >= 0 AND len(r) > 1 THEN r[got.alarm + 1].step END AS onset FROM {name}_q)"""


def _both(kind: str) -> str:
    return f"SELECT b.machine, b.fired, b.onset AS backward, f.onset AS forward FROM b_{kind} b JOIN f_{kind} f USING (machine, fired)"


def _found(spark, sf, region):
    t = telemetry(spark, sf)
    return localise.regions(t, t.filter("cents > 15000").withColumn("fired", F.col("step")), {"obs": F.col("obs")}, region)


def _joined(of, spark, sf, **more):
    back, ahead = (of(_found(spark, sf, r), "obs", r, out=name, **m).drop("region") for r, name, m in ((BACK, "backward", {}), (AHEAD, "forward", more)))
    return back.join(ahead, ["machine", "fired"])


@query(f"WITH {TEL}, {_TRIG}, {_region('b', BACK)}, {_region('f', AHEAD)}, {_page('b', 1.0, 5.0)}, {_page('f', 1.0, 5.0)} {_both('page')}")
def win_page_onset(spark, sf):
    """Onsets by a Page test restarted near each trigger: back from it, and ahead."""
    return _joined(localise.page_onset, spark, sf)


@query(f"WITH {TEL}, {_TRIG}, {_region('b', BACK)}, {_region('f', AHEAD)}, {_ewma('b', 0.15, 3.0)}, {_ewma('f', 0.15, 3.5)} {_both('ewma')}")
def win_ewma_onset(spark, sf):
    """Onsets by the limits of an EWMA restarted near each trigger: 3 deviations back from it, 3.5 ahead."""
    return _joined(localise.ewma_onset, spark, sf, limit=3.5)


@query(f"""WITH {TEL}, {_TRIG} SELECT g.machine, fired, min(step) FILTER (WHERE state = 'DOWN' AND step BETWEEN fired - 16 AND fired + 7) AS edge, min(step) FILTER (WHERE state = 'DOWN' AND step BETWEEN fired AND fired + 39) AS forward
FROM trig g JOIN tel t ON t.machine = g.machine GROUP BY g.machine, fired""")
def win_counter_onset(spark, sf):
    """Where a counter of failed rows turns positive near each trigger."""
    t = sq.run_while(telemetry(spark, sf), F.col("state") == "DOWN", out="down")
    found = localise.regions(t, t.filter("cents > 15000").withColumn("fired", F.col("step")), {"down": F.col("down")}, localise.Region(16, 40))
    within = lambda a, b: F.filter("whole", lambda x: (x["step"] >= F.col("fired") + a) & (x["step"] < F.col("fired") + b))
    found = found.withColumnRenamed("region", "whole")
    edge = localise.counter_onset(found.withColumn("region", within(-BACK.before, BACK.after)), "down", "edge")
    return localise.counter_onset(edge.withColumn("region", within(0, 40)), "down", "forward").select("machine", "fired", "edge", "forward")


_OVER = "OVER (PARTITION BY machine ORDER BY step"
ROUTED = f"""{TEL}, {FAULTS}, med AS (SELECT machine, quantile_cont(obs, 0.5) AS m FROM tel GROUP BY machine),
 isl0 AS (SELECT *, cents // 1000 AS q, (state = 'DOWN') AS d FROM tel),
 isl1 AS (SELECT *, CASE WHEN lag(q) {_OVER}) IS NOT DISTINCT FROM q THEN 0 ELSE 1 END AS nq, CASE WHEN lag(d) {_OVER}) IS NOT DISTINCT FROM d THEN 0 ELSE 1 END AS nd FROM isl0),
 isl2 AS (SELECT *, sum(nq) {_OVER}) AS iq, sum(nd) {_OVER}) AS id FROM isl1),
 sig AS (SELECT isl2.machine, step, cents, abs(obs - m) AS proj, row_number() OVER (PARTITION BY isl2.machine, iq ORDER BY step) - 1 AS stale, CASE WHEN d THEN row_number() OVER (PARTITION BY isl2.machine, id ORDER BY step) ELSE 0 END AS down FROM isl2 JOIN med ON med.machine = isl2.machine),
 w AS (SELECT a.machine, a.step AS start FROM tel a JOIN tel b ON b.machine = a.machine AND b.step BETWEEN a.step AND a.step + {WIDTH - 1} WHERE a.step % {STRIDE} = 0 GROUP BY a.machine, a.step HAVING max(b.cents) > 15000),
 hot AS (SELECT f.machine, class, t0, t1, min(start) AS fired FROM faults f JOIN w ON w.machine = f.machine AND start < t1 AND start + {WIDTH} > t0 GROUP BY 1, 2, 3, 4),
 {_region('f', AHEAD, 'sig', 'proj', 'hot')}, {_page('f', 1.0, 5.0)}, {_ewma('f', 0.15, 3.5)},
 c AS (SELECT h.machine, h.fired, min(step) FILTER (WHERE stale > 0) AS stale, min(step) FILTER (WHERE down > 0) AS down FROM (SELECT DISTINCT machine, fired FROM hot) h JOIN sig ON sig.machine = h.machine AND step BETWEEN h.fired AND h.fired + {AHEAD.after - 1} GROUP BY 1, 2),
 o AS (SELECT hot.machine, class, t0, hot.fired, hot.fired + {WIDTH // 2} AS centre, CASE WHEN class IN ('delay', 'loss') THEN c.stale WHEN class = 'breakdown' THEN c.down WHEN class = 'drift' THEN e.onset ELSE p.onset END AS onset
  FROM hot JOIN c USING (machine, fired) JOIN f_ewma e USING (machine, fired) JOIN f_page p USING (machine, fired)),
 routed AS (SELECT *, abs(centre - t0) AS centre_error, abs(onset - t0) AS onset_error FROM o WHERE onset IS NOT NULL)"""


def routed(spark, sf):
    t = telemetry(spark, sf)
    med = ranked.quantiles(t.groupBy("machine", "obs").agg(F.count("*").alias("n")), "obs", "n", [0.5], ("machine",)).select("machine", F.col("q").alias("m"))
    sig = sq.run_while(sq.repeats(t.withColumn("q", F.expr("cents div 1000")), "q"), F.col("state") == "DOWN", out="down")
    sig = sig.join(med, "machine").withColumn("proj", F.abs(F.col("obs") - F.col("m")))
    last = F.max("cents").over(S.by().rangeBetween(0, WIDTH - 1))
    windows = t.withColumn("top", last).filter(F.col("step") % STRIDE == 0).withColumn("start", F.col("step"))
    hot = localise.triggers_of(windows, faults(spark, sf).select("machine", "class", "t0", "t1"), WIDTH, F.col("top") > 15000)
    return localise.routed(sig, hot, "proj", COUNTERS, width=WIDTH, ahead=AHEAD)


@query(f"WITH {ROUTED} SELECT machine, class, t0, fired, centre, onset, centre_error, onset_error FROM routed")
def rst_localise_route(spark, sf):
    """Each fault's onset from its first hot window on, by the estimator of its family, beside the window's centre."""
    return routed(spark, sf)


@query(f"WITH {ROUTED} SELECT class, quantile_cont(centre_error, 0.5) AS centre, quantile_cont(onset_error, 0.5) AS onset, count(*) AS n FROM routed GROUP BY class")
def rst_localise_summary(spark, sf):
    """The median error of both by family."""
    kinds = ("centre", "onset")
    r = routed(spark, sf).select("class", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_error").alias("error")) for k in kinds])).alias("x")).select("class", "x.*")
    counts = r.groupBy("class", "kind", "error").agg(F.count("*").alias("n"))
    of = ranked.quantiles(counts, "error", "n", [0.5], ("class", "kind")).join(counts.groupBy("class", "kind").agg(F.sum("n").alias("n")), ["class", "kind"])
    return of.groupBy("class").agg(*[F.max(F.when(F.col("kind") == k, F.col("q"))).alias(k) for k in kinds], F.max("n").alias("n"))
