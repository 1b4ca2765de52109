"""Queries of calibration, detection, labels and joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeline.operators import calibrate as cal
from gaugeline.operators import detect, labels
from gaugeline.operators import sequence as sq
from gaugeline.plans.base import query
from gaugeline.sources.adapters import CAL_END, FAULTS, GRID, PARTS, SCORES, TEL, WARMUP, faults, grid, parts, read, scores, telemetry



def good():
    return (F.col("state") == "RUN") & F.col("step").between(WARMUP, CAL_END - 1)


OVER = "OVER (PARTITION BY machine ORDER BY step"

FIT = f"""good AS (SELECT *, count(*) FILTER (WHERE g) OVER (PARTITION BY machine) AS k FROM (SELECT *, state = 'RUN' AND step BETWEEN {WARMUP} AND {CAL_END - 1} AS g FROM tel)),
 q AS (SELECT machine, quantile_cont(obs, 0.99) AS q99, quantile_cont(obs, 0.01) AS q01, quantile_cont(obs, 0.25) AS q1, quantile_cont(obs, 0.75) AS q3,
  CAST(count(*) * sum(cents * cents) - sum(cents) * sum(cents) AS DOUBLE) / (count(*) * count(*)) / 10000 AS clean_var, count(*) AS n FROM good WHERE k < 10 OR g GROUP BY machine),
 fit AS (SELECT *, q3 + 1.5 * (q3 - q1) AS fence, q1 - 1.5 * (q3 - q1) AS low_fence, greatest(q99, q3 + 1.5 * (q3 - q1)) AS thr, least(q01, q1 - 1.5 * (q3 - q1)) AS thr_low FROM q)"""
_FITTED = ("q99", "q01", "q1", "q3", "fence", "low_fence", "thr", "thr_low")


@query(f"WITH {TEL}, {FIT} SELECT machine, " + ", ".join(f"round({c}, 6) AS {c}" for c in _FITTED) + ", round(clean_var, 6) AS clean_var, n FROM fit")
def agg_tukey_fit(spark, sf):
    fit = cal.tukey_fit(telemetry(spark, sf), good())
    return fit.select("machine", *[F.round(c, 6).alias(c) for c in _FITTED], F.round("clean_var", 6).alias("clean_var"), "n")


def _scored(spark, sf):
    t = telemetry(spark, sf)
    return detect.exceedance(t, cal.tukey_fit(t, good()), F.col("state") == "DOWN")


SCORED = f"""sc AS (SELECT tel.*, greatest(obs - thr, thr_low - obs) AS score FROM tel JOIN fit ON tel.machine = fit.machine),
 al AS (SELECT *, score > 0 AND state <> 'DOWN' AS alarm FROM sc)"""


@query(f"WITH {TEL}, {FIT}, {SCORED} SELECT machine, step, round(score, 6) AS score, alarm FROM al")
def det_exceedance(spark, sf):
    return _scored(spark, sf).select("machine", "step", F.round("score", 6).alias("score"), "alarm")


@query(f"""WITH {TEL}, {FIT}, {SCORED}, cf AS (SELECT *, alarm AND sum(CAST(alarm AS INT)) {OVER} ROWS 5 PRECEDING) >= 2 AS c FROM al WHERE step >= {CAL_END})
SELECT machine, count(*) FILTER (WHERE alarm) AS alarms, count(*) FILTER (WHERE c) AS confirmed, min(step) FILTER (WHERE alarm) AS first_alarm, round(max(score), 6) AS peak FROM cf GROUP BY machine""")
def det_flagship(spark, sf):
    """Calibrate, exceed, confirm by dwell, and summarise each entity: two windows and one aggregate by machine."""
    t = sq.confirmed(_scored(spark, sf).filter(F.col("step") >= CAL_END), F.col("alarm"), F.lit(False), 2, 5)
    return t.groupBy("machine").agg(F.count_if("alarm").alias("alarms"), F.count_if("confirmed").alias("confirmed"), F.min(F.when(F.col("alarm"), F.col("step"))).alias("first_alarm"), F.round(F.max("score"), 6).alias("peak"))


@query(f"""WITH {TEL}, {FIT}, {SCORED}, p AS (SELECT machine // 10 AS line, machine, round(max(score), 6) AS peak FROM al GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY peak DESC, machine) AS rk FROM p)
SELECT a.line, CASE WHEN a.machine % 3 = 0 AND b.peak > 0 AND a.peak < 2 * b.peak THEN b.machine ELSE a.machine END AS machine,
 CASE WHEN a.machine % 3 = 0 AND b.peak > 0 AND a.peak < 2 * b.peak THEN b.peak ELSE a.peak END AS peak
FROM (SELECT * FROM r WHERE rk = 1) a LEFT JOIN (SELECT * FROM r WHERE rk = 2) b ON a.line = b.line""")
def srt_top1_veto(spark, sf):
    p = _scored(spark, sf).groupBy(F.expr("machine div 10").alias("line"), "machine").agg(F.round(F.max("score"), 6).alias("peak"))
    return detect.blamed(p, ("line",), "machine", F.col("machine") % 3 == 0)


@query(f"WITH {TEL} SELECT machine, " + ", ".join(f"round(quantile_cont(obs, {q}), 6) AS p{str(q)[2:]}" for q in (0.5, 0.9, 0.95, 0.98, 0.99, 0.995)) + " , min(obs) AS lo, max(obs) AS hi FROM tel GROUP BY machine")
def agg_percentile_grid(spark, sf):
    qs = (0.5, 0.9, 0.95, 0.98, 0.99, 0.995)
    g = telemetry(spark, sf).groupBy("machine").agg(F.percentile("obs", F.array(*map(F.lit, qs))).alias("q"), F.min("obs").alias("lo"), F.max("obs").alias("hi"))
    return g.select("machine", *[F.round(F.get("q", F.lit(k)), 6).alias(f"p{str(q)[2:]}") for k, q in enumerate(qs)], "lo", "hi")


@query(f"""WITH {TEL}, q AS (SELECT machine, coalesce(quantile_cont(obs, 0.5) FILTER (WHERE state = 'DOWN'), quantile_cont(obs, 0.5)) AS med,
 coalesce(quantile_cont(obs, 0.75) FILTER (WHERE state = 'DOWN'), quantile_cont(obs, 0.75)) - coalesce(quantile_cont(obs, 0.25) FILTER (WHERE state = 'DOWN'), quantile_cont(obs, 0.25)) AS iqr FROM tel GROUP BY machine)
SELECT tel.machine, step, round((obs - med) / (CASE WHEN iqr = 0 THEN 1 ELSE iqr END + 0.00000001), 6) AS z FROM tel JOIN q ON tel.machine = q.machine""")
def agg_median_iqr(spark, sf):
    t = telemetry(spark, sf)
    fit = cal.median_iqr(t, F.col("state") == "DOWN")
    return t.join(fit, "machine").select("machine", "step", F.round((F.col("obs") - F.col("med")) / (F.col("iqr") + 1e-8), 6).alias("z"))


@query(f"WITH {GRID}, ok AS (SELECT step FROM grid GROUP BY step HAVING bool_and(state <> 'STARVED')) SELECT channel, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM grid WHERE step IN (SELECT step FROM ok) AND state <> 'DOWN' GROUP BY channel")
def flt_all_run(spark, sf):
    """Only the steps at which every channel has a value: an aggregate by step, then a semi-join."""
    g = grid(spark, sf)
    ok = g.groupBy("step").agg(F.bool_and(F.col("state") != "STARVED").alias("ok")).filter("ok")
    return g.join(ok, "step", "left_semi").filter("state <> 'DOWN'").groupBy("channel").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query(f"WITH {TEL} SELECT machine, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM tel WHERE step >= {WARMUP} AND state = 'RUN' GROUP BY machine")
def flt_warmup_run(spark, sf):
    return telemetry(spark, sf).filter((F.col("step") >= WARMUP) & (F.col("state") == "RUN")).groupBy("machine").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query(f"WITH {TEL}, k AS (SELECT DISTINCT machine FROM tel ORDER BY machine LIMIT 10) SELECT machine, count(*) AS n FROM tel WHERE machine IN (SELECT machine FROM k) GROUP BY machine")
def flt_first_n(spark, sf):
    """The rows of the first ten entities: a top-k of the distinct keys, then a semi-join."""
    t = telemetry(spark, sf)
    return t.join(t.select("machine").distinct().orderBy("machine").limit(10), "machine", "left_semi").groupBy("machine").agg(F.count("*").alias("n"))


@query(f"WITH {TEL} SELECT count(*) FILTER (WHERE v IS NOT NULL) AS kept, count(*) FILTER (WHERE v IS NULL) AS dropped FROM (SELECT CASE WHEN cents % 7 = 0 THEN NULL ELSE obs END AS v FROM tel)")
def flt_finite(spark, sf):
    v = F.when(F.col("cents") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("obs"))
    t = telemetry(spark, sf).select(v.alias("v"))
    ok = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf"))
    return t.agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))


@query(f"WITH {TEL}, {FAULTS} SELECT tel.machine, step, CASE WHEN f.class IS NULL THEN 0 ELSE 1 END AS y, f.class FROM tel LEFT JOIN faults f ON f.machine = tel.machine AND step >= t0 AND step < t1")
def jn_interval(spark, sf):
    return labels.active(telemetry(spark, sf), faults(spark, sf)).select("machine", "step", "y", "class")


@query(f"""WITH {TEL}, {FAULTS}, nb AS (SELECT machine AS origin, machine + h AS machine, h, t1, t0 FROM faults CROSS JOIN (VALUES (1), (2), (3)) AS d(h))
SELECT tel.machine, step, min(h) AS hop, min_by(origin, h * 1000 + t0) AS root FROM tel JOIN nb ON nb.machine = tel.machine AND step >= t1 AND step < t1 + 8 WHERE state IN ('STARVED', 'BLOCKED', 'DOWN') GROUP BY 1, 2""")
def jn_symptom_tail(spark, sf):
    """Symptoms in the eight steps after a fault, up to three hops downstream: each fault explodes into its
    tail and neighbours, then an equi-join by entity and step."""
    f = faults(spark, sf).select(F.col("machine").alias("root"), "t0", "t1", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("hop"))
    f = f.withColumn("machine", F.col("root") + F.col("hop"))
    f = labels.exploded(f.withColumn("end", F.col("t1") + 8), "t1", "end")
    t = telemetry(spark, sf).filter(F.col("state").isin("STARVED", "BLOCKED", "DOWN")).select("machine", "step")
    got = t.join(f, ["machine", "step"]).groupBy("machine", "step")
    return got.agg(F.min("hop").cast("long").alias("hop"), F.min_by("root", F.col("hop") * 1000 + F.col("t0")).alias("root"))


@query(f"""WITH {TEL}, {FAULTS}, w AS (SELECT DISTINCT machine, step - step % 8 AS w0 FROM tel)
SELECT w.machine, w0, class, least(w0 + 16, t1) - greatest(w0, t0) AS shared FROM w JOIN faults f ON f.machine = w.machine AND w0 < t1 AND t0 < w0 + 16""")
def jn_overlap(spark, sf):
    w = telemetry(spark, sf).select("machine", (F.col("step") - F.col("step") % 8).alias("w0")).distinct().withColumn("w1", F.col("w0") + 16)
    return labels.overlap(w, faults(spark, sf), ("machine",), 16).select("machine", "w0", "class", "shared")


@query(f"""WITH {TEL}, w AS (SELECT machine, step AS w0, cents FROM tel WHERE step % 4 = 0)
SELECT tel.machine, tel.step, CAST(sum(w.cents) AS DOUBLE) / count(*) AS mean FROM tel JOIN w ON w.machine = tel.machine AND tel.step >= w0 AND tel.step < w0 + 16 GROUP BY 1, 2""")
def jn_tick_windows(spark, sf):
    """The mean score of the windows that cover a tick: windows explode into ticks, one shuffle by entity and step."""
    t = telemetry(spark, sf)
    w = t.filter("step % 4 = 0").select("machine", "cents", F.explode(F.sequence(F.col("step"), F.col("step") + 15)).alias("step"))
    w = w.groupBy("machine", "step").agg((F.sum("cents").cast("double") / F.count("*")).alias("mean"))
    return t.select("machine", "step").join(w, ["machine", "step"])


@query(f"""WITH {PARTS}, d AS (SELECT machine, t, max(CASE flag WHEN 'REJECT' THEN 2 WHEN 'DEGRADE' THEN 1 ELSE 0 END) AS q FROM parts GROUP BY 1, 2),
 k AS (SELECT machine, g.t FROM (SELECT DISTINCT machine FROM parts) CROSS JOIN (SELECT range * 100 AS t FROM range(26)) g)
SELECT machine, t, q FROM (SELECT k.machine, k.t, d.q, row_number() OVER (PARTITION BY k.machine, k.t ORDER BY d.t DESC) AS rn FROM k JOIN d ON d.machine = k.machine AND d.t <= k.t) WHERE rn = 1""")
def jn_asof_parts(spark, sf):
    """The last verdict at or before each asked day: a union in order of time and a last value, no join of ranges."""
    d = parts(spark, sf).groupBy("machine", "t").agg(F.max(F.when(F.col("flag") == "REJECT", 2).when(F.col("flag") == "DEGRADE", 1).otherwise(0)).cast("long").alias("q"))
    asked = d.select("machine").distinct().select("machine", F.explode(F.transform(F.sequence(F.lit(0), F.lit(25)), lambda x: (x * 100).cast("long"))).alias("t"))
    both = d.withColumn("ask", F.lit(0)).unionByName(asked.withColumns({"q": F.lit(None).cast("long"), "ask": F.lit(1)}))
    w = Window.partitionBy("machine").orderBy("t", "ask").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("q", F.last("q", ignorenulls=True).over(w)).filter("ask = 1 and q is not null").select("machine", "t", "q")


@query(f"""WITH {PARTS}, o AS (SELECT *, lag(flag) OVER (PARTITION BY part ORDER BY t, line, machine, flag) AS b FROM parts)
SELECT part, line, t, flag <> 'REJECT' AS passed FROM o WHERE NOT (flag = 'DEGRADE' AND coalesce(b = 'REJECT', false))""")
def jn_reject_route(spark, sf):
    return detect.kit_outcomes(parts(spark, sf)).select("part", "line", "t", "passed")


@query(f"""WITH {SCORES}, a AS (SELECT id, score FROM scores WHERE id % 2 = 0), b AS (SELECT id, score / 2 AS score FROM scores WHERE id % 3 <> 0)
SELECT coalesce(a.id, b.id) AS id, (coalesce(a.score, 0) + coalesce(b.score, 0)) / 2 AS fused, a.id IS NULL OR b.id IS NULL AS lone FROM a FULL JOIN b ON a.id = b.id""")
def jn_scales_aligned(spark, sf):
    s = scores(spark, sf)
    a = s.filter("id % 2 = 0").select("id", F.col("score").alias("a"))
    b = s.filter("id % 3 <> 0").select("id", (F.col("score") / 2).alias("b"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return a.join(b, "id", "full").select("id", ((zero("a") + zero("b")) / 2).alias("fused"), (F.col("a").isNull() | F.col("b").isNull()).alias("lone"))


@query(f"""WITH {FAULTS}, tr AS (SELECT machine % 5 AS g, machine, t0, t1 FROM faults WHERE machine % 2 = 0), te AS (SELECT machine % 5 AS g, machine, t0 + 1 AS t0, t1 + 1 AS t1 FROM faults WHERE machine % 2 = 1 AND machine < 40)
SELECT machine, t0, t1 FROM tr WHERE NOT EXISTS (SELECT 1 FROM te WHERE te.g = tr.g AND tr.t0 < te.t1 AND te.t0 < tr.t1)""")
def jn_purge(spark, sf):
    """Training intervals that overlap no test interval of their group: overlaps by bins, then an anti-join."""
    f = faults(spark, sf).withColumn("g", F.col("machine") % 5)
    train = f.filter("machine % 2 = 0").select("g", "machine", F.col("t0").alias("w0"), F.col("t1").alias("w1"))
    test = f.filter("machine % 2 = 1 and machine < 40").select("g", (F.col("t0") + 1).alias("t0"), (F.col("t1") + 1).alias("t1"))
    hit = labels.overlap(train, test, ("g",), 16).select("machine").distinct()
    return train.join(hit, "machine", "left_anti").select("machine", F.col("w0").alias("t0"), F.col("w1").alias("t1"))


@query(f"WITH {FAULTS}, h AS (SELECT machine, dur FROM faults WHERE machine % 3 = 0) SELECT f.machine, class, coalesce(h.dur, 0) AS hit_dur, h.machine IS NOT NULL AS hit FROM faults f LEFT JOIN h ON h.machine = f.machine")
def jn_left_hits(spark, sf):
    f = faults(spark, sf)
    h = f.filter("machine % 3 = 0").select("machine", F.col("dur").alias("d"))
    return f.join(h, "machine", "left").select("machine", "class", F.coalesce("d", F.lit(0)).alias("hit_dur"), F.col("d").isNotNull().alias("hit"))


@query(f"WITH {GRID} SELECT step, string_agg(channel || ':' || n, ',' ORDER BY channel) AS events, CAST(sum(n) AS BIGINT) AS n FROM grid GROUP BY step")
def jn_event_tick(spark, sf):
    g = grid(spark, sf).groupBy("step").agg(F.array_sort(F.collect_list(F.struct("channel", "n"))).alias("e"), F.sum("n").alias("n"))
    return g.select("step", F.array_join(F.transform("e", lambda x: F.concat(x["channel"], F.lit(":"), x["n"].cast("string"))), ",").alias("events"), "n")


@query("""SELECT n_name AS nation, r_name AS region, count(*) AS suppliers, CAST(sum(CAST(round(s_acctbal * 100) AS BIGINT)) AS BIGINT) AS cents FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def jn_dimensions(spark, sf):
    s = read(spark, sf, "supplier").join(read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.groupBy(F.col("n_name").alias("nation"), F.col("r_name").alias("region")).agg(F.count("*").alias("suppliers"), F.sum(F.round(F.col("s_acctbal") * 100).cast("long")).alias("cents"))


_GATES = ("delay", "loss", "combo", "breakdown")


@query(f"""WITH {TEL}, a AS (SELECT *, sum(tput) {OVER} ROWS UNBOUNDED PRECEDING) AS gt, CASE WHEN state = 'DOWN' AND lag(state) {OVER}) = 'DOWN' THEN 0 ELSE 1 END AS nw, CASE WHEN lag(cents // 10000) {OVER}) = cents // 10000 THEN 0 ELSE 1 END AS sw FROM tel),
 b AS (SELECT *, sum(nw) {OVER} ROWS UNBOUNDED PRECEDING) AS di, sum(sw) {OVER} ROWS UNBOUNDED PRECEDING) AS si FROM a),
 c AS (SELECT machine, state, row_number() OVER (PARTITION BY machine, gt ORDER BY step) - CASE WHEN gt = 0 THEN 0 ELSE 1 END AS lag_, CASE WHEN state = 'DOWN' THEN row_number() OVER (PARTITION BY machine, di ORDER BY step) ELSE 0 END AS dn, row_number() OVER (PARTITION BY machine, si ORDER BY step) - 1 AS st FROM b)
SELECT machine, count(*) FILTER (WHERE lag_ >= 10 AND state = 'RUN') AS delay, count(*) FILTER (WHERE st >= 6) AS loss, count(*) FILTER (WHERE lag_ >= 5 AND st >= 1) AS combo, count(*) FILTER (WHERE dn >= 3) AS breakdown FROM c GROUP BY machine""")
def det_gates(spark, sf):
    t = telemetry(spark, sf).withColumn("v", F.expr("cents div 10000"))
    t = sq.since(sq.run_while(sq.repeats(t, "v"), F.col("state") == "DOWN"), F.col("tput") > 0)
    gates = detect.structural_gates(F.col("tputlag"), F.col("stale"), F.col("downrun"), F.col("state") == "RUN")
    return t.groupBy("machine").agg(*[F.count_if(gates[g]).alias(g) for g in _GATES])


@query(f"WITH {TEL} SELECT machine, step, round((obs - 100) / 30, 6) AS z FROM tel WHERE abs(obs - 100) / 30 > 3")
def det_zscore(spark, sf):
    z = (F.col("obs") - 100) / 30
    return telemetry(spark, sf).filter(F.abs(z) > 3).select("machine", "step", F.round(z, 6).alias("z"))


COUNTS = """g AS (SELECT {k} score, CAST(sum(y) AS BIGINT) AS p, count(*) AS n FROM scores GROUP BY {k} score),
 c AS (SELECT {k} score, sum(p) OVER ({part} ORDER BY score DESC) AS tp, sum(n) OVER ({part} ORDER BY score DESC) AS k, sum(p) OVER ({part}) AS pos FROM g)"""


@query(f"WITH {SCORES}, {COUNTS.format(k='', part='')}, f AS (SELECT score, 2.0 * tp / (k + pos) AS f1 FROM c) SELECT score AS thr, round(f1, 6) AS f1 FROM f ORDER BY f1 DESC, score LIMIT 1")
def cal_best_f1(spark, sf):
    return cal.best_f1(scores(spark, sf)).select("thr", F.round("f1", 6).alias("f1"))


@query(f"WITH {SCORES}, {COUNTS.format(k='fam,', part='PARTITION BY fam')}, f AS (SELECT fam, score, 2.0 * tp / (k + pos) AS f1 FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY f1 DESC, score) AS rn FROM f) SELECT fam, score AS thr, round(f1, 6) AS f1 FROM r WHERE rn = 1")
def cal_best_f1_family(spark, sf):
    return cal.best_f1(scores(spark, sf), ("fam",)).select("fam", "thr", F.round("f1", 6).alias("f1"))


@query(f"WITH {SCORES}, {COUNTS.format(k='fam,', part='PARTITION BY fam')} SELECT fam, CASE WHEN max(pos) = 0 THEN max(score) ELSE coalesce(max(score) FILTER (WHERE tp >= 0.7 * pos), min(score)) END AS thr FROM c GROUP BY fam")
def cal_recall_floor(spark, sf):
    return cal.recall_floor(scores(spark, sf), 0.7, ("fam",))


@query(f"WITH {SCORES} SELECT fam, round(quantile_cont(score, 0.95), 6) AS tau FROM scores WHERE y = 0 GROUP BY fam")
def cal_quantile(spark, sf):
    return scores(spark, sf).filter("y = 0").groupBy("fam").agg(F.round(F.percentile("score", F.lit(0.95)), 6).alias("tau"))


@query(f"""WITH {TEL}, e AS (SELECT state, cents - 10000 AS e FROM tel), g AS (SELECT state, count(*) FILTER (WHERE e > 0) AS n, count(*) AS a, sum(e) FILTER (WHERE e > 0) AS x, sum(e * e) FILTER (WHERE e > 0) AS xx FROM e GROUP BY state),
 m AS (SELECT state, n, a, CAST(x AS DOUBLE) / n AS m, CAST(n * xx - x * x AS DOUBLE) / (n * (n - 1)) AS v FROM g), x AS (SELECT *, 0.5 * (1 - m * m / v) AS xi FROM m),
 s AS (SELECT *, m * (1 - xi) AS sigma, n < 20 OR xi >= 0.45 AS frozen FROM x)
SELECT state, n, round(xi, 6) AS xi, round(sigma, 4) AS sigma, frozen, CASE WHEN NOT frozen THEN round(sigma / xi * (pow(0.01 * a / n, -xi) - 1), 4) END AS z FROM s""")
def cal_pot(spark, sf):
    g = cal.peaks_over(telemetry(spark, sf), ("state",), "cents", F.lit(10000), 0.01)
    return g.select("state", "n", F.round("xi", 6).alias("xi"), F.round("sigma", 4).alias("sigma"), "frozen", F.round("z", 4).alias("z"))


@query(f"""WITH {SCORES}, q AS (SELECT fam, quantile_cont(score, 0.5) AS a, quantile_cont(score, 0.75) AS b, quantile_cont(score, 0.9) AS c FROM scores GROUP BY fam)
SELECT fam, round(CASE WHEN least(b - a, c - b) > 0.25 * abs(b) THEN c WHEN b - a <= c - b THEN (a + b) / 2 ELSE (b + c) / 2 END, 6) AS tau FROM q""")
def cal_stability_vote(spark, sf):
    q = lambda p: F.percentile("score", F.lit(p))
    g = scores(spark, sf).groupBy("fam").agg(q(0.9).alias("a"), q(0.5).alias("b"), q(0.75).alias("c"))
    return g.select("fam", F.round(cal.stability_vote(F.col("a"), F.col("b"), F.col("c")), 6).alias("tau"))


@query(f"WITH {SCORES} SELECT id, round(pow(1 - least(score, 1), 2), 6) AS w FROM scores")
def cal_focal(spark, sf):
    return scores(spark, sf).select("id", F.round(F.pow(1 - F.least("score", F.lit(1.0)), F.lit(2.0)), 6).alias("w"))


@query(f"WITH {SCORES} SELECT id, CASE WHEN fam IN ('fr', 'de') AND score >= 0.2 THEN true ELSE score >= 0.6 END AS dec FROM scores")
def cal_recall_veto(spark, sf):
    """Protected families keep an alarm that the looser threshold gives."""
    return scores(spark, sf).select("id", ((F.col("fam").isin("fr", "de") & (F.col("score") >= 0.2)) | (F.col("score") >= 0.6)).alias("dec"))
