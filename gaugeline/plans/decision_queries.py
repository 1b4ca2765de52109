"""Queries of event metrics, fusion, gates, routing and arguments."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions.dims import MACHINES, machines, sql_values
from gaugeline.operators import contracts, detect, fusion, gates
from gaugeline.operators import metrics as me
from gaugeline.operators import sequence as sq
from gaugeline.operators.ranked import numbered
from gaugeline.plans.base import query
from gaugeline.plans.sequence_queries import ROWS, _islands
from gaugeline.sources.adapters import FAULTS, FLEET, SCORES, TEL, faults, fleet, read, scores, telemetry

S = sq.TELEMETRY
OVER = "OVER (PARTITION BY machine ORDER BY step"
FR = OVER + " ROWS 15 PRECEDING)"
_ROSTER = sql_values([(k, *m) for k, m in enumerate(MACHINES)], "idx, machine, class, base, sigma, cycle, mttf, mttr")


@query(f"""WITH {TEL}, x AS (SELECT *, cents // 10000 AS v FROM tel), {_islands('v', source='x')}, s AS (SELECT machine, step, row_number() OVER (PARTITION BY machine, island ORDER BY step) - 1 AS stale FROM isl)
SELECT step, max(stale) AS stale, CASE WHEN max(stale) >= 6 THEN 'DROPOUT' WHEN max(stale) >= 3 THEN 'SUSPECT' ELSE 'OK' END AS health FROM s GROUP BY step""")
def prj_sensor_health(spark, sf):
    """The plant's sensor flag at each step, from the longest run of a repeated value."""
    return detect.sensor_health(telemetry(spark, sf).withColumn("v", F.expr("cents div 10000")), "v")


_NAB = "state = 'DOWN' AND cents > 20000"


@query(f"""WITH {TEL}, {FAULTS}, a AS (SELECT machine, step FROM tel WHERE {_NAB}), h AS (SELECT f.machine, t0, t1 + 5 AS e, min(step) AS hit FROM faults f JOIN a ON a.machine = f.machine AND step >= t0 AND step < t1 + 5 GROUP BY 1, 2, 3),
 o AS (SELECT (SELECT CAST(count(*) AS DOUBLE) FROM h) / (SELECT count(*) FROM faults) AS r, (SELECT sum(2 / (1 + exp(5 * CAST(hit - t0 AS DOUBLE) / (e - t0)))) / count(*) FROM h) AS c,
  (SELECT CAST(count(*) AS DOUBLE) FROM a WHERE machine % 4 = 0) / (SELECT count(DISTINCT machine) FROM tel WHERE machine % 4 = 0) AS f)
SELECT profile, round(r, 6) AS hit_rate, round(coalesce(c, 0), 6) AS mean_credit, round(f, 6) AS clean_fp_rate, round(least(1, greatest(0, (r * coalesce(c, 0) * fn - f * fp) / fn)), 6) AS score
FROM o, (VALUES ('standard', CAST(1 AS DOUBLE), CAST(1 AS DOUBLE)), ('low-fn', CAST(2 AS DOUBLE), CAST(1 AS DOUBLE)), ('low-fp', CAST(1 AS DOUBLE), CAST(2 AS DOUBLE))) AS p(profile, fn, fp)""")
def met_nab(spark, sf):
    """Event scores of one detector in all three profiles."""
    t = telemetry(spark, sf)
    f = faults(spark, sf).select(F.col("machine").alias("key"), "t0", (F.col("t1") + 5).alias("end"))
    n = me.nab_scores(f, t.filter(_NAB).select(F.col("machine").alias("key"), "step"), t.filter("machine % 4 = 0").select(F.col("machine").alias("key")))
    return n.select("profile", *[F.round(c, 6).alias(c) for c in ("hit_rate", "mean_credit", "clean_fp_rate", "score")])


@query(f"""WITH {TEL}, {FAULTS}, a AS (SELECT machine, step AS w0, step + 16 AS w1, max(cents) {OVER} ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) > 30000 AS dec FROM tel),
 o AS (SELECT a.machine, w0, max(CAST(greatest(0, least(w1, t1) - greatest(w0, t0)) AS DOUBLE) / (t1 - t0)) AS share FROM a JOIN faults f ON f.machine = a.machine WHERE dec AND w0 % 8 = 0 GROUP BY 1, 2)
SELECT machine, w0, share >= 0.5 AS kept FROM o""")
def met_pa_k(spark, sf):
    """Window decisions that cover at least half of a fault."""
    w = S.by().rowsBetween(0, 15)
    t = telemetry(spark, sf).select("machine", F.col("step").alias("w0"), (F.col("step") + 16).alias("w1"), (F.max("cents").over(w) > 30000).alias("dec")).filter("w0 % 8 = 0 and dec")
    return me.covering_share(t, faults(spark, sf), ("machine",)).select("machine", "w0", (F.col("share") >= 0.5).alias("kept"))


@query(f"""WITH {TEL}, {FAULTS}, d AS (SELECT f.machine, class, min(step) - min(t0) AS delay FROM faults f JOIN tel ON tel.machine = f.machine AND step >= t0 AND state = 'DOWN' GROUP BY f.machine, class)
SELECT class, quantile_cont(delay, 0.5) AS med, quantile_cont(delay, 0.9) AS p90, max(delay) AS worst FROM d GROUP BY class""")
def met_ttd(spark, sf):
    return me.delays(faults(spark, sf), telemetry(spark, sf).filter("state = 'DOWN'").select("machine", "step"), "machine", "class")


@query(f"""WITH {SCORES}, r AS (SELECT fam, count(*) FILTER (WHERE score >= 0.6 AND y = 1) AS tp, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE score >= 0.6 AND y = 0) AS fp, count(*) FILTER (WHERE y = 0) AS q FROM scores GROUP BY fam)
SELECT fam, round(ln(CAST(tp + 1 AS DOUBLE) / (p + 2) / (CAST(fp + 1 AS DOUBLE) / (q + 2))), 6) AS w_plus, round(ln((1 - CAST(tp + 1 AS DOUBLE) / (p + 2)) / (1 - CAST(fp + 1 AS DOUBLE) / (q + 2))), 6) AS w_minus,
 round(CAST(p + q AS DOUBLE) / (p + q + 20) * (CAST(tp + 1 AS DOUBLE) / (p + 2)) + 20.0 / (p + q + 20) * 0.5, 6) AS shrunk FROM r""")
def fus_reliability(spark, sf):
    """Laplace reliabilities, their log odds as votes, and shrinkage towards a half."""
    c = me.counts(F.col("score") >= 0.6, F.col("y") == 1)
    g = scores(spark, sf).groupBy("fam").agg(c["tp"].alias("tp"), F.count_if(F.col("y") == 1).alias("p"), c["fp"].alias("fp"), F.count_if(F.col("y") == 0).alias("q"))
    d, a = fusion.laplace(F.col("tp"), F.col("p")), fusion.laplace(F.col("fp"), F.col("q"))
    plus, minus = fusion.vote_weights(d, a)
    return g.select("fam", F.round(plus, 6).alias("w_plus"), F.round(minus, 6).alias("w_minus"), F.round(fusion.shrunk(d, F.lit(0.5), F.col("p") + F.col("q")), 6).alias("shrunk"))


@query(f"WITH {SCORES} SELECT id, CASE WHEN score >= 0.3 THEN CAST(2 AS DOUBLE) ELSE CAST(-0.5 AS DOUBLE) END + CASE WHEN id % 3 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END > 1.5 AS weighted, CAST(score >= 0.3 AS INT) + CAST(id % 3 = 0 AS INT) + CAST(fam = 'en' AS INT) >= 2 AS two_of_three FROM scores")
def fus_votes(spark, sf):
    a, b, c = F.col("score") >= 0.3, F.col("id") % 3 == 0, F.col("fam") == "en"
    return scores(spark, sf).select("id", fusion.weighted_vote([(a, 2.0, -0.5), (b, 1.0, -1.0)], 1.5).alias("weighted"), fusion.at_least([a, b, c], 2).alias("two_of_three"))


def _experts(spark, sf):
    """Two experts' scores of the labelled documents."""
    return scores(spark, sf).select("id", "ep", "fam", "y", F.col("score").alias("s1"), ((F.col("id") * 7 % 89 + F.col("y") * 20) / 64.0).alias("s2"), (F.col("y") == 0).alias("clean"))


def _each(form: str) -> str:
    return ", ".join(form.replace("#", k) for k in "12")


@query(f"""WITH {SCORES}, s AS (SELECT id, ep, fam, y, score AS s1, CAST(id * 7 % 89 + y * 20 AS DOUBLE) / 64 AS s2 FROM scores),
 q AS (SELECT ep, {_each("quantile_cont(s#, 0.25) AS a#, quantile_cont(s#, 0.5) AS m#, quantile_cont(s#, 0.75) AS b#")} FROM s GROUP BY ep),
 n AS (SELECT s.*, {_each("(s# - m#) / greatest(b# - a#, 1e-9) AS n#")} FROM s JOIN q ON q.ep = s.ep),
 t AS (SELECT {_each("quantile_cont(n#, 0.99) AS t#, quantile_cont(n#, 0.5) AS m#, quantile_cont(n#, 0.75) - quantile_cont(n#, 0.25) AS i#")} FROM n WHERE y = 0),
 z AS (SELECT id, fam, y, {_each("n# > t# AS d#, (n# - m#) / (CASE WHEN i# = 0 THEN 1 ELSE i# END + 1e-9) AS z#")} FROM n, t),
 f AS (SELECT fam, CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) AS p, CAST(count(*) FILTER (WHERE y = 0) AS DOUBLE) AS n, {_each("CAST(count(*) FILTER (WHERE d# AND y = 1) AS DOUBLE) AS tp#, CAST(count(*) FILTER (WHERE d# AND y = 0) AS DOUBLE) AS fp#")} FROM z GROUP BY fam),
 a AS (SELECT sum(p) AS p, sum(n) AS n, {_each("sum(tp#) AS tp#, sum(fp#) AS fp#")} FROM f),
 w AS (SELECT f.fam, {_each("greatest(CAST(0 AS DOUBLE), (f.p + f.n) / (f.p + f.n + 20) * ((f.tp# + 1) / (f.p + 2) - (f.fp# + 1) / (f.n + 2)) + 20 / (f.p + f.n + 20) * ((a.tp# + 1) / (a.p + 2) - (a.fp# + 1) / (a.n + 2))) AS w#")} FROM f, a),
 u AS (SELECT id, z.fam, y, w1 * z1 + w2 * z2 AS fused FROM z JOIN w ON w.fam = z.fam),
 r AS (SELECT fam, fused, CAST(sum(y) OVER (PARTITION BY fam ORDER BY fused DESC) AS DOUBLE) AS tp, CAST(sum(y) OVER (PARTITION BY fam) AS DOUBLE) AS pos FROM u),
 h AS (SELECT fam, CASE WHEN max(pos) = 0 THEN max(fused) ELSE coalesce(max(fused) FILTER (WHERE tp >= CAST(0.7 AS DOUBLE) * pos), min(fused)) END AS thr FROM r GROUP BY fam),
 g AS (SELECT u.fam, count(*) FILTER (WHERE fused >= thr AND y = 1) AS tp, CAST(count(*) FILTER (WHERE fused >= thr) AS DOUBLE) AS k, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(y) AS DOUBLE) / count(*) AS rate FROM u JOIN h ON h.fam = u.fam GROUP BY u.fam)
SELECT id, round(fused, 6) AS fused_score, u.fam = 'fr' OR (fused >= thr AND coalesce(2 * tp / nullif(k + pos, 0), 0) >= CASE WHEN rate > 0 THEN 2 * rate / (1 + rate) ELSE 0 END + 0.02) AS fused FROM u JOIN h ON h.fam = u.fam JOIN g ON g.fam = u.fam""")
def fus_soft(spark, sf):
    """Soft fusion of two experts by informedness, thresholds of the quantile arm."""
    f = fusion.soft(_experts(spark, sf), ["s1", "s2"], protected=("fr",))
    return f.select("id", F.round("fused_score", 6).alias("fused_score"), "fused")


@query()
def fus_soft_three_arms(spark, sf):
    """The same with the vote of all three arms; tests compare its thresholds with the arms' own."""
    f = fusion.soft(_experts(spark, sf), ["s1", "s2"], protected=("fr",), arm=fusion.three_arms)
    return f.select("id", F.round("fused_score", 6).alias("fused_score"), "fused")


@query(f"""WITH {TEL}, {FAULTS}, x AS (SELECT *, cents // 10000 AS v, state = 'DOWN' AS d, sum(tput) {ROWS} AS gt FROM tel), {_islands('v', 'iv', 'x')}, {_islands('d', 'idn', 'x')},
 c AS (SELECT iv.machine, iv.step, row_number() OVER (PARTITION BY iv.machine, iv.gt ORDER BY iv.step) - CASE WHEN iv.gt = 0 THEN 0 ELSE 1 END AS cycle_lag, row_number() OVER (PARTITION BY iv.machine, iv.island ORDER BY iv.step) - 1 AS stale_run,
  CASE WHEN idn.d THEN row_number() OVER (PARTITION BY idn.machine, idn.island ORDER BY idn.step) ELSE 0 END AS down_run FROM iv JOIN idn ON idn.machine = iv.machine AND idn.step = iv.step),
 w AS (SELECT machine, step - 15 AS start, max(cents) {FR} > 30000 AS dec FROM tel),
 k AS (SELECT w.machine, w.start, max(CASE class WHEN 'delay' THEN CAST(cycle_lag >= 5 AS INT) WHEN 'loss' THEN CAST(stale_run >= 1 AS INT) WHEN 'breakdown' THEN CAST(down_run >= 1 AS INT) ELSE 1 END) = 1 AS ok, any_value(dec) AS dec, any_value(coalesce(class, 'none')) AS family
  FROM w LEFT JOIN faults f ON f.machine = w.machine JOIN c ON c.machine = w.machine AND c.step BETWEEN w.start AND w.start + 15 WHERE start >= 0 AND start % 8 = 0 GROUP BY 1, 2)
SELECT machine, start, family, dec AND ok AS kept FROM k""")
def fus_hybrid_gate(spark, sf):
    """Structural families need their own counter inside the window to confirm the decision."""
    t = telemetry(spark, sf).withColumn("v", F.expr("cents div 10000"))
    t = sq.since(t, F.col("tput") > 0, out="cycle_lag")
    t = sq.run_while(sq.repeats(t, "v", out="stale_run"), F.col("state") == "DOWN", out="down_run")
    w = t.select("machine", (F.col("step") - 15).alias("start"), (F.max("cents").over(S.last(16)) > 30000).alias("dec")).filter("start >= 0 and start % 8 = 0")
    w = w.join(faults(spark, sf).select("machine", F.col("class").alias("family")), "machine", "left").fillna("none", "family")
    return fusion.hybrid_gate(w, t, 16).select("machine", "start", "family", "kept")


_BATTERY = f"""m AS (SELECT 'F1 ' || fam AS metric, coalesce(2.0 * count(*) FILTER (WHERE score >= 0.6 AND y = 1) / nullif(count(*) FILTER (WHERE score >= 0.6) + count(*) FILTER (WHERE y = 1), 0), 0) AS value FROM scores GROUP BY fam
 UNION ALL SELECT 'flip_' || fam, CAST(count(*) FILTER (WHERE score >= 0.5 AND score < 0.6) AS DOUBLE) / count(*) FROM scores GROUP BY fam
 UNION ALL SELECT CASE WHEN ep % 2 = 0 THEN 'AC@1-intra' ELSE 'AC@1 cross' END, avg(top) FROM (SELECT ep, max_by(y, score * 1000000 - id) AS top FROM scores GROUP BY ep) GROUP BY 1
 UNION ALL SELECT 'p99_latency', quantile_cont(first, 0.99) FROM (SELECT machine, min(step) AS first FROM tel WHERE state = 'DOWN' GROUP BY machine)
 UNION ALL SELECT 'wall_s', max(step) FROM tel UNION ALL SELECT 'unknown thing', 1)"""


@query(f"""WITH {SCORES}, {TEL}, {_BATTERY}, c AS (SELECT CASE WHEN metric LIKE 'F1%' THEN 'F1' WHEN metric LIKE 'AC@1%' THEN 'AC@1' WHEN metric LIKE 'flip%' THEN 'flip' WHEN metric LIKE 'p99%' THEN 'p99' WHEN metric LIKE 'wall%' THEN 'wall' END AS gate,
  CASE WHEN metric LIKE 'AC@1%' OR metric LIKE 'flip%' THEN substr(metric, 6) END AS part, value FROM m),
 g AS (SELECT gate, part, CASE WHEN gate IN ('F1', 'AC@1') THEN min(value) ELSE max(value) END AS worst FROM c WHERE gate IS NOT NULL GROUP BY 1, 2),
 o AS (SELECT *, CASE gate WHEN 'F1' THEN worst >= 0.85 WHEN 'AC@1' THEN worst >= 0.7 WHEN 'flip' THEN worst < 0.4 WHEN 'p99' THEN worst <= 3 ELSE worst < 600 END AS ok FROM g)
SELECT gate, part, round(worst, 6) AS worst, ok, CASE WHEN ok THEN 0 ELSE CASE gate WHEN 'F1' THEN 10 WHEN 'AC@1' THEN 11 WHEN 'flip' THEN 12 WHEN 'p99' THEN 13 ELSE 14 END END AS code FROM o UNION ALL SELECT 'grounding', NULL, NULL, false, 15""")
def agg_gates(spark, sf):
    """All gates over a battery of named metrics; one of them has no values."""
    s, t = scores(spark, sf), telemetry(spark, sf)
    c = me.counts(F.col("score") >= 0.6, F.col("y") == 1)
    m = s.groupBy("fam").agg(c["tp"].alias("tp"), c["fp"].alias("fp"), c["fn"].alias("fn"), (F.count_if((F.col("score") >= 0.5) & (F.col("score") < 0.6)) / F.count("*")).alias("flip"))
    rows = m.select(F.concat(F.lit("F1 "), "fam").alias("metric"), me.f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("value")).unionByName(m.select(F.concat(F.lit("flip_"), "fam").alias("metric"), F.col("flip").alias("value")))
    top = s.groupBy("ep").agg(F.max_by("y", F.struct("score", -F.col("id"))).alias("top")).groupBy(F.when(F.col("ep") % 2 == 0, "AC@1-intra").otherwise("AC@1 cross").alias("metric")).agg(F.avg("top").alias("value"))
    first = t.filter("state = 'DOWN'").groupBy("machine").agg(F.min("step").alias("first")).agg(F.percentile("first", F.lit(0.99)).alias("value"))
    rows = rows.unionByName(top).unionByName(first.select(F.lit("p99_latency").alias("metric"), "value"))
    rows = rows.unionByName(t.agg(F.max("step").cast("double").alias("value")).select(F.lit("wall_s").alias("metric"), "value")).unionByName(spark.range(1).select(F.lit("unknown thing").alias("metric"), F.lit(1.0).alias("value")))
    return gates.evaluated(rows).withColumn("worst", F.round("worst", 6))


_SINCE = "date_diff('second', TIMESTAMP '2024-01-01', ts)"


@query(f"WITH w AS (SELECT user_id AS machine, max({_SINCE}) - min({_SINCE}) AS wall FROM events GROUP BY 1) SELECT machine, wall FROM w WHERE wall > (SELECT CAST(sum(wall) AS DOUBLE) / count(*) FROM w) * 1.02")
def agg_wall_budget(spark, sf):
    """Entities whose elapsed seconds are over the mean's budget."""
    at = F.timestamp_diff("SECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts"))
    return gates.over_budget(read(spark, sf, "events").groupBy(F.col("user_id").alias("machine")).agg((F.max(at) - F.min(at)).alias("wall")))


@query(f"""WITH {SCORES}, g AS (SELECT fam, coalesce(2.0 * count(*) FILTER (WHERE score >= 0.6 AND y = 1) / nullif(count(*) FILTER (WHERE score >= 0.6) + count(*) FILTER (WHERE y = 1), 0), 0) AS f1, CAST(count(*) FILTER (WHERE score >= 0.6 AND y = 0) AS DOUBLE) / nullif(count(*) FILTER (WHERE y = 0), 0) AS fpr FROM scores GROUP BY fam),
 w AS (SELECT fam || ' f1' AS id, f1 AS metric, CAST(0.61 AS DOUBLE) AS bar, true AS up FROM g UNION ALL SELECT fam || ' fpr', fpr, CAST(0.43 AS DOUBLE), false FROM g)
SELECT id, round(metric, 4) AS metric, bar, CASE WHEN CASE WHEN up THEN metric >= bar ELSE metric <= bar END THEN 'Survived' ELSE 'Falsified' END AS status FROM w""")
def agg_adjudicate(spark, sf):
    """Hypotheses of two directions on each family."""
    c = me.counts(F.col("score") >= 0.6, F.col("y") == 1)
    g = scores(spark, sf).groupBy("fam").agg(me.f1(c["tp"], c["fp"], c["fn"]).alias("f1"), F.try_divide(c["fp"].cast("double"), F.count_if(F.col("y") == 0)).alias("fpr"))
    wire = lambda name, bar, up: F.struct(F.concat("fam", F.lit(f" {name}")).alias("id"), F.col(name).alias("metric"), F.lit(bar).alias("bar"), F.lit(up).alias("higher_is_better"))
    wires = g.select(F.inline(F.array(wire("f1", 0.61, True), wire("fpr", 0.43, False))))
    return gates.adjudicated(wires).select("id", F.round("metric", 4).alias("metric"), "bar", "status")


@query(f"""WITH {SCORES}, m AS (SELECT fam AS c, avg(score) AS m FROM scores GROUP BY fam), n AS (SELECT id, fam, c, row_number() OVER (PARTITION BY id ORDER BY abs(score - m), c) AS k FROM scores, m WHERE y = 1)
SELECT count(*) AS n, round(CAST(count(*) FILTER (WHERE c = fam) AS DOUBLE) / count(*), 6) AS accuracy FROM n WHERE k = 1""")
def rst_attribution(spark, sf):
    """How often the family of the nearest mean is the true one among positives."""
    return me.attribution(me.nearest_class(scores(spark, sf), "score", "fam"), "predicted", "fam", "y").withColumn("accuracy", F.round("accuracy", 6))


@query("""WITH a AS (SELECT event_id, '  ' || upper(event_type) || chr(9) AS part, CASE WHEN event_id % 2 = 0 THEN ' ' || props || ' ' WHEN event_id % 3 = 0 THEN NULL ELSE ' ' || event_type || ' ' END AS spec FROM events)
SELECT event_id, lower(trim(part, chr(9) || ' ')) AS part, CASE WHEN spec IS NULL THEN NULL WHEN json_valid(spec) AND json_type(spec) IN ('OBJECT', 'ARRAY') THEN 'json' ELSE 'text' END AS kind, trim(spec) AS spec FROM a""")
def rst_arguments(spark, sf):
    """Replay arguments: a partition in any case, a subgraph as JSON or text."""
    e = read(spark, sf, "events").select("event_id", F.concat(F.lit("  "), F.upper("event_type"), F.lit("\t")).alias("part"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" "), "props", F.lit(" "))).when(F.col("event_id") % 3 != 0, F.concat(F.lit(" "), "event_type", F.lit(" "))).alias("spec"))
    spec = contracts.parsed_spec(F.col("spec"))
    return e.select("event_id", contracts.normal_name(F.col("part"), ("view", "click", "purchase", "signup", "error")).alias("part"), spec["kind"].alias("kind"), spec["spec"].alias("spec"))


@query(f"WITH {FAULTS} SELECT machine, 7 * 1000 + row_number() OVER (ORDER BY machine) - 1 AS seed, CASE class WHEN 'quality' THEN 'quality_drop' ELSE class END AS fault_class FROM faults")
def rst_seed_rule(spark, sf):
    """Seed = master * 1000 + row of the manifest; an alias for one class."""
    f = numbered(faults(spark, sf), "machine", "row")
    return f.select("machine", (7000 + F.col("row")).alias("seed"), F.when(F.col("class") == "quality", "quality_drop").otherwise(F.col("class")).alias("fault_class"))


@query("SELECT user_id, list_reduce(list_prepend(0, list_transform(range(1, 65), lambda i: instr('0123456789abcdef', substr(sha256(CAST(user_id AS VARCHAR)), i, 1)) - 1)), lambda a, d: (a * 16 + d) % 100) AS bucket FROM (SELECT DISTINCT user_id FROM events)")
def fn_hash_bucket(spark, sf):
    u = read(spark, sf, "events").select("user_id").distinct()
    return u.select("user_id", contracts.bucket_of(F.col("user_id").cast("string")).alias("bucket"))


@query(f"""WITH RECURSIVE {TEL}, r AS (SELECT machine, step, obs AS anchor, CAST(0 AS BIGINT) AS stale FROM tel WHERE step = 0 UNION ALL
 SELECT t.machine, t.step, CASE WHEN abs(t.obs - r.anchor) <= 40 THEN r.anchor ELSE t.obs END, CASE WHEN abs(t.obs - r.anchor) <= 40 THEN r.stale + 1 ELSE 0 END FROM r JOIN tel t ON t.machine = r.machine AND t.step = r.step + 1)
SELECT machine, step, stale FROM r""")
def win_stale_anchored(spark, sf):
    return sq.anchored_repeats(telemetry(spark, sf), "obs", 40.0)


@query(f"""WITH {TEL}, w AS (SELECT machine, step, sum(cents % 7 - 3) {ROWS} AS walk, count(*) OVER (PARTITION BY machine) AS n FROM tel), e AS (SELECT machine, max_by(walk, step) AS last FROM w GROUP BY machine)
SELECT w.machine, step, round(walk - CASE WHEN n > 1 THEN CAST(step AS DOUBLE) / (n - 1) * last ELSE 0 END, 6) AS drift FROM w JOIN e ON e.machine = w.machine""")
def win_drift(spark, sf):
    """A random walk of each entity's noise, bridged so that it ends where it began."""
    return sq.bridged_walk(telemetry(spark, sf).withColumn("noise", F.col("cents") % 7 - 3), "noise").select("machine", "step", F.round("drift", 6).alias("drift"))


_TAILS = ("A9", "B9", "C7", "PKG1", "PKG2")


@query(f"WITH {FLEET}, m AS (SELECT DISTINCT user_id AS machine FROM events) SELECT m.machine, CASE WHEN name IN {_TAILS} THEN 'AGV' WHEN class IS NULL THEN 'unknown' WHEN class IN ('feed', 'form') THEN 'never-diverts' ELSE 'SBUF-eligible' END AS path FROM m LEFT JOIN fleet f ON f.machine = m.machine AND m.machine % 27 < 26")
def prj_tail_path(spark, sf):
    """Where a machine's output goes; a machine that isn't in the roster is unknown."""
    f = fleet(spark, sf).withColumn("name", F.when(F.col("machine") % 27 < 26, F.col("name")).otherwise(F.concat(F.lit("X"), F.col("machine").cast("string"))))
    paths = detect.tail_path(f.select(F.col("name").alias("machine")).distinct(), machines(spark)).withColumnRenamed("machine", "name")
    return f.join(paths, "name").select("machine", "path")


@query(f"WITH {TEL}, k AS (SELECT machine, machine % 3 AS line, count(*) FILTER (WHERE state = 'STARVED') AS kit, count(*) FILTER (WHERE state = 'BLOCKED') AS waiting FROM tel GROUP BY 1) SELECT line, machine, row_number() OVER (PARTITION BY line ORDER BY kit + CASE WHEN machine % 5 = 0 THEN -10 ELSE 0 END, -waiting, machine) AS place FROM k")
def srt_tail_priority(spark, sf):
    """The order in which tails are served: the emptiest kit first, rework ahead by ten, then the longest queue."""
    n = lambda state: F.count_if(F.col("state") == state)
    k = telemetry(spark, sf).groupBy("machine").agg(n("STARVED").alias("kit"), n("BLOCKED").alias("waiting")).withColumn("line", F.col("machine") % 3)
    return detect.tail_order(k, ("line",), F.col("kit"), F.col("waiting"), F.col("machine") % 5 == 0, "machine").select("line", "machine", "place")
