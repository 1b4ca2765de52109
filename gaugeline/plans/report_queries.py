"""Queries of whole-episode scoring, ledgers, reports and the remaining small operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions.dims import EDGES, MACHINES, edges, machines, sql_values
from gaugeline.operators import calibrate as cal
from gaugeline.operators import causal, detect, episodes, flow, labels, validate
from gaugeline.operators import metrics as me
from gaugeline.operators import sequence as sq
from gaugeline.plans.base import query
from gaugeline.plans.detect_queries import FIT, SCORED, good
from gaugeline.plans.flow_queries import partition_of
from gaugeline.sources.adapters import CAL_END, FAULTS, FLEET, GRID, SCORES, TEL, faults, fleet_edges, fleet_edges_sql, grid, read, scores, telemetry

S = sq.TELEMETRY
OVER = "OVER (PARTITION BY machine ORDER BY step"
_MACH = sql_values([(k, *m) for k, m in enumerate(MACHINES)], "idx, machine, class, base, sigma, cycle, mttf, mttr")

EPISODE = f"""{TEL}, {FAULTS}, {FIT}, {SCORED}, d AS (SELECT machine, step, alarm AND sum(CAST(alarm OR state = 'DOWN' AS INT)) {OVER} ROWS 5 PRECEDING) >= 2 OR state = 'DOWN' AND sum(CAST(alarm OR state = 'DOWN' AS INT)) {OVER} ROWS 5 PRECEDING) >= 2 AS dec FROM al),
 l AS (SELECT d.machine, d.step, dec, f.class IS NOT NULL AS y FROM d LEFT JOIN faults f ON f.machine = d.machine AND step >= t0 AND step < t1 WHERE step >= {CAL_END}),
 e AS (SELECT machine, count(*) FILTER (WHERE dec AND y) AS tp, count(*) FILTER (WHERE dec AND NOT y) AS fp, count(*) FILTER (WHERE NOT dec AND y) AS fn, min(step) FILTER (WHERE dec AND y) AS first_hit FROM l GROUP BY machine)"""


def episode_scores(spark, sf):
    return episodes.scored_episodes(telemetry(spark, sf), faults(spark, sf), good(), CAL_END)


_ROWS = "ROWS UNBOUNDED PRECEDING)"
FULL = f"""{TEL}, {FAULTS}, {FIT}, {SCORED}, ga AS (SELECT *, sum(tput) {OVER} {_ROWS} AS gt, CASE WHEN state = 'DOWN' AND lag(state) {OVER}) = 'DOWN' THEN 0 ELSE 1 END AS nw, CASE WHEN lag(cents // 10000) {OVER}) = cents // 10000 THEN 0 ELSE 1 END AS sw FROM al),
 gb AS (SELECT *, sum(nw) {OVER} {_ROWS} AS di, sum(sw) {OVER} {_ROWS} AS si FROM ga),
 gc AS (SELECT *, row_number() OVER (PARTITION BY machine, gt ORDER BY step) - CASE WHEN gt = 0 THEN 0 ELSE 1 END AS lag_, CASE WHEN state = 'DOWN' THEN row_number() OVER (PARTITION BY machine, di ORDER BY step) ELSE 0 END AS dn, row_number() OVER (PARTITION BY machine, si ORDER BY step) - 1 AS st FROM gb),
 cu AS (SELECT *, sum(CASE WHEN state = 'DOWN' AND cents > 10000 THEN CAST(ln(CAST(0.25 AS DOUBLE) * 402) AS DOUBLE) ELSE CAST(ln(CAST(0.75 AS DOUBLE) / (1 - CAST(1 AS DOUBLE) / 402)) AS DOUBLE) END) {OVER} {_ROWS} AS c FROM gc),
 arms AS (SELECT machine // 5 AS ep, machine, step, score, alarm AS quantile, (lag_ >= 10 AND state = 'RUN') OR st >= 6 OR (lag_ >= 5 AND st >= 1) OR dn >= 3 AS structural, cents > 30000 AS ml, c - least(0, min(c) {OVER} {_ROWS}) >= 3 AS cusum FROM cu),
 ff AS (SELECT machine // 5 AS ep, min(machine) AS origin, arg_min(class, machine) AS class, arg_min(t0, machine) AS t0, arg_min(t1, machine) AS t1 FROM faults WHERE machine // 5 % 4 <> 0 GROUP BY 1),
 es AS (SELECT ep, step, bool_or(quantile) AS quantile, bool_or(structural) AS structural, bool_or(ml) AS ml, bool_or(cusum) AS cusum FROM arms GROUP BY 1, 2),
 ed AS (SELECT *, (quantile OR structural OR ml) AND sum(CAST(quantile OR structural OR ml AS INT)) OVER (PARTITION BY ep ORDER BY step ROWS 5 PRECEDING) >= 3 OR cusum AS d FROM es),
 ej AS (SELECT ed.*, class, origin, coalesce(step >= t0 AND step < t1, false) AS y, coalesce(step >= t0 AND step < t1 + 5, false) AS near FROM ed LEFT JOIN ff ON ff.ep = ed.ep),
 ew AS (SELECT ep, class, origin, count(*) FILTER (WHERE d AND y AND step >= {CAL_END}) AS tp, count(*) FILTER (WHERE d AND NOT y AND step >= {CAL_END}) AS fp, count(*) FILTER (WHERE NOT d AND y AND step >= {CAL_END}) AS fn, bool_or(d AND near) AS hit, bool_or(ml AND near) AS ml, bool_or(cusum AND near) AS cusum FROM ej GROUP BY 1, 2, 3),
 eh AS (SELECT a.*, origin, t0, t1 FROM arms a JOIN ff ON ff.ep = a.ep AND step >= t0 AND step < t1 + 5),
 eo AS (SELECT ep, bool_or(quantile) AS quantile, bool_or(structural) AS structural FROM eh WHERE machine = origin GROUP BY 1),
 ep AS (SELECT ep, machine, max(score) FILTER (WHERE step < t1) AS peak, min(step - t0) FILTER (WHERE score > 0) AS first FROM eh GROUP BY 1, 2),
 er AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY peak DESC, machine) AS rk FROM ep WHERE peak IS NOT NULL),
 et AS (SELECT a.ep, CASE WHEN a.machine % 3 = 0 AND b.peak > 0 AND a.peak < 2 * b.peak THEN b.machine ELSE a.machine END AS top FROM (SELECT * FROM er WHERE rk = 1) a LEFT JOIN (SELECT * FROM er WHERE rk = 2) b ON b.ep = a.ep),
 full_ AS (SELECT ew.ep, class, origin, tp, fp, fn, hit, et.top, CASE WHEN class IS NOT NULL THEN coalesce(ep.first, 999) END AS latency, coalesce(quantile, false) AS quantile, coalesce(structural, false) AS structural, ml, cusum
  FROM ew LEFT JOIN eo ON eo.ep = ew.ep LEFT JOIN et ON et.ep = ew.ep LEFT JOIN ep ON ep.ep = et.ep AND ep.machine = et.top)"""


def _full(spark, sf):
    t = telemetry(spark, sf)
    d = detect.exceedance(t, cal.tukey_fit(t, good(), ("machine",)), F.col("state") == "DOWN", ("machine",)).withColumn("v", F.expr("cents div 10000"))
    d = sq.since(sq.run_while(sq.repeats(d, "v"), F.col("state") == "DOWN"), F.col("tput") > 0)
    gates = detect.structural_gates(F.col("tputlag"), F.col("stale"), F.col("downrun"), F.col("state") == "RUN")
    gate = F.lit(False)
    for g in gates.values():
        gate = gate | g
    d = d.withColumns({"quantile": F.col("alarm"), "structural": gate, "ml": F.col("cents") > 30000}).drop("alarm")
    d = sq.bernoulli_cusum(d, (F.col("state") == "DOWN") & (F.col("cents") > 10000), 1 / 402, 0.25, 3.0).withColumn("cusum", F.col("alarm"))
    arms = d.select(F.floor(F.col("machine") / F.lit(5)).alias("ep"), "machine", "step", "score", *episodes.ARMS)
    f = faults(spark, sf).withColumn("ep", F.floor(F.col("machine") / F.lit(5))).filter("ep % 4 <> 0")
    f = f.groupBy("ep").agg(F.min(F.struct(F.col("machine").alias("origin"), "class", "t0", "t1")).alias("x")).select("ep", "x.*")
    return episodes.full_scores(arms, f, CAL_END, F.col("machine") % 3 == 0)


@query(f"WITH {FULL} SELECT * FROM full_")
def det_full_scores(spark, sf):
    """Episodes of five entities with one fault at most: the decision of all arms, the entity to blame, and what each arm saw."""
    return _full(spark, sf)


@query(f"WITH {FULL} SELECT class, count(*) AS n, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE top = origin AND latency <= 5) AS ac1, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, count(*) FILTER (WHERE quantile) AS quantile, count(*) FILTER (WHERE structural) AS structural, count(*) FILTER (WHERE ml) AS ml, count(*) FILTER (WHERE cusum) AS cusum FROM full_ GROUP BY class")
def det_full_battery(spark, sf):
    """The same by class: hits, the right entity named in time, errors, and hits of each arm; clean episodes have no class."""
    return episodes.full_battery(_full(spark, sf))


@query(f"WITH {EPISODE} SELECT machine, tp, fp, fn, first_hit, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM e")
def det_episode_score(spark, sf):
    return episode_scores(spark, sf).withColumn("f1", F.round(me.f1(F.col("tp"), F.col("fp"), F.col("fn")), 6))


@query(f"""WITH {EPISODE} SELECT class, count(*) AS n, count(*) FILTER (WHERE tp > 0) AS hits, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
 round(CAST(sum(first_hit - t0) AS DOUBLE) / nullif(count(first_hit), 0), 6) AS latency FROM e LEFT JOIN faults f ON f.machine = e.machine GROUP BY class""")
def det_battery(spark, sf):
    return episodes.battery(episode_scores(spark, sf), faults(spark, sf)).withColumn("latency", F.round("latency", 6))


LEDGER = f"""{TEL}, {FAULTS}, i AS (SELECT 'failure' AS kind, machine, step FROM tel WHERE state = 'DOWN' UNION ALL
 SELECT 'sensor', machine, step FROM (SELECT machine, step, row_number() OVER (PARTITION BY machine, step // 10 ORDER BY step) AS n FROM tel WHERE cents > 30000) WHERE n = 1 UNION ALL
 SELECT 'transport', machine, step FROM (SELECT machine, step, row_number() OVER (PARTITION BY machine, step // 5 ORDER BY step) AS n FROM tel WHERE state = 'BLOCKED') WHERE n = 1 UNION ALL SELECT 'label', machine, t0 FROM faults)"""


def ledger(spark, sf):
    """Incidents of four kinds; sensor and transport ones are debounced."""
    return episodes.incidents(telemetry(spark, sf), faults(spark, sf), F.col("cents") > 30000)


@query(f"WITH {LEDGER} SELECT kind, machine, step FROM i")
def det_incidents(spark, sf):
    return ledger(spark, sf)


@query(f"WITH {LEDGER} SELECT machine, count(*) FILTER (WHERE kind = 'failure') AS failure, count(*) FILTER (WHERE kind = 'sensor') AS sensor, count(*) FILTER (WHERE kind = 'transport') AS transport, count(*) FILTER (WHERE kind = 'label') AS label FROM i GROUP BY machine")
def agg_incident_counts(spark, sf):
    return episodes.counted(ledger(spark, sf), "machine", "kind", ("failure", "sensor", "transport", "label"))


@query("SELECT event_id, user_id, event_type FROM events WHERE user_id % 3 = 0 AND event_type IN ('purchase', 'error')")
def flt_event_feed(spark, sf):
    return episodes.event_feed(read(spark, sf, "events"), F.col("user_id") % 3 == 0, ("purchase", "error")).select("event_id", "user_id", "event_type")


@query(f"WITH {TEL}, {FAULTS} SELECT tel.machine, step, CASE WHEN f.class IS NULL THEN 'natural' ELSE 'injected' END AS kind FROM tel LEFT JOIN faults f ON f.machine = tel.machine AND step >= t0 AND step < t1 WHERE state = 'DOWN'")
def prj_down_kind(spark, sf):
    return episodes.down_kind(telemetry(spark, sf), faults(spark, sf))


@query(f"WITH {TEL}, {FAULTS}, l AS (SELECT tel.machine, CASE WHEN f.class IS NULL THEN 0 ELSE 1 END AS y FROM tel LEFT JOIN faults f ON f.machine = tel.machine AND step >= t0 AND step < t1 WHERE step >= {CAL_END}) SELECT machine % 4 AS grp, round(CAST(sum(y) AS DOUBLE) / count(*), 6) AS rate, CAST(sum(y) AS DOUBLE) / count(*) <= 0.5 AS ok FROM l GROUP BY 1")
def val_positive_rate(spark, sf):
    t = telemetry(spark, sf).filter(F.col("step") >= CAL_END)
    return validate.positive_rate(t, faults(spark, sf), F.col("machine") % 4, 0.5).withColumn("rate", F.round("rate", 6))


@query(f"WITH {FAULTS}, c AS (SELECT DISTINCT user_id AS machine FROM events WHERE user_id % 4 = 0) SELECT count(*) AS shared FROM (SELECT machine FROM faults INTERSECT SELECT machine FROM c)")
def val_disjoint(spark, sf):
    clean = read(spark, sf, "events").filter("user_id % 4 = 0").select(F.col("user_id").alias("machine"))
    return validate.shared(faults(spark, sf).select("machine"), clean)


@query("SELECT count(*) FILTER (WHERE event_type IS NULL OR user_id IS NULL) AS no_key, count(*) FILTER (WHERE event_type NOT IN ('view', 'click', 'purchase', 'signup', 'error')) AS unknown, count(*) FILTER (WHERE value < 0) AS negative, count(*) FILTER (WHERE json_extract_string(props, '$.k') IS NULL) AS no_prop FROM events")
def val_event_keys(spark, sf):
    return validate.event_keys(read(spark, sf, "events"), ("view", "click", "purchase", "signup", "error"), "$.k")


@query(f"WITH {TEL} SELECT machine % 5 AS part, count(*) AS rows_, count(DISTINCT machine) AS nodes, count(*) >= 800 AS enough, count(DISTINCT machine) <= 10 AS small FROM tel GROUP BY 1")
def val_evidence_floor(spark, sf):
    return validate.evidence_floor(telemetry(spark, sf), F.col("machine") % 5, "machine")


@query(f"WITH {GRID} SELECT a.step, a.n FROM grid a JOIN grid b ON a.step = b.step AND a.channel = 'view' AND b.channel = 'signup' WHERE a.n >= 5 AND b.n <= a.n")
def jn_pile_up(spark, sf):
    g = grid(spark, sf)
    down = g.filter("channel = 'signup'").select("step", F.col("n").alias("m"))
    return g.filter("channel = 'view' and n >= 5").join(down, "step").filter("m <= n").select("step", "n")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN (SELECT c_mktsegment FROM customer WHERE c_custkey <= 3)")
def jn_protected(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return validate.protected_rows(c, "c_mktsegment", F.col("c_custkey") <= 3).select("c_custkey", "c_mktsegment")


@query(f"WITH {TEL} SELECT machine, round(CAST(count(*) FILTER (WHERE state <> 'DOWN') AS DOUBLE) / count(*), 2) AS availability, round(100.0 * count(*) FILTER (WHERE state IN ('DOWN', 'BLOCKED')) / count(*), 2) AS disruption, CAST(sum(tput) AS BIGINT) AS output FROM tel GROUP BY machine")
def agg_episode_kpis(spark, sf):
    return flow.episode_kpis(telemetry(spark, sf), ("machine",)).withColumns({c: F.round(c, 2) for c in ("availability", "disruption")})


@query(f"WITH {TEL}, m AS (SELECT m.machine, {('CASE ' + ' '.join(f'''WHEN machine LIKE '{p}%' THEN '{n}' ''' for p, n in (('ASM', 'cell'), ('INSP', 'cell'), ('RWK', 'rework'), ('PKG', 'line-C'), ('C', 'line-C'), ('A', 'line-A'), ('B', 'line-B'))) + 'END')} AS part, idx FROM {_MACH.replace(' AS t(', ' AS m(')}) SELECT part, round(100.0 * count(*) FILTER (WHERE state = 'RUN') / count(*), 2) AS util, count(DISTINCT m.machine) AS members FROM tel JOIN m ON tel.machine % 26 = m.idx GROUP BY part")
def agg_line_utilisation(spark, sf):
    m = machines(spark).select("idx", F.col("machine").alias("name"), partition_of(F.col("machine")).alias("part"))
    t = telemetry(spark, sf).select((F.col("machine") % 26).cast("int").alias("idx"), "state").join(m, "idx")
    return flow.utilisation(t, "part", "name").withColumn("util", F.round("util", 2))


@query(f"""WITH {TEL}, {FAULTS}, o AS (SELECT f.machine, class, abs(min(step) FILTER (WHERE cents > 15000 AND step >= 30) - min(t0)) AS err FROM faults f JOIN tel ON tel.machine = f.machine GROUP BY f.machine, class)
SELECT class, quantile_cont(err, 0.5) AS med, round(quantile_cont(err, 0.9), 6) AS p90, count(err) AS n FROM o GROUP BY class""")
def agg_localise_error(spark, sf):
    e = episodes.localise_error(telemetry(spark, sf), faults(spark, sf), (F.col("cents") > 15000) & (F.col("step") >= 30))
    return e.withColumn("p90", F.round("p90", 6))


def _vus(b: int) -> str:
    return f"SELECT {b} AS b, state, cents AS score, max(y) {OVER} ROWS BETWEEN {b} PRECEDING AND {b} FOLLOWING) AS y FROM l"


@query(f"""WITH {TEL}, {FAULTS}, l AS (SELECT tel.machine, step, state, cents, CASE WHEN f.class IS NULL THEN 0 ELSE 1 END AS y FROM tel LEFT JOIN faults f ON f.machine = tel.machine AND step >= t0 AND step < t1),
 s AS ({_vus(0)} UNION ALL {_vus(4)} UNION ALL {_vus(8)}),
 q AS (SELECT b, sum(y) AS pos, {", ".join(f"quantile_cont(score, CAST({k} AS DOUBLE) / 49) AS q{k}" for k in range(50))} FROM s GROUP BY b),
 t AS (SELECT DISTINCT b, pos, unnest([{", ".join(f"q{k}" for k in range(50))}]) AS thr FROM q WHERE pos > 0),
 p AS (SELECT t.b, t.thr, CAST(sum(y) FILTER (WHERE score >= thr) AS DOUBLE) / max(pos) AS r, coalesce(CAST(sum(y) FILTER (WHERE score >= thr) AS DOUBLE) / nullif(count(*) FILTER (WHERE score >= thr), 0), 1) AS p FROM t JOIN s ON s.b = t.b GROUP BY t.b, t.thr),
 a AS (SELECT b, r, p, thr AS o FROM p UNION ALL SELECT DISTINCT b, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), CAST(1e300 AS DOUBLE) FROM t UNION ALL SELECT DISTINCT b, CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), CAST(-1e300 AS DOUBLE) FROM t),
 m AS (SELECT b, r - lag(r) OVER (PARTITION BY b ORDER BY r, o DESC) AS dr, max(p) OVER (PARTITION BY b ORDER BY r, o DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best FROM a)
SELECT b, round(sum(coalesce(dr * best, 0)), 6) AS pr_auc FROM m GROUP BY b""")
def met_vus_pr(spark, sf):
    """Range PR-AUC at three dilations of the labels; their mean is the volume."""
    t = labels.active(telemetry(spark, sf), faults(spark, sf))
    for b in (0, 4, 8):
        t = sq.dilated(t, F.col("y") == 1, b, out=f"y{b}")
    t = t.select(F.col("cents").cast("double").alias("score"), F.inline(F.array(*[F.struct(F.lit(b).alias("b"), F.col(f"y{b}").alias("y")) for b in (0, 4, 8)])))
    return me.range_pr_auc(t, "score", "y", ("b",)).withColumn("pr_auc", F.round("pr_auc", 6))


@query(f"""WITH {SCORES}, h AS (SELECT fam, id % 2 AS half, score, y FROM scores), r AS (SELECT fam, half, y, rank() OVER (PARTITION BY fam, half ORDER BY score) AS rk, count(*) OVER (PARTITION BY fam, half, score) AS k FROM h),
 s AS (SELECT fam, half, sum((2 * rk + k - 1) * y) AS r2, sum(y) AS p, count(*) - sum(y) AS q FROM r GROUP BY fam, half), a AS (SELECT fam, half, CAST(r2 - p * (p + 1) AS DOUBLE) / nullif(2.0 * p * q, 0) AS auc FROM s)
SELECT x.fam, round(x.auc, 6) AS before, round(z.auc, 6) AS after_, CASE WHEN z.auc >= x.auc - 0.05 THEN 'retained' ELSE 'lost' END AS verdict FROM a x JOIN a z ON x.fam = z.fam AND x.half = 0 AND z.half = 1""")
def met_retention(spark, sf):
    return episodes.retention(scores(spark, sf), "fam", F.col("id") % 2 == 1).withColumns({c: F.round(c, 6) for c in ("before", "after_")})


@query(f"""WITH {TEL}, {FAULTS}, i AS (SELECT *, CASE WHEN lag(state) {OVER}) = state THEN 0 ELSE 1 END AS nw FROM tel), j AS (SELECT *, sum(nw) {OVER}) AS isl FROM i),
 d AS (SELECT machine, step, row_number() OVER (PARTITION BY machine, isl ORDER BY step) AS dwell FROM j), m AS (SELECT step, CAST(floor(quantile_cont(dwell, 0.5)) AS BIGINT) AS med FROM d GROUP BY step)
SELECT d.machine, d.step, CASE WHEN f.machine IS NULL THEN med ELSE dwell END AS dwell FROM d JOIN m ON m.step = d.step LEFT JOIN faults f ON f.machine = d.machine AND d.step >= t0 AND d.step < t1""")
def win_root_or_median(spark, sf):
    """A root's own counter while its fault is active, else the plant's median at that step, cut to a whole number."""
    return episodes.root_or_median(sq.run_length(telemetry(spark, sf), F.col("state")), faults(spark, sf), "dwell")


@query("SELECT user_id AS machine, CAST(greatest(1, round_even(b * 0.5, 0)) AS BIGINT) AS short, b AS base, 2 * b AS long FROM (SELECT user_id, count(DISTINCT event_type) AS b FROM events GROUP BY user_id UNION ALL SELECT user_id, count(*) FROM events GROUP BY user_id)")
def win_scales(spark, sf):
    """Half, whole and double of two base widths of each entity: how many kinds of events it has, and how many events."""
    g = read(spark, sf, "events").groupBy(F.col("user_id").alias("machine")).agg(F.countDistinct("event_type").alias("kinds"), F.count("*").alias("n"))
    b = g.select("machine", F.explode(F.array("kinds", "n")).alias("b"))
    return b.select("machine", F.greatest(F.lit(1.0), F.bround(F.col("b") * 0.5)).cast("long").alias("short"), F.col("b").alias("base"), (2 * F.col("b")).alias("long"))


@query(f"""WITH {TEL}, {FAULTS}, p AS (SELECT tel.machine, step, cents FROM tel JOIN faults f ON f.machine = tel.machine WHERE step < t0), c AS (SELECT machine, count(*) AS n, sum(step) AS x, sum(cents) AS y, sum(step * step) AS xx, sum(step * cents) AS xy FROM p GROUP BY machine),
 r AS (SELECT tel.machine, abs(cents - ((CAST(y AS DOUBLE) - CAST(n * xy - x * y AS DOUBLE) / (n * xx - x * x) * x) / n + CAST(n * xy - x * y AS DOUBLE) / (n * xx - x * x) * step)) / 100 AS r FROM tel JOIN c ON c.machine = tel.machine)
SELECT machine, round(max(r), 4) AS worst FROM r GROUP BY machine""")
def win_trend_residual(spark, sf):
    """The largest distance from the line fitted before the fault."""
    from gaugeline.operators import features

    t = telemetry(spark, sf).join(faults(spark, sf).select("machine", "t0"), "machine")
    return features.detrended(t, F.col("step") < F.col("t0")).groupBy("machine").agg(F.round(F.max(F.abs("residual")), 4).alias("worst"))


@query(f"WITH {TEL}, {FAULTS}, w AS (SELECT machine, step // 8 AS k, max(cents) > 30000 AS dec FROM tel GROUP BY 1, 2) SELECT f.machine, min(k) FILTER (WHERE dec AND k * 8 >= t0 - 7) - min(t0) // 8 AS windows FROM faults f JOIN w ON w.machine = f.machine GROUP BY f.machine HAVING min(k) FILTER (WHERE dec AND k * 8 >= t0 - 7) IS NOT NULL")
def win_stream_delay(spark, sf):
    return episodes.stream_delay(telemetry(spark, sf), faults(spark, sf), F.max("cents") > 30000)


@query(f"WITH {SCORES} SELECT fam, ep, count(*) AS n, max(score) AS best, row_number() OVER (PARTITION BY fam ORDER BY max(score) DESC, ep) AS place FROM scores GROUP BY fam, ep")
def srt_leaderboard(spark, sf):
    return episodes.leaderboard(scores(spark, sf), "fam", "ep")


@query(f"WITH {TEL}, f AS (SELECT machine, state, min(step) AS pos FROM tel GROUP BY 1, 2) SELECT machine, string_agg(state, '>' ORDER BY pos) AS states FROM f GROUP BY machine")
def set_ordered_dedupe(spark, sf):
    f = validate.ordered_distinct(telemetry(spark, sf), "machine", "state", "step")
    return f.select("machine", F.array_join("values", ">").alias("states"))


@query(f"WITH {FAULTS} SELECT DISTINCT class FROM faults WHERE class NOT IN ('spike', 'drift')")
def set_unlisted(spark, sf):
    return validate.unlisted(faults(spark, sf), "class", ("spike", "drift"))


_CLASS = "CASE WHEN src_name LIKE 'RWK%' OR dst_name LIKE 'RWK%' THEN 'rework' WHEN dst_name LIKE 'ASM%' OR dst_name LIKE 'INSP%' THEN 'assembly' WHEN dst_name LIKE 'PKG%' THEN 'tail-stage' ELSE 'line-gap' END"


@query(f"WITH {FLEET}, {fleet_edges_sql()}, e AS (SELECT src, dst, {_CLASS} AS kind FROM fleet_edges) SELECT src AS machine, dst AS neighbour, kind FROM e UNION ALL SELECT dst, src, kind FROM e")
def grf_neighbours(spark, sf):
    """The machines on either side of each, and what kind of edge it is."""
    s, d = F.col("src_name"), F.col("dst_name")
    kind = F.when(s.startswith("RWK") | d.startswith("RWK"), "rework").when(d.startswith("ASM") | d.startswith("INSP"), "assembly").when(d.startswith("PKG"), "tail-stage").otherwise("line-gap")
    e = fleet_edges(spark, sf).withColumn("kind", kind)
    both = F.array(F.struct(F.col("src").alias("machine"), F.col("dst").alias("neighbour")), F.struct(F.col("dst").alias("machine"), F.col("src").alias("neighbour")))
    return e.select("kind", F.inline(both)).select("machine", "neighbour", "kind")


@query(f"""WITH {GRID}, p AS (SELECT a.channel AS cause, b.channel AS effect, l.lag AS lag, a.n AS x, b.n AS y FROM grid a CROSS JOIN (VALUES (1), (2)) AS l(lag) JOIN grid b ON b.step = a.step + l.lag AND a.channel <> b.channel)
SELECT cause, effect, lag, round(CAST(count(*) * sum(x * y) - sum(x) * sum(y) AS DOUBLE) / nullif(sqrt(CAST(count(*) * sum(x * x) - sum(x) * sum(x) AS DOUBLE)) * sqrt(CAST(count(*) * sum(y * y) - sum(y) * sum(y) AS DOUBLE)), 0), 6) AS r FROM p GROUP BY 1, 2, 3""")
def grf_lagged_correlation(spark, sf):
    """Correlation of each channel with each other one or two steps later, from exact integer sums."""
    g = grid(spark, sf)
    a = g.select(F.col("channel").alias("cause"), F.col("n").alias("x"), F.explode(F.array(F.lit(1), F.lit(2))).alias("lag"), "step").withColumn("step", F.col("step") + F.col("lag"))
    p = a.join(g.select(F.col("channel").alias("effect"), F.col("n").alias("y"), "step"), "step").filter("cause <> effect")
    n, x, y = F.count("*"), F.sum("x"), F.sum("y")
    dev = lambda c, s: F.sqrt((n * F.sum(F.col(c) * F.col(c)) - s * s).cast("double"))
    r = F.try_divide((n * F.sum(F.col("x") * F.col("y")) - x * y).cast("double"), dev("x", x) * dev("y", y))
    return p.groupBy("cause", "effect", "lag").agg(F.round(r, 6).alias("r"))


_KINDS = ("click", "error", "purchase", "signup", "view")


@query()
def grf_causal_links(spark, sf):
    """Which channel drives which, one or two steps later, given all else that does: correlation and p-value of each lag."""
    links = causal.lagged_links(grid(spark, sf), "channel", "step", F.col("n"), list(_KINDS))
    return links.withColumns({"r": F.round("r", 6), "p": F.round("p", 6), "link": F.col("p") <= 0.01})


@query()
def grf_stable_links(spark, sf):
    """Links that are found in four or more of five stretches of time, whatever their lag."""
    g = grid(spark, sf).withColumn("seed", F.floor(F.col("step") / F.lit(36)) % 5)
    return causal.stable_edges(causal.lagged_links(g, "channel", "step", F.col("n"), list(_KINDS), by=("seed",)), "seed", 4, 0.2)


@query(f"""WITH {TEL}, f AS (SELECT machine, step, sum(CASE WHEN state = 'DOWN' THEN 1 ELSE 0 END) {OVER}) AS k, row_number() {OVER}) AS n FROM tel WHERE machine % 4 = 0),
 c AS (SELECT machine, step, k * ln(CAST(5 AS DOUBLE)) + (n - k) * ln(CAST(0.5 AS DOUBLE) / 0.9) AS c FROM f), s AS (SELECT machine, c - least(CAST(0 AS DOUBLE), min(c) {OVER})) AS s FROM c), a AS (SELECT machine, bool_or(s >= 3) AS hit FROM s GROUP BY machine)
SELECT count(*) AS n, count(*) FILTER (WHERE hit) AS hits FROM a""")
def rst_clean_cusum_share(spark, sf):
    c = sq.bernoulli_cusum(telemetry(spark, sf).filter("machine % 4 = 0"), F.col("state") == "DOWN", 0.1, 0.5, 3.0)
    return c.groupBy("machine").agg(F.bool_or("alarm").alias("hit")).agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


@query(f"WITH {TEL}, w AS (SELECT machine, step AS start, row_number() {OVER}) AS a, row_number() OVER (PARTITION BY machine ORDER BY step DESC) AS b FROM tel WHERE step % 4 = 0) SELECT machine, start FROM w WHERE a > 2 AND b > 2")
def rst_purged_view(spark, sf):
    """Windows without the two at either end."""
    return episodes.purged(telemetry(spark, sf).filter("step % 4 = 0").select("machine", F.col("step").alias("start")), "machine", "start", 2)


@query(f"WITH {SCORES}, h AS (SELECT fam, count(*) AS n, count(*) FILTER (WHERE score >= 0.6) AS h FROM scores GROUP BY fam) SELECT '| ' || fam || ' | ' || n || ' | ' || h || ' |' AS line FROM h")
def snk_markdown(spark, sf):
    h = scores(spark, sf).groupBy("fam").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 0.6).alias("h"))
    return episodes.markdown(h, ["fam", "n", "h"])


_TRIPLE = r"\[FW-([0-9]{3}) \| E-(M[0-9]{2})->(M[0-9]{2}) \| DET-[A-Z0-9]+\]"


@query(f"""WITH {FAULTS}, x AS (SELECT machine, t0, '[FW-' || lpad(CAST(machine % 1000 AS VARCHAR), 3, '0') || ' | E-M' || lpad(CAST(machine % 26 AS VARCHAR), 2, '0') || '->M' || lpad(CAST((machine + 1) % 26 AS VARCHAR), 2, '0') || ' | DET-A' || t0 || ']' AS t FROM faults),
 l AS (SELECT machine, CASE machine % 3 WHEN 0 THEN 'no triple here' WHEN 1 THEN t ELSE t || ' and ' || t END AS text FROM x)
SELECT machine, regexp_extract(text, '{_TRIPLE}', 1) AS fw, regexp_extract(text, '{_TRIPLE}', 3) AS goal, len(regexp_extract_all(text, '{_TRIPLE}')) AS n FROM l""")
def fn_triples(spark, sf):
    """Evidence triples in the lines that are written about faults."""
    two = lambda x: F.lpad((x % 26).cast("string"), 2, "0")
    one = F.concat(F.lit("[FW-"), F.lpad((F.col("machine") % 1000).cast("string"), 3, "0"), F.lit(" | E-M"), two(F.col("machine")), F.lit("->M"), two(F.col("machine") + 1), F.lit(" | DET-A"), F.col("t0").cast("string"), F.lit("]"))
    text = F.when(F.col("machine") % 3 == 0, "no triple here").when(F.col("machine") % 3 == 1, one).otherwise(F.concat(one, F.lit(" and "), one))
    found = lambda k: F.regexp_extract("text", _TRIPLE, k)
    t = faults(spark, sf).select("machine", text.alias("text"))
    return t.select("machine", found(1).alias("fw"), found(3).alias("goal"), F.size(F.regexp_extract_all("text", F.lit(_TRIPLE), F.lit(0))).cast("long").alias("n"))
