"""Queries of windows, metrics, fusion and graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeline.functions.dims import EDGES, MACHINES, PHYSICAL_EDGES, edges, machines, sql_values
from gaugeline.operators import features as fe
from gaugeline.operators import graph, labels
from gaugeline.operators import metrics as me
from gaugeline.operators import sequence as sq
from gaugeline.plans.base import query
from gaugeline.sources.adapters import FAULTS, FLEET, GRID, SCORES, TEL, faults, fleet_edges, fleet_edges_sql, grid, scores, telemetry

S = sq.TELEMETRY
C = sq.Series(keys=("channel",))
OVER = "OVER (PARTITION BY machine ORDER BY step"
FR = OVER + " ROWS 15 PRECEDING)"


@query(f"""WITH {TEL}, f AS (SELECT machine, step - 15 AS start, round(CAST(sum(cents) {FR} AS DOUBLE) / 16 / 100, 6) AS mean,
 round(sqrt(CAST(16 * sum(cents * cents) {FR} - sum(cents) {FR} * sum(cents) {FR} AS DOUBLE)) / 16 / 100, 6) AS std, min(cents) {FR} AS lo, max(cents) {FR} AS hi, cents - first_value(cents) {FR} AS slope FROM tel)
SELECT * FROM f WHERE start >= 0 AND start % 8 = 0""")
def win_features(spark, sf):
    f = fe.window_features(telemetry(spark, sf), 16, 8)
    return f.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query(f"""WITH {GRID}, x AS (SELECT channel, step, coalesce(cents, 0) AS cents FROM grid), f AS (SELECT channel, step - 15 AS start, max(cents) OVER w AS hi, cents - first_value(cents) OVER w AS slope FROM x WINDOW w AS (PARTITION BY channel ORDER BY step ROWS 15 PRECEDING))
SELECT start, max(hi) AS hi_max, CAST(sum(hi) AS DOUBLE) / count(*) AS hi_mean, round(sqrt(CAST(count(*) * sum(hi * hi) - sum(hi) * sum(hi) AS DOUBLE)) / count(*), 4) AS hi_std,
 max(slope) AS slope_max, CAST(sum(slope) AS DOUBLE) / count(*) AS slope_mean, round(sqrt(CAST(count(*) * sum(slope * slope) - sum(slope) * sum(slope) AS DOUBLE)) / count(*), 4) AS slope_std FROM f WHERE start >= 0 AND start % 4 = 0 GROUP BY start""")
def win_invariant(spark, sf):
    g = grid(spark, sf).withColumn("cents", F.coalesce("cents", F.lit(0)))
    f = fe.invariant(fe.window_features(g, 16, 4, s=C), ("start",), ("hi", "slope"))
    return f.withColumns({c: F.round(c, 4) for c in ("hi_std", "slope_std")})


@query(f"""WITH {TEL}, {FAULTS}, l AS (SELECT tel.machine, step, CASE WHEN f.class IS NULL THEN 0 ELSE 1 END AS y, f.class AS c FROM tel LEFT JOIN faults f ON f.machine = tel.machine AND step >= t0 AND step < t1),
 w AS (SELECT machine, step - 15 AS start, max(y) {FR} AS y, first_value(c IGNORE NULLS) {FR} AS family FROM l)
SELECT machine, start, y, coalesce(family, 'none') AS family FROM w WHERE start >= 0 AND start % 8 = 0""")
def win_labels(spark, sf):
    t = labels.active(telemetry(spark, sf), faults(spark, sf))
    w = S.last(16)
    t = t.select("machine", (F.col("step") - 15).alias("start"), F.max("y").over(w).alias("y"), F.coalesce(F.first("class", ignorenulls=True).over(w), F.lit("none")).alias("family"))
    return t.filter("start >= 0 and start % 8 = 0")


@query(f"WITH {TEL} SELECT machine, step, CAST(sum(cents) {OVER}) AS BIGINT) AS s, CAST(sum(cents * cents) {OVER}) AS BIGINT) AS q FROM tel")
def win_prefix_sums(spark, sf):
    w = S.upto()
    return telemetry(spark, sf).select("machine", "step", F.sum("cents").over(w).alias("s"), F.sum(F.col("cents") * F.col("cents")).over(w).alias("q"))


_BANK = " UNION ALL ".join(f"SELECT machine, {w} AS w, step - {w - 1} AS start, CAST(sum(cents) {OVER} ROWS {w - 1} PRECEDING) AS BIGINT) AS x, CAST(sum(cents * cents) {OVER} ROWS {w - 1} PRECEDING) AS BIGINT) AS xx, min(cents) {OVER} ROWS {w - 1} PRECEDING) AS lo, max(cents) {OVER} ROWS {w - 1} PRECEDING) AS hi FROM tel" for w in (1, 2, 4, 8, 16, 32, 64))


@query(f"WITH {TEL} SELECT * FROM ({_BANK}) WHERE start >= 0")
def win_cover_bank(spark, sf):
    return fe.cover_bank(telemetry(spark, sf), (1, 2, 4, 8, 16, 32, 64)).drop("n")


@query(f"""WITH {TEL}, r AS (SELECT machine, step AS s, 5 + step % 38 AS w FROM tel WHERE step % 5 = 0), m AS (SELECT machine, count(*) AS n FROM tel GROUP BY machine)
SELECT r.machine, r.s, r.w, round(CAST(sum(cents) AS DOUBLE) / r.w / 100, 6) AS mean, round(sqrt(CAST(sum(cents * cents) AS DOUBLE) / r.w) / 100, 6) AS rms, min(cents) AS lo, max(cents) AS hi
FROM r JOIN m ON m.machine = r.machine AND r.s + r.w <= n JOIN tel ON tel.machine = r.machine AND step >= r.s AND step < r.s + r.w GROUP BY 1, 2, 3""")
def win_reconstruct(spark, sf):
    """Any range from powers of two: equal to the aggregate of the range itself."""
    t = telemetry(spark, sf)
    n = F.count("*").over(Window.partitionBy("machine"))
    r = t.withColumn("n", n).filter("step % 5 = 0").select("machine", F.col("step").alias("s"), (5 + F.col("step") % 38).alias("w"), "n").filter("s + w <= n").drop("n")
    got = fe.reconstruct(r, fe.cover_bank(t, (1, 2, 4, 8, 16, 32, 64)))
    return got.withColumns({c: F.round(c, 6) for c in ("mean", "rms")})


@query(f"""WITH {TEL}, f AS (SELECT machine, count(*) AS n, sum(step) AS x, sum(cents) AS y, sum(step * step) AS xx, sum(step * cents) AS xy FROM tel WHERE state = 'RUN' GROUP BY machine),
 l AS (SELECT machine, n, x, y, coalesce(CAST(n * xy - x * y AS DOUBLE) / nullif(n * xx - x * x, 0), 0) AS b FROM f)
SELECT tel.machine, step, round((cents - CASE WHEN n >= 2 THEN (CAST(y AS DOUBLE) - b * x) / n + b * step ELSE 0 END) / 100, 4) AS residual FROM tel LEFT JOIN l ON l.machine = tel.machine""")
def win_detrend(spark, sf):
    return fe.detrended(telemetry(spark, sf), F.col("state") == "RUN").withColumn("residual", F.round("residual", 4))


@query(f"WITH {SCORES} SELECT fam, count(*) FILTER (WHERE score >= 0.6 AND y = 1) AS tp, count(*) FILTER (WHERE score >= 0.6 AND y = 0) AS fp, count(*) FILTER (WHERE score < 0.6 AND y = 1) AS fn, round(2.0 * count(*) FILTER (WHERE score >= 0.6 AND y = 1) / (count(*) FILTER (WHERE score >= 0.6) + count(*) FILTER (WHERE y = 1)), 6) AS f1 FROM scores GROUP BY fam")
def agg_point_f1(spark, sf):
    c = me.counts(F.col("score") >= 0.6, F.col("y") == 1)
    g = scores(spark, sf).groupBy("fam").agg(*[c[k].alias(k) for k in ("tp", "fp", "fn")])
    return g.withColumn("f1", F.round(me.f1(F.col("tp"), F.col("fp"), F.col("fn")), 6))


@query(f"""WITH {SCORES}, c AS (SELECT fam, CAST(count(*) FILTER (WHERE score >= 0.6 AND y = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE score >= 0.6 AND y = 0) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE score < 0.6 AND y = 1) AS DOUBLE) AS fn, CAST(count(*) FILTER (WHERE score < 0.6 AND y = 0) AS DOUBLE) AS tn FROM scores GROUP BY fam)
SELECT fam, round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc FROM c""")
def agg_mcc(spark, sf):
    c = me.counts(F.col("score") >= 0.6, F.col("y") == 1)
    g = scores(spark, sf).groupBy("fam").agg(*[v.alias(k) for k, v in c.items()])
    return g.select("fam", F.round(me.mcc(*(F.col(k) for k in ("tp", "fp", "fn", "tn"))), 6).alias("mcc"))


@query(f"""WITH {SCORES}, r AS (SELECT fam, y, score, rank() OVER (PARTITION BY fam ORDER BY score) AS rk, count(*) OVER (PARTITION BY fam, score) AS k FROM scores),
 s AS (SELECT fam, sum((2 * rk + k - 1) * y) AS r2, sum(y) AS p, count(*) - sum(y) AS q FROM r GROUP BY fam)
SELECT fam, round(CAST(r2 - p * (p + 1) AS DOUBLE) / nullif(2.0 * p * q, 0), 6) AS auc FROM s""")
def agg_auc(spark, sf):
    return me.auc(scores(spark, sf), ("fam",)).withColumn("auc", F.round("auc", 6))


@query(f"""WITH {SCORES}, c AS (SELECT ep, CAST(count(*) FILTER (WHERE score >= 0.6) AS DOUBLE) AS h, count(*) AS n FROM scores GROUP BY ep), p AS (SELECT *, h / n AS p FROM c)
SELECT ep, round(((p + 3.8416 / (2 * n)) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 6) AS lo, round(((p + 3.8416 / (2 * n)) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 6) AS hi FROM p""")
def agg_wilson(spark, sf):
    g = scores(spark, sf).groupBy("ep").agg(F.count_if(F.col("score") >= 0.6).alias("h"), F.count("*").alias("n"))
    lo, hi = me.wilson(F.col("h"), F.col("n"))
    return g.select("ep", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query(f"""WITH {SCORES}, e AS (SELECT ep, fam, bool_or(score >= 0.9) AS hit, bool_or(y = 1 AND id % 3 = 0) AS faulty FROM scores GROUP BY ep, fam)
SELECT faulty, count(*) AS n, count(*) FILTER (WHERE hit) AS hits, round(CAST(count(*) FILTER (WHERE hit) AS DOUBLE) / count(*), 6) AS rate FROM e GROUP BY faulty""")
def agg_episode_hit(spark, sf):
    e = scores(spark, sf).groupBy("ep", "fam").agg(F.bool_or(F.col("score") >= 0.9).alias("hit"), F.bool_or((F.col("y") == 1) & (F.col("id") % 3 == 0)).alias("faulty"))
    n, h = F.count("*"), F.count_if("hit")
    return e.groupBy("faulty").agg(n.alias("n"), h.alias("hits"), F.round(h.cast("double") / n, 6).alias("rate"))


@query(f"""WITH {SCORES}, q AS (SELECT fam, sum(y) AS pos, {", ".join(f"quantile_cont(score, CAST({k} AS DOUBLE) / 49) AS q{k}" for k in range(50))} FROM scores GROUP BY fam),
 t AS (SELECT DISTINCT fam, pos, unnest([{", ".join(f"q{k}" for k in range(50))}]) AS thr FROM q WHERE pos > 0),
 p AS (SELECT t.fam, t.thr, CAST(sum(y) FILTER (WHERE score >= thr) AS DOUBLE) / max(pos) AS r, CAST(sum(y) FILTER (WHERE score >= thr) AS DOUBLE) / count(*) FILTER (WHERE score >= thr) AS p FROM t JOIN scores s ON s.fam = t.fam GROUP BY t.fam, t.thr),
 a AS (SELECT fam, r, p, thr AS o FROM p UNION ALL SELECT DISTINCT fam, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), CAST(1e300 AS DOUBLE) FROM t UNION ALL SELECT DISTINCT fam, CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), CAST(-1e300 AS DOUBLE) FROM t),
 m AS (SELECT fam, r - lag(r) OVER (PARTITION BY fam ORDER BY r, o DESC) AS dr, max(p) OVER (PARTITION BY fam ORDER BY r, o DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best FROM a)
SELECT fam, round(sum(coalesce(dr * best, 0)), 6) AS pr_auc FROM m GROUP BY fam""")
def met_range_pr_auc(spark, sf):
    return me.range_pr_auc(scores(spark, sf), "score", "y", ("fam",)).withColumn("pr_auc", F.round("pr_auc", 6))


_E = sql_values(EDGES, "src, dst")
_UND = f"e AS (SELECT src, dst FROM {_E} UNION SELECT dst, src FROM {_E})"


_FLEET_UND = f"{FLEET}, {fleet_edges_sql()}, e AS (SELECT src, dst FROM fleet_edges UNION SELECT dst, src FROM fleet_edges)"


@query(f"WITH RECURSIVE {_FLEET_UND}, w AS (SELECT DISTINCT src, src AS dst, 0 AS hop FROM e UNION SELECT w.src, e.dst, hop + 1 FROM w JOIN e ON e.src = w.dst WHERE hop < 3) SELECT src, dst, min(hop) AS hop FROM w GROUP BY src, dst")
def grf_hops(spark, sf):
    """How far machines of a plant are from each other, up to three edges."""
    return graph.hops(fleet_edges(spark, sf))


@query(f"WITH RECURSIVE {FLEET}, {fleet_edges_sql(True)}, e AS (SELECT dst AS src, src AS dst FROM fleet_edges), w AS (SELECT src, dst, 1 AS hop FROM e UNION SELECT w.src, e.dst, hop + 1 FROM w JOIN e ON e.src = w.dst WHERE hop < 3) SELECT src AS machine, string_agg(CAST(dst AS VARCHAR), '>' ORDER BY hop, dst) AS chain FROM (SELECT src, dst, min(hop) AS hop FROM w GROUP BY 1, 2) GROUP BY src")
def grf_upstream_chain(spark, sf):
    """What feeds each machine, the nearest first."""
    e = fleet_edges(spark, sf, physical=True).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    h = graph.hops(e, 3, directed=True).filter("hop > 0").groupBy("src").agg(F.array_sort(F.collect_list(F.struct("hop", "dst"))).alias("c"))
    return h.select(F.col("src").alias("machine"), F.array_join(F.transform("c", lambda x: x["dst"].cast("string")), ">").alias("chain"))


@query(f"WITH RECURSIVE {_FLEET_UND}, w AS (SELECT DISTINCT src, src AS dst, 0 AS hop FROM e UNION SELECT w.src, e.dst, hop + 1 FROM w JOIN e ON e.src = w.dst WHERE hop < 2) SELECT src AS machine, count(DISTINCT dst) AS affected FROM w GROUP BY src")
def grf_affected(spark, sf):
    """How many machines are within two edges of each."""
    return graph.hops(fleet_edges(spark, sf), 2).groupBy(F.col("src").alias("machine")).agg(F.count("*").alias("affected"))


_MSQL = sql_values([(k, *m) for k, m in enumerate(MACHINES)], "idx, machine, class, base, sigma, cycle, mttf, mttr")


@query(f"""WITH RECURSIVE {_UND}, {TEL}, pk AS (SELECT m.machine, max(cents) AS peak FROM tel JOIN {_MSQL.replace(' AS t(', ' AS m(')} ON tel.machine % 26 = m.idx GROUP BY m.machine),
 w AS (SELECT DISTINCT src, src AS dst, 0 AS hop FROM e UNION SELECT w.src, e.dst, hop + 1 FROM w JOIN e ON e.src = w.dst WHERE hop < 3), h AS (SELECT src, dst, min(hop) AS hop FROM w GROUP BY 1, 2),
 r AS (SELECT src, hop, dst, peak, row_number() OVER (PARTITION BY src, hop ORDER BY peak DESC, dst) AS rank FROM h JOIN pk ON pk.machine = h.dst WHERE hop > 0)
SELECT * FROM r WHERE rank <= 2""")
def grf_ranked_walk(spark, sf):
    m = machines(spark).select("idx", "machine")
    t = telemetry(spark, sf).groupBy((F.col("machine") % 26).cast("int").alias("idx")).agg(F.max("cents").alias("peak"))
    return graph.ranked_walk(graph.hops(edges(spark)), t.join(m, "idx").select("machine", "peak"), 2)


@query(f"""WITH {TEL}, a AS (SELECT machine, step, cents AS score FROM tel WHERE state = 'DOWN')
SELECT a.machine, a.step, a.score FROM a WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.machine = a.machine - 1 AND b.machine % 5 <> 0 AND b.step BETWEEN a.step - 3 AND a.step AND b.score >= a.score)""")
def grf_echo(spark, sf):
    """Alarms that no upstream alarm of at least their score explains."""
    a = telemetry(spark, sf).filter("state = 'DOWN'").select("machine", "step", F.col("cents").alias("score"))
    up = a.select(F.col("machine").alias("src")).distinct().filter("src % 5 <> 0").withColumn("dst", F.col("src") + 1)
    return graph.echoes(a, up, 3)


def _survivors(m: int) -> str:
    gone = "".join(
        f""" AND NOT (EXISTS (SELECT 1 FROM s{u} x WHERE x.line = a.line AND x.step BETWEEN a.step - {3 + m - u} AND a.step)
 AND EXISTS (SELECT 1 FROM t v WHERE v.line = a.line AND v.place = {u} AND v.step BETWEEN a.step - {3 + m - u} AND a.step AND v.score >= a.score))"""
        for u in range(m)
    )
    return f"s{m} AS MATERIALIZED (SELECT a.line, a.place, a.step, a.score FROM t a WHERE a.alarm AND a.place = {m}{gone})"


@query(f"""WITH {TEL}, t AS MATERIALIZED (SELECT machine // 5 AS line, machine % 5 AS place, step, cents AS score, state = 'DOWN' AS alarm FROM tel),
{', '.join(map(_survivors, range(5)))}
{' UNION ALL '.join(f'SELECT line, place, step, score FROM s{m}' for m in range(5))}""")
def grf_echo_cascade(spark, sf):
    """Alarms of lines of five that stay when each line is taken from its head on."""
    line = F.floor(F.col("machine") / F.lit(5)).cast("long")
    t = telemetry(spark, sf).select(line.alias("line"), (F.col("machine") % 5).alias("place"), "step", F.col("cents").alias("score"), (F.col("state") == "DOWN").alias("alarm"))
    return graph.echo_cascade(t, 5, 3)


@query(f"""WITH {GRID}, p AS (SELECT a.channel AS cause, b.channel AS effect, CAST(b.step - a.step AS BIGINT) AS lag, a.n AS x, b.n AS y, z.n AS z
 FROM grid a JOIN grid b ON b.step IN (a.step + 1, a.step + 2) AND a.channel <> b.channel JOIN grid z ON z.channel = b.channel AND z.step = b.step - 1),
 c AS (SELECT cause, effect, lag, count(*) AS n, CAST(count(*) * sum(x * y) - sum(x) * sum(y) AS DOUBLE) AS xy, CAST(count(*) * sum(x * z) - sum(x) * sum(z) AS DOUBLE) AS xz, CAST(count(*) * sum(y * z) - sum(y) * sum(z) AS DOUBLE) AS yz,
 sqrt(CAST(count(*) * sum(x * x) - sum(x) * sum(x) AS DOUBLE)) AS dx, sqrt(CAST(count(*) * sum(y * y) - sum(y) * sum(y) AS DOUBLE)) AS dy, sqrt(CAST(count(*) * sum(z * z) - sum(z) * sum(z) AS DOUBLE)) AS dz FROM p GROUP BY 1, 2, 3),
 r AS (SELECT cause, effect, lag, n, xy / nullif(dx * dy, 0) AS xy, xz / nullif(dx * dz, 0) AS xz, yz / nullif(dy * dz, 0) AS yz FROM c)
SELECT cause, effect, lag, n, round(CASE WHEN (1 - xz * xz) * (1 - yz * yz) > 1e-12 THEN (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) END, 6) AS r FROM r""")
def grf_partial_correlation(spark, sf):
    """What a channel says of another one or two steps later beyond the other's own last value."""
    g = grid(spark, sf).select("channel", "step", "n")
    y = g.select(F.col("channel").alias("effect"), "step", F.col("n").alias("y"), F.lag("n").over(Window.partitionBy("channel").orderBy("step")).alias("z")).filter("z is not null")
    x = g.select(F.col("channel").alias("cause"), F.col("n").alias("x"), F.posexplode(F.array(F.col("step") + 1, F.col("step") + 2)).alias("k", "step"))
    p = x.join(y, "step").filter("cause <> effect").withColumn("lag", (F.col("k") + 1).cast("long"))
    return graph.partial_correlation(p, ("cause", "effect", "lag")).withColumn("r", F.round("r", 6))
