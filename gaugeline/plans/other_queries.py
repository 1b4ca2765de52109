"""Queries of streams, learning, transforms and the generator. Most have no SQL; tests state their properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.operators import envelope, features, learning, mixture, profile
from gaugeline.plans.base import query
from gaugeline.sources.adapters import FAULTS, SCORES, TEL, faults, read, scores, telemetry
from gaugeline.streaming import replay


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY event_type")
def str_ingest(spark, sf):
    got = replay.drained(replay.ingested(replay.events_stream(spark, sf)))
    return got.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


_CUSUM = f"""WITH {TEL}, f AS (SELECT machine, step, sum(CASE WHEN state = 'DOWN' THEN 1 ELSE 0 END) OVER (PARTITION BY machine ORDER BY step) AS fails, row_number() OVER (PARTITION BY machine ORDER BY step) AS n FROM tel),
 c AS (SELECT *, fails * ln(CAST(0.25 AS DOUBLE) * 402) + (n - fails) * ln(CAST(0.75 AS DOUBLE) / (1 - CAST(1 AS DOUBLE) / 402)) AS c FROM f),
 s AS (SELECT *, c - least(CAST(0 AS DOUBLE), min(c) OVER (PARTITION BY machine ORDER BY step)) AS cusum FROM c)
SELECT machine AS user_id, max(n) AS n, CAST(max(fails) AS BIGINT) AS fails, round(max_by(cusum, n), 6) AS cusum FROM s GROUP BY machine"""


@query(_CUSUM)
def str_cusum(spark, sf):
    """The stateful detector over a stream equals the batch closed form."""
    got = replay.drained(replay.cusum_states(replay.events_stream(spark, sf)), "update")
    return got.groupBy("user_id").agg(F.max("n").alias("n"), F.max("fails").alias("fails"), F.round(F.max_by("cusum", "n"), 6).alias("cusum"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, CAST(floor(date_diff('second', TIMESTAMP '1970-01-01', ts) / 864000) AS BIGINT) AS slot FROM events GROUP BY 1, 4")
def str_windows(spark, sf):
    got = replay.drained(replay.windowed(replay.events_stream(spark, sf)), "complete")
    return got.select("event_type", "n", "cents", F.floor(F.unix_timestamp("start") / 864000).cast("long").alias("slot"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 43200000000 AS "end", count(*) AS n FROM s GROUP BY user_id, s""")
def str_sessions(spark, sf):
    """Each user's sessions over the stream."""
    got = replay.drained(replay.sessions(replay.events_stream(spark, sf)), "complete")
    return got.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


@query(f"WITH {SCORES}, g AS (SELECT ep, max(y) AS y FROM scores GROUP BY ep) SELECT ep, CAST((row_number() OVER (PARTITION BY y ORDER BY ep) - 1) % 3 AS BIGINT) AS fold FROM g")
def ml_grouped_folds(spark, sf):
    return learning.grouped_folds(scores(spark, sf), "ep", "y").select("ep", F.col("fold").cast("long").alias("fold"))


@query()
def ml_pca_error(spark, sf):
    return learning.pca_error(read(spark, sf, "embeddings"), F.col("embedding")).select("vec_id", F.round("error", 6).alias("error"))


@query()
def cal_mixture(spark, sf):
    """The threshold of all clean scores, and of how many components it is."""
    tau, k = mixture.mixture_threshold(scores(spark, sf).filter("y = 0"), "score", 0.01)
    return spark.range(1).select(F.lit(tau).alias("tau"), F.lit(k).alias("k"))


@query()
def agg_bootstrap(spark, sf):
    return learning.bootstrap_interval(telemetry(spark, sf), "machine", F.col("state") == "DOWN")


_T = "(0.5 + 0.5 * cos(pi() * k / 17)) * 2 / (pi() * k)"


@query(f"""WITH {TEL}, m AS (SELECT machine, avg(obs) AS m FROM tel GROUP BY machine), x AS (SELECT tel.machine, step, obs - m AS v FROM tel JOIN m ON m.machine = tel.machine),
 k AS (SELECT k, {_T} AS h FROM (SELECT unnest(range(-15, 16, 2)) AS k)),
 q AS (SELECT a.machine, a.step, sum(b.v * h) AS q FROM x a, k JOIN x b ON b.machine = a.machine AND b.step = a.step - k GROUP BY 1, 2)
SELECT x.machine, x.step, round(sqrt(v * v + coalesce(q, 0) * coalesce(q, 0)), 6) AS envelope FROM x LEFT JOIN q ON q.machine = x.machine AND q.step = x.step""")
def win_envelope(spark, sf):
    """The envelope of each series by a filter over 16 rows on both sides, in blocks of 32."""
    return envelope.envelope(telemetry(spark, sf), F.col("obs"), half=16, block=32).withColumn("envelope", F.round("envelope", 6))


_STATS = f"""e AS (SELECT a.machine, a.start, a.i, a.x, sum(b.x * CASE WHEN (a.i - b.i) % 2 = 0 THEN 0 ELSE cos(pi() * (a.i - b.i) / 8) / sin(pi() * (a.i - b.i) / 8) / 4 END) AS y FROM win a JOIN win b ON b.machine = a.machine AND b.start = a.start GROUP BY 1, 2, 3, 4),
 e2 AS (SELECT machine, start, i, sqrt(x * x + y * y) AS e FROM e), m AS (SELECT machine, start, max(e) AS hi, min(e) AS lo, avg(e) AS mean, stddev_pop(e) AS sd FROM e2 GROUP BY 1, 2),
 p AS (SELECT e2.machine, e2.start, k, pow(sum((e - mean) * (e - mean) * cos(2 * pi() * k * i / 8)), 2) + pow(sum((e - mean) * (e - mean) * sin(2 * pi() * k * i / 8)), 2) AS p FROM e2 JOIN m ON m.machine = e2.machine AND m.start = e2.start, (SELECT unnest(range(5)) AS k) GROUP BY 1, 2, 3),
 stats AS (SELECT m.machine, m.start, hi AS envelope_max, lo AS envelope_min, mean AS envelope_mean, sd AS envelope_std, sum(p) FILTER (WHERE k > 0) / sum(p) AS envelope_band_energy FROM m JOIN p ON p.machine = m.machine AND p.start = m.start GROUP BY 1, 2, 3, 4, 5, 6)"""
_WIN = "win AS (SELECT a.machine, a.step AS start, b.step - a.step AS i, b.obs AS x FROM tel a JOIN tel b ON b.machine = a.machine AND b.step BETWEEN a.step AND a.step + 7 JOIN (SELECT machine, max(step) AS last FROM tel GROUP BY machine) n ON n.machine = a.machine AND a.step + 7 <= last"
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in envelope.STATISTICS)


@query(f"WITH {TEL}, {_WIN} WHERE a.step % 4 = 0), {_STATS} SELECT machine, start, {_ROUNDED} FROM stats")
def win_envelope_stats(spark, sf):
    """Statistics of the envelope of each window of eight rows, every four."""
    got = envelope.envelope_statistics(telemetry(spark, sf), F.col("obs"), 8, 4)
    return got.drop("w").withColumns({c: F.round(c, 6) for c in envelope.STATISTICS})


@query(f"""WITH {TEL}, {_WIN}), {_STATS}, r AS (SELECT machine, start, CAST(sum(CAST(round(x * 100) AS BIGINT)) AS DOUBLE) / 8 / 100 AS mean, sqrt(CAST(sum(CAST(round(x * 100) AS BIGINT) * CAST(round(x * 100) AS BIGINT)) AS DOUBLE) / 8) / 100 AS rms, min(x) AS lo, max(x) AS hi FROM win GROUP BY 1, 2)
SELECT r.machine, r.start, round(mean, 6) AS mean, round(rms, 6) AS rms, lo, hi, {_ROUNDED} FROM r JOIN stats ON stats.machine = r.machine AND stats.start = r.start""")
def win_rolling(spark, sf):
    """Every window of eight rows: sums and extremes from the bank of ranges, and its envelope."""
    t = telemetry(spark, sf)
    got = envelope.rolling(t, features.cover_bank(t, (8,)), F.col("obs"), 8, 0.01).drop("w")
    return got.withColumns({c: F.round(c, 6) for c in ("mean", "rms", *envelope.STATISTICS)} | {c: F.round(c, 2) for c in ("lo", "hi")})


@query(f"""WITH {TEL}, g AS (SELECT machine, step // 16 AS g, step % 16 AS i, obs FROM tel), n AS (SELECT machine, g, avg(obs) AS m FROM g GROUP BY 1, 2 HAVING count(*) = 16),
 p AS (SELECT g.machine, g.g, k, pow(sum((obs - m) * cos(2 * pi() * k * i / 16)), 2) + pow(sum((obs - m) * sin(2 * pi() * k * i / 16)), 2) AS p FROM g JOIN n ON n.machine = g.machine AND n.g = g.g, (SELECT unnest(range(9)) AS k) GROUP BY 1, 2, 3)
SELECT machine, round(sum(p) FILTER (WHERE k >= 2) / sum(p), 6) AS ratio FROM p GROUP BY machine""")
def win_band_energy(spark, sf):
    """The share of power between 0.1 and 0.5 cycles a row, over segments of 16 rows."""
    return envelope.band_power(telemetry(spark, sf), F.col("obs"), 0.1, 0.5, 16).withColumn("ratio", F.round("ratio", 6))


_M = 8


@query(f"""WITH {TEL}, w AS (SELECT machine, step AS s, list(obs) OVER (PARTITION BY machine ORDER BY step ROWS BETWEEN CURRENT ROW AND {_M - 1} FOLLOWING) AS x FROM tel),
 v AS (SELECT machine, s, x, list_avg(x) AS mean, list_stddev_pop(x) AS sd FROM w WHERE len(x) = {_M}),
 z AS (SELECT machine, s, list_transform(x, lambda y: (y - mean) / CASE WHEN sd > 1e-12 THEN sd ELSE 1 END) AS z FROM v),
 d AS (SELECT a.machine, a.s, min(list_distance(a.z, b.z)) AS d FROM z a JOIN z b ON b.machine = a.machine AND abs(a.s - b.s) > {_M // 2} GROUP BY a.machine, a.s)
SELECT machine, arg_max(s, struct_pack(d := d, b := -s)) AS at_step, round(max(d), 6) AS distance FROM d GROUP BY machine""")
def win_discord(spark, sf):
    """The subsequence of each series that is least like any other, from the matrix profile."""
    found = profile.discord(profile.matrix_profile(telemetry(spark, sf), F.col("obs"), _M))
    return found.select("machine", F.col("at").alias("at_step"), F.round("distance", 6).alias("distance"))


@query(f"""WITH {TEL}, w AS (SELECT machine, step AS s, list(cents) OVER (PARTITION BY machine ORDER BY step ROWS BETWEEN CURRENT ROW AND {_M - 1} FOLLOWING) AS x FROM tel),
 v AS (SELECT machine, s, x, list_avg(x) AS mean, list_stddev_pop(x) AS sd FROM w WHERE len(x) = {_M}),
 z AS (SELECT machine, s, list_transform(x, lambda y: (y - mean) / CASE WHEN sd > 1e-12 THEN sd ELSE 1 END) AS z FROM v)
SELECT a.machine, a.s AS at_step, round(min(list_distance(a.z, b.z)), 6) AS distance FROM z a JOIN z b ON b.machine = a.machine AND abs(a.s - b.s) > {_M // 2} GROUP BY a.machine, a.s""")
def win_matrix_profile(spark, sf):
    """The distance of every subsequence to its nearest neighbour, in tiles of 32 starts."""
    found = profile.matrix_profile(telemetry(spark, sf), F.col("cents"), _M, block=32)
    return found.select("machine", F.col("at").alias("at_step"), F.round("distance", 6).alias("distance"))


@query(f"""WITH {TEL}, {FAULTS}, n AS (SELECT machine, machine - 1 AS nb FROM faults UNION ALL SELECT machine, machine + 1 FROM faults)
SELECT n.machine, n.nb AS neighbour, tel.step FROM n JOIN faults f ON f.machine = n.machine JOIN tel ON tel.machine = n.nb AND tel.step = f.t0 WHERE tel.state <> 'RUN'""")
def jn_neighbours(spark, sf):
    """Neighbours that don't run at a fault's first step."""
    f = faults(spark, sf).select("machine", F.col("t0").alias("step"), F.explode(F.array(F.col("machine") - 1, F.col("machine") + 1)).alias("neighbour"))
    t = telemetry(spark, sf).filter("state <> 'RUN'").select(F.col("machine").alias("neighbour"), "step")
    return f.join(t, ["neighbour", "step"]).select("machine", "neighbour", "step")
