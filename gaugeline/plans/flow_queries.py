"""Queries of flow, contracts, projections, sets and replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions.dims import AMPS, BUFFERS, CLASSES, FAMILIES, LOADS, MACHINES, buffers, machines, sql_values
from gaugeline.operators import contracts, episodes, flow, labels, validate
from gaugeline.operators import sequence as sq
from gaugeline.plans.base import query
from gaugeline.sources.adapters import FAULTS, FLEET, GRID, PARTS, SCORES, TEL, faults, fleet, grid, parts, read, scores, telemetry
from gaugeline.sources import frames_source, storage
from gaugeline.streaming import frames, narration

S = sq.TELEMETRY
C = sq.Series(keys=("channel",))
_SHARES = ", ".join(f"round(CAST(count(*) FILTER (WHERE state = '{s}') AS DOUBLE) / count(*), 6) AS {s.lower()}" for s in flow.STATES)
_M = sql_values([(k, *m) for k, m in enumerate(MACHINES)], "idx, machine, class, base, sigma, cycle, mttf, mttr")
_B = sql_values([(k, *b) for k, b in enumerate(BUFFERS)], "ord, buffer, cap")
_PART_SQL = "CASE WHEN machine LIKE 'ASM%' OR machine LIKE 'INSP%' THEN 'cell' WHEN machine LIKE 'RWK%' THEN 'rework' WHEN machine LIKE 'PKG%' OR machine LIKE 'C%' THEN 'line-C' WHEN machine LIKE 'A%' THEN 'line-A' WHEN machine LIKE 'B%' THEN 'line-B' END"


def partition_of(m):
    """The partition of a machine by ordered prefixes; an unknown one is an error."""
    rules = (("ASM", "cell"), ("INSP", "cell"), ("RWK", "rework"), ("PKG", "line-C"), ("C", "line-C"), ("A", "line-A"), ("B", "line-B"))
    out = F.raise_error(F.concat(F.lit("unknown machine "), m))
    for prefix, name in reversed(rules):
        out = F.when(m.startswith(prefix), name).otherwise(out)
    return out


@query(f"WITH {TEL} SELECT machine, count(*) AS n, {_SHARES} FROM tel GROUP BY ROLLUP (machine)")
def agg_state_shares(spark, sf):
    s = flow.shares(telemetry(spark, sf), ("machine",))
    return s.select("machine", "n", *[F.round(x.lower(), 6).alias(x.lower()) for x in flow.STATES])


@query(f"WITH {TEL} SELECT machine // 10 AS line, count(*) AS n, {_SHARES} FROM tel WHERE machine % 12 <> 0 AND step >= 15 GROUP BY 1")
def agg_duty(spark, sf):
    t = telemetry(spark, sf).filter("machine % 12 <> 0 and step >= 15").withColumn("line", F.expr("machine div 10"))
    s = flow.share_of(t, ("line",))
    return s.select("line", "n", *[F.round(x.lower(), 6).alias(x.lower()) for x in flow.STATES])


@query(f"WITH {GRID} SELECT step % 6 AS slot, count(*) FILTER (WHERE state = 'STARVED' AND channel = 'view') AS feed, count(*) FILTER (WHERE state = 'STARVED' AND channel IN ('click', 'signup')) AS kit, count(*) FILTER (WHERE state = 'STARVED' AND channel NOT IN ('view', 'click', 'signup')) AS cell, count(*) FILTER (WHERE state = 'STARVED') AS total FROM grid GROUP BY 1")
def agg_starved_split(spark, sf):
    return flow.starved_split(grid(spark, sf), F.col("step") % 6, F.col("channel") == "view", F.col("channel").isin("click", "signup"))


@query(f"WITH {PARTS}, f AS (SELECT machine, count(DISTINCT part) AS sunk, count(*) FILTER (WHERE flag = 'REJECT') AS scrapped, count(*) AS n FROM parts GROUP BY machine) SELECT quantile_cont(n - scrapped, 0.5) AS med, round(quantile_cont(n - scrapped, 0.1), 6) AS p10, round(quantile_cont(n - scrapped, 0.9), 6) AS p90, CAST(sum(scrapped) AS BIGINT) AS scrapped, CAST(sum(sunk) AS BIGINT) AS sunk FROM f")
def agg_funnel(spark, sf):
    f = flow.funnel_summary(flow.funnel(parts(spark, sf), "machine", "part", F.col("flag") == "REJECT"))
    return f.withColumns({c: F.round(c, 6) for c in ("p10", "p90")})


_AMPS = "CASE class " + " ".join(f"WHEN '{c}' THEN CAST({a} AS DOUBLE)" for c, a in AMPS) + " END"
_LOAD = "CASE " + " ".join(f"WHEN m.machine LIKE '{p}%' THEN CAST({k} AS DOUBLE)" for p, k in reversed(LOADS)) + " END"


@query(f"""WITH {TEL}, d AS (SELECT m.idx, m.machine AS name, {_AMPS} AS amps, {_LOAD} AS load FROM {_M.replace(' AS t(', ' AS m(')}),
 r AS (SELECT d.name, d.amps, d.load, count(*) AS n, count(*) FILTER (WHERE state = 'RUN') AS runs FROM tel JOIN d ON tel.machine % 26 = d.idx GROUP BY 1, 2, 3)
SELECT name, round(sqrt(CAST(3 AS DOUBLE)) * 400 * (n * amps * 0.15 + runs * load * (amps - amps * 0.15)) / 3600, 6) AS wh, round(sqrt(CAST(3 AS DOUBLE)) * 400 * (n * amps * 0.15 + runs * load * (amps - amps * 0.15)) / 3600 / nullif(runs, 0), 6) AS per_unit FROM r""")
def agg_energy(spark, sf):
    amps, load = flow.rated(F.col("name"), F.col("class"), AMPS, LOADS)
    m = machines(spark).select("idx", F.col("machine").alias("name"), "class").withColumns({"amps": amps, "load": load})
    t = telemetry(spark, sf).select((F.col("machine") % 26).cast("int").alias("idx"), "state").join(m, "idx")
    return flow.energy_by(t, "name", F.col("state") == "RUN", F.col("amps"), F.col("load")).select("name", F.round("wh", 6).alias("wh"), F.round("per_unit", 6).alias("per_unit"))


@query(f"WITH {TEL} SELECT machine, round(CAST(count(*) FILTER (WHERE step >= 15 AND step < 30 AND state = 'STARVED') AS DOUBLE) / nullif(count(*) FILTER (WHERE step >= 15 AND step < 30), 0) - CAST(count(*) FILTER (WHERE step < 15 AND state = 'STARVED') AS DOUBLE) / 15, 6) AS delta FROM tel GROUP BY machine")
def agg_stationarity(spark, sf):
    return flow.stationarity(telemetry(spark, sf), ("machine",), F.col("state") == "STARVED").withColumn("delta", F.round("delta", 6))


@query(f"""WITH {TEL}, a AS (SELECT *, cents > 8000 AS f FROM tel), b AS (SELECT *, CASE WHEN lag(f) OVER (PARTITION BY machine ORDER BY step) = f THEN 0 ELSE 1 END AS nw FROM a), c AS (SELECT *, sum(nw) OVER (PARTITION BY machine ORDER BY step) AS i FROM b)
SELECT machine, min(step) AS start, count(*) AS length FROM c WHERE f GROUP BY machine, i HAVING count(*) >= 3 AND bool_or(state = 'STARVED')""")
def agg_pile_up(spark, sf):
    return flow.pile_ups(telemetry(spark, sf), F.col("cents") > 8000, F.col("state") == "STARVED", 3)


@query(f"WITH {PARTS}, u AS (SELECT part, machine FROM parts WHERE flag <> 'OK' UNION SELECT part, machine + 1 FROM parts WHERE line = 1) SELECT part % 100 AS grp, count(DISTINCT machine) AS fan_out FROM u GROUP BY 1")
def agg_fan_out(spark, sf):
    p = parts(spark, sf)
    u = p.filter("flag <> 'OK'").select("part", "machine").unionByName(p.filter("line = 1").select("part", (F.col("machine") + 1).alias("machine")))
    return flow.fan_out(u, F.col("part") % 100, "machine")


@query(f"WITH {FAULTS} SELECT machine % 5 AS part, string_agg(DISTINCT class, ',' ORDER BY class) AS classes, count(*) AS n FROM faults GROUP BY 1")
def agg_coverage_cells(spark, sf):
    return flow.coverage_cells(faults(spark, sf), F.col("machine") % 5, "class")


@query(f"WITH {TEL} SELECT step, CAST(sum(tput) AS BIGINT) AS tput, count(*) FILTER (WHERE state = 'DOWN') AS down, round(CAST(sum(cents) AS DOUBLE) / count(*) / 100, 6) AS mean_obs FROM tel GROUP BY step")
def agg_line_kpis(spark, sf):
    return flow.line_kpis(telemetry(spark, sf)).withColumn("mean_obs", F.round("mean_obs", 6))


@query(f"WITH {SCORES} SELECT fam, y, count(*) AS n, round(CAST(sum(count(*)) OVER (PARTITION BY fam) AS DOUBLE) / (count(*) OVER (PARTITION BY fam) * count(*)), 6) AS weight FROM scores GROUP BY fam, y")
def agg_class_weights(spark, sf):
    return flow.class_weights(scores(spark, sf), "fam", "y").withColumn("weight", F.round("weight", 6))


@query(f"WITH {TEL} SELECT machine, count(*) FILTER (WHERE state = 'DOWN') AS fails, round(CAST(count(*) FILTER (WHERE state = 'DOWN') + 1 AS DOUBLE) / (count(*) + 2), 6) AS p0 FROM tel WHERE machine % 4 = 0 GROUP BY machine")
def agg_p0(spark, sf):
    return flow.failure_rate(telemetry(spark, sf).filter("machine % 4 = 0"), ("machine",), F.col("state") == "DOWN").withColumn("p0", F.round("p0", 6))


@query(f"WITH {TEL} SELECT state, round(sqrt(CAST(count(*) * sum(cents * cents) - sum(cents) * sum(cents) AS DOUBLE)) / count(*) / 100, 6) AS noise FROM tel GROUP BY state")
def agg_noise_floor(spark, sf):
    return flow.noise_floor(telemetry(spark, sf), ("state",)).withColumn("noise", F.round("noise", 6))


_FAM = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{f}'" for e, f in FAMILIES) + " END"


def family_of(event):
    """The family of an event name; an unknown one is an error."""
    names = F.create_map(*[F.lit(x) for pair in FAMILIES for x in pair])
    return F.coalesce(F.element_at(names, event), F.raise_error(F.concat(F.lit("unknown event "), event)))


@query(f"SELECT {_FAM} AS family, count(*) AS n FROM events GROUP BY 1")
def prj_event_family(spark, sf):
    return read(spark, sf, "events").groupBy(family_of(F.col("event_type")).alias("family")).agg(F.count("*").alias("n"))


_NAMED = _PART_SQL.replace("machine LIKE", "name LIKE")


@query(f"WITH {FLEET} SELECT machine, name, {_NAMED} AS part, replace({_NAMED}, 'rework', 'cell') AS causal FROM fleet")
def prj_partition(spark, sf):
    """The partition of each machine of the fleet, and the one that it counts to in causes."""
    p = partition_of(F.col("name"))
    return fleet(spark, sf).select("machine", "name", p.alias("part"), F.when(p == "rework", "cell").otherwise(p).alias("causal"))


_FLEET_LOAD = _LOAD.replace("m.machine LIKE", "name LIKE")


@query(f"WITH {FLEET} SELECT machine, {_AMPS} AS amps, {_FLEET_LOAD} AS load, round({_AMPS} * 0.15 + {_FLEET_LOAD} * ({_AMPS} - {_AMPS} * 0.15), 6) AS run_amps FROM fleet")
def prj_load(spark, sf):
    """Rated current, load factor and running current of each machine of the fleet."""
    amps, load = flow.rated(F.col("name"), F.col("class"), AMPS, LOADS)
    m = fleet(spark, sf).withColumns({"amps": amps, "load": load})
    return m.select("machine", "amps", "load", F.round(flow.current(F.lit(True), 0.15, F.col("amps"), F.col("load")), 6).alias("run_amps"))


@query(f"WITH {FAULTS} SELECT machine, class, CASE WHEN class IN ('spike', 'drift', 'bias') THEN 'observation' WHEN class = 'stuck' OR class LIKE '%sensor%' THEN 'observation' ELSE 'physical' END AS mode, CASE WHEN class IN ('spike', 'drift', 'bias') THEN 'sensor' WHEN class IN ('delay', 'loss', 'breakdown', 'quality') THEN 'process' ELSE 'unknown' END AS origin, CASE WHEN mag >= 3.5 THEN 'caricature' ELSE 'incipient' END AS rung, t0 + CASE WHEN class = 'breakdown' THEN CAST(ceil(dur * 1.5) AS BIGINT) ELSE dur END AS until FROM faults")
def prj_fault_rows(spark, sf):
    """Mode, origin, rung and the extended end of breakdowns."""
    c = F.col("class")
    seen = c.isin("spike", "drift", "bias")
    until = F.col("t0") + F.when(c == "breakdown", F.ceil(F.col("dur") * 1.5)).otherwise(F.col("dur"))
    return faults(spark, sf).select(
        "machine", "class", F.when(seen | (c == "stuck") | c.contains("sensor"), "observation").otherwise("physical").alias("mode"),
        F.when(seen, "sensor").when(c.isin("delay", "loss", "breakdown", "quality"), "process").otherwise("unknown").alias("origin"),
        F.when(F.col("mag") >= 3.5, "caricature").otherwise("incipient").alias("rung"), until.alias("until"),
    )


@query(f"WITH {TEL} SELECT machine, step, greatest(-600, least(600, cents - 10000)) AS clamped, abs(cents - 10000) > 300 AS outside FROM tel")
def prj_envelope(spark, sf):
    d = F.col("cents") - 10000
    return telemetry(spark, sf).select("machine", "step", F.greatest(F.lit(-600), F.least(F.lit(600), d)).alias("clamped"), (F.abs(d) > 300).alias("outside"))


@query(f"WITH {GRID} SELECT buffer, step, round(least(1.0, CAST(n AS DOUBLE) / cap), 6) AS util, buffer = 'SBUF' AND n >= 0.8 * cap AS high, round(1 + 3 * least(1.0, CAST(n AS DOUBLE) / cap), 6) AS width FROM grid JOIN {_B.replace(' AS t(', ' AS b(')} ON b.ord % 5 = CASE channel WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END")
def prj_buffer_util(spark, sf):
    slot = F.when(F.col("channel") == "click", 0).when(F.col("channel") == "error", 1).when(F.col("channel") == "purchase", 2).when(F.col("channel") == "signup", 3).otherwise(4)
    g = grid(spark, sf).withColumn("slot", slot).join(buffers(spark).withColumn("slot", F.col("ord") % 5), "slot")
    return flow.buffer_use(g).select("buffer", "step", F.round("util", 6).alias("util"), "high", F.round("width", 6).alias("width"))


_RULES = {"t0_early": "t0 >= 42", "too_long": "t1 <= 49", "class": "class <> 'loss'", "mag": "mag = 0 OR (mag >= 0.5 AND mag <= 6)"}


@query(f"WITH {FAULTS} " + " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER (WHERE NOT ({v})) AS n FROM faults" for k, v in _RULES.items()))
def val_fault_contract(spark, sf):
    return contracts.violations(faults(spark, sf), {k: F.expr(v) for k, v in _RULES.items()})


@query(f"WITH {FAULTS}, g AS (SELECT machine, class, t0 - lag(t1) OVER (PARTITION BY machine % 5 ORDER BY t0, machine) AS gap FROM faults) SELECT machine, class, gap FROM g WHERE gap < 5")
def val_gap(spark, sf):
    return validate.gaps_below(faults(spark, sf), F.col("machine") % 5, 5)


@query(f"""WITH {FLEET}, b AS (SELECT plant || ':' || buffer AS buffer, cap FROM (SELECT DISTINCT plant FROM fleet), {_B})
SELECT 'machines' AS what, count(*) AS n, count(*) - count(DISTINCT machine) AS repeats, count(*) FILTER (WHERE mttf <= mttr) AS bad FROM fleet UNION ALL SELECT 'buffers', count(*), count(*) - count(DISTINCT buffer), count(*) FILTER (WHERE cap <= 0) FROM b""")
def val_roster(spark, sf):
    """The rosters of the fleet's machines and of its plants' buffers."""
    f = fleet(spark, sf)
    m = validate.roster(f, "machines", "machine", F.col("mttf") <= F.col("mttr"))
    caps = F.explode(F.array(*[F.struct(F.lit(b).alias("buffer"), F.lit(c).alias("cap")) for b, c in BUFFERS]))
    b = f.select("plant").distinct().select("plant", caps.alias("b")).select(F.concat_ws(":", F.col("plant").cast("string"), "b.buffer").alias("buffer"), "b.cap")
    return m.unionByName(validate.roster(b, "buffers", "buffer", F.col("cap") <= 0))


@query(f"WITH {FAULTS}, f AS (SELECT DISTINCT machine % 16 AS part, class FROM faults) SELECT p.part, c.class FROM (SELECT range AS part FROM range(16)) p CROSS JOIN {sql_values([(c,) for c in CLASSES], 'class').replace(' AS t(', ' AS c(')} WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.part = p.part AND f.class = c.class)")
def val_coverage_gate(spark, sf):
    cells = spark.range(16).select(F.col("id").alias("part"), F.explode(F.array(*map(F.lit, CLASSES))).alias("class"))
    return flow.coverage_gaps(faults(spark, sf).select((F.col("machine") % 16).alias("part"), "class"), cells)


@query(f"WITH {FAULTS}, s AS (SELECT machine % 10 AS ep, unnest(range(t0, t1)) AS t FROM faults) SELECT ep, count(DISTINCT t) AS steps, count(*) AS total, count(DISTINCT t) <= 0.08 * 180 AS ok FROM s GROUP BY ep")
def val_rate_budget(spark, sf):
    return validate.rate_budget(faults(spark, sf), F.col("machine") % 10, 0.08 * 180)


@query(f"WITH {TEL} SELECT count(*) AS n, count(DISTINCT state) AS states, count(*) FILTER (WHERE state NOT IN ('RUN', 'DOWN', 'BLOCKED', 'STARVED')) AS bad_state, count(*) FILTER (WHERE obs IS NULL OR obs < 0) AS bad_obs, count(*) FILTER (WHERE step < 0) AS bad_step FROM tel")
def val_tick_contract(spark, sf):
    return validate.tick_contract(telemetry(spark, sf), flow.STATES)


@query("SELECT 'missing' AS side, l AS k FROM (SELECT CAST(c_custkey AS BIGINT) AS l FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'extra', l FROM (SELECT o_custkey AS l FROM orders WHERE o_custkey % 2 = 0 EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0)")
def set_symmetric(spark, sf):
    c, o = read(spark, sf, "customer").select(F.col("c_custkey").alias("k")), read(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    missing = validate.symmetric_difference(c, o).filter("side = 'missing'")
    return missing.unionByName(validate.symmetric_difference(c.filter("k % 4 = 0"), o.filter("k % 2 = 0")).filter("side = 'extra'"))


@query("SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 = 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_intersect(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("k")).filter("k % 3 = 0").intersect(read(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")))


@query("WITH s AS (SELECT DISTINCT user_id % 5 AS g, event_type || CAST(event_id % 7 AS VARCHAR) AS e FROM events WHERE event_id % 3 = 0), p AS (SELECT a.g AS ga, b.g AS gb, count(*) AS common FROM s a JOIN s b ON a.e = b.e AND a.g < b.g GROUP BY 1, 2), n AS (SELECT g, count(*) AS n FROM s GROUP BY g) SELECT ga, gb, round(1 - CAST(common AS DOUBLE) / (x.n + y.n - common), 6) AS flip FROM p JOIN n x ON x.g = ga JOIN n y ON y.g = gb")
def set_edge_flip(spark, sf):
    """The share of edges on which each two of five sets differ."""
    s = read(spark, sf, "events").filter("event_id % 3 = 0").select((F.col("user_id") % 5).alias("g"), F.concat("event_type", (F.col("event_id") % 7).cast("string")).alias("e"))
    return validate.edge_flips(s).withColumn("flip", F.round("flip", 6))


@query(f"WITH {TEL}, r AS (SELECT machine, step, state, row_number() OVER (PARTITION BY machine ORDER BY step DESC) AS rn, count(*) OVER (PARTITION BY machine) AS n FROM tel WHERE state <> 'RUN') SELECT machine, step, state, greatest(0, n - 5) AS overflow FROM r WHERE rn <= 5")
def srt_latest_capped(spark, sf):
    """The five latest of each entity and how many there are besides."""
    t = telemetry(spark, sf).filter("state <> 'RUN'").select("machine", "step", "state")
    return episodes.latest_capped(t, "machine", "step", 5)


@query(f"WITH {FAULTS} SELECT machine % 7 AS g, min_by(class, CAST(t0 AS BIGINT) * 100000 + machine) AS root, max_by(machine, mag * 100000 - machine) AS severest FROM faults GROUP BY 1")
def srt_priority(spark, sf):
    return episodes.priority(faults(spark, sf), F.col("machine") % 7)


@query("SELECT lower(sha256(event_type || ':' || CAST(user_id AS VARCHAR))) AS digest, count(*) AS n FROM events GROUP BY 1")
def snk_digest(spark, sf):
    return read(spark, sf, "events").groupBy(F.sha2(F.concat("event_type", F.lit(":"), F.col("user_id").cast("string")), 256).alias("digest")).agg(F.count("*").alias("n"))


@query()
def snk_content_digest(spark, sf):
    """Digest of each entity's telemetry, whatever the order of its rows."""
    return contracts.content_digest(telemetry(spark, sf).drop("event_id"), ("machine",))


@query("SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def fn_json(spark, sf):
    return read(spark, sf, "events").groupBy("user_id", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query(f"WITH {GRID} SELECT step, '{{\"step\":' || step || ',\"n\":[' || string_agg(CAST(n AS VARCHAR), ',' ORDER BY channel) || ']}}' AS tick FROM grid GROUP BY step")
def str_ticks(spark, sf):
    """The tick frames of a replay: one JSON object a step, channels in order."""
    return frames.ticks(grid(spark, sf))


@query(f"""WITH {TEL}, c AS (SELECT machine // 26 AS plant, machine % 26 AS idx, step, state, tput FROM tel)
SELECT plant, step, '{{"step":' || step || ',"states":["' || string_agg(state, '","' ORDER BY idx) || '"],"throughput":[' || string_agg(CAST(tput AS VARCHAR), ',' ORDER BY idx) || ']}}' AS tick FROM c GROUP BY plant, step""")
def str_plant_ticks(spark, sf):
    """The ticks of each plant of the fleet, its machines in the order of the roster."""
    c = telemetry(spark, sf).withColumns({"plant": F.floor(F.col("machine") / F.lit(26)), "idx": F.col("machine") % 26})
    return frames.ordered_ticks(c, {"states": "state", "throughput": "tput"}, ("plant",), "idx")


@query(f"WITH {GRID} SELECT step, 'event: tick' || chr(10) || 'data: ' || CAST(sum(n) AS BIGINT) || chr(10) || chr(10) AS frame FROM grid WHERE step >= 90 GROUP BY step")
def str_sse_frames(spark, sf):
    g = grid(spark, sf).filter("step >= 90").groupBy("step").agg(F.sum("n").alias("n"))
    return frames.server_events(g, "tick", F.col("n").cast("string")).select("step", "frame")


_PRIO = "CASE WHEN f.machine IS NOT NULL THEN 5 WHEN state = 'DOWN' THEN 4 WHEN state = 'BLOCKED' THEN 3 WHEN state = 'STARVED' THEN 2 ELSE 1 END"


@query(f"""WITH RECURSIVE {TEL}, {FAULTS}, p AS MATERIALIZED (SELECT tel.machine, step, {_PRIO} AS priority FROM tel LEFT JOIN faults f ON f.machine = tel.machine AND step >= t0 AND step < t1),
 r AS (SELECT machine, step, priority, priority AS shown, step AS since FROM p WHERE step = 0
  UNION ALL SELECT p.machine, p.step, p.priority, CASE WHEN p.priority > shown OR p.step - since >= 3 THEN p.priority ELSE shown END, CASE WHEN p.priority > shown OR p.step - since >= 3 THEN p.step ELSE since END
   FROM r JOIN p ON p.machine = r.machine AND p.step = r.step + 1)
SELECT machine, step, priority, shown FROM r""")
def str_narration(spark, sf):
    """What is said of each entity's replay at each step, and what is shown, which stays for three steps unless something graver comes."""
    t = labels.active(telemetry(spark, sf), faults(spark, sf))
    down, blocked, starved = (F.bool_or(F.col("state") == s) for s in ("DOWN", "BLOCKED", "STARVED"))
    p = frames.priorities(t, [(F.max("y") == 1, 5), (down, 4), (blocked, 3), (starved, 2)], ("machine",))
    return narration.narrated(p, F.col("priority"), 3)


@query(f"""WITH {TEL}, f AS (SELECT machine, step, '{{"step":' || step || ',"cents":' || cents || '}}' AS tick FROM tel WHERE machine % 3 <> 0 OR step <> 20 UNION ALL SELECT machine, step, '{{"step":' || step || ',"cents":' || cents || '}}' FROM tel WHERE step >= 10 AND step < 15),
 g AS (SELECT machine, count(DISTINCT step) AS rows, max(step) AS last, CAST(sum(strlen(tick)) AS BIGINT) AS bytes FROM f GROUP BY machine)
SELECT machine, rows, last, CASE WHEN machine % 3 = 0 AND last > 20 THEN 20 ELSE rows END AS resume, bytes, rows = 60 AS complete, bytes <= 1700 AS budget_ok FROM g""")
def str_completeness(spark, sf):
    """Frames of each replay, some lost and some sent again: whether all are there, where to resume, and their bytes against a budget."""
    t = telemetry(spark, sf)
    sent = t.filter("machine % 3 <> 0 or step <> 20").unionByName(t.filter("step >= 10 and step < 15"))
    return frames.completeness(sent.select("machine", "step", F.to_json(F.struct("step", "cents")).alias("tick")), 60, 1700)


@query(f"WITH {GRID} SELECT step, CAST(sum(n) AS BIGINT) AS n FROM grid GROUP BY step")
def src_frames(spark, sf):
    """The events of a replay written as a stream sends them, and read by the data source in ranges of 300 bytes."""
    path = storage.shared_folder(spark)
    g = grid(spark, sf).groupBy("step").agg(F.sum("n").alias("n"))
    data = F.to_json(F.struct("step", "n"))
    # a line's end is the second of a frame's
    frames.server_events(g, "tick", data).select(F.expr("substr(frame, 1, length(frame) - 1)")).write.text(path)
    frames_source.register(spark)
    got = spark.read.format("frames").option("path", path).option("range", 300).load().filter("event = 'tick'")
    return got.select(F.from_json("data", "step long, n long").alias("x")).select("x.*")


@query(f"WITH {GRID} SELECT step // 10 AS batch, CAST(sum(n) AS BIGINT) AS n, CAST(greatest(0, sum(n) - 500) AS BIGINT) AS dropped FROM grid GROUP BY 1")
def str_backpressure(spark, sf):
    return frames.dropped(grid(spark, sf), F.expr("step div 10"), 500)


@query(f"WITH {SCORES}, t AS (SELECT unnest([0.3, 0.4, 0.5, 0.6]) AS thr) SELECT CAST(thr AS DOUBLE) AS thr, count(*) FILTER (WHERE score >= CAST(thr AS DOUBLE) AND y = 1) AS tp, count(*) FILTER (WHERE score >= CAST(thr AS DOUBLE) AND y = 0) AS fp, round(2.0 * count(*) FILTER (WHERE score >= CAST(thr AS DOUBLE) AND y = 1) / (count(*) FILTER (WHERE score >= CAST(thr AS DOUBLE)) + sum(y)), 6) AS f1 FROM scores, t GROUP BY thr")
def rst_threshold_sweep(spark, sf):
    return episodes.threshold_sweep(scores(spark, sf), [0.3, 0.4, 0.5, 0.6]).withColumn("f1", F.round("f1", 6))


@query(f"WITH {SCORES}, f AS (SELECT fam, quantile_cont(score, 0.9) AS thr FROM scores WHERE fam IN ('en', 'de') GROUP BY fam), g AS (SELECT quantile_cont(score, 0.9) AS thr FROM scores) SELECT id, score >= coalesce(f.thr, g.thr) AS dec FROM scores LEFT JOIN f ON f.fam = scores.fam, g")
def rst_family_threshold(spark, sf):
    """Each family's threshold, else the global one."""
    return episodes.by_family_threshold(scores(spark, sf), F.col("fam").isin("en", "de"), 0.9, "fam").select("id", "dec")


@query(f"WITH {TEL}, m AS (SELECT machine, quantile_cont(obs, 0.5) AS med FROM tel WHERE state = 'RUN' GROUP BY machine) SELECT tel.machine, step, round(CASE WHEN state = 'DOWN' THEN med ELSE obs END, 6) AS obs FROM tel LEFT JOIN m ON m.machine = tel.machine")
def rst_impute(spark, sf):
    t = episodes.imputed(telemetry(spark, sf), "obs", F.col("state") == "DOWN", F.col("state") == "RUN")
    return t.select("machine", "step", F.round("obs", 6).alias("obs"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS qty FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def src_projection(spark, sf):
    """Four columns and one pushed filter of a wide table."""
    li = read(spark, sf, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.round("l_quantity").cast("long")).alias("qty"))


@query("SELECT shard, event_type, count(*) AS n FROM (SELECT 0 AS shard, event_type FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 1, event_type FROM events WHERE event_id % 2 = 1) GROUP BY 1, 2")
def src_shards(spark, sf):
    e = read(spark, sf, "events")
    both = e.filter("event_id % 2 = 0").withColumn("shard", F.lit(0)).unionByName(e.filter("event_id % 2 = 1").withColumn("shard", F.lit(1)))
    return both.groupBy("shard", "event_type").agg(F.count("*").alias("n"))


@query(f"WITH {FAULTS}, a AS (SELECT list(machine ORDER BY machine) AS m, list(class ORDER BY machine) AS c FROM faults) SELECT unnest(m) AS machine, unnest(c) AS class, unnest(range(len(m))) AS pos FROM a")
def src_positional_zip(spark, sf):
    """Two arrays of a manifest zipped by position. The arrays hold one element a manifest row."""
    f = faults(spark, sf).agg(F.array_sort(F.collect_list(F.struct("machine", "class"))).alias("x"))
    z = f.select(F.arrays_zip(F.transform("x", lambda r: r["machine"]).alias("machine"), F.transform("x", lambda r: r["class"]).alias("class")).alias("z"))
    return z.select(F.posexplode("z").alias("pos", "r")).select("r.machine", "r.class", F.col("pos").cast("long").alias("pos"))
