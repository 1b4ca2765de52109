"""The driver's tables as canonical telemetry, faults, parts and scores, each with its SQL.

Time is an integer step. An entity's rows are dealt out by its key once; the operators' windows keep that
partitioning, so a query over one series table has one shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeline.functions.dims import CLASSES, EDGES, MACHINES, PHYSICAL_EDGES, edges, machines, sql_values

#: Scaled-down constants: steps of warm-up, and the end of calibration.
WARMUP, CAL_END = 5, 40


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(machine, step, obs, cents, state, tput, event_id): a user's events in order of time."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    state = F.when(F.col("event_type") == "error", "DOWN").when(F.col("event_type") == "purchase", "BLOCKED").when(F.col("event_type") == "signup", "STARVED").otherwise("RUN")
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return e.select(
        F.col("user_id").alias("machine"),
        (F.row_number().over(w) - 1).cast("long").alias("step"),
        F.col("value").alias("obs"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        state.alias("state"),
        (F.col("event_type") == "purchase").cast("long").alias("tput"),
        "event_id",
    )


TEL = f"""tel AS (SELECT user_id AS machine, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS step,
 value AS obs, CAST(round(value * 100) AS BIGINT) AS cents,
 CASE event_type WHEN 'error' THEN 'DOWN' WHEN 'purchase' THEN 'BLOCKED' WHEN 'signup' THEN 'STARVED' ELSE 'RUN' END AS state,
 CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS tput, event_id FROM events)"""


def faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(machine, class, t0, dur, t1, mag): one labelled half-open interval for three entities of four."""
    m = read(spark, sf_dir, "events").select(F.col("user_id").alias("machine")).distinct().filter("machine % 4 <> 0")
    names = F.array(*map(F.lit, CLASSES))
    m = m.withColumns({"class": F.get(names, (F.col("machine") % 7).cast("int")), "t0": 40 + F.col("machine") % 4, "dur": 4 + F.col("machine") % 5, "mag": (F.col("machine") % 16) / 2.0})
    return m.withColumn("t1", F.col("t0") + F.col("dur"))


_CLASS_SQL = "CASE machine % 7 " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(CLASSES)) + " END"
FAULTS = f"""faults AS (SELECT machine, {_CLASS_SQL} AS class, 40 + machine % 4 AS t0, 4 + machine % 5 AS dur,
 44 + machine % 4 + machine % 5 AS t1, CAST(machine % 16 AS DOUBLE) / 2 AS mag
 FROM (SELECT DISTINCT user_id AS machine FROM events) WHERE machine % 4 <> 0)"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, step, cents, n, state): four-hour buckets of each event type, dense from the first to the last bucket that any has.
    An empty cell is STARVED with no value."""
    e = read(spark, sf_dir, "events")
    step = F.floor(F.timestamp_diff("SECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts")) / F.lit(14400)).cast("long")
    got = e.select(F.col("event_type").alias("channel"), step.alias("step"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    got = got.groupBy("channel", "step").agg(F.sum("cents").alias("cents"), F.count("*").alias("n"))
    # one row a channel meets here
    frame = got.groupBy("channel").agg(F.min("step").alias("a"), F.max("step").alias("b"))
    whole = Window.partitionBy(F.lit(0))
    frame = frame.select("channel", F.min("a").over(whole).alias("a"), F.max("b").over(whole).alias("b")).select("channel", F.explode(F.sequence("a", "b")).alias("step"))
    return frame.join(got, ["channel", "step"], "left").select("channel", "step", "cents", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), "STARVED").when(F.col("channel") == "error", "DOWN").otherwise("RUN").alias("state"))


GRID = """got AS (SELECT event_type AS channel, CAST(floor(date_diff('second', TIMESTAMP '2024-01-01', ts) / 14400) AS BIGINT) AS step,
 CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n FROM events GROUP BY 1, 2),
 grid AS (SELECT c.channel, s.step, g.cents, coalesce(g.n, 0) AS n,
 CASE WHEN g.n IS NULL THEN 'STARVED' WHEN c.channel = 'error' THEN 'DOWN' ELSE 'RUN' END AS state
 FROM (SELECT DISTINCT event_type AS channel FROM events) c CROSS JOIN (SELECT unnest(range(min(step), max(step) + 1)) AS step FROM got) s
 LEFT JOIN got g ON g.channel = c.channel AND g.step = s.step)"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part, line, machine, t, flag): line items as parts, suppliers as machines, days as steps."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_returnflag")
    flag = F.when(F.col("l_returnflag") == "R", "REJECT").when(F.col("l_returnflag") == "A", "DEGRADE").otherwise("OK")
    day = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")).cast("long")
    return li.select(F.col("l_orderkey").alias("part"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_suppkey").alias("machine"), day.alias("t"), flag.alias("flag"))


PARTS = """parts AS (SELECT l_orderkey AS part, CAST(l_linenumber AS BIGINT) AS line, l_suppkey AS machine,
 CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS t,
 CASE l_returnflag WHEN 'R' THEN 'REJECT' WHEN 'A' THEN 'DEGRADE' ELSE 'OK' END AS flag FROM lineitem)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ep, fam, score, y): a deterministic score of labelled documents; a hundredth apart at least."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")
    score = ((F.col("n_chars") * 7 + F.col("doc_id") * 13) % 97 + F.when(F.col("quality") == 1, 30).otherwise(0)) / 128.0
    return d.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 10).alias("ep"), F.col("lang").alias("fam"), score.alias("score"), F.col("quality").cast("long").alias("y"))


SCORES = """scores AS (SELECT d.doc_id AS id, d.doc_id % 10 AS ep, d.lang AS fam,
 CAST((d.n_chars * 7 + d.doc_id * 13) % 97 + CASE WHEN l.quality = 1 THEN 30 ELSE 0 END AS DOUBLE) / 128 AS score,
 CAST(l.quality AS BIGINT) AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(machine, plant, name, class, base, sigma, cycle, mttf, mttr): the entities of events as machines of plants, a whole roster to each."""
    m = read(spark, sf_dir, "events").select(F.col("user_id").alias("machine")).distinct()
    m = m.withColumns({"plant": F.floor(F.col("machine") / F.lit(len(MACHINES))).cast("long"), "idx": (F.col("machine") % len(MACHINES)).cast("int")})
    return m.join(F.broadcast(machines(spark).withColumnRenamed("machine", "name")), "idx").drop("idx")  # one roster


_ROSTER = sql_values([(k, *m) for k, m in enumerate(MACHINES)], "idx, name, class, base, sigma, cycle, mttf, mttr")
FLEET = f"""fleet AS (SELECT u.machine, u.machine // {len(MACHINES)} AS plant, r.name, r.class, r.base, r.sigma, r.cycle, r.mttf, r.mttr
 FROM (SELECT DISTINCT user_id AS machine FROM events) u JOIN {_ROSTER.replace(' AS t(', ' AS r(')} ON u.machine % {len(MACHINES)} = r.idx)"""


def fleet_edges(spark: SparkSession, sf_dir: str, physical: bool = False) -> DataFrame:
    """(src, dst, src_name, dst_name): the flow edges of every plant between machines that it has."""
    f = fleet(spark, sf_dir).select("machine", "plant", "name")
    e = F.broadcast(edges(spark, physical).select(F.col("src").alias("src_name"), F.col("dst").alias("dst_name")))  # one plant's
    e = f.select(F.col("machine").alias("src"), "plant", F.col("name").alias("src_name")).join(e, "src_name")
    return e.join(f.select(F.col("machine").alias("dst"), "plant", F.col("name").alias("dst_name")), ["plant", "dst_name"]).select("src", "dst", "src_name", "dst_name")


def fleet_edges_sql(physical: bool = False) -> str:
    pairs = sql_values(PHYSICAL_EDGES if physical else EDGES, "src, dst").replace(" AS t(", " AS p(")
    return f"fleet_edges AS (SELECT a.machine AS src, b.machine AS dst, a.name AS src_name, b.name AS dst_name FROM fleet a JOIN {pairs} ON p.src = a.name JOIN fleet b ON b.name = p.dst AND b.plant = a.plant)"
