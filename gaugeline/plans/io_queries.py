"""Queries that write a driver table through one of the writers to the shared folder and read it back through the guarded reader."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeline.operators import calibrate as cal
from gaugeline.operators import features as fe
from gaugeline.operators import gates, models
from gaugeline.operators.contracts import ContractError
from gaugeline.plans.base import query
from gaugeline.plans.detect_queries import FIT, good
from gaugeline.sources import storage
from gaugeline.sources.adapters import TEL, read, telemetry

_KINDS = "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY event_type"


def _kinds(df):
    return df.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def _events(spark, sf):
    return read(spark, sf, "events").select("event_id", "user_id", "event_type", "value")


@query(_KINDS)
def src_versioned(spark, sf):
    """A table of schema version 6, which a reader of version 5 refuses."""
    path = storage.write_sorted(_events(spark, sf).withColumn("schema_version", F.lit(6)), storage.shared_folder(spark), ["event_id"])
    columns = {"event_id": "bigint", "event_type": "string"}
    try:
        storage.read_versioned(spark, path, columns, 5)
    except ContractError:
        return _kinds(storage.read_versioned(spark, path, columns, 6))
    raise AssertionError("a table of another version was read")


@query(_KINDS)
def src_checksummed(spark, sf):
    """A table whose files have the digests that were noted when it was written."""
    path = storage.write_sorted(_events(spark, sf), storage.shared_folder(spark), ["event_id"], 4)
    noted = {r.name: r.sha256 for r in storage.file_digests(spark, path).collect()}  # one row a file
    return _kinds(storage.read_checksummed(spark, path, noted))


@query("""WITH r AS (SELECT user_id AS run_id, event_type AS job_name, CASE WHEN count(*) % 7 = 0 THEN 'failed' ELSE 'success' END AS status, round(sum(value), 2) AS wall, CAST(max(event_id) AS DOUBLE) AS rss FROM events WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT CAST(run_id AS VARCHAR) AS run_id, job_name, category FROM (SELECT *, 'status' AS category FROM r WHERE status <> 'success' UNION ALL SELECT *, 'wall' FROM r WHERE NOT (wall > 0 AND wall <= CAST(60 AS DOUBLE) * 1.02) UNION ALL SELECT *, 'rss' FROM r WHERE NOT (rss > 0 AND rss <= 4096))""")
def src_run_log(spark, sf):
    """A run log of JSON lines with comments and blank lines, and what is wrong with its runs."""
    e = read(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("job_name"))
    r = e.agg(F.when(F.count("value") % 7 == 0, "failed").otherwise("success").alias("status"), F.round(F.sum("value"), 2).alias("wall_seconds"), F.max("event_id").cast("double").alias("peak_rss_mb"))
    lines = r.select(F.explode(F.array(F.lit("# a comment"), F.lit("  "), F.to_json(F.struct(*r.columns)))).alias("value"))
    path = storage.shared_folder(spark)
    lines.write.text(path)
    return gates.run_log_failures(storage.read_run_log(spark, path))


@query("""SELECT 'f1_' || event_type AS metric, round(avg(CAST(round(value * 100) AS BIGINT)), 4) AS value FROM events GROUP BY event_type UNION ALL SELECT 'flip A', NULL""")
def src_gate_csv(spark, sf):
    """A CSV of metrics and values, one of which isn't a number."""
    m = read(spark, sf, "events").groupBy(F.concat(F.lit("f1_"), "event_type").alias("metric")).agg(F.round(F.avg(F.round(F.col("value") * 100).cast("long")), 4).cast("string").alias("value"))
    path = storage.shared_folder(spark)
    m.unionByName(spark.createDataFrame([("flip A", "none")], "metric string, value string")).coalesce(1).write.option("header", True).csv(path)
    return storage.read_gate_csv(spark, path)


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids, 'event_id,event_type,user_id,value' AS columns, CAST(0 AS BIGINT) AS unsorted FROM events")
def snk_sorted(spark, sf):
    """A table in shards, columns by name and rows in order: every file begins where the one before ended or later."""
    path = storage.write_sorted(_events(spark, sf), storage.shared_folder(spark), ["event_id"], 4)
    df = spark.read.parquet(path)
    files = df.groupBy(F.input_file_name().alias("f")).agg(F.min("event_id").alias("a"), F.max("event_id").alias("b"), F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))
    files = files.withColumn("bad", F.coalesce(F.col("a") <= F.lag("b").over(Window.orderBy("a")), F.lit(False)))  # one row a file
    return files.agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"), F.lit(",".join(df.columns)).alias("columns"), F.count_if("bad").alias("unsorted"))


@query("""SELECT '{"columns":["event_id","event_type"],"rows":' || count(*) || '}' AS meta FROM events""")
def snk_sidecar(spark, sf):
    """A table's description as JSON with sorted keys."""
    path = storage.shared_folder(spark) + "/meta.json"
    storage.write_text(spark, path, storage.sidecar({"rows": read(spark, sf, "events").count(), "columns": ["event_id", "event_type"]}))
    return spark.createDataFrame([(storage.read_text(spark, path),)], "meta string")


@query(_KINDS)
def snk_partitioned(spark, sf):
    """A folder for each kind of event, with digests of all files, verified before it is read."""
    path = storage.shared_folder(spark)
    storage.write_partitioned(_events(spark, sf), path, "event_type")
    storage.verify_partitioned(spark, path)
    return _kinds(spark.read.option("pathGlobFilter", "*.parquet").option("basePath", path).parquet(f"{path}/event_type=*"))


@query("SELECT event_type, 2 * count(*) AS n, CAST(2 * sum(event_id) AS BIGINT) AS ids FROM events GROUP BY event_type")
def snk_append(spark, sf):
    """Two batches of JSON lines; one is written twice and counts once."""
    path, e = storage.shared_folder(spark), _events(spark, sf)
    added = [storage.append_json_lines(e, path, b) for b in ("a", "b", "a")]
    assert added == [True, True, False]
    return _kinds(spark.read.schema(e.schema).option("recursiveFileLookup", True).json(path))


@query("SELECT event_type, 2 * count(*) AS n, CAST(2 * sum(event_id) AS BIGINT) AS ids FROM events GROUP BY event_type")
def snk_csv(spark, sf):
    """A CSV table of one header, appended to twice."""
    path, e = storage.shared_folder(spark), _events(spark, sf).select("event_id", "event_type")
    storage.append_csv(e, path)
    storage.append_csv(e, path)
    return _kinds(storage.read_csv_table(spark, path, "event_id long, event_type string"))


@query("SELECT true AS kept, true AS refused")
def snk_capped(spark, sf):
    """A table within its cap stays; one over it is removed and is an error."""
    a, b = storage.shared_folder(spark), storage.shared_folder(spark)
    kept = storage.write_capped(_events(spark, sf), a, 1 << 60) > 0
    try:
        storage.write_capped(_events(spark, sf), b, 10)
        refused = False
    except ContractError:
        refused = True
    return spark.createDataFrame([(kept, refused)], "kept boolean, refused boolean")


_PLANT = TEL.replace("user_id AS machine", "user_id % 26 AS machine", 1)


@query(f"WITH {_PLANT}, {FIT} SELECT machine, round(thr, 6) AS thr, round(thr_low, 6) AS thr_low FROM fit")
def snk_thresholds(spark, sf):
    """Thresholds of the plant's 26 machines, saved as an artifact and loaded; another roster is refused."""
    t = telemetry(spark, sf).withColumn("machine", F.col("machine") % 26)
    fit = cal.tukey_fit(t, good()).select("machine", "thr", "thr_low")
    path = storage.shared_folder(spark) + "/thresholds.json"
    models.save_thresholds(fit, path, 17)
    roster = {r.machine for r in fit.select("machine").collect()}
    try:
        models.load_thresholds(spark, path, roster | {-1})
    except ContractError:
        return models.load_thresholds(spark, path, roster).select("machine", F.round("thr", 6).alias("thr"), F.round("thr_low", 6).alias("thr_low"))
    raise AssertionError("an artifact of another roster was loaded")


@query(f"""WITH {TEL}, f AS (SELECT machine, step - 15 AS start, min(cents) OVER w AS lo, max(cents) OVER w AS hi FROM tel WINDOW w AS (PARTITION BY machine ORDER BY step ROWS 15 PRECEDING))
SELECT machine, start, lo, hi FROM f WHERE start >= machine * 7 % 8 AND (start - machine * 7 % 8) % 8 = 0""")
def win_jitter(spark, sf):
    """Windows whose first start is each entity's own phase."""
    return fe.window_features(telemetry(spark, sf), 16, 8, off=F.col("machine") * 7 % 8).select("machine", "start", "lo", "hi")
