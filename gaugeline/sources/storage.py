"""Readers with guards, deterministic writers, and the shared folder."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.operators.contracts import ContractError, assert_schema, content_digest


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share; a local one only if unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='gaugeline-')}"
    return f"{base.rstrip('/')}/run-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage ends there, and lost executors don't matter. The
    table goes when the driver ends."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone, and the shared folder's own cleaning has to do
        pass


def read_versioned(spark: SparkSession, path: str, columns: dict[str, str], version: int) -> DataFrame:
    """A Parquet table with these columns and one schema version, else a ContractError."""
    return assert_schema(spark.read.parquet(path), columns, version)


def read_checksummed(spark: SparkSession, path: str, expected: dict[str, str]) -> DataFrame:
    """A Parquet table whose files have the given SHA-256 by name; hashing is done where the files are read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    found = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))
    got = {r.name: r.sha256 for r in found.limit(len(expected) + 1).collect()}
    if got != expected:
        raise ContractError(f"checksums differ for {sorted(set(got.items()) ^ set(expected.items()))[:3]}")
    return spark.read.parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON manifest {rows: [...], fault_episodes: [...]}: each row with its episode by position. An object
    {manifest: ...} is unwrapped; an empty one or one of unequal lengths is an error."""
    raw = spark.read.option("multiLine", True).json(path)
    raw = raw.select("manifest.*") if "manifest" in raw.columns else raw
    z = raw.select(F.size("rows").alias("a"), F.size("fault_episodes").alias("b"), F.posexplode(F.arrays_zip("rows", "fault_episodes")).alias("pos", "z"))
    if z.filter("a = b").isEmpty() or not z.filter("a <> b").isEmpty():
        raise ContractError("a manifest needs as many episodes as rows, and one at least")
    return z.select("pos", "z.rows.*", F.col("z.fault_episodes").alias("episode_id"))


def read_run_log(spark: SparkSession, path: str, required: tuple[str, ...] = ("run_id", "job_name", "wall_seconds", "status")) -> DataFrame:
    """JSON lines without blank ones and comments; a line that lacks a required field is an error."""
    ddl = "run_id string, job_name string, wall_seconds double, peak_rss_mb double, status string, artifact_path string"
    lines = spark.read.text(path).filter("trim(value) <> '' and not startswith(ltrim(value), '#')")
    rows = lines.select(F.from_json("value", ddl).alias("r"), "value").select("r.*", "value")
    bad = rows.filter(" or ".join(f"{c} is null" for c in required))
    if not bad.isEmpty():
        raise ContractError(f"run log line without {required}: {bad.first().value[:80]}")
    return rows.drop("value")


def read_gate_csv(spark: SparkSession, path: str) -> DataFrame:
    """(metric, value) of a CSV of either form: key and value columns, or a column for each metric."""
    raw = spark.read.option("header", True).csv(path)
    if [c.lower() for c in raw.columns] == ["metric", "value"]:
        return raw.select(F.col(raw.columns[0]).alias("metric"), F.col(raw.columns[1]).try_cast("double").alias("value"))
    long = raw.unpivot([], raw.columns, "metric", "value")
    return long.select("metric", F.col("value").try_cast("double").alias("value"))


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, row, value) of the one-dimensional arrays of NPZ dumps, read where the files are."""

    def opened(batches):
        import io

        import numpy as np
        import pandas as pd

        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as held:
                    for name in held.files:
                        x = held[name].astype("f8").ravel()
                        yield pd.DataFrame({"file": file.rsplit("/", 1)[-1], "name": name, "row": np.arange(len(x)), "value": x})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    return files.mapInPandas(opened, "file string, name string, row long, value double")


def write_sorted(df: DataFrame, path: str, order: list[str], files: int = 8) -> str:
    """Parquet with columns by name and rows in one order, in so many range-partitioned files."""
    df = df.select(*sorted(df.columns))
    df = df.coalesce(1).sortWithinPartitions(*order) if files == 1 else df.repartitionByRange(files, *order).sortWithinPartitions(*order)
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)
    return path


def file_digests(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """(name, bytes, sha256) of the files below a folder, hashed where they are read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_capped(df: DataFrame, path: str, most_bytes: int) -> int:
    """Writes a Parquet table and returns its bytes; one of more than ``most_bytes`` is removed again and is an error."""
    df.write.mode("overwrite").parquet(path)
    got = df.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).agg(F.sum("length")).first()[0] or 0
    if got > most_bytes:
        remove(df.sparkSession, path)
        raise ContractError(f"{path} has {got} bytes, over {most_bytes}")
    return got


def write_partitioned(df: DataFrame, path: str, by: str) -> DataFrame:
    """One folder for each value of ``by``, and beside them _manifest with (name, bytes, sha256) of each file and a master
    digest of them; returns (by, n)."""
    df.repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)
    files = file_digests(df.sparkSession, path)
    master = content_digest(files).select(F.lit("*").alias("name"), F.col("n").alias("bytes"), F.col("digest").alias("sha256"))
    files.unionByName(master).write.mode("overwrite").json(f"{path}/_manifest")
    return df.groupBy(by).agg(F.count("*").alias("n"))


def verify_partitioned(spark: SparkSession, path: str) -> None:
    """An error unless the files below ``path`` are those of its manifest."""
    held = spark.read.schema("name string, bytes long, sha256 string").json(f"{path}/_manifest")
    files = file_digests(spark, path)
    master = held.filter("name = '*'").select("sha256").collect()
    now = content_digest(files).first()
    if [r.sha256 for r in master] != [now.digest] or not held.filter("name <> '*'").exceptAll(files).isEmpty():
        raise ContractError(f"files of {path} differ from its manifest")


def append_json_lines(df: DataFrame, path: str, batch: str) -> bool:
    """Appends the rows as a batch of JSON lines of that name, and says whether it did: a batch that is there already isn't written again,
    so a writer that runs twice, or two at once with one name, add it once. Read with ``recursiveFileLookup``."""
    try:
        df.write.mode("errorifexists").json(f"{path}/{batch}")
        return True
    except AnalysisException:
        return False


def append_csv(df: DataFrame, path: str) -> None:
    """Appends to a CSV table that has one header: a file of its own, written first, and rows without one."""
    spark = df.sparkSession
    header = f"{path}/_header"
    try:
        names = read_text(spark, header).strip().split(",")
    except Exception:
        write_text(spark, header, ",".join(df.columns) + "\n")
        names = df.columns
    if names != df.columns:
        raise ContractError(f"columns {df.columns}, not {names}")
    df.write.mode("append").option("header", False).csv(path)


def read_csv_table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A table of ``append_csv``, if its header has the names of ``ddl``."""
    df = spark.read.schema(ddl).option("pathGlobFilter", "*.csv").csv(path)
    if read_text(spark, f"{path}/_header").strip().split(",") != df.columns:
        raise ContractError("the header names other columns")
    return df


def _file(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, replaced whole."""
    where, fs = _file(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    where, fs = _file(spark, path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def sidecar(meta: dict) -> str:
    return json.dumps(meta, sort_keys=True, separators=(",", ":"))
