"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a session without
    that setting, as in tests, gets a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='gaugeline-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone, and the shared folder's own cleaning has to do
        pass


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back, which cuts the lineage and
    survives lost executors. The table goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def set_apart(docs: DataFrame, used: tuple[str, ...], replaced: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the columns ``used`` as they are and all others under names that no operator uses, without
    those ``replaced``; and the names to give back: {held: own}."""
    held = {c: f"__own_{k}" for k, c in enumerate(docs.columns) if c not in used}
    out = docs.toDF(*[held.get(c, c) for c in docs.columns])
    gone = [h for c, h in held.items() if c in replaced]
    return out.drop(*gone), {h: c for c, h in held.items() if c not in replaced}


def given_back(out: DataFrame, own: dict[str, str]) -> DataFrame:
    """``out`` with the names that set_apart took."""
    return out.toDF(*[own.get(c, c) for c in out.columns])


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if it has at most ``rows`` rows, by count; else left to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def numbered(rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``rows`` with a column ``out``: their places, from 0, in ``order``; equals are told apart by where they are stored, so
    ``rows`` should be a written table. Rows are dealt out by range and sorted in their part, and a part's rows get the count of
    those of the parts before it: one row a part meets in a task. No key, however frequent, has to fit in a part."""
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    by = [*order, F.col("__tie")]
    # the id of a row in a sorted part is the part's number, and below 33 bits the row's
    held = written(tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("__tie").withColumn("__at", F.monotonically_increasing_id()))
    parts = held.groupBy(F.shiftright("__at", 33).alias("__part")).agg(F.count("*").alias("__n"))
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__part", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    held = held.withColumn("__part", F.shiftright("__at", 33)).join(F.broadcast(parts), "__part")  # as many rows as parts
    return held.withColumn(out, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__at", "__before")
