"""Mixing sources to target weights by systematic sampling. DataFrame operations only.

Within each source the documents stand in one fixed order (size, then a hash of the id and text, then the id and the text's hash),
each document's expected copies are summed up to it, one random offset is added, and the document is
emitted once for each whole number that the sum crosses. Ordering by size makes the words taken follow
the target closely, for every stretch of the order gives its share.

The prefix sum is distributed: counts for each (source, size), then for each hash bin of those, then a
row number within a bin. So no task ever holds a whole source, or all documents of one size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.llm.common import WORD, broadcast_up_to, given_back, set_apart, text_of, written

#: Expected copies are whole multiples of 1 / UNIT, so that prefix sums are exact in any order.
UNIT = 1 << 24
#: Hash bins among documents of one source and size.
BINS = 4096
#: Up to so many sources are broadcast, by count.
MAX_BROADCAST_SOURCES = 50_000


def n_words(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(__source, source_size, target, rate) from rows (__source, size).

    Sources in order of code point, null last, get the weights in turn. They share all words by
    weight, but none gets more than ``cap`` times its own; the excess is shared again by weight.
    That is a water level: in the order of cap / weight a source is capped if the level that the
    sources from it on would have reaches its cap. The windows hold one row a source.
    """
    w = Window.orderBy(F.col("__source").substr(1, 1).desc(), "__source")
    given = F.array(*[F.lit(float(x)) for x in weights])
    s = sizes.groupBy("__source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("__w", F.get(given, (F.row_number().over(w) - 1) % len(weights)))
    s = s.withColumn("__cap", F.col("source_size").cast("double") * cap)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("__cap") / F.col("__w"), "__source").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(order), F.lit(0.0))
    s = s.withColumns(
        {
            "__total": F.sum(F.col("source_size").cast("double")).over(everything),
            "__weight": F.sum("__w").over(everything),
            "__cap_before": before("__cap"),
            "__w_before": before("__w"),
        }
    )
    s = s.withColumn("__capped", F.col("__cap") * (F.col("__weight") - F.col("__w_before")) <= F.col("__w") * (F.col("__total") - F.col("__cap_before")))
    over = lambda c: F.sum(F.when(F.col("__capped"), F.col(c)).otherwise(0.0)).over(everything)
    s = s.withColumns({"__caps": over("__cap"), "__ws": over("__w")})
    level = F.try_divide(F.col("__total") - F.col("__caps"), F.col("__weight") - F.col("__ws"))
    target = F.when(F.col("__capped"), F.col("__cap")).otherwise(F.least(F.col("__cap"), F.col("__w") * level))
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    return s.withColumn("target", target).withColumn("rate", rate).select("__source", "source_size", "target", "rate")


def _keyed(docs: DataFrame, size: Column) -> DataFrame:
    # null sources sort last: 'v' before 'n' under the descending first character
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("source")))
    # of rows with one id, or none, the text tells which comes first
    tie = F.xxhash64("text") if "text" in docs.columns else F.lit(0).cast("long")
    return docs.withColumns({"__source": key, "size": size, "__tie": tie, "__bin": F.pmod(F.xxhash64("doc_id", tie), F.lit(BINS))})


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 17, size: Column | None = None) -> DataFrame:
    """All rows of ``docs`` (doc_id, source and what else there is) with size, source_size, target, copies
    and taken (copies * size). Columns of those names are replaced; others stay, whatever their names. ``size``, if given, is a
    column of ``docs`` that may be of one of those names.

    A null text has size 0; a source without words has target 0 and is not taken. Rows that are equal
    are separate documents. Null sources form one source, the last. An empty table gives an empty one.
    The result depends on the rows and ``seed`` only.
    """
    docs = docs.withColumn("__given", n_words() if size is None else size)
    docs, own = set_apart(docs, ("doc_id", "source", "text", "__given"), ("size", "source_size", "target", "copies", "taken"))
    keyed = _keyed(docs, F.col("__given")).drop("__given")
    light = written(keyed.select("__source", "size", "__bin").groupBy("__source", "size", "__bin").agg(F.count("*").alias("__n")))
    counts = light.select("__source", (F.col("size") * F.col("__n")).alias("size"))
    sources = source_targets(counts, weights, cap).withColumn("__e", F.round(F.col("rate") * UNIT).cast("long"))
    sources = sources.withColumn("__u", F.pmod(F.xxhash64(F.lit(seed), "__source"), F.lit(UNIT))).drop("rate")

    ahead = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    by_size = light.groupBy("__source", "size").agg(F.sum("__n").alias("__n"))
    by_size = by_size.select("__source", "size", F.coalesce(F.sum("__n").over(ahead("__source", "size")), F.lit(0)).alias("__before"))
    bins = light.withColumn("__in_size", F.coalesce(F.sum("__n").over(ahead("__source", "size", "__bin")), F.lit(0)))
    bins = bins.join(by_size, ["__source", "size"]).select("__source", "size", "__bin", (F.col("__before") + F.col("__in_size")).alias("__first"))

    place = Window.partitionBy("__source", "size", "__bin").orderBy("doc_id", "__tie")
    ranked = keyed.withColumn("__place", F.row_number().over(place).cast("long"))
    ranked = ranked.join(bins, ["__source", "size", "__bin"])
    ranked = ranked.join(broadcast_up_to(sources, MAX_BROADCAST_SOURCES), "__source")
    crossed = f"(__u + __e * (__first + __place)) div {UNIT} - (__u + __e * (__first + __place - 1)) div {UNIT}"
    out = ranked.withColumn("copies", F.expr(crossed))
    out = out.withColumn("taken", F.col("copies") * F.col("size"))
    return given_back(out.drop("__source", "__bin", "__tie", "__place", "__first", "__e", "__u"), own)


def emitted(mixed: DataFrame) -> DataFrame:
    """Each document as often as it is taken."""
    rows, own = set_apart(mixed, ("copies",))
    return given_back(rows.filter("copies > 0").withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("__i"), own)


def sizes_table(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size), written once: the mix itself then moves no text."""
    return written(docs.select("doc_id", "source", n_words().alias("size")))
