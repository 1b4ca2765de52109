"""Running sums and exact quantiles over an order, without a task that sees all rows of a key.

Rows are cut into stretches of the order by approximate percentiles, summed within each, and a stretch's
rows get the total of the stretches before it: one row a stretch and key meets in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stretches of an order, for each key. An order of all rows has as many as Spark has shuffle partitions, if those are more.
PARTS = 64


def _parts(df: DataFrame, keys: tuple[str, ...]) -> int:
    held = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return PARTS if keys or not held.isdigit() else max(PARTS, int(held))


def _below(df: DataFrame, cuts: str, order: str, most: int, out: str) -> DataFrame:
    """``df`` with ``out``: how many of ``cuts``, a sorted array of ``most`` at most, are less than ``order``. A binary search, each step a column."""
    df = df.withColumn(out, F.lit(0))
    for step in (1 << b for b in reversed(range(most.bit_length()))):
        df = df.withColumn(out, F.col(out) + F.when(F.get(cuts, F.col(out) + (step - 1)) < F.col(order), step).otherwise(0))
    return df


def with_running_sums(df: DataFrame, order: str, sums: dict[str, str], keys: tuple[str, ...] = (), descending: bool = False, parts: int | None = None) -> DataFrame:
    """``df`` with a column for each of ``sums`` {name: summed column}: the sum up to and with the row, and <name>_all: that of all
    rows of the key. ``order`` is a number and differs between the rows of a key."""
    by = list(keys) or ["__all"]
    parts = parts or _parts(df, keys)
    df = df if keys else df.withColumn("__all", F.lit(0))
    cuts = df.groupBy(*by).agg(F.percentile_approx(order, F.array(*[F.lit((k + 1) / parts) for k in range(parts - 1)]), F.lit(max(1000, 10 * parts))).alias("__cuts"))
    df = df.join(cuts if keys else F.broadcast(cuts), by)  # without keys it is one row
    df = _below(df, "__cuts", order, parts - 1, "__part")
    df = df.withColumn("__part", parts - F.col("__part") if descending else F.col("__part")).drop("__cuts")
    within = Window.partitionBy(*by, "__part").orderBy(F.col(order).desc() if descending else F.col(order)).rowsBetween(Window.unboundedPreceding, 0)
    totals = df.groupBy(*by, "__part").agg(*[F.sum(c).alias(f"__t_{name}") for name, c in sums.items()])
    whole = Window.partitionBy(*by)
    ahead = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(f"__t_{name}").over(ahead), F.lit(0)).alias(f"__b_{name}") for name in sums]
    totals = totals.select(*by, "__part", *before, *[F.sum(f"__t_{name}").over(whole).alias(f"{name}_all") for name in sums])
    out = df.withColumns({name: F.sum(c).over(within) for name, c in sums.items()})
    out = out.join(totals if keys else F.broadcast(totals), [*by, "__part"])  # without keys as many rows as parts
    out = out.withColumns({name: F.col(name) + F.col(f"__b_{name}") for name in sums})
    return out.drop("__part", "__all", *[f"__b_{name}" for name in sums])


def ranks_within(shares: list[float], before: Column, n: Column, total: Column) -> Column:
    """array<struct(nth, part, lo, hi)>: the ``shares`` of whose two neighbouring ranks, p * (total - 1) rounded down and up, at least one
    is among the ``n`` ranks from ``before`` on; part is what lies between them."""
    place = lambda p: p * (total - 1)
    here = lambda i: (i >= before) & (i < before + n)
    of = F.transform(F.array(*map(F.lit, shares)), lambda p, k: F.struct(k.alias("nth"), (place(p) - F.floor(place(p))).alias("part"), here(F.floor(place(p))).alias("lo"), here(F.ceil(place(p))).alias("hi")))
    return F.filter(of, lambda x: x["lo"] | x["hi"])


def quantiles(counts: DataFrame, value: str, n: str, shares: list[float], keys: tuple[str, ...]) -> DataFrame:
    """(keys, nth, q): the ``shares[nth]`` quantile, interpolated between neighbours, of distinct values that occur ``n`` times."""
    g = with_running_sums(counts.select(*keys, value, n), value, {"__upto": n}, keys)
    g = g.select(*keys, value, F.explode(ranks_within(shares, F.col("__upto") - F.col(n), F.col(n), F.col("__upto_all"))).alias("x"))
    g = g.groupBy(*keys, F.col("x.nth").alias("nth")).agg(F.max(F.when(F.col("x.lo"), F.col(value))).alias("lo"), F.max(F.when(F.col("x.hi"), F.col(value))).alias("hi"), F.max("x.part").alias("part"))
    return g.select(*keys, "nth", F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("double")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("q"))


def numbered(df: DataFrame, order: str, out: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``out``: each row's number from 0 in its key's order. ``order`` differs between the rows of a key."""
    held = with_running_sums(df.withColumn("__one", F.lit(1).cast("long")), order, {out: "__one"}, keys)
    return held.withColumn(out, F.col(out) - 1).drop("__one", f"{out}_all")


def as_number(df: DataFrame, column: str) -> Column:
    """The column if it is a number, else a hash of it: an order for ``with_running_sums``."""
    kind = dict(df.dtypes)[column]
    return F.col(column) if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal") else F.xxhash64(column)


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float], keys: tuple[str, ...] = ()) -> DataFrame:
    """One row (keys, <column>: array<double> of its ``shares`` quantiles), for each key or for all rows; null where a key has no value of a column, and one row of nulls for no
    rows at all without keys. The values of all columns are counted side by side, and no task sees all of any."""
    by = (*keys, "__c")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns]))
    long = df.select(*keys, each.alias("__x")).select(*keys, F.col("__x.c").alias("__c"), F.col("__x.v").alias("__v")).filter("__v is not null")
    q = quantiles(long.groupBy(*by, "__v").agg(F.count("*").alias("__n")), "__v", "__n", shares, by)
    of = lambda c: F.array(*[F.max(F.when((F.col("__c") == c) & (F.col("nth") == k), F.col("q"))) for k in range(len(shares))])
    found = q.groupBy(*keys).agg(*[of(c).alias(c) for c in columns], *[F.count_if(F.col("__c") == c).alias(f"__n_{c}") for c in columns])
    return found.select(*keys, *[F.when(F.col(f"__n_{c}") > 0, F.col(c)).alias(c) for c in columns])
