"""Exact nearest neighbours by a box-partitioned join, and scores from them.

Reference vectors, each different one once with its count, are dealt out to cells: the leaves of a tree of cuts at medians. A vector that asks is first compared within its own cell; how far its
k-th nearest is there bounds how far it can be at all, and the vector is sent on only to those cells whose bounding box is as near. In a task a cell is cut into
leaves by such a tree again, and only leaves that are near enough are compared. A cell that many ask is dealt out to many tasks. Nothing is sampled but the rows that the
cuts between cells come from, which decide the work and not the result.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.sources.storage import written

#: Cells: their boxes are sent to all tasks. Beyond so many blocks of reference vectors cells have more than a block.
MOST_CELLS = 2_048
BLOCK = 4_096
#: Reference vectors in a leaf of a cell, and vectors that are compared with it at once.
LEAF, AT_ONCE = 128, 2_048


def _vectors(df: DataFrame, features: list[str], counted: Column) -> DataFrame:
    """(v, n): the different vectors, and how many rows ``counted`` has of each."""
    v = F.array(*[F.col(f).cast("double") for f in features])
    return df.select(v.alias("v"), counted.cast("long").alias("n")).groupBy("v").agg(F.sum("n").alias("n"))


class Cuts:
    """A tree of at most ``most`` leaves: the largest leaf is cut next, at the median of the column that varies most. Equal rows stay together."""

    def __init__(self, x, most: int) -> None:
        import numpy as np

        nodes = [[-1, 0.0, 0, 0]]  # column or -1, cut, nodes below and from it on
        open_, leaves = [(-len(x), 0, x)], 1
        while open_ and leaves < most:
            _, node, part = heapq.heappop(open_)
            varies = np.ptp(part, 0) > 0 if len(part) > 1 else np.zeros(1, bool)
            if not varies.any():
                continue
            f = int(np.where(varies, part.std(0), -1.0).argmax())
            held = np.sort(part[:, f])
            cut = held[len(held) // 2]
            cut = held[np.searchsorted(held, cut, "right")] if cut == held[0] else cut
            nodes[node] = [f, cut, len(nodes), len(nodes) + 1]
            for below in (part[part[:, f] < cut], part[part[:, f] >= cut]):
                heapq.heappush(open_, (-len(below), len(nodes), below))
                nodes.append([-1, 0.0, 0, 0])
            leaves += 1
        self.column, self.cut, self.below, self.on = map(np.array, zip(*nodes, strict=True))
        self.leaf = np.cumsum(self.column < 0) - 1

    def of(self, x):
        """The number of each row's leaf."""
        import numpy as np

        node = np.zeros(len(x), "i8")
        while len(inner := np.flatnonzero(self.column[node] >= 0)):
            at = node[inner]
            node[inner] = np.where(x[inner, self.column[at]] < self.cut[at], self.below[at], self.on[at])
        return self.leaf[node]


def _squares(x, lo, hi, far: bool = False):
    """The squared distance of each of ``x`` from the nearest place of each box, or from its farthest one. Terms are rounded and added as those of points are, so no point of the box is nearer (farther)."""
    import numpy as np

    out = np.zeros((len(x), len(lo)))
    for f in range(x.shape[1]):
        a, b = lo[None, :, f] - x[:, f, None], x[:, f, None] - hi[None, :, f]
        out += (np.maximum(np.abs(a), np.abs(b)) if far else np.maximum(np.maximum(a, b), 0.0)) ** 2
    return out


class Held:
    """The reference vectors of a cell, leaf by leaf."""

    def __init__(self, ids, n, y) -> None:
        import numpy as np

        leaf = Cuts(y, -(-len(y) // LEAF)).of(y)
        order = np.argsort(leaf, kind="stable")
        self.ids, self.n, self.y = ids[order], n[order], y[order]
        self.starts = np.append(np.flatnonzero(np.diff(leaf[order], prepend=-1)), len(y))
        self.lo, self.hi = (f.reduceat(self.y, self.starts[:-1]) for f in (np.minimum, np.maximum))

    def nearest(self, x, bound, k: int):
        """(row, place, d) of the ``k`` nearest of each of ``x`` that are no farther than ``bound``; ties to smaller ids, and in that order."""
        import numpy as np

        def squares(rows, a, b):
            out = np.zeros((len(rows), b - a))
            for f in range(x.shape[1]):
                gap = x[rows, f, None] - self.y[None, a:b, f]
                gap *= gap
                out += gap
            return out

        least = _squares(x, self.lo, self.hi)
        within = bound * bound * (1 + 1e-12) + 1e-300  # a hair more, for what the root rounds
        own = np.where(np.isinf(bound), least.argmin(1), -1)
        for leaf in np.unique(own[own >= 0]):
            a, b = self.starts[leaf], self.starts[leaf + 1]
            if b - a >= k:
                rows = np.flatnonzero(own == leaf)
                within[rows] = np.partition(squares(rows, a, b), k - 1, 1)[:, k - 1] * (1 + 1e-12) + 1e-300
        found = []
        for leaf, (a, b) in enumerate(zip(self.starts[:-1], self.starts[1:], strict=True)):
            rows = np.flatnonzero(least[:, leaf] <= within)
            if len(rows):
                s = squares(rows, a, b)
                i, j = np.nonzero(s <= within[rows, None])
                found.append((rows[i], j + a, s[i, j]))
        row, place, s = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0))
        d = np.sqrt(s)
        order = np.lexsort((self.ids[place], d, row))
        row, place, d = row[order], place[order], d[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        kept = (rank < k) & (d <= bound[row])
        return row[kept], place[kept], d[kept]


def nearest(vectors: DataFrame, k: int, width: int, block: int = BLOCK, most_cells: int = MOST_CELLS) -> DataFrame:
    """(id, other, n, d) for each of ``vectors`` (id, v, n), a written table: its ``k`` nearest ones with n > 0 and their n, itself included, or all if there are fewer; ties to
    smaller ids. v has ``width`` numbers."""
    import numpy as np

    spark = vectors.sparkSession
    names = [f"f{f}" for f in range(width)]
    flat = ", ".join(f"{f} double" for f in names)
    vectors = vectors.select("id", F.col("n").cast("long").alias("n"), *[F.get("v", F.lit(f)).alias(name) for f, name in enumerate(names)])
    reference = vectors.filter("n > 0")
    size = reference.count()
    if not size:
        return spark.createDataFrame([], "id long, other long, n long, d double")
    most = min(most_cells, -(-size // block))
    some = reference.filter(F.pmod(F.xxhash64("id"), F.lit(size)) < 32 * most)  # so many rows, or nearly, to cut by
    cuts = Cuts(np.array([tuple(r) for r in some.select(*names).collect()], "f8").reshape(-1, width), most)

    def columns(batch):
        return np.stack([batch.column(f).to_numpy(zero_copy_only=False) for f in names], 1)

    def placed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield batch.append_column("cell", pa.array(cuts.of(columns(batch)), pa.int32()))

    rows = written(vectors.mapInArrow(placed, f"id long, n long, {flat}, cell int"))
    reference = rows.filter("n > 0")
    boxes = reference.groupBy("cell").agg(F.count("*").alias("n"), *[f(name).alias(f"{f.__name__}_{name}") for f in (F.min, F.max) for name in names]).orderBy("cell").collect()  # a row for each cell
    cells, sizes = np.array([r.cell for r in boxes]), np.array([r.n for r in boxes])
    lo, hi = (np.array([[r[f"{f}_{name}"] for name in names] for r in boxes]) for f in ("min", "max"))

    def answered(batches: Iterator) -> Iterator:
        """A row for each that asks: what its cell has within its bound. The rows of a cell come together, the reference vectors first."""
        import pyarrow as pa

        cell, there, held = None, [], None
        for batch in batches:
            at, asks, ids, n, bound = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "asks", "id", "n", "bound"))
            part = batch.column("part").to_numpy(zero_copy_only=False)
            x = columns(batch)
            starts = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0) | (np.diff(asks.astype("i1"), prepend=-1) != 0))
            for a, b in zip(starts, [*starts[1:], len(at)], strict=True):
                if cell != (at[a], part[a]):
                    cell, there, held = (at[a], part[a]), [], None
                if not asks[a]:
                    there.append((ids[a:b], n[a:b], x[a:b]))
                    continue
                held = held or Held(*map(np.concatenate, zip(*there, strict=True)))
                for c in range(a, b, AT_ONCE):
                    e = min(b, c + AT_ONCE)
                    row, place, d = held.nearest(x[c:e], bound[c:e], k)
                    ends = np.searchsorted(row, np.arange(e - c + 1))
                    full = np.diff(ends) == k
                    new = np.full(e - c, np.inf)
                    new[full] = d[ends[1:][full] - 1]
                    lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v)) for v in (held.ids[place], held.n[place], d)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(f).slice(c, e - c) for f in ("id", *names, "cell")), pa.array(new), *lists], ["id", *names, "cell", "bound", "others", "ns", "ds"])

    def compared(asking: DataFrame) -> DataFrame:
        """The answers of the cells to ``asking`` (id, <names>, cell, bound), a written table."""
        parts = [(r.cell, -(-r.n // (4 * block))) for r in asking.groupBy("cell").agg(F.count("*").alias("n")).collect()]  # a row for each cell
        if not parts:
            return spark.createDataFrame([], answers)
        held = F.broadcast(spark.createDataFrame(parts, "cell int, parts long"))
        asking = asking.join(held, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
        there = reference.join(held, "cell").withColumns({"part": F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)), "bound": F.lit(0.0)})
        both = there.withColumn("asks", F.lit(False)).unionByName(asking.withColumns({"asks": F.lit(True), "n": F.lit(0).cast("long")})).drop("parts")
        tasks = min(10_000, sum(p for _, p in parts))
        return both.repartition(tasks, "cell", "part").sortWithinPartitions("cell", "part", "asks").mapInArrow(answered, answers)

    answers = f"id long, {flat}, cell int, bound double, others array<long>, ns array<long>, ds array<double>"
    own = written(compared(rows.select("id", *names, "cell", F.lit(float("inf")).alias("bound"))))

    def asked(batches: Iterator) -> Iterator:
        """A row for each other cell that may have one as near as the k-th in the own cell is."""
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                x, bound = columns(part), part.column("bound").to_numpy().copy()
                few = np.flatnonzero(np.isinf(bound))
                if len(few) and size >= k:  # as far as the farthest place of the nearest boxes that have k
                    far = np.sqrt(_squares(x[few], lo, hi, True))
                    order = far.argsort(1)
                    enough = (sizes[order].cumsum(1) >= k).argmax(1)
                    bound[few] = far[np.arange(len(few)), order[np.arange(len(few)), enough]]
                near = (np.sqrt(_squares(x, lo, hi)) <= bound[:, None]) & (cells[None] != part.column("cell").to_numpy()[:, None])
                row, cell = np.nonzero(near)
                out = part.select(["id", *names]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cells[cell], pa.int32()), pa.array(bound[row])], ["id", *names, "cell", "bound"])

    found = own
    if len(cells) > 1:
        found = own.unionByName(compared(written(own.select("id", *names, "cell", "bound").mapInArrow(asked, f"id long, {flat}, cell int, bound double"))))
    found = found.select("id", F.inline(F.arrays_zip("others", "ns", "ds"))).toDF("id", "other", "n", "d")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d", "other"))
    return found.withColumn("__r", rank).filter(F.col("__r") <= k).drop("__r")


def scores(df: DataFrame, features: list[str], clean: Column, k: int = 5, k_density: int = 20, block: int = BLOCK) -> DataFrame:
    """``df`` with knn, the distance to the k-th nearest clean row, and lof, how much thinner the row's surroundings are than those of its k_density nearest clean
    ones; equal clean rows count each, a clean row's own distance of 0 among them. A clean row's density is that among the others. With fewer clean rows
    than k + 1, all but one of them count; with fewer than two, or a null feature, both are null."""
    df = written(df)
    whole = F.lit(True)
    for f in features:
        whole = whole & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    vectors = _vectors(df.filter(whole), features, F.coalesce(clean, F.lit(False)).cast("int"))
    vectors = written(vectors.withColumn("id", F.monotonically_increasing_id()))
    total = vectors.agg(F.sum("n")).first()[0] or 0
    v = F.array(*[F.col(f).cast("double") for f in features])
    if total < 2:
        return df.withColumns({c: F.lit(None).cast("double") for c in ("knn", "lof")})
    near, dense = min(k, total - 1), min(k_density, total - 1)
    found = nearest(vectors, max(near, dense) + 1, len(features), block)
    before = Window.partitionBy("id").orderBy("d", "other").rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda n: F.coalesce(F.sum(n).over(before), F.lit(0))
    others = F.col("n") - (F.col("id") == F.col("other")).cast("long")
    found = found.withColumn("m", others).withColumns({"before": ahead("n"), "before_m": ahead("m")})
    take = lambda n, b, most: F.greatest(F.lit(0), F.least(F.col(n), most - F.col(b)))
    found = written(found.select("id", "other", "d", take("n", "before", dense).alias("w"), take("m", "before_m", dense).alias("w_m"), take("n", "before", near).alias("w_k")))
    reach = written(found.filter("w_m > 0").groupBy("id").agg(F.max("d").alias("reach")).select(F.col("id").alias("other"), "reach"))
    found = found.join(reach, "other")
    far = F.greatest("d", "reach")
    thin = lambda w: dense / F.greatest(F.sum(F.col(w) * far), F.lit(1e-12))
    density = written(found.groupBy("id").agg(thin("w_m").alias("density"), thin("w").alias("own"), F.max(F.when(F.col("w_k") > 0, F.col("d"))).alias("knn")))
    lof = found.select("id", "other", "w").join(density.select(F.col("id").alias("other"), "density"), "other")
    lof = lof.groupBy("id").agg((F.sum(F.col("w") * F.col("density")) / dense).alias("mean"))
    of = density.join(lof, "id").join(vectors.select("id", "v"), "id").select(F.col("v").alias("__v"), "knn", (F.col("mean") / F.col("own")).alias("lof"))
    return df.withColumn("__v", F.when(whole, v)).join(of, "__v", "left").drop("__v")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
