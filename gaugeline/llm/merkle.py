"""A Merkle manifest of a dataset, by Pregel-style supersteps over an RDD of subtrees.

A vertex is a subtree of up to BLOCK consecutive nodes of one level of one group, so that a step climbs many levels at
once. Upward, nodes message the vertex above them; a vertex that has all its nodes hashes them, level by level, and
forwards its root as a node of the next vertex. Each step's vertices are a table in the shared folder, which cuts the lineage.
Downward, a vertex gets the sibling path of its root, and sends each of its nodes that path after the node's own siblings
inside; at the leaves the paths are proofs. The groups' roots are leaves of one more tree of the same kind.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator
from hashlib import sha256

from pyspark import RDD, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm.common import broadcast_up_to, numbered, written

ARITY = 2
#: Nodes of a vertex at most.
BLOCK = 1_024
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
GROUP = "lang"
#: Up to so many groups are broadcast, by count.
MAX_BROADCAST_GROUPS = 100_000


def field(value: Column) -> Column:
    """`-` for null, else the number of bytes in UTF-8, a colon and the value."""
    v = value.cast("string")
    return F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def levels_of(nodes: list[str], steps: int | None, arity: int = ARITY) -> list[list[str]]:
    """The levels above and with ``nodes``: ``steps`` more, or as many as leave one node."""
    out = [nodes]
    while len(out[-1]) > 1 if steps is None else len(out) <= steps:
        now = out[-1]
        out.append([digest("".join(now[i : i + arity])) for i in range(0, len(now), arity)])
    return out


def siblings(levels: list[list[str]], at: int, arity: int = ARITY) -> list[tuple[str, str]]:
    """For each level below the last, the hashes joined that stand before and after the ancestor of node ``at`` in its run."""
    out = []
    for nodes in levels[:-1]:
        first = at - at % arity
        out.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + arity])))
        at //= arity
    return out


def folded(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root over a leaf with those siblings."""
    for before, after in path:
        leaf = digest(before + leaf + after)
    return leaf


def proof(path: list[tuple[str, str]]) -> str:
    return digest("".join(before + after for before, after in path))


class Tree:
    """The trees over groups of nodes."""

    def __init__(self, spark: SparkSession, nodes: RDD, most: int, arity: int = ARITY, block: int = BLOCK):
        """``nodes``: (group, (n, position, hash, what)): a group's number, how many nodes it has, and what goes with the node.
        ``most``: the nodes of the largest group."""
        steps = 1
        while arity ** (steps + 1) <= block:
            steps += 1
        self.wide, self.steps, self.arity, self.vertices = arity**steps, steps, arity, []
        wide, levels = self.wide, self._levels()

        def up(node):
            group, (n, at, value, what) = node
            return (group, at // wide), (n, at, value, what)

        def complete(vertex):
            (group, at), messages = vertex
            messages = sorted(messages, key=lambda m: m[1])
            return group, at, messages[0][0], "".join(m[2] for m in messages), pickle.dumps([m[3] for m in messages])

        def hashed(vertex):
            (group, at), (n, hashes, _) = vertex
            return group, (-(-n // wide), at, levels(n, hashes)[-1][0], None)

        parted = lambda r: ((r.g, r.at), (r.n, [r.hashes[i : i + 64] for i in range(0, len(r.hashes), 64)], pickle.loads(r.what)))
        while True:  # a superstep
            told = nodes.map(up).groupByKey().map(complete)
            held = written(spark.createDataFrame(told, "g long, at long, n long, hashes string, what binary", verifySchema=False))
            self.vertices.append(held.rdd.map(parted))
            nodes = self.vertices[-1].map(hashed)
            most = -(-most // wide)
            if most <= 1:  # a group that is done earlier passes its root on as it is
                break
        self.roots = nodes.mapValues(lambda x: x[2])

    def _levels(self):
        wide, steps, arity = self.wide, self.steps, self.arity
        return lambda n, hashes: levels_of(hashes, steps if n > wide else None, arity)

    def proofs(self, above: RDD) -> RDD:
        """(hash, path, what, told) of each node: its siblings up to the last root, and what went with it. ``above``:
        (group, (path, told)): the path over each group's root, and anything that its nodes are to be told."""
        wide, arity, levels = self.wide, self.arity, self._levels()

        def down(vertex) -> Iterator:
            (group, at), ((n, hashes, what), (path, told)) = vertex
            inside = levels(n, hashes)
            for i, h in enumerate(hashes):
                yield (group, at * wide + i), h, siblings(inside, i, arity) + path, what[i], told

        message = above.map(lambda x: ((x[0], 0), x[1]))
        for k, vertices in enumerate(reversed(self.vertices), 1):  # a superstep
            reached = vertices.join(message).flatMap(down)
            if k == len(self.vertices):
                return reached.map(lambda x: x[1:])
            message = reached.map(lambda x: (x[0], (x[2], x[4])))


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """``docs`` with __leaf, and __tampered: the leaf with the columns of ``tampered`` in the place of those of that name, for rows
    ``where`` says so, else null."""
    out = docs.withColumn("__leaf", leaf([F.col(c) for c in fields]))
    false = leaf([(tampered or {}).get(c, F.col(c)) for c in fields])
    return out.withColumn("__tampered", F.when(F.coalesce(F.lit(False) if where is None else where, F.lit(False)), false))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = GROUP, tampered: dict[str, Column] | None = None, where: Column | None = None, paths: bool = False, arity: int = ARITY, block: int = BLOCK) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of ``docs``, which has ``fields`` and
    ``group`` (any other columns aren't read); with ``paths`` also path, array<struct<before, after>>.

    A leaf is a hash of the ``fields``. The leaves of a ``group`` stand by doc_id (null first; equal ids by their leaves, equal rows in any
    order, as their leaves are one); the groups by their name in bytes, null first. folded_root is what the path makes of the leaf, or of the tampered one.
    Null values differ from empty ones. A lone leaf is its group's subroot, a lone subroot the root. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    # under names of their own, in case that a field is called like a group or an id
    rows = leaves(docs, fields, tampered, where).select(F.col("doc_id").alias("__id"), F.col(group).cast("string").alias("__group"), "__leaf", "__tampered")
    schema = f"doc_id {rows.schema['__id'].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    schema += ", path array<struct<before: string, after: string>>" * paths
    first = [F.col(c).asc_nulls_first() for c in ("__group", "__id")]
    placed = written(numbered(written(rows), [*first, F.col("__leaf")], "__place"))
    groups = numbered(written(placed.groupBy("__group").agg(F.min("__place").alias("__first"), F.count("*").alias("__n"))), first[:1], "__g")
    groups = written(groups.withColumnRenamed("__group", "__named"))
    n_groups, most = groups.agg(F.count("*"), F.max("__n")).first()
    if not n_groups:
        return spark.createDataFrame([], schema)
    placed = placed.join(broadcast_up_to(groups, MAX_BROADCAST_GROUPS), F.col("__group").eqNullSafe(F.col("__named")))
    placed = placed.select("__g", "__n", (F.col("__place") - F.col("__first")).alias("at"), "__leaf", "__id", "__tampered")
    below = Tree(spark, placed.rdd.map(lambda r: (r[0], (r[1], r[2], r[3], (r[4], r[5])))), most, arity, block)
    top = Tree(spark, below.roots.map(lambda x: (0, (n_groups, x[0], x[1], x[0]))), n_groups, arity, block)
    over = top.proofs(top.roots.map(lambda x: (x[0], ([], x[1]))))  # (subroot, path, group, root)
    over = over.map(lambda x: (x[2], (x[1], (x[0], x[3]))))

    def judged(x):
        own, path, (doc_id, false), (subroot, root) = x
        got = folded(false or own, path)
        return (doc_id, own, subroot, root, proof(path), got, got == root, *([path] if paths else []))

    return spark.createDataFrame(below.proofs(over).map(judged), schema, verifySchema=False)


def root_of(leaf: Column, path: Column) -> Column:
    """What a path of siblings, array<struct<before, after>>, makes of a leaf: to check a proof in Spark."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def tampering(n_chars: str = "n_chars", every: int = 7) -> tuple[dict[str, Column], Column]:
    """One more in ``n_chars`` (nulls stay) of the rows whose id has a crc32 that ``every`` divides."""
    return {n_chars: F.col(n_chars).cast("decimal(38,0)") + 1}, F.crc32(F.col("doc_id").cast("string")) % every == 0


cloudpickle.register_pickle_by_value(sys.modules[__name__])
