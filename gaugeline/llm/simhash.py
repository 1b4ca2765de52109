"""Near duplicates by SimHash, found by anchor-point covering.

Each half of the 64-bit fingerprint is 31 bits under the Hamming code [31, 26] and one free bit: a
covering code of radius 1. Two fingerprints with at most THRESHOLD = 3 differing bits differ in at most
one bit in one of the halves. There the nearest anchor of the one, at most 1 away, is at most 1 + 1 from
the other. So each fingerprint is replicated to every anchor within covering radius plus threshold (17
at most in a half, from the syndrome), looks up its nearest anchor in each half, and is compared with
what stands there; no link is lost. Only distinct fingerprints take part, so exact copies cost nothing.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm import covering
from gaugeline.llm.common import broadcast_up_to, given_back, set_apart, written
from gaugeline.llm.components import components

THRESHOLD = 3
SHINGLE = 3
SEED = 42
#: Up to so many ids of dropped documents are broadcast, by count.
MAX_BROADCAST_IDS = 500_000
#: Shingles whose bits are unpacked at once: 64 bytes each.
AT_ONCE = 16_384


def simhash(text: str, shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of a text. No words give zero."""
    import numpy as np
    import xxhash

    words = text.encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest, ones = xxhash.xxh64_digest, np.zeros(64, "i8")
    for k in range(0, n, AT_ONCE):
        some = range(k, min(n, k + AT_ONCE))
        held = b"".join([digest(b" ".join(words[i : i + shingle]), SEED) for i in some])
        ones += np.unpackbits(np.frombuffer(held, "u1").reshape(-1, 8), axis=1).sum(0, dtype="i8")
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row, in Python on Arrow batches."""

    def hashed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for texts in batches:
            yield pa.array([simhash(t.as_py() or "") for t in texts], pa.int64())

    return docs.select("doc_id", F.arrow_udf(hashed, "long", F.ArrowUDFType.SCALAR_ITER)(F.col("text").cast("string")).alias("fp"))


def _half(fp: Column, half: int) -> Column:
    return F.shiftrightunsigned(fp, 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))


def _syndrome(x: Column) -> Column:
    """The exclusive or of the positions 1 to 31 of the set bits."""
    checks = [sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1) for j in range(5)]
    return sum(F.bit_count(x.bitwiseAND(F.lit(m))) % 2 * (1 << j) for j, m in enumerate(checks)).cast("int")


def _flip(position: Column) -> Column:
    """The bit at a position from 1 on; nothing at 0."""
    return F.call_function("shiftright", F.call_function("shiftleft", F.lit(1).cast("long"), position), F.lit(1))


def nearest_anchor(x: Column) -> Column:
    return x.bitwiseXOR(_flip(_syndrome(x)))


def anchors(x: Column, syndrome: Column) -> Column:
    """All anchors within 2 of a 32-bit half, each once: flip the positions a and a ^ syndrome, or nothing
    more than the nearest if the half is an anchor itself; and the nearest with the free bit flipped."""
    pair = lambda a: x.bitwiseXOR(_flip(a)).bitwiseXOR(_flip(a.bitwiseXOR(syndrome)))
    coded = F.transform(F.filter(F.sequence(F.lit(0), F.lit(31)), lambda a: (a == 0) | (a < a.bitwiseXOR(syndrome))), pair)
    return F.concat(coded, F.array(x.bitwiseXOR(_flip(syndrome)).bitwiseXOR(F.lit(1 << 31))))


def _in_half(anchors: Column, half: int) -> Column:
    return F.transform(anchors, lambda a: a.bitwiseOR(F.lit(half << 32)))


def links(fps: DataFrame) -> DataFrame:
    """(u, v), u < v: all pairs of the distinct fingerprints ``fps`` (fp) with at most THRESHOLD differing bits."""
    halves = fps.select("fp", *[_half(F.col("fp"), h).alias(f"x{h}") for h in (0, 1)])
    halves = halves.withColumns({f"s{h}": _syndrome(F.col(f"x{h}")) for h in (0, 1)})
    near = F.concat(*[_in_half(anchors(F.col(f"x{h}"), F.col(f"s{h}")), h) for h in (0, 1)])
    stored = halves.select(F.col("fp").alias("v"), F.explode(near).alias("anchor"))
    own = F.concat(*[_in_half(F.array(nearest_anchor(F.col(f"x{h}"))), h) for h in (0, 1)])
    asked = halves.select(F.col("fp").alias("u"), F.explode(own).alias("anchor"))
    close = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= THRESHOLD
    return asked.join(stored, (asked.anchor == stored.anchor) & (F.col("u") < F.col("v")) & close).select("u", "v").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text; other columns aren't read).

    Fingerprints link at THRESHOLD or fewer differing bits; component_id is the smallest doc_id reachable.
    Null, empty and blank texts have fingerprint zero and link like any other. Repeated rows have the same
    component. Null ids stay, and don't name a component unless they are alone. Links exist between
    distinct fingerprints only, and neither they nor the components pass through the driver.
    """
    held = written(fingerprints(docs))
    classes = written(held.groupBy("fp").agg(F.min("doc_id").alias("first")))
    rooted = components(links(classes.select("fp"))).withColumnRenamed("node", "fp")
    rooted = classes.join(rooted, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(named, "root").select("fp", "component_id")
    return held.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those whose text is like an earlier one's, by id: linked transitively by
    shingles of five words (covering.similar). Of equal texts the one with the smallest id stays, of equal rows one;
    rows with one id and different texts are different. Only ids and hashes are shuffled: those to drop are
    broadcast if there are few, and rows that occur twice are handled apart."""
    docs, own = set_apart(docs, ("doc_id", "text"))
    rows, edges = covering.similar(docs)
    key = ["__id", "__h"]
    copies = components(edges).filter("node <> root").select(F.col("node.h").alias("__h")).distinct()
    # a table of its own, so that a very large group's share of the join can be split
    least = written(rows.groupBy("__h").agg(F.min("__id").alias("least"), F.count("*").alias("n")).filter("n > 1"))
    dropped = rows.join(least, "__h").filter("__id > least").select(*key).unionByName(rows.join(copies, "__h").select(*key)).distinct()
    docs = covering.keyed(docs)
    kept = docs.join(broadcast_up_to(written(dropped), MAX_BROADCAST_IDS), key, "left_anti")
    twice = rows.groupBy(*key).count().filter("count > 1").select(*key)
    if not twice.isEmpty():
        twice = broadcast_up_to(twice, MAX_BROADCAST_IDS)
        kept = kept.join(twice, key, "left_anti").unionByName(kept.join(twice, key, "left_semi").dropDuplicates(key))
    return given_back(kept.drop(*key), own)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
