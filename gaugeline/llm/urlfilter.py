"""URL rules, and a block list probed as a sorted digest array.

The list is a table. Spark deals its strings out by the leading bits of their 64-bit XXH64, so that
each task has one stretch of the digests, sorts it and writes it as a row of three flat arrays (digests, string
ends, strings) to the shared folder; the driver sees only file names. ``SparkContext.addFile`` brings the files to
every executor, where the first worker lays the stretches end to end beside them and all workers of the
executor map the result into memory. A worker probes all keys of a batch with one vectorised binary search and
confirms each hit against the stored string, so a digest collision blocks nothing. A lost executor's
successor fetches the files again. Memory is that of the mapped files and of one stretch at a time.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm.common import given_back, set_apart, shared_dir

#: (verdict, host, path prefix): a rule fits its host and all subdomains; the longest wins.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: Hosts whose pages are blocked, all subdomains included.
BLOCKED_HOSTS = ("adult-x.example.com", "ads-track.example.com", "casino-win.example.net", "cheap-pills.example.net", "free-bets.example.net", "spam-farm.example.org")
#: Further blocked hosts made by rule, the size of a public list: parked-0.example.net and so on.
PARKED = 200_000
#: Entries of one stretch of the array, about.
STRETCH = 1 << 16


def block_list(spark: SparkSession, parked: int = PARKED) -> DataFrame:
    """(entry): BLOCKED_HOSTS and ``parked`` hosts by rule."""
    hosts = spark.createDataFrame([(h,) for h in BLOCKED_HOSTS], "entry string")
    return hosts.unionByName(spark.range(parked).select(F.concat(F.lit("parked-"), "id", F.lit(".example.net")).alias("entry")))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), else null; of equally long ones the first."""
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for _, h, p in longest]
    found = [F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for v, h, p in longest]
    return F.coalesce(*[F.when(f, x) for f, x in zip(fits, found, strict=True)])


class DigestArray:
    """A memory-mapped set of byte strings."""

    def __init__(self, path: str) -> None:
        import numpy as np

        load = lambda kind, t: np.memmap(f"{path}.{kind}", t, "r") if os.path.getsize(f"{path}.{kind}") else np.empty(0, t)
        self.digests, self.ends, self.bytes = load("digests", "<u8"), load("ends", "<i8"), load("strings", "u1")

    def contains(self, keys: list[bytes]) -> list[bool]:
        import numpy as np
        import xxhash

        probe = np.fromiter((xxhash.xxh64_intdigest(k, 42) for k in keys), "<u8", len(keys))
        first, last = np.searchsorted(self.digests, probe, "left"), np.searchsorted(self.digests, probe, "right")
        found = [False] * len(keys)
        for i in np.flatnonzero(first < last).tolist():
            found[i] = any(self._string(j) == keys[i] for j in range(first[i], last[i]))
        return found

    def _string(self, j: int) -> bytes:
        return self.bytes[int(self.ends[j - 1]) if j else 0 : int(self.ends[j])].tobytes()


def write_digest_array(entries: DataFrame, stretch: int = STRETCH) -> str:
    """The array of a set of strings (the first column; nulls and repeats don't count) as a table in the shared folder, one row for
    each stretch; returns its path. Digests count as unsigned."""
    entry = F.col(entries.columns[0]).cast("string")
    held = entries.select(entry.alias("s")).filter("s is not null").distinct().select("s", F.xxhash64("s").alias("h"))
    bits = max(1, min(32, -(-held.count() // stretch)).bit_length())

    def flat(rows):
        import numpy as np
        import pyarrow as pa

        h = rows.column("h").to_numpy().view("<u8")
        strings = [x.encode() for x in rows.column("s").to_pylist()]
        order = np.lexsort((np.array(strings, object), h)) if len(h) else []
        strings = [strings[i] for i in order]
        ends = np.cumsum([len(x) for x in strings], dtype="<i8")
        return pa.table({"part": [rows.column("part")[0].as_py()], "digests": [h[order].tobytes()], "ends": [ends.tobytes()], "strings": [b"".join(strings)]})

    parts = held.withColumn("part", F.shiftrightunsigned("h", 64 - bits)).groupBy("part").applyInArrow(flat, "part long, digests binary, ends binary, strings binary")
    path = f"{shared_dir(entries.sparkSession)}/digests-{uuid.uuid4().hex}"
    parts.write.parquet(path)
    return path


def send(spark: SparkSession, path: str) -> list[str]:
    """The names under which every executor finds the files of an array."""
    names = [x for x in spark.read.parquet(path).inputFiles() if x.endswith(".parquet")] if not spark.read.parquet(path).isEmpty() else []
    for x in names:
        spark.sparkContext.addFile(x)
    return [os.path.basename(x) for x in names]


def unpacked(files: list[str], into: str) -> str:
    """The flat files ``into``.digests, .ends and .strings of an array's fetched files; made once for all workers that share the folder."""
    import fcntl

    import numpy as np
    import pyarrow.parquet as pq

    with open(f"{into}.lock", "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        if not os.path.exists(f"{into}.done"):
            at = {part: (f, k) for f in files for k, part in enumerate(pq.read_table(f, columns=["part"]).column("part").to_pylist())}
            total = 0
            with open(f"{into}.digests", "wb") as digests, open(f"{into}.ends", "wb") as ends, open(f"{into}.strings", "wb") as strings:
                for part in sorted(at):
                    row = pq.read_table(at[part][0]).slice(at[part][1], 1).to_pylist()[0]
                    digests.write(row["digests"])
                    ends.write((np.frombuffer(row["ends"], "<i8") + total).tobytes())
                    strings.write(row["strings"])
                    total += len(row["strings"])
            open(f"{into}.done", "w").close()
    return into


_ARRAYS: dict[str, DigestArray] = {}


def probe_keys(host: str, path: str) -> list[str]:
    """The host and its parent domains, and host + path: what a list entry may name."""
    parts = host.split(".")
    return [host + path, *(".".join(parts[k:]) for k in range(len(parts)))] if host else []


def listed(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """``rows`` with host and path, plus ``listed``: whether the host, a parent domain, or host + path is in
    ``entries``. Rows are kept as they are, whatever other columns they have."""
    path = write_digest_array(entries)
    names = send(rows.sparkSession, path)
    name = os.path.basename(path)

    def probe(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import SparkFiles

        if name not in _ARRAYS:
            _ARRAYS[name] = DigestArray(unpacked([SparkFiles.get(x) for x in names], SparkFiles.get(name)))
        for hosts, paths in batches:
            keys, upto = [], []
            for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True):
                keys += [k.encode() for k in probe_keys(h or "", p or "")]
                upto.append(len(keys))
            hits = _ARRAYS[name].contains(keys)
            yield pa.array([any(hits[a:b]) for a, b in zip([0, *upto], upto, strict=False)], pa.bool_())

    return rows.withColumn("listed", F.arrow_udf(probe, "boolean", F.ArrowUDFType.SCALAR_ITER)("host", "path"))


def judge(pages: DataFrame, rules: tuple = RULES, entries: DataFrame | None = None) -> DataFrame:
    """All rows of ``pages`` with host, path, rule and verdict. Columns of those names are replaced.

    The longest fitting rule decides; without one the url is blocked if its host, a parent domain or its
    host + path is in ``entries`` (by default block_list), else allowed. A null url or one without
    ``://`` has an empty host and path, fits no rule and is allowed. Repeated rows are judged alike.
    """
    if entries is None:
        entries = block_list(pages.sparkSession)
    pages, own = set_apart(pages, ("url",), ("host", "path", "rule", "verdict"))
    out = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    out = out.withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))
    out = listed(out, entries)
    method = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    out = out.withColumns({"rule": F.col("__rule.rule"), "verdict": F.coalesce(F.col("__rule.verdict"), method)})
    return given_back(out.drop("__rule", "listed"), own)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
