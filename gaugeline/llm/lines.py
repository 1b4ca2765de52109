"""Removing passages that repeat across documents, by content-defined chunks of lines. DataFrame operations only.

A line that occurs once can't be part of a repeated passage, so only runs of repeated lines within a document
are looked at. A rolling hash over each two neighbouring lines cuts a run into chunks: between two lines whose
hash is less than that of the pairs before and after. Those are the same wherever the lines stand, two cuts
are never neighbours, and so every chunk has two lines at least; an insertion moves no cut beyond the lines that
it touches. A chunk also counts without its first line, its last, or both, if two are left: at the edge of a passage that line may be a
neighbour. Of a chunk that occurs again, the first (by doc_id and position) stays, and another is removed
if its bytes have the first's SHA-256, however common its lines are. On demand (``by_chance``) a chunk stays whose lines all occur so many times as
often as it does, as common ones (licences) do that stand beside each other by chance.

A chunk at the edge of a passage may hold more lines of others. So that no long passage is lost by that, nor one
that is a single line, runs are also looked through for cores: a core is a window of lines with over LONG_WORDS
words that has fewer without its first or its last line. That depends on the window's lines alone, so
any passage of over LONG_WORDS words has one, however often each of its lines occurs elsewhere. What lies between two cores
of one repeated passage goes with them. A line at its edge, without which the passage has over LONG_WORDS
words still, goes if at least half of its occurrences are beside the passage; else it is a common line and stays.
Lines without words count for nothing but what lies between others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.llm.common import WORD, broadcast_up_to, given_back, set_apart, text_of, written

#: A passage of more words than this goes whatever chunks it is cut into.
LONG_WORDS = 50
#: Up to so many ids of repeated rows are broadcast, by count.
MAX_BROADCAST_IDS = 300_000

#: Chunks and cores are looked up apart.
CHUNK, CORE = 0, 2

ID = ["__id", "__text_hash"]


def _keyed(docs: DataFrame) -> DataFrame:
    # equal rows count as one document: they get the same removals
    docs = docs.withColumn("__text", text_of(F.col("text").cast("string")))
    return docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "__text_hash": F.xxhash64("__text")})


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(__id, __text_hash, pos, h, w, n) of the lines that occur twice or more, and of those without words: the hash, the number
    of words, and of occurrences (null without words)."""
    split = F.transform(F.split("__text", "\n", -1), lambda x: F.struct(F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("w")))
    lines = _keyed(docs.select("doc_id", "text")).select(*ID, F.posexplode(split).alias("pos", "x")).select(*ID, "pos", "x.h", "x.w")
    lines = written(lines)
    # of repeated rows one counts; any row has a first line
    twice = lines.filter("pos = 0").groupBy(*ID).count().filter("count > 1").select(*ID)
    if not twice.isEmpty():
        twice = broadcast_up_to(twice, MAX_BROADCAST_IDS)
        lines = lines.join(twice, ID, "left_anti").unionByName(lines.join(twice, ID, "left_semi").dropDuplicates([*ID, "pos"]))
    # a table of its own: both sides of the join are then dealt out for it, and a very common line's share can be split
    counts = written(lines.filter("w > 0").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"))
    out = lines.filter("w > 0").join(counts.hint("merge"), "h").unionByName(lines.filter("w = 0").withColumn("n", F.lit(None).cast("long")))
    # a line of more words counts as just too long for a passage to need another
    return out.withColumn("w", F.least("w", F.lit(LONG_WORDS + 1)))


def chunks_and_cores(docs: DataFrame, key_bits: int = 64, by_chance: int | None = None) -> DataFrame:
    """(__id, __text_hash, start, lines, key, cut_start, cut_lines, n, times_more) of the chunks and cores of runs of
    repeated lines: the first line, the number of lines, a hash of their hashes, the lines to cut if the window
    occurs before, and how often a line may occur (n, null if it doesn't matter) against the window: times_more as often."""
    w = Window.partitionBy(*ID).orderBy("pos")
    new_run = F.coalesce(F.col("pos") - F.lag("pos").over(w) != 1, F.lit(True))
    # both windows share one order, so a task sorts its lines once
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    lines = repeated_lines(docs).withColumn("new_run", new_run).withColumns({"run": F.sum(F.col("new_run").cast("int")).over(upto), "upto": F.sum("w").over(upto)})
    line = F.struct("pos", "h", "w", "n", "upto")
    runs = lines.groupBy(*ID, "run").agg(F.sum("w").alias("words"), F.count_if(F.col("w") > 0).alias("worded"), F.collect_list(line).alias("x"))
    runs = runs.filter((F.col("words") > LONG_WORDS) | (F.col("worded") > 1))
    runs = runs.select(*ID, F.array_sort("x").alias("x")).select(*ID, F.get("x", F.lit(0))["pos"].alias("origin"), F.transform("x", lambda x: x["h"]).alias("hashes"), F.filter("x", lambda x: x["w"] > 0).alias("x"))

    # of the lines with words, each has one word at least, so the nearest LONG_WORDS + 1 are enough
    at = lambda i: F.get("x", i)
    far = F.lit(LONG_WORDS + 1)
    before = lambda x: x["upto"] - x["w"]

    def ends(x: Column, i: Column) -> Column:
        # the first line on to which there are enough words, and the last one from which there are
        to = i + F.size(F.filter(F.slice("x", i + 1, far), lambda y: y["upto"] - before(x) <= LONG_WORDS))
        since = i - F.size(F.filter(F.slice("x", F.greatest(i + 2 - far, F.lit(1)), F.least(i + 1, far)), lambda y: x["upto"] - before(y) <= LONG_WORDS))
        return F.struct(i.alias("i"), to.alias("to"), since.alias("since"))

    # the rolling hash at place i is that of the lines i and i + 1
    rolling = F.transform("x", lambda x, i: F.xxhash64(x["h"], at(i + 1)["h"]))
    placed = runs.withColumns({"ends": F.transform("x", ends), "size": F.size("x"), "rolling": rolling})
    rolled = lambda i: F.get("rolling", i)
    first_line = lambda i: (i == 0) | ((i > 1) & (i < F.col("size") - 1) & (rolled(i - 1) < rolled(i - 2)) & (rolled(i - 1) < rolled(i)))
    starts = F.filter(F.transform("x", lambda _, i: i), first_line)
    placed = placed.withColumn("starts", F.when(F.col("size") > 1, starts).otherwise(F.slice(starts, 1, 0)))

    def of(first: Column, last: Column, cut: Column, upto: Column, n: Column, times_more: int, kind: int = CORE) -> Column:
        start, count = at(first)["pos"], at(last)["pos"] - at(first)["pos"] + 1
        key = F.shiftrightunsigned(F.xxhash64(F.lit(kind), F.slice("hashes", start - F.col("origin") + 1, count)), 64 - key_bits)
        return F.struct(start.alias("start"), count.alias("lines"), key.alias("key"), cut.alias("cut_start"), (upto - cut).alias("cut_lines"), n.alias("n"), F.lit(times_more).alias("times_more"))

    def cores(e: Column) -> Column:
        i, to, since = e["i"], e["to"], e["since"]
        forward, back = to < F.col("size"), since >= 0
        core = at(to)["upto"] - at(i)["upto"] <= LONG_WORDS
        core_back = before(at(i)) - before(at(since)) <= LONG_WORDS
        own = at(i)["pos"]
        n = at(i)["n"]
        none = F.lit(None).cast("long")
        after, until = at(i + 1)["pos"], at(i - 1)["pos"] + 1
        whole = F.when(forward & core, of(i, to, own, at(to)["pos"] + 1, none, 2)).when(forward, of(i, to, own, after, n, 2))
        edge = F.when(back & ~core_back, of(since, i, until, own + 1, n, 2))
        inner = F.when(forward & ~core & back & ~core_back, of(since, to, until, after, none, 2))
        return F.array(whole, edge, inner)

    def trimmed(i: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.col("size")) - 1

        def window(first: Column, last: Column) -> Column:
            rarest = F.array_min(F.transform(F.slice("x", first + 1, last - first + 1), lambda x: x["n"])) if by_chance else F.lit(None).cast("long")
            return F.when(last > first, of(first, last, at(first)["pos"], at(last)["pos"] + 1, rarest, by_chance or 0, CHUNK))

        return F.array(window(i, end), window(i + 1, end), window(i, end - 1), window(i + 1, end - 1))

    found = F.concat(F.flatten(F.transform("ends", cores)), F.flatten(F.transform("starts", trimmed)))
    return placed.select(*ID, F.explode(found).alias("y")).filter("y is not null").select(*ID, "y.*")


def repeats(docs: DataFrame, key_bits: int = 64, by_chance: int | None = None) -> DataFrame:
    """(__id, __text_hash, __cuts): for each document with lines to remove, array<struct(start, lines)>, in order
    and apart from each other. ``key_bits``: of the hash by which windows are looked up; what is cut has equal bytes whatever it is."""
    found = written(chunks_and_cores(docs, key_bits, by_chance))
    # the firsts are tables of their own, so that a very common chunk's share of a join can be split
    first = written(found.groupBy("key").agg(F.count("*").alias("times"), F.min(F.struct(*ID, "start")).alias("first")).filter("times > 1"))
    found = found.join(first.hint("merge"), "key").withColumn("is_first", F.struct(*ID, "start") == F.col("first"))
    # a window that overlaps the first one doesn't repeat it
    inside = (F.col("__id") == F.col("first.__id")) & (F.col("__text_hash") == F.col("first.__text_hash")) & (F.col("start") < F.col("first.start") + F.col("lines"))
    found = found.filter(F.col("is_first") | (~inside & (F.col("n").isNull() | (F.col("n") <= F.col("times_more") * F.col("times")))))
    wanted = found.groupBy(*ID).agg(F.collect_list(F.struct("key", "start", "lines", "cut_start", "cut_lines", "is_first")).alias("wanted"))
    texts = _keyed(docs.select("doc_id", "text")).select(*ID, "__text").join(wanted, ID).withColumn("__lines", F.split("__text", "\n", -1))
    digest = lambda x: F.unhex(F.sha2(F.array_join(F.slice("__lines", x["start"] + 1, x["lines"]), "\n"), 256))
    names = ("key", "cut_start", "cut_lines", "is_first")
    texts = texts.select(*ID, F.explode(F.transform("wanted", lambda x: F.struct(*[x[c].alias(c) for c in names], digest(x).alias("digest")))).alias("x"))
    texts = written(texts.select(*ID, "x.*"))
    firsts = written(texts.filter("is_first").select("key", F.col("digest").alias("first_digest")).dropDuplicates(["key"]))
    same = texts.filter("not is_first").join(firsts.hint("merge"), "key").filter("digest = first_digest")
    same = same.select(*ID, F.col("cut_start").alias("start"), (F.col("cut_start") + F.col("cut_lines")).alias("end"))
    w = Window.partitionBy(*ID).orderBy("start", "end")
    reached = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    same = same.withColumn("apart", F.coalesce(F.col("start") > reached, F.lit(True)).cast("int"))
    same = same.withColumn("part", F.sum("apart").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = same.groupBy(*ID, "part").agg(F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("lines"))
    return written(parts).groupBy(*ID).agg(F.array_sort(F.collect_list(F.struct("start", "lines"))).alias("__cuts"))


def dedup_lines(docs: DataFrame, key_bits: int = 64, by_chance: int | None = None) -> DataFrame:
    """All rows of ``docs`` with the repeated passages cut out of text, plus removed_lines, which replaces a column of
    that name.

    With ``by_chance`` a chunk stays whose rarest line occurs over so many times as often as the chunk.
    A null text stays null and an empty one empty; both are left alone, as are single lines of LONG_WORDS words or
    fewer. A document all of whose lines are cut is left with an empty text. Equal rows are one document,
    and stay equal. Other columns are passed on, whatever their names. Within a document a second occurrence is cut too.
    """
    docs, own = set_apart(docs, ("doc_id", "text"), ("removed_lines",))
    cuts = repeats(docs, key_bits, by_chance)
    # shuffled at any size: a join that is broadcast for small inputs only says nothing about large ones
    out = _keyed(docs).join(cuts.hint("merge"), ID, "left")
    lines, cut = F.split("__text", "\n", -1), lambda i: F.get("__cuts", i)
    begin = lambda i: F.coalesce(cut(i - 1)["start"] + cut(i - 1)["lines"], F.lit(0))
    kept = F.transform(F.sequence(F.lit(0), F.size("__cuts")), lambda i: F.slice(F.col("__lines"), begin(i) + 1, F.coalesce(cut(i)["start"], F.size("__lines")) - begin(i)))
    new = F.array_join(F.flatten(kept), "\n")
    removed = F.aggregate("__cuts", F.lit(0), lambda a, c: a + c["lines"])
    out = out.withColumn("__lines", F.when(F.col("__cuts").isNotNull(), lines)).withColumns({"text": F.when(F.col("__cuts").isNull(), F.col("text")).otherwise(new), "removed_lines": F.coalesce(removed, F.lit(0)).cast("long")})
    return given_back(out.drop("__text", "__lines", "__cuts", *ID), own)
