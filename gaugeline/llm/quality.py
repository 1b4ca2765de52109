"""Quality rules, and a hashed n-gram likelihood ratio. DataFrame operations only.

Words and word pairs are hashed into BUCKETS. Two smoothed multinomials over the buckets are counted on
whole texts: one of the trusted documents, one of the raw corpus. A document's score is the mean log ratio
of its n-grams, so length cancels out, and a fixed threshold decides: equal texts always fare alike. The
model is BUCKETS numbers whatever the corpus; counting them sums up before it shuffles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import broadcast_up_to, given_back, set_apart, text_of, words_of

BUCKETS = 8192
#: Mean log ratio in nats from which a document is kept.
THRESHOLD = -0.05
#: Added to each bucket's count, as a share of the mean count.
SMOOTHING = 0.05
#: Up to so many trusted ids are broadcast, by count.
MAX_BROADCAST_IDS = 1_000_000


def _upto(n: Column) -> Column:
    """0 .. n - 1, also for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def ngram_buckets(words: Column) -> Column:
    """The buckets of all words and all pairs of neighbours."""
    bucket = lambda *parts: F.pmod(F.hash(*parts), F.lit(BUCKETS))
    pairs = F.transform(_upto(F.size(words) - 1), lambda i: bucket(F.get(words, i), F.get(words, i + 1)))
    return F.concat(F.transform(words, lambda w: bucket(w)), pairs)


def fit(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """The log ratio of each bucket: trusted documents (rows of ``trusted``, doc_id) against all. Without
    trusted documents all are zero."""
    ids = broadcast_up_to(trusted.select("doc_id").filter("doc_id is not null").distinct().withColumn("__t", F.lit(1)), MAX_BROADCAST_IDS)
    rows = docs.select("doc_id", "text").join(ids, "doc_id", "left")
    rows = rows.select("__t", words_of(text_of()).alias("__w")).select("__t", F.explode(ngram_buckets(F.col("__w"))).alias("b"))
    counts = rows.groupBy("b").agg(F.count("*").alias("raw"), F.count("__t").alias("good")).collect()  # BUCKETS rows at most
    raw, good = [0] * BUCKETS, [0] * BUCKETS
    for r in counts:
        raw[r.b], good[r.b] = r.raw, r.good
    if not sum(good):
        return [0.0] * BUCKETS
    share = lambda held: [(n + SMOOTHING * sum(held) / BUCKETS) / (sum(held) * (1 + SMOOTHING)) for n in held]
    return [round(math.log(g / r), 4) for g, r in zip(share(good), share(raw), strict=True)]


def ratio(words: Column, weights: list[float]) -> Column:
    """The mean log ratio of a document's n-grams; 0 without words."""
    held = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<double>")  # folded to one literal
    buckets = ngram_buckets(words)
    total = F.aggregate(buckets, F.lit(0.0), lambda a, b: a + F.get(held, b))
    return total / F.greatest(F.lit(1.0), (2 * F.size(words) - 1).cast("double"))


def repeated_words(words: Column, name: str = "__g") -> tuple[dict[str, Column], Column]:
    """Columns to add, one step after the other, and then the number of words that stand in a three-word
    window found twice or more.

    Windows are 64-bit hashes. Packed with their positions into one number each they sort fast; equal
    33-bit prefixes give the candidates, and those are compared by the whole hash.
    """
    h, g, c = f"{name}h", f"{name}g", f"{name}c"
    at = lambda column, i: F.get(F.col(column), i)
    windows = F.transform(_upto(F.size(h) - 2), lambda i: F.xxhash64(at(h, i), at(h, i + 1), at(h, i + 2)))
    packed = F.sort_array(F.transform(F.col(g), lambda x, i: x.bitwiseAND(F.lit(-(1 << 31))).bitwiseOR(i.cast("long"))))
    s = f"{name}s"
    same = lambda i, k: F.coalesce(F.shiftright(at(s, i), 31) == F.shiftright(at(s, k), 31), F.lit(False))
    alike = F.filter(_upto(F.size(s)), lambda i: same(i, i + 1) | (F.when(i > 0, same(i, i - 1)).otherwise(False)))
    position = F.transform(alike, lambda i: at(s, i).bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
    exact = F.sort_array(F.transform(position, lambda i: F.struct(at(g, i).alias("g"), i.alias("i"))))
    twice = lambda i, k: F.coalesce(at(c, i)["g"] == at(c, k)["g"], F.lit(False))
    found = F.filter(_upto(F.size(c)), lambda i: twice(i, i + 1) | (F.when(i > 0, twice(i, i - 1)).otherwise(False)))
    starts = F.sort_array(F.transform(found, lambda i: at(c, i)["i"]))
    seen = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(starts, seen, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])
    empty = F.array().cast("array<bigint>")
    steps = {h: F.transform(words, lambda w: F.xxhash64(w)), g: windows, s: F.when(F.size(F.array_distinct(g)) < F.size(g), packed).otherwise(empty), c: exact}
    return steps, covered.cast("long")


def judge(docs: DataFrame, weights: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """All rows of ``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    score and kept. Columns of those names are replaced; others stay, whatever their names.

    A null or empty text has no words and fails the base rules. Repeated rows are judged alike; nothing
    but the text counts. An empty table gives an empty one.
    """
    docs, own = set_apart(docs, ("text",), ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"))
    out = docs.withColumn("__text", text_of()).withColumn("__w", words_of(F.col("__text")))
    w = F.col("__w")
    lines = F.filter(F.split("__text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    steps, covered = repeated_words(w)
    out = out.withColumn("__lines", lines)
    for name, column in steps.items():
        out = out.withColumn(name, column)
    out = out.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": covered,
            "score": ratio(w, weights),
        }
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    return given_back(out.drop("__text", "__w", "__lines", *steps), own)
