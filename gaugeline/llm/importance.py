"""Importance resampling towards a target distribution, by hashed n-grams and two passes over Arrow batches.

The first pass turns each partition into one vector of bucket counts with np.bincount, and a treeReduce adds the
vectors up, so the driver holds one. The gain of a bucket is the logarithm of how much likelier it is in the target
than in the corpus. The second pass gathers the broadcast gains of a document's features and sums them by document
with bincount weights. Documents are then drawn without replacement by Gumbel's top-k: the largest weight plus noise,
where the noise is a hash of the id.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import given_back, numbered, set_apart, written

BUCKETS = 10_000
#: A feature is a run of 1 to so many consecutive words.
LONGEST = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Gains and noise are in thousandths.
UNIT = 1_000
#: Bytes of a text that are taken apart at once, and features that are summed at once.
AT_ONCE = 1 << 20

#: ASCII letters in lower case; what else there is in ASCII but digits parts words.
_FOLDED = bytes(b if 97 <= b <= 122 or 48 <= b <= 57 or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def runs_of_words(text: bytes, at_once: int = AT_ONCE) -> Iterator[list[bytes]]:
    """The lower-case words of a text, in order, in lists of bounded size."""
    start = 0
    while start < len(text):
        some = text[start : start + at_once].translate(_FOLDED)
        if start + at_once < len(text):
            cut = some.rfind(b" ") + 1
            if not cut:  # a word longer than that
                end = start + at_once
                while end < len(text) and _FOLDED[text[end]] != 32:
                    end += 1
                some, cut = text[start:end].translate(_FOLDED), end - start
            some, start = some[:cut], start + cut
        else:
            start = len(text)
        yield some.split()


def buckets_of(text: bytes, buckets: int = BUCKETS, longest: int = LONGEST) -> Iterator:
    """Arrays of the buckets of a text's features."""
    from zlib import crc32

    import numpy as np

    held: list[bytes] = []  # the last longest - 1 words
    for words in runs_of_words(text):
        new, words = len(held), held + words
        for n in range(1, longest + 1):
            first = max(0, new - n + 1)
            grams = words[first:] if n == 1 else [b" ".join(words[i : i + n]) for i in range(first, len(words) - n + 1)]
            yield np.fromiter(map(crc32, grams), "u4", len(grams)) % buckets
        held = words[max(0, len(words) - longest + 1) :] if longest > 1 else []


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST):
    """How many features of all texts fall into each bucket: an array of ``buckets`` integers. A null text has none."""
    import numpy as np

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(buckets, "i8")
        for batch in batches:
            for t in batch.column(0):
                if t.is_valid:
                    for found in buckets_of(t.as_py(), buckets, longest):
                        total += np.bincount(found, minlength=buckets)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = docs.select(F.col(text).cast("string").cast("binary").alias("t")).mapInArrow(counted, "counts binary").rdd
    if not vectors.getNumPartitions():
        return np.zeros(buckets, "i8")
    return vectors.map(lambda r: np.frombuffer(r[0], "i8")).treeReduce(np.add, depth=3)


def gains(corpus, target):
    """The gain of each bucket in thousandths, rounded down: how much likelier it is in ``target`` than in ``corpus``, counts with
    one added to each bucket."""
    import numpy as np

    n = len(corpus)
    ratio = (target + 1.0) * float(corpus.sum() + n) / ((corpus + 1.0) * float(target.sum() + n))
    return np.floor(UNIT * np.log(ratio)).astype("i8")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel's noise in thousandths, rounded down, from the first 32 bits of a hash of the id; a null id counts as empty."""
    first = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(first, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-UNIT * F.log(-F.log(u))).cast("long")


def weigh(docs: DataFrame, gain, text: str = "text", longest: int = LONGEST) -> DataFrame:
    """``docs`` with __features, the number of features, and __weight, the floored mean of their gains; 0 without features."""
    import numpy as np

    sent = docs.sparkSession.sparkContext.broadcast(np.asarray(gain, "f8"))

    def weighed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        of = sent.value
        for texts in batches:
            n, total = np.zeros(len(texts), "i8"), np.zeros(len(texts), "f8")
            some: list = []
            whose: list[int] = []
            held = 0

            def add():
                docs_of = np.repeat(whose, [len(x) for x in some])
                n[:] += np.bincount(docs_of, minlength=len(n))
                total[:] += np.bincount(docs_of, of[np.concatenate(some)], len(n))

            for k, t in enumerate(texts):
                for found in buckets_of(t.as_py(), len(of), longest) if t.is_valid else ():
                    some.append(found)
                    whose.append(k)
                    held += len(found)
                    if held > AT_ONCE:
                        add()
                        some, whose, held = [], [], 0
            if some:
                add()
            weight = total.astype("i8") // np.maximum(n, 1)  # sums of whole numbers, and rounded down
            yield pa.StructArray.from_arrays([pa.array(n), pa.array(weight)], ["n", "weight"])

    got = F.arrow_udf(weighed, "n long, weight long", F.ArrowUDFType.SCALAR_ITER)(F.col(text).cast("string").cast("binary"))
    out = docs.withColumn("__got", got)
    return out.withColumns({"__features": F.col("__got.n"), "__weight": F.col("__got.weight")}).drop("__got")


def drawn(scored: DataFrame, eligible: Column, percent: int = PERCENT) -> DataFrame:
    """All rows of ``scored`` (doc_id, score and what else there is), a written table, with __rank: 1, 2, 3 and so on for those
    ``percent`` of the ``eligible`` that have the highest scores, ties to smaller ids and null ids last; null for the others."""
    of = scored.withColumn("__in", F.coalesce(eligible, F.lit(False)))
    take = percent * of.filter("__in").count() // 100
    placed = numbered(of.filter("__in"), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "__rank")
    placed = placed.withColumn("__rank", F.when(F.col("__rank") < take, F.col("__rank") + 1))
    return placed.unionByName(of.filter("not __in").withColumn("__rank", F.lit(None).cast("long"))).drop("__in")


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, carry: bool = True) -> DataFrame:
    """All rows of ``docs`` (doc_id, text) with n_features, weight, score and rank, all long, which replace columns of those names; the
    others stay, whatever their names, or go if ``carry`` is false, so that the ranking moves no text. ``target`` (text).

    The sample is those with a rank. Texts with fewer than ``least_words`` words are scored but not drawn; a null or empty text has
    no features and weight 0. Repeated rows are drawn each for itself; rows of one id have the same noise. An empty corpus
    gives an empty table; an empty target makes all gains those of rare and common buckets alone.
    """
    rows, own = set_apart(docs, ("doc_id", "text"), ("n_features", "weight", "score", "rank"))
    gain = gains(bucket_counts(rows, buckets=buckets, longest=longest), bucket_counts(target, buckets=buckets, longest=longest))
    out = weigh(rows if carry else rows.select("doc_id", "text"), gain, longest=longest)
    out = out.withColumn("score", F.col("__weight") + noise(F.col("doc_id"), seed))
    # of w words there are w + (w - 1) + ... runs
    enough = least_words * longest - longest * (longest - 1) // 2 if least_words >= longest else least_words * (least_words + 1) // 2
    out = drawn(written(out if carry else out.drop("text")), F.col("__features") >= enough, percent)
    out = out.withColumnsRenamed({"__features": "n_features", "__weight": "weight", "__rank": "rank"})
    return given_back(out, own)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
