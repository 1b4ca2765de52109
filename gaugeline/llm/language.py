"""Language identification by averaged hashed subword embeddings and a linear softmax, with calibrated rejection.

The subwords of a text are its runs of 2 to LONGEST bytes within a word and its edges, in lower case. Each is hashed to a
row of an embedding matrix; the mean row is a document's vector, and a linear softmax over it gives the languages' shares. Matrix and
softmax are trained by stochastic gradient descent in numpy, on a bounded sample: executors send a document's bucket counts, not its text. On
a part of the sample that the training doesn't see, a temperature is fitted to make the shares true probabilities, and
the share below which a prediction is rejected is chosen so that only REJECTED of the right ones are.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.llm.common import given_back, set_apart, written

BUCKETS = 1 << 13
WIDTH = 16
LONGEST = 4
#: The fit sees at most so many documents of a language, those first by a hash of the id and text.
MOST_A_LANGUAGE = 600
#: And in all; many languages share them evenly.
MOST_IN_ALL = 12_000
#: And at most so many languages, those with the most documents, ties by name.
MOST_LANGUAGES = 400
#: One document in so many of the sample calibrates.
CALIBRATES = 5
REJECTED = 0.01
UNKNOWN = "und"
#: Bytes of a text that are taken apart at once.
AT_ONCE = 1 << 18
EPOCHS = 12
BATCH = 32
RATE = 20.0
SEED = 5

#: Control characters, blanks, digits and marks of ASCII part words.
_PARTED = bytes(b if 97 <= b <= 122 or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def subword_counts(text: str, buckets: int = BUCKETS, longest: int = LONGEST):
    """How many subwords of a text fall into each bucket."""
    import numpy as np

    held = (" " + text.lower() + " ").encode("utf-8", "replace").translate(_PARTED)
    found, b = np.zeros(buckets, "i8"), np.frombuffer(held, "u1")
    for start in range(0, len(b), AT_ONCE):
        some = b[start : start + AT_ONCE + longest - 1].astype("u4")
        blank = some == 32
        code, inner = some, np.zeros(len(some), bool)  # of the run from each byte on, and whether it has a blank inside
        for n in range(2, longest + 1):
            if len(some) < n:
                break
            code = code[: len(some) - n + 1] * np.uint32(257) + some[n - 1 :]
            if n > 2:
                inner = inner[: len(some) - n + 1] | blank[n - 2 : len(some) - 1]
            else:
                inner = inner[: len(some) - 1]
            ok = ~(inner | (blank[:-1] & blank[1:]) if n == 2 else inner)[:AT_ONCE]  # each start once; two blanks are no word
            spread = (code[:AT_ONCE][ok] ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            found += np.bincount((spread ^ (spread >> np.uint32(15))) % np.uint32(buckets), minlength=buckets)
    return found


@dataclass
class LanguageModel:
    """languages; embedding (buckets x width); weight (width x languages); bias; temperature; the least share that isn't rejected."""

    languages: list[str]
    embedding: object = None
    weight: object = None
    bias: object = None
    temperature: float = 1.0
    least: float = 0.0

    def softmax(self, z):
        import numpy as np

        z = z / self.temperature
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def shares(self, counts):
        """The languages' shares of bucket counts (rows x buckets)."""
        import numpy as np

        mean = counts @ self.embedding / np.maximum(counts.sum(1, keepdims=True), 1)
        return self.softmax(mean @ self.weight + self.bias)


def fit(counts, names: list[str], calibrates, buckets: int = BUCKETS, width: int = WIDTH, epochs: int = EPOCHS) -> LanguageModel:
    """The model of documents' sparse bucket counts, a list of (buckets, counts), their languages, and which of them calibrate. Deterministic.

    In every other epoch a document is replaced by a small random part of its subwords, so that short texts are known as well."""
    import numpy as np

    rng = np.random.default_rng(SEED)
    languages = sorted(set(names))
    of = {x: k for k, x in enumerate(languages)}
    y, calibrates = np.array([of[x] for x in names], "i8"), np.asarray(calibrates, bool)
    model = LanguageModel(languages, rng.normal(0, 1.0, (buckets, width)), rng.normal(0, 0.1, (width, len(languages))), np.zeros(len(languages)))
    if len(languages) < 2:
        return model
    e, w, bias = model.embedding, model.weight, model.bias
    seen = np.flatnonzero(~calibrates)
    share = 1.0 / np.maximum(np.bincount(y[seen], minlength=len(languages)), 1)
    share = share / share[y[seen]].mean()  # rare languages weigh as much as common ones

    def rows(some, part: bool):
        x = np.zeros((len(some), buckets))
        for r, k in enumerate(some):
            at, n = counts[k]
            if part and len(at):
                drawn = rng.choice(at, int(rng.integers(2, 200)), p=n / n.sum())
                x[r] = np.bincount(drawn, minlength=buckets)
            else:
                x[r, at] = n
        return x / np.maximum(x.sum(1, keepdims=True), 1)

    steps, step = epochs * -(-len(seen) // BATCH), 0
    for epoch in range(epochs):
        order = rng.permutation(seen)
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            x = rows(some, epoch % 2 == 1)
            mean = x @ e
            z = mean @ w + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            p *= share[y[some]][:, None] / len(some)
            down = x.T @ (p @ w.T)
            w -= rate / width * (mean.T @ p)
            bias -= 0.1 * rate / width * p.sum(0)
            e -= rate * down
    held = np.flatnonzero(calibrates)
    if len(held):
        z = np.concatenate([rows(held[i : i + BATCH], False) @ e @ w + bias for i in range(0, len(held), BATCH)])
        rights = (np.arange(len(held)), y[held])

        def loss(t):
            s = z / t
            s = s - s.max(1, keepdims=True)
            return float((np.log(np.exp(s).sum(1)) - s[rights]).mean())

        model.temperature = min((float(t) for t in np.geomspace(0.25, 16, 61)), key=loss)
        p = model.softmax(z)
        good = np.sort(p.max(1)[p.argmax(1) == y[held]])
        if len(good):
            model.least = float(good[int(REJECTED * len(good))])
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def counts_of(text: Column, buckets: int = BUCKETS, longest: int = LONGEST) -> Column:
    """The sparse bucket counts of a text: struct(at, n), arrays as bytes of 32-bit integers."""

    def counted(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for texts in batches:
            at, n = [], []
            for t in texts:
                found = subword_counts(t.as_py() or "", buckets, longest)
                some = np.flatnonzero(found)
                at.append(some.astype("<i4").tobytes())
                n.append(np.minimum(found[some], 2**31 - 1).astype("<i4").tobytes())
            yield pa.StructArray.from_arrays([pa.array(at, pa.binary()), pa.array(n, pa.binary())], ["at", "n"])

    return F.arrow_udf(counted, "at binary, n binary", F.ArrowUDFType.SCALAR_ITER)(text.cast("string"))


def train(docs: DataFrame, most: int = MOST_A_LANGUAGE) -> LanguageModel:
    """The model of at most ``most`` documents of each language (doc_id, text, lang) that aren't held out. Without any it has no languages."""
    import numpy as np

    known = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    first = F.xxhash64("doc_id", "text")
    keys = written(known.select("lang", first.alias("h"), F.crc32(F.col("doc_id").cast("string")).alias("c")))
    sizes = keys.groupBy("lang").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "lang").limit(MOST_LANGUAGES)
    sizes = written(sizes)
    most = min(most, -(-MOST_IN_ALL // max(sizes.count(), 1)))
    # twice as many as needed are so by their hash alone; those that are first of these are ranked
    near = (F.col("h").cast("double") + 2.0**63) / 2.0**64 * F.col("size") <= 2 * most + 50
    chosen = keys.join(F.broadcast(sizes), "lang").filter(near).select("lang", "h")
    chosen = chosen.select("lang", "h", F.row_number().over(Window.partitionBy("lang").orderBy("h")).alias("k")).filter(F.col("k") <= most)
    chosen = chosen.select("lang", "h").distinct()
    some = known.withColumn("h", first).join(F.broadcast(chosen), ["lang", "h"])
    some = some.dropDuplicates(["lang", "h"]).select("lang", "h", counts_of(F.col("text")).alias("x")).select("lang", "h", "x.*")
    rows = some.orderBy("lang", "h").toPandas()
    counts = [(np.frombuffer(a, "<i4"), np.frombuffer(n, "<i4").astype("f8")) for a, n in zip(rows["at"], rows["n"], strict=True)]
    return fit(counts, list(rows["lang"]), [h % CALIBRATES == 0 for h in rows["h"]])


def predicted(text: Column, model: LanguageModel, spark) -> Column:
    """struct(lang_pred, score, rejected)"""
    # plain values: executors needn't have this library
    sent = spark.sparkContext.broadcast((model.languages, model.embedding, model.weight, model.bias, model.temperature, model.least))

    def of(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        m = LanguageModel(*sent.value)
        for texts in batches:
            langs, scores, out = [], [], []
            for t in texts:
                t = t.as_py() or ""
                if not m.languages or not any(map(str.isalpha, t)):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    out.append(True)
                    continue
                p = m.shares(subword_counts(t, *m.embedding.shape[:1]).astype("f8")[None])[0]
                k = int(np.argmax(p))
                langs.append(m.languages[k])
                scores.append(float(p[k]))
                out.append(bool(p[k] < m.least))
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())], ["lang_pred", "score", "rejected"])

    return F.arrow_udf(of, "lang_pred string, score double, rejected boolean", F.ArrowUDFType.SCALAR_ITER)(text.cast("string"))


def identify(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """All rows of ``docs`` (doc_id, text, and lang if there is no ``model``) with held_out, lang_pred, score and rejected, which replace columns
    of those names; others stay, whatever their names.

    The prediction depends on the text alone, and is that of a learned language, ``und`` with score 0 for a null text or one
    without a letter, or if no language was learned. rejected: the score is below the calibrated least one, or there is no language.
    Repeated rows fare alike. An empty table gives an empty one.
    """
    model = train(docs) if model is None else model
    docs, own = set_apart(docs, ("doc_id", "text"), ("held_out", "lang_pred", "score", "rejected"))
    out = docs.withColumn("held_out", held_out()).withColumn("__got", predicted(F.col("text"), model, docs.sparkSession))
    out = out.withColumns({c: F.col(f"__got.{c}") for c in ("lang_pred", "score", "rejected")}).drop("__got")
    return given_back(out, own)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
