"""A quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Shallow boosted trees are grown on a bounded sample of labelled rows; every path from a root to a node
becomes a rule, a conjunction of thresholds; a logistic model with an L1 penalty picks few of them; and
those are compiled into one Spark column expression, so scoring is a plain projection.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import GAP, given_back, set_apart, text_of

#: The fit sees at most so many labelled documents, those first by a hash of the id.
MAX_LABELLED = 12_000
#: A document is good if its score is at least this.
CUT = 0.3

STATISTICS = ("words", "word_length", "upper", "symbols", "digits", "marks", "bars", "repeated_lines", "distinct_words", "words_per_line", "stops", "odd_words", "long_words")


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct __stats of STATISTICS, all of the whole text; a null text counts as empty."""
    t = text_of(text)
    count = lambda pattern: F.regexp_count(F.col("__text"), F.lit(pattern)).cast("double")
    docs = docs.withColumn("__text", t)
    docs = docs.withColumns({"__words": F.array_remove(F.split("__text", GAP), ""), "__lines": F.filter(F.split("__text", "\n"), lambda x: F.length(x) > 0)})
    n, lines = F.size("__words").cast("double"), F.size("__lines").cast("double")
    docs = docs.withColumns({"__n": F.greatest(n, F.lit(1.0)), "__l": F.greatest(lines, F.lit(1.0)), "__c": F.greatest(F.length("__text").cast("double"), F.lit(1.0))})
    stats = {
        "words": n,
        "word_length": F.col("__c") / F.col("__n"),
        "upper": count(r"\p{Lu}") / F.col("__c"),
        "symbols": count(r"[#*$%&<>^~_=]") / F.col("__n"),
        "digits": count(r"[0-9]") / F.col("__c"),
        "marks": count(r"[!?]") / F.col("__n"),
        "bars": count(r"\|") / F.col("__n"),
        "repeated_lines": 1 - F.size(F.array_distinct("__lines")) / F.col("__l"),
        "distinct_words": F.size(F.array_distinct("__words")) / F.col("__n"),
        "words_per_line": F.col("__n") / F.col("__l"),
        "stops": count(r"[.]") / F.col("__n"),
        "odd_words": count(r"(?<![^\x20\x09-\x0D])\P{L}[^\x20\x09-\x0D]*") / F.col("__n"),
        "long_words": count(r"[^\x20\x09-\x0D]{13,}") / F.col("__n"),
    }
    return docs.withColumn("__stats", F.struct(*[v.alias(k) for k, v in stats.items()])).drop("__text", "__words", "__lines", "__n", "__l", "__c")


@dataclass(frozen=True)
class Rule:
    """All of (statistic, above, threshold): statistic > threshold if above, else <=."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        parts = [(F.col(f"__stats.{s}") > t) if above else (F.col(f"__stats.{s}") <= t) for s, above, t in self.terms]
        held = parts[0]
        for p in parts[1:]:
            held = held & p
        return held


@dataclass
class RuleModel:
    intercept: float
    rules: list[Rule] = field(default_factory=list)

    def score(self) -> Column:
        total = F.lit(float(self.intercept))
        for r in self.rules:
            total = total + F.when(r.column(), F.lit(float(r.weight))).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _grow(x, codes, edges, residual, hessian, depth: int, least: int, rng_rows, path: tuple, rules: dict):
    """Adds the rules of one regression tree; returns its prediction on all rows as leaf values."""
    import numpy as np

    rows = rng_rows
    value = residual[rows].sum() / (hessian[rows].sum() + 1.0)
    if path:
        rules[tuple(sorted(path))] = None
    best = (1e-6, None, None)
    if depth and len(rows) >= 2 * least:
        g, h = residual[rows], hessian[rows]
        base = g.sum() ** 2 / (h.sum() + 1.0)
        for j in range(x.shape[1]):
            k = len(edges[j])
            if not k:
                continue
            c = codes[rows, j]
            gl, hl, nl = (np.cumsum(np.bincount(c, w, k + 1))[:-1] for w in (g, h, np.ones(len(rows))))
            ok = (nl >= least) & (len(rows) - nl >= least)
            gain = np.where(ok, gl**2 / (hl + 1.0) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1.0) - base, 0.0)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], j, i)
    if best[1] is None:
        return [(rows, value)]
    _, j, i = best
    left = codes[rows, j] <= i
    out = []
    for above, part in ((False, rows[left]), (True, rows[~left])):
        out += _grow(x, codes, edges, residual, hessian, depth - 1, least, part, (*path, (STATISTICS[j], above, float(edges[j][i]))), rules)
    return out


def fit_rules(x, y, trees: int = 24, depth: int = 3, rate: float = 0.4, penalty: float = 2e-4, steps: int = 400) -> RuleModel:
    """The model of the statistics ``x`` (rows x STATISTICS) and labels ``y``, 0 or 1. No rows, or one class
    alone, give a constant: the share of ones, smoothed. Deterministic."""
    import numpy as np

    prior = (y.sum() + 1.0) / (len(y) + 2.0)
    start = float(np.log(prior / (1 - prior)))
    if len(y) < 20 or y.min() == y.max():
        return RuleModel(start)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 42)[1:-1])) for j in range(x.shape[1])]
    edges = [e[e < x[:, j].max()] for j, e in enumerate(edges)]
    codes = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    margin, found = np.full(len(y), start), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        for rows, value in _grow(x, codes, edges, y - p, p * (1 - p), depth, max(5, len(y) // 400), np.arange(len(y)), (), found):
            margin[rows] += rate * value
    terms = list(found)
    column = {s: k for k, s in enumerate(STATISTICS)}
    r = np.ones((len(y), len(terms)))
    for k, path in enumerate(terms):
        for s, above, t in path:
            r[:, k] *= (x[:, column[s]] > t) if above else (x[:, column[s]] <= t)
    varied = [k for k in range(len(terms)) if 0 < r[:, k].mean() < 1]
    if not varied:
        return RuleModel(start)
    terms, r = [terms[k] for k in varied], r[:, varied]
    mean, scale = r.mean(0), r.std(0)
    z = (r - mean) / scale
    w, b, fast, t = np.zeros(z.shape[1]), start, np.zeros(z.shape[1] + 1), 1.0
    fast[-1] = start
    step = 4.0 / (np.linalg.norm(z, 2) ** 2 / len(y) + 1.0)
    for _ in range(steps):  # accelerated proximal gradient
        p = 1 / (1 + np.exp(-(z @ fast[:-1] + fast[-1])))
        moved = fast[:-1] - step * (z.T @ (p - y)) / len(y)
        new_w = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        new_b = fast[-1] - step * (p - y).mean()
        new_t = (1 + (1 + 4 * t * t) ** 0.5) / 2
        fast = np.append(new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b))
        w, b, t = new_w, new_b, new_t
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel(float(b - (w / scale * mean)[kept].sum()), [Rule(terms[k], float(w[k] / scale[k])) for k in kept])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_LABELLED) -> RuleModel:
    """The model of at most ``most`` labelled documents that aren't held out."""
    import numpy as np

    given = labels.select("doc_id", F.col(label).cast("double").alias("__y")).filter("__y is not null and doc_id is not null")
    given = given.filter(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id", "__y").limit(most)
    known = with_statistics(docs.select("doc_id", "text").join(F.broadcast(given), "doc_id")).select("doc_id", "__y", "__stats.*")
    rows = known.orderBy(F.xxhash64("doc_id"), *known.columns).limit(most).toPandas()
    return fit_rules(rows[list(STATISTICS)].to_numpy("f8"), np.asarray(rows["__y"], "f8"))


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """All rows of ``docs`` with held_out, score and predicted. Columns of those names are replaced; others stay, whatever their names.

    The score depends on the text alone. A null text counts as empty and is scored like any other;
    repeated rows score alike; without labels every score is one half. An empty table gives an empty one.
    """
    model = train(docs, labels)
    docs, own = set_apart(docs, ("doc_id", "text"), ("held_out", "score", "predicted"))
    out = with_statistics(docs).withColumn("held_out", held_out())
    out = out.withColumn("score", model.score()).drop("__stats")
    return given_back(out.withColumn("predicted", F.when(F.col("score") >= cut, 1).otherwise(0)), own)


