"""Learning on feature tables with Spark ML: grouped folds, out-of-fold scores, experts."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.operators.ranked import as_number, exact_quantiles, numbered
from gaugeline.sources.storage import written


def grouped_folds(df: DataFrame, group: str, y: str, k: int = 3) -> DataFrame:
    """(group, fold): groups in order, dealt out in turn among those with and those without a positive."""
    g = df.groupBy(group).agg(F.max(y).alias("__y"))
    g = numbered(g.withColumn("__o", as_number(g, group)), "__o", "fold", ("__y",))
    return g.select(group, (F.col("fold") % k).cast("int").alias("fold"))


def balanced(df: DataFrame, y: str) -> DataFrame:
    """Adds weight = n / (classes * n of the class)."""
    c = df.groupBy(y).agg(F.count("*").alias("__n"))
    total = c.agg(F.sum("__n").alias("__all"), F.count("*").alias("__k"))
    c = c.join(F.broadcast(total), F.lit(True)).select(y, (F.col("__all") / (F.col("__k") * F.col("__n"))).alias("weight"))
    return df.join(c, y)


def out_of_fold(df: DataFrame, features: list[str], y: str, group: str, k: int = 3, kind: str = "logistic", seed: int = 3) -> DataFrame:
    """``df`` with fold and oof: each row's score by a model that hasn't seen its group. The loop is over folds."""
    df = written(df.join(grouped_folds(df, group, y, k), group))
    df = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="keep").transform(df)
    out = None
    for fold in range(k):
        train = balanced(df.filter(F.col("fold") != fold), y)
        if kind == "gbt":
            model = GBTClassifier(featuresCol="__x", labelCol=y, weightCol="weight", maxIter=5, maxDepth=3, seed=seed).fit(train)
        else:
            model = LogisticRegression(featuresCol="__x", labelCol=y, weightCol="weight", maxIter=20, regParam=0.01).fit(train)
        part = model.transform(df.filter(F.col("fold") == fold)).withColumn("oof", vector_to_array("probability")[1])
        part = part.drop("rawPrediction", "probability", "prediction", "__x")
        out = part if out is None else out.unionByName(part)
    return out


def fold_norm(train: DataFrame, features: list[str], entity: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, entity, <feature>: array of median and interquartile range) of the training rows of each entity, and of all of them with a null entity, for each ``by``. A range of 0 counts as 1."""
    own = exact_quantiles(train.filter(F.col(entity).isNotNull()), features, [0.25, 0.5, 0.75], (*by, entity))
    both = own.unionByName(exact_quantiles(train, features, [0.25, 0.5, 0.75], by).withColumn(entity, F.lit(None).cast(dict(train.dtypes)[entity])))
    wide = lambda f: F.get(f, F.lit(2)) - F.get(f, F.lit(0))
    return both.select(*by, entity, *[F.when(F.col(f).isNotNull(), F.array(F.get(f, F.lit(1)), F.when(wide(f) == 0, 1.0).otherwise(wide(f)))).alias(f) for f in features])


def fold_normed(df: DataFrame, norm: DataFrame, features: list[str], entity: str) -> DataFrame:
    """``df`` with the features less the median of their entity, in its interquartile ranges; those of an entity that ``norm`` doesn't know by those of all."""
    own = norm.filter(F.col(entity).isNotNull()).select(F.col(entity), *[F.col(f).alias(f"__o_{f}") for f in features])
    whole = norm.filter(F.col(entity).isNull()).select(*[F.col(f).alias(f"__a_{f}") for f in features])  # one row
    out = df.join(own, entity, "left").join(F.broadcast(whole), F.lit(True), "left")
    of = lambda f, k: F.coalesce(F.get(f"__o_{f}", F.lit(k)), F.get(f"__a_{f}", F.lit(k)))
    return out.withColumns({f: (F.col(f).cast("double") - of(f, 0)) / of(f, 1) for f in features}).select(*df.columns)


def logistic_expert(focal: bool = True):
    """Balanced logistic regression; with ``focal`` fitted a second time, rows weighted up the less the first fit gave their class."""

    def score(train: DataFrame, test: DataFrame, features: list[str], y: str, name: str) -> DataFrame:
        assemble = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="keep")
        x = written(assemble.transform(balanced(train, y)).select("__x", F.col(y).alias("__y"), "weight"))
        fit = lambda rows: LogisticRegression(featuresCol="__x", labelCol="__y", weightCol="weight", maxIter=50, regParam=0.01).fit(rows)
        model = fit(x)
        if focal:
            p = vector_to_array("probability")
            right = F.when(F.col("__y") == 1, p[1]).otherwise(p[0])
            model = fit(model.transform(x).select("__x", "__y", (F.col("weight") * ((1 - right) * (1 - right) + 0.5)).alias("weight")))
        return model.transform(assemble.transform(test)).withColumn(name, vector_to_array("probability")[1]).select(*test.columns, name)

    return score


def _beside(train: DataFrame, test: DataFrame, features: list[str], y: str) -> DataFrame:
    """(features, __clean, __row): clean training rows, and test rows with all that they have."""
    clean = train.filter(F.col(y) == 0).select(*features, F.lit(True).alias("__clean"))
    return clean.unionByName(test.select(*features, F.lit(False).alias("__clean"), F.struct(*test.columns).alias("__row")), allowMissingColumns=True)


def distance_expert(kind: str, k: int = 5, k_density: int = 20):
    """The distance to the ``k``-th clean training row (knn), or how thin its surroundings are (lof)."""
    from gaugeline.operators import neighbours

    def score(train: DataFrame, test: DataFrame, features: list[str], y: str, name: str) -> DataFrame:
        got = neighbours.scores(_beside(train, test, features, y), features, F.col("__clean"), k, k_density).filter(~F.col("__clean"))
        return got.select("__row.*", F.col(kind).alias(name))

    return score


def distance_experts(k: int = 5, k_density: int = 20):
    """Both of them from one search, for two names: first knn, then lof."""
    from gaugeline.operators import neighbours

    def score(train: DataFrame, test: DataFrame, features: list[str], y: str, names: tuple[str, str]) -> DataFrame:
        got = neighbours.scores(_beside(train, test, features, y), features, F.col("__clean"), k, k_density).filter(~F.col("__clean"))
        return got.select("__row.*", F.col("knn").alias(names[0]), F.col("lof").alias(names[1]))

    return score


def component_expert(share: float = 0.9):
    """The distance from the components that explain ``share`` of the variance of clean training rows."""

    def score(train: DataFrame, test: DataFrame, features: list[str], y: str, name: str) -> DataFrame:
        got = pca_error(_beside(train, test, features, y), F.array(*[F.col(f).cast("double") for f in features]), share, F.col("__clean")).filter(~F.col("__clean"))
        return got.select("__row.*", F.col("error").alias(name))

    return score


def out_of_fold_experts(df: DataFrame, features: list[str], experts: dict, y: str, group: str, entity: str, k: int = 3, at_once: int = 2) -> DataFrame:
    """``df`` with fold and a score of each of ``experts`` {name: function (train, test, features, y, name) that adds a column to test}, or several for a tuple of names: by what was fitted on the other folds alone. Groups aren't
    split between folds, and features are normalised by the training rows of each fold, for each ``entity``. The features themselves stay as they are. ``at_once`` folds are fitted side by side."""
    df = written(df)
    rows = written(df.join(grouped_folds(df, group, y, k), group))
    kept = [f"__f_{f}" for f in features]
    rows = rows.withColumns({h: F.col(f) for h, f in zip(kept, features, strict=True)})
    trained = F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda fold: fold != F.col("fold")))
    norms = written(fold_norm(rows.select("*", trained.alias("__k")), features, entity, ("__k",)))

    def scored(fold: int) -> DataFrame:
        norm = norms.filter(F.col("__k") == fold).drop("__k")
        train, test = (written(fold_normed(rows.filter(of), norm, features, entity)) for of in (F.col("fold") != fold, F.col("fold") == fold))
        for name, expert in experts.items():
            test = written(expert(train, test, features, y, name))
        return test

    with ThreadPoolExecutor(at_once) as pool:
        parts = [pool.submit(inheritable_thread_target(df.sparkSession)(scored), fold) for fold in range(k)]
        out = reduce(DataFrame.unionByName, [p.result() for p in parts])
    return out.withColumns({f: F.col(h) for h, f in zip(kept, features, strict=True)}).drop(*kept)


def pca_error(df: DataFrame, vector: Column, share: float = 0.9, clean: Column | None = None) -> DataFrame:
    """Adds error: the squared distance of a vector from its projection on the first components about the mean, as many as together explain more than ``share``
    of the variance. Mean and components are those of the ``clean`` rows, or of all. Null vectors have no error; without a row to fit on none has."""
    df = df.withColumn("__v", F.when(vector.isNotNull(), array_to_vector(vector.cast("array<double>"))))
    fit = df.filter(F.col("__v").isNotNull() & (F.lit(True) if clean is None else F.coalesce(clean, F.lit(False))))
    first = fit.select(F.size(vector_to_array("__v")).alias("n")).first()
    if first is None:
        return df.withColumn("error", F.lit(None).cast("double")).drop("__v")
    centred = StandardScaler(inputCol="__v", outputCol="__c", withMean=True, withStd=False).fit(fit)
    model = PCA(k=first.n, inputCol="__c", outputCol="__p").fit(centred.transform(fit))
    explained = np.cumsum(model.explainedVariance.toArray())
    k = min(first.n, int(np.searchsorted(explained, share, "right")) + 1)
    known = model.transform(centred.transform(df.filter(F.col("__v").isNotNull())))
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)
    known = known.withColumn("error", F.greatest(F.lit(0.0), square(vector_to_array("__c")) - square(F.slice(vector_to_array("__p"), 1, k))))
    none = df.filter(F.col("__v").isNull()).withColumn("error", F.lit(None).cast("double"))
    return known.drop("__c", "__p").unionByName(none).drop("__v")


#: The Poisson distribution of mean 1: the chance of no more than 0, 1, ... draws.
_POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(10)]


def bootstrap_interval(df: DataFrame, cluster: str, hit: Column, reps: int = 500, seed: int = 9) -> DataFrame:
    """(lo, hi): the 2.5 and 97.5 percentiles of the hit rate over resamples of whole clusters. Rows are summed
    by cluster first; how often a repetition draws a cluster is Poisson of mean 1, from a hash of seed, repetition and
    cluster, so reruns agree and no cluster is ranked or looked up."""
    c = df.groupBy(cluster).agg(F.count_if(hit).alias("h"), F.count("*").alias("n"))
    draws = c.select("h", "n", cluster, F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    u = F.pmod(F.xxhash64(F.lit(seed), "rep", cluster), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = sum(F.when(u >= x, 1).otherwise(0) for x in _POISSON)
    rate = draws.groupBy("rep").agg((F.sum(F.col("h") * times) / F.sum(F.col("n") * times)).alias("r"))
    q = rate.agg(F.percentile("r", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return q.select(F.get("q", F.lit(0)).alias("lo"), F.get("q", F.lit(1)).alias("hi"))
