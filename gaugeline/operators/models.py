"""Trained heads on window features with Spark ML: calibrated final model, classes, neighbours, sweeps and probes."""

from __future__ import annotations

import importlib.util
import itertools
import json
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.operators import calibrate as cal
from gaugeline.operators import learning
from gaugeline.operators import metrics as me
from gaugeline.operators.contracts import ContractError
from gaugeline.operators.ranked import as_number, exact_quantiles, numbered
from gaugeline.sources.storage import read_text, write_text, written

ARTIFACT_VERSION = 1
# The parameters swept.
GRID = {"maxIter": (20, 50), "maxDepth": (3, 5), "stepSize": (0.05, 0.1), "minInstancesPerNode": (20, 100)}


def assembled(df: DataFrame, features: list[str], out: str = "__x") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep").transform(df)


def clean_norm(df: DataFrame, features: list[str], y: str) -> dict[str, tuple[float, float]]:
    """The median and interquartile range (1e-9 at least) of each feature on clean rows."""
    row = exact_quantiles(df.filter(F.col(y) == 0), features, [0.25, 0.5, 0.75]).first()
    return {f: (row[f][1], max(row[f][2] - row[f][0], 1e-9)) if row[f] else (0.0, 1.0) for f in features}


def normed(df: DataFrame, norm: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({f: (F.col(f) - m) / i for f, (m, i) in norm.items()})


@dataclass
class WindowModel:
    """A booster, the sigmoid on its margin, thresholds for each family with a global one, and what the rows were scaled by."""

    booster: object
    sigmoid: LogisticRegressionModel
    thresholds: dict[str, float]
    global_threshold: float
    norm: dict[str, tuple[float, float]]
    features: list[str]

    def scored(self, df: DataFrame) -> DataFrame:
        rows = self.booster.transform(assembled(normed(df.select("*", *[F.col(f).alias(f"__{f}") for f in self.features]), self.norm), self.features))
        rows = rows.withColumn("__m", vector_to_array("rawPrediction")[1]).drop("rawPrediction", "probability", "prediction", "__x")
        rows = self.sigmoid.transform(assembled(rows, ["__m"])).withColumn("score", vector_to_array("probability")[1])
        return rows.withColumns({f: F.col(f"__{f}") for f in self.features}).drop(*[f"__{f}" for f in self.features], "__m", "__x", "rawPrediction", "probability", "prediction")

    def decided(self, df: DataFrame, family: str) -> DataFrame:
        thr = F.lit(self.global_threshold)
        for name, t in self.thresholds.items():
            thr = F.when(F.col(family) == name, F.lit(t)).otherwise(thr)
        return self.scored(df).withColumn("dec", F.col("score") >= thr)


def finalized(df: DataFrame, features: list[str], y: str, family: str, group: str, seed: int = 0, trees: int = 10) -> WindowModel:
    """Trains on two groups of three, and picks thresholds on every third one, which nothing else sees. The sigmoid is fitted to out-of-fold
    margins of the training groups. A family without positives or negatives keeps the global threshold."""
    g = df.groupBy(group).agg(F.count("*").alias("__n"))
    g = numbered(g.withColumn("__o", as_number(g, group)), "__o", "__k").select(group, (F.col("__k") % 3 == 2).alias("__cal"))
    rows = written(df.join(g, group))
    train = rows.filter("not __cal")
    norm = clean_norm(train, features, y)
    x = written(normed(train, norm))
    booster = lambda: GBTClassifier(featuresCol="__x", labelCol=y, weightCol="weight", maxIter=trees, maxDepth=3, seed=seed)
    folds = x.withColumn("__f", F.pmod(F.xxhash64(group), F.lit(2)))
    parts = []
    for k in (0, 1):
        model = booster().fit(assembled(learning.balanced(folds.filter(F.col("__f") != k), y), features))
        part = model.transform(assembled(folds.filter(F.col("__f") == k), features))
        parts.append(part.select(F.col(y), vector_to_array("rawPrediction")[1].alias("__m")))
    sigmoid = LogisticRegression(featuresCol="__x", labelCol=y, maxIter=25).fit(assembled(parts[0].unionByName(parts[1]), ["__m"]))
    final = WindowModel(booster().fit(assembled(learning.balanced(x, y), features)), sigmoid, {}, 0.5, norm, features)
    held = written(final.scored(rows.filter("__cal")).select(family, y, "score"))
    best = cal.best_f1(held, (), "score", y).first()
    final.global_threshold = float(best.thr) if best and best.thr is not None else 0.5
    both = held.groupBy(family).agg(F.countDistinct(y).alias("k")).filter("k = 2").select(family)
    final.thresholds = {r[family]: float(r.thr) for r in cal.best_f1(held.join(both, family), (family,), "score", y).collect()}  # one row a family
    return final


def thresholds_artifact(thresholds: DataFrame, seed: int, version: int = ARTIFACT_VERSION) -> str:
    """JSON of rows (machine, ...): sorted keys, the roster and what it was made by. One row an entity of the roster."""
    held = {r["machine"]: {k: v for k, v in r.asDict().items() if k != "machine"} for r in thresholds.collect()}
    return json.dumps({"version": version, "cal_seed": seed, "machines": sorted(held), "thresholds": {str(k): v for k, v in held.items()}}, indent=2, sort_keys=True)


def save_thresholds(thresholds: DataFrame, path: str, seed: int) -> None:
    write_text(thresholds.sparkSession, path, thresholds_artifact(thresholds, seed))


def load_thresholds(spark: SparkSession, path: str, roster: set, version: int = ARTIFACT_VERSION) -> DataFrame:
    """(machine, ...) of an artifact; an unreadable one, another version or another roster is a ContractError."""
    try:
        held = json.loads(read_text(spark, path))
    except Exception as err:
        raise ContractError(f"no readable artifact at {path}: {err}") from err
    if held.get("version") != version:
        raise ContractError(f"artifact version {held.get('version')!r}, not {version!r}")
    if set(held.get("machines", [])) != set(roster):
        raise ContractError("the artifact is of another roster")
    names = sorted(next(iter(held["thresholds"].values()), {}))
    rows = [(m, *[held["thresholds"][str(m)][n] for n in names]) for m in held["machines"]]
    kind = "long" if all(isinstance(m, int) for m in held["machines"]) else "string"
    return spark.createDataFrame(rows, f"machine {kind}, " + ", ".join(f"`{n}` double" for n in names))


def save_model(model: WindowModel, spark: SparkSession, path: str, seed: int = 0) -> None:
    """The booster and the sigmoid in Spark's own format, and a sidecar of all else."""
    model.booster.write().overwrite().save(f"{path}/booster")
    model.sigmoid.write().overwrite().save(f"{path}/sigmoid")
    write_text(spark, f"{path}/model.json", json.dumps({"version": ARTIFACT_VERSION, "seed": seed, "thresholds": model.thresholds, "global_threshold": model.global_threshold, "norm": model.norm, "features": model.features}, sort_keys=True))


def load_model(spark: SparkSession, path: str, features: list[str]) -> WindowModel:
    """A saved model, if it has this version and these features in this order."""
    from pyspark.ml.classification import GBTClassificationModel

    try:
        held = json.loads(read_text(spark, f"{path}/model.json"))
    except Exception as err:
        raise ContractError(f"no readable model at {path}: {err}") from err
    if held.get("version") != ARTIFACT_VERSION or held.get("features") != features:
        raise ContractError(f"model of version {held.get('version')!r} and features {held.get('features')}")
    norm = {f: tuple(v) for f, v in held["norm"].items()}
    return WindowModel(GBTClassificationModel.load(f"{path}/booster"), LogisticRegressionModel.load(f"{path}/sigmoid"), held["thresholds"], held["global_threshold"], norm, features)


def out_of_fold_classes(df: DataFrame, features: list[str], label: str, group: str, k: int = 3, trees: int = 10, seed: int = 0) -> DataFrame:
    """``df`` with fold and predicted: each row's class by a forest that hasn't seen its group."""
    names = [r[0] for r in df.select(label).distinct().orderBy(label).collect()]  # one row a class
    index = F.array_position(F.array(*map(F.lit, names)), F.col(label)) - 1
    rows = df.withColumn("__y", index.cast("double"))
    rows = written(rows.join(learning.grouped_folds(rows.withColumn("__p", (F.col("__y") > 0).cast("int")), group, "__p", k), group))
    out = None
    for fold in range(k):
        x = assembled(rows, features)
        model = RandomForestClassifier(featuresCol="__x", labelCol="__y", numTrees=trees, maxDepth=5, seed=seed).fit(x.filter(F.col("fold") != fold))
        part = model.transform(x.filter(F.col("fold") == fold)).withColumn("predicted", F.get(F.array(*map(F.lit, names)), F.col("prediction").cast("int")))
        part = part.select(*df.columns, "fold", "predicted")
        out = part if out is None else out.unionByName(part)
    return out


def swept(df: DataFrame, features: list[str], y: str, group: str, grid: dict[str, tuple] = GRID, seed: int = 0) -> DataFrame:
    """(place, f1, <parameters>): the out-of-fold F1 at .5 of every combination of ``grid``, the best first. The loop is over combinations."""
    rows = written(df.withColumn("__f", F.pmod(F.xxhash64(group), F.lit(2))))
    x = assembled(rows, features)
    out = []
    for values in itertools.product(*grid.values()):
        tp = fp = fn = 0
        for k in (0, 1):
            model = GBTClassifier(featuresCol="__x", labelCol=y, seed=seed, **dict(zip(grid, values, strict=True))).fit(x.filter(F.col("__f") != k))
            c = me.counts(F.col("prediction") == 1, F.col(y) == 1)
            r = model.transform(x.filter(F.col("__f") == k)).agg(c["tp"].alias("tp"), c["fp"].alias("fp"), c["fn"].alias("fn")).first()
            tp, fp, fn = tp + r.tp, fp + r.fp, fn + r.fn
        out.append((2.0 * tp / (2 * tp + fp + fn) if tp else 0.0, *map(float, values)))
    out.sort(key=lambda r: (-r[0], r[1:]))
    return df.sparkSession.createDataFrame([(k, *r) for k, r in enumerate(out)], "place int, f1 double, " + ", ".join(f"`{c}` double" for c in grid))


def batch_auc(a: DataFrame, b: DataFrame, features: list[str], key: str) -> DataFrame:
    """One row (auc): how well a linear model tells two batches apart out of fold; one half if it can't. Folds are by hash of ``key``."""
    rows = a.select(key, *features, F.lit(0).alias("y")).unionByName(b.select(key, *features, F.lit(1).alias("y")))
    rows = assembled(written(rows.withColumn("__f", F.pmod(F.xxhash64(key, "y"), F.lit(3)))), features)
    out = None
    for k in range(3):
        model = LogisticRegression(featuresCol="__x", labelCol="y", maxIter=20).fit(rows.filter(F.col("__f") != k))
        part = model.transform(rows.filter(F.col("__f") == k)).select("y", vector_to_array("probability")[1].alias("score"))
        out = part if out is None else out.unionByName(part)
    return me.auc(out)


def trainability(df: DataFrame, features: list[str], family: str, y: str, least: int = 5) -> DataFrame:
    """(family, n, auc): how well a linear model separates each family's positives from all clean rows it is fitted on; null with fewer
    than ``least`` of either. The loop is over families."""
    rows = assembled(written(df.select(family, y, *features)), features)
    n = {r[family]: r.n for r in rows.filter(F.col(y) == 1).groupBy(family).agg(F.count("*").alias("n")).collect()}  # one row a family
    clean, out = rows.filter(F.col(y) == 0).count(), []
    for name in sorted(n):
        auc = None
        if n[name] >= least and clean >= least:
            part = rows.filter((F.col(y) == 0) | (F.col(family) == name))
            model = LogisticRegression(featuresCol="__x", labelCol=y, maxIter=20).fit(part)
            auc = me.auc(model.transform(part).select(F.col(y).alias("y"), vector_to_array("rawPrediction")[1].alias("score"))).first().auc
        out.append((name, n[name], auc))
    return df.sparkSession.createDataFrame(out, f"`{family}` string, n long, auc double")


def oversampled(df: DataFrame, y: str, times: int = 1) -> DataFrame:
    """Positives ``times`` over; as given with 1."""
    return df if times == 1 else df.withColumn("__k", F.explode(F.sequence(F.lit(1), F.when(F.col(y) == 1, times).otherwise(1)))).drop("__k")


def detector_pool() -> dict[str, str]:
    """Each expert of the library with "ready", or why it isn't there."""
    needed = {"quantile": None, "mixture": "numpy", "pot": None, "logistic": "numpy", "trees": "numpy", "forest": "numpy", "knn": "pandas", "lof": "pandas", "pca": "numpy", "discord": "numpy"}
    return {name: "ready" if module is None or importlib.util.find_spec(module) else f"needs {module}" for name, module in needed.items()}


def feature_names(columns: list[str], statistics: tuple[str, ...] = ("mean", "std", "min", "max", "slope"), counters: tuple[str, ...] = ()) -> list[str]:
    """The names of window features in the order that a model expects them."""
    return [f"{c}.{s}" for c in columns for s in statistics] + [f"{c}.{s}" for c in counters for s in (("rate", "max") if c == "stale_hold_run" else ("max", "mean"))]
