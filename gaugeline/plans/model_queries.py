"""Queries of trained heads on window features. Models have no SQL; tests state their properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.operators import features as fe
from gaugeline.operators import learning, models, neighbours
from gaugeline.plans.base import query
from gaugeline.sources import storage
from gaugeline.sources.adapters import FAULTS, SCORES, TEL, faults, scores, telemetry

FEATURES = ["mean", "std", "lo", "hi", "slope"]


def windows(spark, sf):
    """Window features with y, and family: the class of the fault that a window touches, else none."""
    f = fe.window_features(telemetry(spark, sf), 16, 8)
    y = faults(spark, sf).select("machine", "t0", "t1", "class")
    f = f.join(y, "machine", "left").withColumn("y", F.coalesce(((F.col("start") < F.col("t1")) & (F.col("t0") < F.col("start") + 16)).cast("int"), F.lit(0)))
    return f.withColumn("family", F.when(F.col("y") == 1, F.col("class")).otherwise("none")).drop("t0", "t1", "class")


@query()
def ml_final(spark, sf):
    """The calibrated final model, saved, loaded and applied: scores and decisions of all windows."""
    w = windows(spark, sf)
    path = storage.shared_folder(spark)
    models.save_model(models.finalized(w, FEATURES, "y", "family", "machine", trees=3), spark, path)
    got = models.load_model(spark, path, FEATURES).decided(w, "family")
    return got.select("machine", "start", "y", F.round("score", 6).alias("score"), "dec")


@query()
def ml_classes(spark, sf):
    """Each window's class by a forest that hasn't seen its entity."""
    return models.out_of_fold_classes(windows(spark, sf), FEATURES, "family", "machine", trees=5).select("machine", "start", "family", "fold", "predicted")


_W = "OVER (PARTITION BY machine ORDER BY step ROWS 15 PRECEDING)"
WINDOWS = f"""{TEL}, {FAULTS}, f AS (SELECT machine, step - 15 AS start, CAST(sum(cents) {_W} AS DOUBLE) / 16 / 100 AS mean,
  sqrt(CAST(16 * sum(cents * cents) {_W} - sum(cents) {_W} * sum(cents) {_W} AS DOUBLE)) / 16 / 100 AS std, min(cents) {_W} AS lo, max(cents) {_W} AS hi, cents - first_value(cents) {_W} AS slope FROM tel),
 wins AS (SELECT f.*, CASE WHEN start < t1 AND t0 < start + 16 THEN 1 ELSE 0 END AS y FROM f LEFT JOIN faults ON faults.machine = f.machine WHERE start >= 0 AND start % 8 = 0)"""
_GAP = "sqrt(" + " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in FEATURES) + ")"


@query(f"""WITH {WINDOWS}, pairs AS MATERIALIZED (SELECT a.machine, a.start, b.machine AS m, b.start AS s, {_GAP} AS d, a.y FROM wins a JOIN wins b ON b.y = 0),
 own AS (SELECT *, row_number() OVER (PARTITION BY m0, s0 ORDER BY d, m, s) AS k FROM (SELECT machine AS m0, start AS s0, m, s, d FROM pairs WHERE y = 0 AND (machine <> m OR start <> s))),
 reach AS (SELECT m0, s0, max(d) AS reach FROM own WHERE k <= 20 GROUP BY 1, 2),
 density AS (SELECT o.m0, o.s0, 20 / greatest(sum(greatest(d, reach)), 1e-12) AS density FROM own o JOIN reach r ON r.m0 = o.m AND r.s0 = o.s WHERE k <= 20 GROUP BY 1, 2),
 near AS (SELECT *, row_number() OVER (PARTITION BY machine, start ORDER BY d, m, s) AS k FROM pairs)
SELECT machine, start, round(max(d) FILTER (WHERE k <= 5), 6) AS knn, round(avg(density) / (20 / greatest(sum(greatest(d, reach)), 1e-12)), 6) AS lof
FROM near n JOIN reach r ON r.m0 = n.m AND r.s0 = n.s JOIN density x ON x.m0 = n.m AND x.s0 = n.s WHERE k <= 20 GROUP BY machine, start""")
def ml_neighbours(spark, sf):
    """Distance to the fifth clean neighbour, and local outlier factor of twenty, among all clean windows."""
    got = neighbours.scores(windows(spark, sf), FEATURES, F.col("y") == 0)
    return got.select("machine", "start", F.round("knn", 6).alias("knn"), F.round("lof", 6).alias("lof"))


@query()
def ml_sweep(spark, sf):
    """A sweep of two parameters with two values each."""
    return models.swept(windows(spark, sf), FEATURES, "y", "machine", {"maxIter": (2,), "maxDepth": (2, 3), "stepSize": (0.05, 0.1)}).withColumn("f1", F.round("f1", 6))


@query()
def ml_batch_auc(spark, sf):
    """Whether a linear probe can tell even entities from odd ones."""
    w = windows(spark, sf).withColumn("id", F.concat_ws("-", "machine", "start"))
    return models.batch_auc(w.filter("machine % 2 = 0"), w.filter("machine % 2 = 1"), FEATURES, "id").select(F.round("auc", 6).alias("auc"))


@query()
def ml_trainability(spark, sf):
    """The training AUC of each class of fault."""
    return models.trainability(windows(spark, sf), FEATURES, "family", "y").withColumn("auc", F.round("auc", 6))


@query(f"WITH {SCORES} SELECT fam, CAST(sum(CASE WHEN y = 1 THEN 3 ELSE 1 END) AS BIGINT) AS n, count(*) AS plain FROM scores GROUP BY fam")
def ml_oversample(spark, sf):
    s = scores(spark, sf)
    return models.oversampled(s, "y", 3).groupBy("fam").agg(F.count("*").alias("n")).join(models.oversampled(s, "y").groupBy("fam").agg(F.count("*").alias("plain")), "fam")


@query()
def ml_oof_experts(spark, sf):
    """Out-of-fold scores of all experts, normalised by line within the training folds."""
    w = windows(spark, sf).drop("family").withColumn("line", F.col("machine") % 4)
    experts = {"logistic": learning.logistic_expert(), ("knn", "lof"): learning.distance_experts(), "pca": learning.component_expert()}
    got = learning.out_of_fold_experts(w, FEATURES, experts, "y", "machine", "line")
    return got.select("machine", "start", "fold", "y", *[F.round(c, 4).alias(c) for c in ("logistic", "knn", "lof", "pca")])


@query()
def ml_oof_logistic(spark, sf):
    """Out-of-fold window scores by balanced logistic regression."""
    return learning.out_of_fold(windows(spark, sf).drop("family"), FEATURES, "y", "machine").select("machine", "start", "fold", "y", F.round("oof", 6).alias("oof"))


@query()
def ml_oof_trees(spark, sf):
    """Out-of-fold window scores by gradient-boosted trees."""
    return learning.out_of_fold(windows(spark, sf).drop("family"), FEATURES, "y", "machine", kind="gbt").select("machine", "start", "fold", "y", F.round("oof", 6).alias("oof"))
