"""Out-of-fold scores: what was fitted where, and that a leak would show."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.operators import learning, ranked


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    out = []
    for m in range(18):
        line, shift = m % 3, 30 * (m % 3) + (500 if m >= 15 else 0)
        for t in range(30):
            y = int(m % 2 == 0 and t % 6 == 0)
            out.append((m, t, line, float(rng.normal(shift + 4 * y, 1)), float(rng.normal(0, 1 + line)), y))
    return spark.createDataFrame(out, "machine long, t int, line int, a double, b double, y int")


def test_norm_of_training_rows(spark, rows):
    train = rows.filter("machine < 9 and line < 2")
    norm = learning.fold_norm(train, ["a", "b"], "line")
    got = {(r.machine, r.t): (r.a, r.b) for r in learning.fold_normed(rows, norm, ["a", "b"], "line").collect()}
    held = train.collect()
    for r in rows.collect():
        own = [x for x in held if x.line == r.line] or held  # a line that isn't in the training rows
        for f, v in zip("ab", got[r.machine, r.t]):
            q = np.quantile([x[f] for x in own], [0.25, 0.5, 0.75])
            assert v == pytest.approx((r[f] - q[1]) / (q[2] - q[0]))
    flat = train.withColumn("a", F.lit(7.0))
    assert {round(r.a, 9) for r in learning.fold_normed(flat, learning.fold_norm(flat, ["a"], "line"), ["a"], "line").collect()} == {0.0}


def test_a_leak_would_change_the_scores(spark, rows):
    seen = []

    def spy(train, test, features, y, name):
        seen.append(({r.machine for r in train.select("machine").distinct().collect()}, {r.machine for r in test.select("machine").distinct().collect()}))
        return test.withColumn(name, F.col("a"))

    got = learning.out_of_fold_experts(rows, ["a", "b"], {"own": spy}, "y", "machine", "line")
    assert all(not train & test and len(train | test) == 18 for train, test in seen) and len(seen) == 3
    leaked = learning.fold_normed(rows, learning.fold_norm(rows, ["a", "b"], "line"), ["a", "b"], "line")
    pairs = got.select("machine", "t", "own", F.col("a").alias("raw")).join(leaked.select("machine", "t", "a"), ["machine", "t"]).collect()
    assert len(pairs) == 540 and np.mean([abs(r.own - r.a) > 1e-6 for r in pairs]) > 0.9
    assert {(r.machine, r.t, r.raw) for r in pairs} == {(r.machine, r.t, r.a) for r in rows.collect()}


def test_experts_tell_faults(spark, rows):
    experts = {"lr": learning.logistic_expert(), "plain": learning.logistic_expert(False), "knn": learning.distance_expert("knn"), "lof": learning.distance_expert("lof"), "pca": learning.component_expert(0.5)}
    got = learning.out_of_fold_experts(rows.filter("machine < 15"), ["a", "b"], experts, "y", "machine", "line").toPandas()
    assert len(got) == 450

    def auc(s):
        p, n = s[got.y == 1].to_numpy()[:, None], s[got.y == 0].to_numpy()[None]
        return (p > n).mean() + (p == n).mean() / 2

    assert auc(got.lr) > 0.9 and auc(got.plain) > 0.9 and auc(got.knn) > 0.8 and not np.allclose(got.lr, got.plain)
    assert got[["lof", "pca"]].notna().all().all()


def test_norms_of_all_folds_at_once(spark, rows):
    """They are those of each fold's rows alone; a fold without a row of its own loses none of the rows it is to norm."""
    folds = rows.withColumn("k", F.explode(F.array(*map(F.lit, (0, 1, 2))))).filter("machine % 3 <> k or line = 0")
    plain = lambda norm: sorted(map(str, norm.collect()))
    whole = learning.fold_norm(folds, ["a", "b"], "line", ("k",))
    for k in (0, 1, 2):
        own = folds.filter(F.col("k") == k).drop("k")
        assert plain(whole.filter(F.col("k") == k).drop("k")) == plain(learning.fold_norm(own, ["a", "b"], "line"))
    none = learning.fold_normed(rows, whole.filter("k = 7").drop("k"), ["a", "b"], "line")
    assert none.count() == 540 and none.filter("a is not null").isEmpty()


def test_stretches_by_binary_search(spark):
    for cuts in ([], [3.0], [1.0, 1.0, 2.0, 5.0, 5.0], [float(i // 2) for i in range(63)]):
        df = spark.createDataFrame([(cuts, x / 2) for x in range(-2, 70)], "cuts array<double>, x double")
        got = ranked._below(df, "cuts", "x", max(1, len(cuts)), "n").collect()
        assert [r.n for r in got] == [sum(c < r.x for c in cuts) for r in got]
