"""The exact neighbour join and the experts on it against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.operators import learning, neighbours
from gaugeline.plans import model_queries
from gaugeline.sources.storage import written


@pytest.mark.parametrize(("n", "k", "block", "pivots"), [(300, 5, 32, 2048), (300, 21, 1024, 3), (7, 9, 4, 2048), (400, 1, 16, 40)])
def test_nearest_by_brute_force(spark, n, k, block, pivots):
    rng = np.random.default_rng(n + k)
    x = np.round(np.concatenate([rng.normal(0, 1, (n // 2, 3)), rng.normal(8, 0.1, (n - n // 2, 3))]), 1)  # ties, and a dense cell
    known = rng.random(n) < 0.7
    df = written(spark.createDataFrame([(i, list(map(float, v)), int(c)) for i, (v, c) in enumerate(zip(x, known))], "id long, v array<double>, n long"))
    got = {}
    for r in neighbours.nearest(df, k, 3, block, pivots).collect():
        got.setdefault(r.id, []).append((r.d, r.other))
    for i in range(n):
        d = np.zeros(n)
        for f in range(3):
            d += (x[i, f] - x[:, f]) ** 2
        want = sorted((float(np.sqrt(d[j])), j) for j in np.flatnonzero(known))[:k]
        assert [(pytest.approx(a, abs=1e-9), b) for a, b in want] == sorted(got[i])


def plain(rows, k, dense):
    """{place: (knn, lof)} of (vector, clean) by a literal reading."""
    ref = [i for i, (_, c) in enumerate(rows) if c]
    k, dense = min(k, len(ref) - 1), min(dense, len(ref) - 1)
    gap = lambda i, j: float(np.sqrt(sum((a - b) ** 2 for a, b in zip(rows[i][0], rows[j][0]))))
    by = lambda i, of: sorted(of, key=lambda j: (gap(i, j), rows[j][0]))
    own = {i: by(i, [j for j in ref if j != i])[:dense] for i in ref}
    reach = {i: gap(i, own[i][-1]) for i in ref}
    thick = {i: dense / max(1e-12, sum(max(gap(i, j), reach[j]) for j in own[i])) for i in ref}
    out = []
    for i in range(len(rows)):
        near = by(i, ref)
        mine = dense / max(1e-12, sum(max(gap(i, j), reach[j]) for j in near[:dense]))
        out.append((gap(i, near[k - 1]), np.mean([thick[j] for j in near[:dense]]) / mine))
    return out


@pytest.mark.parametrize("copies", [1, 9])
def test_scores_with_copies(spark, copies):
    rng = np.random.default_rng(copies)
    rows = [((float(a), float(b)), int(rng.random() < 0.8)) for a, b in rng.normal(0, 3, (60, 2))]
    rows += [rows[0]] * copies + [((1.5, 2.5), 1)] * (3 * copies)
    df = spark.createDataFrame([(i, *v, c, "x") for i, (v, c) in enumerate(rows)], "i int, a double, b double, c int, v string")
    got = {r.i: (r.knn, r.lof) for r in neighbours.scores(df, ["a", "b"], F.col("c") == 1, 5, 12, 8).collect()}
    for i, (knn, lof) in enumerate(plain(rows, 5, 12)):
        assert got[i] == (pytest.approx(knn, abs=1e-9), pytest.approx(lof, rel=1e-6))


def test_scores_of_few_rows(spark):
    df = spark.createDataFrame([(1, 0.0, 1), (2, 1.0, 1), (3, None, 1), (4, float("nan"), 0), (5, 5.0, 0)], "i int, a double, c int")
    got = {r.i: r.knn for r in neighbours.scores(df, ["a"], F.col("c") == 1).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: None, 4: None, 5: 4.0}
    assert {r.knn for r in neighbours.scores(df.filter("i in (1, 5)"), ["a"], F.col("c") == 1).collect()} == {None}
    assert neighbours.scores(df.limit(0), ["a"], F.col("c") == 1).count() == 0


def test_centred_components(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (200, 2)) @ rng.normal(0, 3, (2, 6)) + rng.normal(0, 0.1, (200, 6)) + 50
    x[-1] += [9, -9, 9, -9, 9, -9]
    df = spark.createDataFrame([(i, [float(a) for a in v], i < 199) for i, v in enumerate(x)] + [(200, None, True)], "i int, e array<double>, c boolean")
    got = {r.i: r.error for r in learning.pca_error(df, F.col("e"), 0.9, F.col("c")).collect()}
    fit = x[:199]
    _, s, vt = np.linalg.svd(fit - fit.mean(0), full_matrices=False)
    k = int(np.searchsorted(np.cumsum(s**2 / (s**2).sum()), 0.9, "right")) + 1
    away = x - fit.mean(0)
    want = ((away - away @ vt[:k].T @ vt[:k]) ** 2).sum(1)
    assert k <= 2 and all(got[i] == pytest.approx(want[i], abs=1e-7) for i in range(200)) and got[200] is None
    assert want[199] > 20 * want[:199].max()


def test_few_cells_are_asked(spark, monkeypatch):
    """The rows of the tables that the search writes: each vector, its answer in its own cell, and one for each other cell that it asks."""
    rng = np.random.default_rng(5)
    df = written(spark.createDataFrame([(i, list(map(float, v)), 1) for i, v in enumerate(rng.normal(0, 1, (4000, 5)))], "id long, v array<double>, n long"))
    rows = []
    monkeypatch.setattr(neighbours, "written", lambda d: (rows.append((w := written(d)).count()), w)[1])
    assert neighbours.nearest(df, 21, 5, 1024).count() == 21 * 4000
    assert sum(rows) < 10 * 4000


def test_one_search_for_both_scores(spark, sf, monkeypatch):
    """knn and lof of a fold come from the same neighbours."""
    folds, found = [], learning.out_of_fold_experts
    monkeypatch.setattr(neighbours, "scores", lambda df, *_: (folds.append(1), df.withColumns({"knn": F.lit(1.0), "lof": F.lit(2.0)}))[1])
    monkeypatch.setattr(learning, "out_of_fold_experts", lambda w, features, experts, *a: found(w, features, {n: e for n, e in experts.items() if n not in ("logistic", "pca")}, *a).withColumns({n: F.lit(0.0) for n in ("logistic", "pca")}))
    assert {(r.knn, r.lof) for r in model_queries.ml_oof_experts(spark, sf).collect()} == {(1.0, 2.0)} and len(folds) == 3
