"""Causal links against regressions on the rows themselves."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.operators import causal


def student(r, free):
    """The two-sided tail of Student's distribution by numeric integration."""
    t = abs(r) * np.sqrt(free / (1 - r * r))
    u = np.linspace(0, np.arctan(t), 200_001)  # x = tan u, so that the tail is bounded
    f = lambda x: (1 + np.tan(x) ** 2 / free) ** (-(free + 1) / 2) * (1 + np.tan(x) ** 2)
    whole = np.linspace(0, np.pi / 2 - 1e-9, 400_001)
    return 1 - np.trapezoid(f(u), u) / np.trapezoid(f(whole), whole)


def regressed(x, a, b, given):
    """(r, p) of two columns with ``given`` regressed out of both."""
    z = np.column_stack([np.ones(len(x)), *[x[:, g] for g in given]])
    e = [c - z @ np.linalg.lstsq(z, c, rcond=None)[0] for c in (x[:, a], x[:, b])]
    r = float((e[0] @ e[1]) / np.sqrt((e[0] @ e[0]) * (e[1] @ e[1])))
    return r, student(r, len(x) - 2 - len(given))


def plain(x, longest, chosen):
    """All links of a matrix (steps x variables), by regressions."""
    n, v = x.shape
    w = np.column_stack([x[2 * longest - lag : n - lag] for lag in range(2 * longest + 1)])
    col = lambda i, lag: lag * v + i
    held = []
    for j in range(v):
        left, weakest, size = [(i, lag) for lag in range(1, longest + 1) for i in range(v)], {}, 0
        while len(left) > size:
            drop = []
            for link in left:
                r, p = regressed(w, col(*link), j, [col(*o) for o in left if o != link][:size])
                weakest[link] = min(weakest.get(link, 1), abs(r))
                drop += [link] if p > chosen else []
            left = sorted(set(left) - set(drop), key=lambda o: (-weakest[o], o))
            size += 1
        held.append(left)
    out = {}
    for j in range(v):
        for lag in range(1, longest + 1):
            for i in range(v):
                given = {col(*o) for o in held[j] if o != (i, lag)} | {col(o, k + lag) for o, k in held[i]}
                out[i, j, lag] = regressed(w, col(i, lag), j, sorted(given))
    return out


def system(n, seed):
    rng = np.random.default_rng(seed)
    x = np.zeros((n, 4))
    for t in range(n):
        e = rng.normal(0, 1, 4)
        x[t] = e + 1000
        if t > 1:
            x[t, 1] += 0.7 * (x[t - 1, 0] - 1000)
            x[t, 2] += 0.6 * (x[t - 2, 1] - 1000) + 0.3 * (x[t - 1, 2] - 1000)
    return x


def rows_of(spark, x, **more):
    return spark.createDataFrame([(f"v{i}", t, float(x[t, i]), *more.values()) for t in range(len(x)) for i in range(x.shape[1])], ", ".join(["v string", "t long", "x double", *[f"{c} long" for c in more]]))


NAMES = ["v0", "v1", "v2", "v3"]


@pytest.mark.parametrize(("a", "b", "x"), [(0.5, 0.5, 0.3), (3, 7, 0.01), (40, 9, 0.9), (2, 2, 1.0), (2, 2, 0.0)])
def test_beta(a, b, x):
    u = np.linspace(0, 1, 2_000_001)[1:-1]
    f = u ** (a - 1) * (1 - u) ** (b - 1)
    assert causal.beta_share(a, b, x) == pytest.approx(f[u <= x].sum() / f.sum(), abs=2e-3)


@pytest.mark.parametrize(("free", "r"), [(1, 0.5), (7, -0.3), (1000, 0.03), (20_000, 0.001), (50, 0.99)])
def test_tails(free, r):
    assert causal.beta_share(free / 2, 0.5, 1 - r * r) == pytest.approx(student(r, free), abs=1e-7)


@pytest.mark.parametrize("longest", [1, 2])
def test_links_like_regressions(spark, longest):
    x = system(300, 1)
    got = causal.lagged_links(rows_of(spark, x).repartition(7), "v", "t", F.col("x"), NAMES, longest).collect()
    want = plain(x, longest, 0.05)
    assert len(got) == len(want) == 16 * longest
    for r in got:
        w = want[NAMES.index(r.cause), NAMES.index(r.effect), r.lag]
        assert (r.r, r.p) == (pytest.approx(w[0], abs=1e-7), pytest.approx(w[1], abs=1e-6)) and r.n == 300 - 2 * longest


def test_true_links_are_found(spark):
    got = causal.lagged_links(rows_of(spark, system(1200, 2)), "v", "t", F.col("x"), NAMES).filter("p <= 0.001").collect()
    assert {(r.cause, r.effect, r.lag) for r in got} == {("v0", "v1", 1), ("v1", "v2", 2), ("v2", "v2", 1)}


def test_groups_gaps_and_constants(spark):
    a, b = rows_of(spark, system(300, 3), g=0), rows_of(spark, system(200, 4), g=1)
    both = a.unionByName(b).filter("not (g = 0 and t = 100 and v = 'v3')").unionByName(rows_of(spark, np.ones((50, 4)), g=2))
    links = causal.lagged_links(both, "v", "t", F.col("x"), NAMES, by=("g",))
    got = {(r.g, r.cause, r.effect, r.lag): r for r in links.collect()}
    alone = {(r.cause, r.effect, r.lag): r for r in causal.lagged_links(b, "v", "t", F.col("x"), NAMES).collect()}
    assert all(got[1, *k].p == pytest.approx(r.p) and got[1, *k].r == pytest.approx(r.r) for k, r in alone.items())
    assert {r.n for k, r in got.items() if k[0] == 0} == {300 - 4 - 5}  # the gap takes itself and the four steps after it
    assert all(r.r == 0 and r.p == 1 for k, r in got.items() if k[0] == 2)
    stable = {(r.cause, r.effect): (r.groups, r.stable) for r in causal.stable_edges(links, "g", 2).collect()}
    assert stable["v0", "v1"] == stable["v1", "v2"] == (2, True)
    assert causal.lagged_links(both.limit(0), "v", "t", F.col("x"), NAMES).count() == 0
