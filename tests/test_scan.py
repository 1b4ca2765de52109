"""Scans and sparse tables against folds over whole series."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gaugeline.operators import scan


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(31)
    out = []
    for m in range(6):
        n = rnd.choice([1, 5, 60, 700])
        at = sorted(rnd.sample(range(-50, 900), n))
        out += [(m, t, rnd.choice([0.0, 0.5, 1.0, -0.3, None]), rnd.gauss(0, 1), rnd.randint(0, 2), rnd.random() < 0.05) for t in at]
    return out


SCHEMA = "machine long, step long, k double, a double, load int, reset boolean"


@pytest.mark.parametrize("block", [3, 10, 256, 5000])
def test_affine_scan(spark, rows, block):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.machine, r.step): r.x for r in scan.affine_scan(df, F.col("k"), F.col("a"), start=2.0, out="x", block=block).collect()}
    assert len(got) == len(rows)
    x = {}
    for m, t, k, a, *_ in rows:
        x[m] = x.get(m, 2.0) if k is None else k * x.get(m, 2.0) + a
        assert got[m, t] == pytest.approx(x[m], abs=1e-9)
    assert scan.affine_scan(df.limit(0), F.col("k"), F.col("a")).count() == 0


def test_wear_with_resets(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.machine, r.step): r.wear for r in scan.wear(df, F.col("load"), F.col("reset"), 1 / 16, 0.8, 5.0).collect()}
    grown = {(r.machine, r.step): r.bias for r in scan.exponential_wear(df, F.col("load"), F.col("reset"), 1 / 16).collect()}
    w, b, over = {}, {}, 0
    for m, t, _, _, load, reset in rows:
        w[m] = (0.0 if reset else w.get(m, 0.0))
        w[m] += load / 16 * (5 if w[m] > 0.8 else 1)
        over += w[m] > 0.8
        b[m] = 0.0 if reset else b.get(m, 0.0)
        b[m] = min(0.5, b[m] + load / 16 * math.exp(2 * max(0.0, b[m] - 0.1)))
        assert got[m, t] == pytest.approx(w[m]) and grown[m, t] == pytest.approx(b[m])
    assert over > 20


@pytest.mark.parametrize(("longest", "block"), [(1, 7), (9, 4), (100, 64), (300, 1000)])
def test_ranges_of_any_width(spark, rows, longest, block):
    dense = [(m, t, random.Random(1000 * m + t).randint(0, 99)) for m in range(3) for t in range(-20, 400) if (m, t) != (1, 200)] + [(7, 3, 5)]
    df = spark.createDataFrame(dense, "machine long, step long, v int")
    table = scan.sparse_table(df, F.col("v"), longest, block=block)
    rnd = random.Random(longest)
    asked = [(m, t, t + rnd.randint(0, longest + 1)) for m in (0, 1, 2, 7) for t in rnd.sample(range(-30, 410), 60)] + [(7, 3, 4)]
    got = {tuple(r)[:3]: (r.lo, r.hi) for r in scan.range_extremes(table, spark.createDataFrame(asked + asked[:5], 'machine long, first long, end long')).collect()}
    held = {(m, t): v for m, t, v in dense}
    most = (1 << longest.bit_length()) - 1
    want = {}
    for m, a, b in asked:
        x = [held.get((m, t)) for t in range(a, b)]
        if x and None not in x and b - a <= most:
            want[m, a, b] = (min(x), max(x))
    assert got == want and len(want) > 30
