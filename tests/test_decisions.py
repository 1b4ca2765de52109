"""Ranks by stretches, fusion, gates, trained heads and artifacts against brute force and literal rules."""

import io
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.operators import contracts, detect, fusion, gates, learning, metrics, models, neighbours, ranked
from gaugeline.operators import sequence as sq
from gaugeline.sources import storage


def test_running_sums_by_stretches(spark):
    rnd = random.Random(1)
    rows = [(k, x, rnd.randint(0, 9)) for k in ("a", "b", "c") for x in rnd.sample(range(-10_000, 10_000), 700 if k == "a" else 3)]
    df = spark.createDataFrame(rows, "k string, x long, n long")
    for down in (False, True):
        got = ranked.with_running_sums(df, "x", {"s": "n"}, ("k",), descending=down, parts=8).collect()
        for k, x, _ in rows[::97]:
            want = sum(m for a, b, m in rows if a == k and (b >= x if down else b <= x))
            r = next(r for r in got if (r.k, r.x) == (k, x))
            assert (r.s, r.s_all) == (want, sum(m for a, _, m in rows if a == k))
    assert sorted(r.i for r in ranked.numbered(df.select("x").distinct(), "x", "i").collect()) == list(range(len({x for _, x, _ in rows})))
    assert ranked.with_running_sums(df.filter("false"), "x", {"s": "n"}, ("k",)).count() == 0


def test_quantiles_by_ranks(spark):
    rnd = random.Random(2)
    rows = [(k, rnd.choice([0.25, 1.5, 7.0, rnd.random()])) for k in "ab" for _ in range(200)] + [("one", 3.0)]
    df = spark.createDataFrame(rows, "k string, v double").groupBy("k", "v").agg(F.count("*").alias("n"))
    shares = [0.0, 0.1, 1 / 3, 0.5, 0.77, 1.0]
    got = {(r.k, shares[r.nth]): r.q for r in ranked.quantiles(df, "v", "n", shares, ("k",)).collect()}
    for k in ("a", "b", "one"):
        for p in shares:
            assert got[k, p] == pytest.approx(np.quantile([v for a, v in rows if a == k], p))


def test_folds_over_long_series(spark):
    rnd = random.Random(3)
    x = [rnd.random() * 100 for _ in range(5000)]
    df = spark.createDataFrame([(m, k, v + m) for m in (1, 2) for k, v in enumerate(x)], "machine long, step long, obs double")
    for weight in (0.15, 0.9):
        got = {(r.machine, r.step): r.ewma for r in sq.ewma(df, "obs", weight, F.lit(5.0)).collect()}
        e = 5.0
        for k, v in enumerate(x):
            e = (1 - weight) * e + weight * (v + 2)
            assert got[2, k] == pytest.approx(e, rel=1e-9)
    got = {(r.machine, r.step): r.stale for r in sq.anchored_repeats(df, "obs", 60.0).collect()}
    anchor, n = None, 0
    for k, v in enumerate(x):
        anchor, n = (anchor, n + 1) if anchor is not None and abs(v + 1 - anchor) <= 60 else (v + 1, 0)
        assert got[1, k] == n


def test_bridged_walk(spark):
    df = spark.createDataFrame([(m, k, (k * 7 + m) % 5 - 2) for m in (1, 2) for k in range(20)] + [(3, 0, 4)], "machine long, step long, e long")
    got = sq.bridged_walk(df, "e").collect()
    assert all(abs(r.drift) < 1e-9 for r in got if r.step == 19) and [r.drift for r in got if r.machine == 3] == [4.0]


def test_bootstrap_covers_the_rate(spark):
    rnd = random.Random(4)
    df = spark.createDataFrame([(k % 60, rnd.random() < 0.3) for k in range(6000)], "c long, hit boolean")
    lo, hi = learning.bootstrap_interval(df, "c", F.col("hit"), 300).first()
    assert lo < 0.3 < hi and hi - lo < 0.06


def slow_soft(rows, taus, protected):
    """Soft fusion of rows (ep, fam, y, s1, s2) with given thresholds, in numpy."""
    ep, fam, y = (np.array([r[k] for r in rows]) for k in range(3))
    s = [np.array([r[k] for r in rows], float) for k in (3, 4)]
    normed = []
    for x in s:
        out = np.zeros(len(x))
        for e in set(ep.tolist()):
            m = ep == e
            q1, q2, q3 = np.quantile(x[m], [0.25, 0.5, 0.75])
            out[m] = (x[m] - q2) / max(q3 - q1, 1e-9)
        normed.append(out)
    clean = y == 0
    fused = np.zeros(len(rows))
    for x, tau in zip(normed, taus(normed, clean), strict=True):
        d = x > tau
        q1, q2, q3 = np.quantile(x[clean], [0.25, 0.5, 0.75])
        z = (x - q2) / ((q3 - q1 or 1.0) + 1e-9)
        j = lambda m: (((d & (y == 1))[m]).sum() + 1) / ((y == 1)[m].sum() + 2) - (((d & (y == 0))[m]).sum() + 1) / ((y == 0)[m].sum() + 2)  # noqa: E731, B023
        for f in set(fam.tolist()):
            m = fam == f
            lam = m.sum() / (m.sum() + 20)
            fused[m] += max(0.0, lam * j(m) + (1 - lam) * j(np.ones(len(y), bool))) * z[m]
    final = np.zeros(len(rows), bool)
    for f in set(fam.tolist()):
        m = fam == f
        order = sorted(set(fused[m].tolist()), reverse=True)
        p = (y[m] == 1).sum()
        thr = order[0] if p == 0 else next((t for t in order if ((fused[m] >= t) & (y[m] == 1)).sum() >= 0.7 * p), order[-1])
        dec = fused[m] >= thr
        f1 = 2 * (dec & (y[m] == 1)).sum() / max(1, dec.sum() + p)
        rate = p / m.sum()
        final[m] = True if f in protected else dec & (f1 >= (2 * rate / (1 + rate) if rate else 0) + 0.02)
    return fused, final


def test_soft_fusion_by_brute_force(spark):
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 3), rnd.choice("abcd"), y, rnd.gauss(2 * y, 1), rnd.gauss(y, 1)) for y in (rnd.random() < 0.3 for _ in range(400))]
    rows = [(a, b, int(y), c, d) for a, b, y, c, d in rows] + [(0, "none", 0, 0.1, 0.2)] * 5
    df = spark.createDataFrame([(k, *r, r[2] == 0) for k, r in enumerate(rows)], "id long, ep long, fam string, y long, s1 double, s2 double, clean boolean")
    got = {r.id: r for r in fusion.soft(df, ["s1", "s2"], protected=("d",)).collect()}
    fused, final = slow_soft(rows, lambda x, clean: [np.quantile(v[clean], 0.99) for v in x], ("d",))
    assert all(got[k].fused_score == pytest.approx(fused[k], abs=1e-9) and got[k].fused == final[k] for k in range(len(rows)))
    assert final.any() and not final.all()
    three = fusion.three_arms(df.filter("clean"), "s1").first().tau
    assert df.agg(F.percentile("s1", F.lit(0.9))).first()[0] * 0.3 < three < 8


def test_hybrid_gate(spark):
    s = spark.createDataFrame([(1, k, 5 if k == 3 else 0, 1 if k == 9 else 0, 0) for k in range(20)], "machine long, step long, cycle_lag long, stale_run long, down_run long")
    w = spark.createDataFrame([(1, a, f, d) for a in (0, 8) for f in ("delay", "loss", "breakdown", "spike") for d in (True, False)], "machine long, start long, family string, dec boolean")
    for f in ("delay", "loss", "breakdown", "spike"):
        got = {(r.start, r.dec): r.kept for r in fusion.hybrid_gate(w.filter(F.col("family") == f), s, 8).collect()}
        want = {"delay": [True, False], "loss": [False, True], "breakdown": [False, False], "spike": [True, True]}[f]
        assert got == {(0, True): want[0], (8, True): want[1], (0, False): False, (8, False): False}


def test_gates(spark):
    names = {"F1": "F1", "f1_macro": "F1", "F-1": "F1", "AC@1 intra": "AC@1/intra", "ac1-cross": "AC@1/cross", "accuracy@1": "AC@1/overall", "flip": "flip/overall", "flip (line-A)": "flip/line-A", "p99_ms": "p99", "Wall time": "wall", "ground_truth": "grounding", "": None, "other": None}
    got = spark.createDataFrame([(n,) for n in names], "m string").select("m", gates.classified(F.col("m")).alias("x")).collect()
    assert {r.m: r.x and r.x.gate + (f"/{r.x.part}" if r.x.part else "") for r in got} == names
    run = lambda **m: {(r.gate, r.part): (r.worst, r.ok, r.code) for r in gates.evaluated(spark.createDataFrame([(k, float(v)) for k, vs in m.items() for v in vs], "metric string, value double")).collect()}
    full = run(f1=[0.9, 0.86], ac1=[0.7], flip_A=[0.1, 0.4], flip_B=[0.2], p99=[3.0], wall=[600.0], ground=[0.95])
    assert full == {("F1", None): (0.86, True, 0), ("AC@1", "overall"): (0.7, True, 0), ("flip", "A"): (0.4, False, 12), ("flip", "B"): (0.2, True, 0), ("p99", None): (3.0, True, 0), ("wall", None): (600.0, False, 14), ("grounding", None): (0.95, True, 0)}
    assert set(run(ac1_intra=[0.5], ac1=[0.9])) == {("AC@1", "intra"), ("F1", None), ("flip", None), ("p99", None), ("wall", None), ("grounding", None)}
    empty = gates.evaluated(spark.createDataFrame([], "metric string, value double"))
    assert {(r.gate, r.part, r.code) for r in empty.collect()} == {("F1", None, 10), ("AC@1", "intra", 11), ("AC@1", "cross", 11), ("flip", None, 12), ("p99", None, 13), ("wall", None, 14), ("grounding", None, 15)}
    assert gates.exit_code(empty).first().code == 10
    wires = spark.createDataFrame([("a", 1.0, 1.0, True), ("b", 0.9, 1.0, None), ("c", 0.9, 1.0, False)], "id string, metric double, bar double, higher_is_better boolean")
    assert [r.status for r in gates.adjudicated(wires).orderBy("id").collect()] == ["Survived", "Falsified", "Survived"]
    runs = spark.createDataFrame([("a", "j", "success", 61.2, 10.0), ("b", "j", "failed", -1.0, None), ("c", "j", "success", None, 5000.0), ("d", "j", "success", 61.3, 4097.0)], "run_id string, job_name string, status string, wall_seconds double, peak_rss_mb double")
    assert sorted((r.run_id, r.category) for r in gates.run_log_failures(runs).collect()) == [("b", "rss"), ("b", "status"), ("b", "wall"), ("c", "wall"), ("d", "rss"), ("d", "wall")]


def test_nab_profiles(spark):
    f = spark.createDataFrame([(1, 10, 30), (2, 10, 30)], "key long, t0 long, end long")
    a = spark.createDataFrame([(1, 10), (1, 12), (2, 5), (3, 1)], "key long, step long")
    got = {r.profile: r for r in metrics.nab_scores(f, a, spark.createDataFrame([(3,), (4,), (5,), (6,)], "key long")).collect()}
    assert all((r.hit_rate, r.mean_credit, r.clean_fp_rate) == (0.5, 1.0, 0.25) for r in got.values())
    assert [got[p].score for p in ("standard", "low-fn", "low-fp")] == [0.25, 0.375, 0.0]
    none = metrics.nab_scores(f.filter("false"), a, f.select("key")).collect()
    assert {r.score for r in none} == {0.0}


def test_arguments(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(contracts.normal_name(F.lit(" Line-A\t"), ("line-a",))) == "line-a" and one(contracts.normal_name(F.lit(None).cast("string"), ("a",))) is None
    spec = lambda x: tuple(one(contracts.parsed_spec(F.lit(x).cast("string"))))
    assert spec(' {"a": 1} ') == ("json", '{"a": 1}') and spec("[1]") == ("json", "[1]") and spec(" 12 ") == ("text", "12") and spec("a b") == ("text", "a b") and spec(None) == (None, None)
    for bad in (contracts.normal_name(F.lit("x"), ("a",)), contracts.parsed_spec(F.lit("  "))):
        with pytest.raises(Exception, match="unknown name|can't be empty"):
            one(bad)


def test_health_and_tails(spark):
    df = spark.createDataFrame([(m, k, 0 if m == 1 and k >= 2 else k) for m in (1, 2) for k in range(10)], "machine long, step long, v long")
    assert [r.health for r in detect.sensor_health(df, "v").orderBy("step").collect()] == ["OK"] * 5 + ["SUSPECT"] * 3 + ["DROPOUT"] * 2
    t = spark.createDataFrame([(1, 5, 0), (2, 5, 9), (3, 12, 0)], "m long, kit long, waiting long")
    got = {r.m: r.place for r in detect.tail_order(t.withColumn("g", F.lit(1)), ("g",), F.col("kit"), F.col("waiting"), F.col("m") == 3, "m").collect()}
    assert got == {3: 1, 2: 2, 1: 3}


@pytest.fixture(scope="module")
def blobs(spark):
    rnd = random.Random(6)
    rows = []
    for g in range(24):
        for k in range(20):
            y = int(g % 2 == 0 and k % 3 == 0)
            rows.append((g, k, y, ("odd" if k % 2 else "even") if y else "none", rnd.gauss(4 * y, 1), rnd.gauss(3 * y * (k % 2), 1)))
    return spark.createDataFrame(rows, "machine long, start long, y int, family string, a double, b double")


def test_final_model_round_trip(spark, blobs, tmp_path):
    m = models.finalized(blobs, ["a", "b"], "y", "family", "machine", trees=3)
    models.save_model(m, spark, f"file://{tmp_path}/m")
    got = models.load_model(spark, f"file://{tmp_path}/m", ["a", "b"])
    one, two = ([tuple(r) for r in x.decided(blobs, "family").orderBy("machine", "start").collect()] for x in (m, got))
    assert one == two and models.load_model(spark, f"file://{tmp_path}/m", ["a", "b"]).thresholds == m.thresholds
    held = [r for r in got.decided(blobs, "family").collect() if r.machine % 3 == 2]
    assert np.mean([r.dec == (r.y == 1) for r in held]) > 0.9 and all(0 <= r.score <= 1 for r in held)
    assert (got.scored(blobs).agg(F.sum("a")).first()[0]) == pytest.approx(blobs.agg(F.sum("a")).first()[0])
    for features in (["b", "a"], ["a"]):
        with pytest.raises(contracts.ContractError):
            models.load_model(spark, f"file://{tmp_path}/m", features)
    with pytest.raises(contracts.ContractError):
        models.load_model(spark, f"file://{tmp_path}/none", ["a", "b"])


def test_classes_and_probes(spark, blobs):
    got = models.out_of_fold_classes(blobs, ["a", "b"], "family", "machine", trees=5).collect()
    assert len(got) == 480 and np.mean([r.predicted == r.family for r in got]) > 0.85
    assert len({(r.machine, r.fold) for r in got}) == 24
    assert models.batch_auc(blobs.filter("y = 0"), blobs.filter("y = 1"), ["a", "b"], "start").first().auc > 0.95
    same = models.batch_auc(blobs.filter("y = 0 and machine < 12"), blobs.filter("y = 0 and machine >= 12"), ["a", "b"], "start").first().auc
    assert 0.35 < same < 0.65
    t = {r.family: r.auc for r in models.trainability(blobs.unionByName(blobs.limit(1).withColumn("family", F.lit("rare")).withColumn("y", F.lit(1))), ["a", "b"], "family", "y").collect()}
    assert t["odd"] > 0.95 and t["rare"] is None
    s = models.swept(blobs, ["a", "b"], "y", "machine", {"maxIter": (1, 2), "maxDepth": (2,)}).collect()
    assert [r.place for r in s] == [0, 1] and s[0].f1 >= s[1].f1 > 0.8
    assert models.oversampled(blobs, "y", 3).count() == 480 + 2 * blobs.filter("y = 1").count()
    assert models.feature_names(["x"], ("mean",), ("stale_hold_run", "cycle_lag")) == ["x.mean", "stale_hold_run.rate", "stale_hold_run.max", "cycle_lag.max", "cycle_lag.mean"]
    assert set(models.detector_pool().values()) == {"ready"}


def test_neighbours_by_brute_force(spark, blobs):
    got = {(r.machine, r.start): r for r in neighbours.scores(blobs, ["a", "b"], F.col("y") == 0).collect()}
    rows = blobs.collect()
    ref = np.array([(r.a, r.b) for r in rows if r.y == 0])
    gap = lambda x: np.sqrt(((ref - x) ** 2).sum(1))
    near = [np.sort(gap(p))[1:21] for p in ref]
    order = [np.argsort(gap(p), kind="stable")[1:21] for p in ref]
    density = np.array([20 / sum(max(d, near[j][-1]) for d, j in zip(near[i], order[i], strict=True)) for i in range(len(ref))])
    for r in rows[::41]:
        d = gap((r.a, r.b))
        k = np.argsort(d, kind="stable")
        assert got[r.machine, r.start].knn == pytest.approx(d[k[4]], abs=1e-6)
        own = 20 / max(1e-12, sum(max(d[j], near[j][-1]) for j in k[:20]))
        assert got[r.machine, r.start].lof == pytest.approx(density[k[:20]].mean() / own, rel=1e-4)
    assert neighbours.scores(blobs.filter("false"), ["a", "b"], F.col("y") == 0).count() == 0


def test_artifacts_fail_closed(spark, tmp_path):
    t = spark.createDataFrame([("a", 1.5, -1.0), ("b", 2.5, 0.0)], "machine string, thr double, thr_low double")
    path = f"file://{tmp_path}/t.json"
    models.save_thresholds(t, path, 3)
    assert sorted(map(tuple, models.load_thresholds(spark, path, {"a", "b"}).collect())) == [("a", 1.5, -1.0), ("b", 2.5, 0.0)]
    for args in ((path, {"a"}, 1), (path, {"a", "b"}, 2), (f"file://{tmp_path}/no.json", {"a"}, 1)):
        with pytest.raises(contracts.ContractError):
            models.load_thresholds(spark, *args)


def test_files(spark, tmp_path):
    held = io.BytesIO()
    np.savez(held, s=np.array([1.5, 2.5]), n=np.array([7]))
    (tmp_path / "d.npz").write_bytes(held.getvalue())
    assert sorted(map(tuple, storage.read_npz(spark, str(tmp_path)).collect())) == [("d.npz", "n", 0, 7.0), ("d.npz", "s", 0, 1.5), ("d.npz", "s", 1, 2.5)]
    df = spark.range(10).withColumn("a", F.col("id") % 3)
    storage.write_partitioned(df, f"file://{tmp_path}/p", "a")
    storage.verify_partitioned(spark, f"file://{tmp_path}/p")
    part = next((tmp_path / "p" / "a=1").glob("*.parquet"))
    spark.range(3).coalesce(1).write.parquet(f"file://{tmp_path}/q")
    part.with_name(f".{part.name}.crc").unlink()
    part.write_bytes(next((tmp_path / "q").glob("*.parquet")).read_bytes())
    with pytest.raises(contracts.ContractError):
        storage.verify_partitioned(spark, f"file://{tmp_path}/p")
    storage.append_csv(df, f"file://{tmp_path}/c")
    with pytest.raises(contracts.ContractError):
        storage.append_csv(df.select("a", "id"), f"file://{tmp_path}/c")
    assert storage.read_csv_table(spark, f"file://{tmp_path}/c", "id long, a long").count() == 10
    assert math.isclose(storage.write_capped(df, f"file://{tmp_path}/k", 1 << 30), sum(f.stat().st_size for f in (tmp_path / "k").glob("*.parquet")))
    with pytest.raises(contracts.ContractError):
        storage.write_capped(df, f"file://{tmp_path}/k2", 1)
    assert not (tmp_path / "k2").exists()
