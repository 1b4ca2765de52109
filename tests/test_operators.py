"""Operators on small vectors, folds against closed forms, and errors."""

import json
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeline.operators import calibrate, contracts, detect, features, graph, labels, metrics, series_udf
from gaugeline.operators import sequence as sq
from gaugeline.sources import storage
from gaugeline.sources.adapters import telemetry
from gaugeline.streaming import replay


def series(spark, **columns):
    n = len(next(iter(columns.values())))
    rows = [(1, k, *[c[k] for c in columns.values()]) for k in range(n)]
    return spark.createDataFrame(rows, ["machine", "step", *columns])


def column(df, name):
    return [r[name] for r in df.orderBy("machine", "step").collect()]


def test_counters(spark):
    df = series(spark, state=["RUN", "RUN", "STARVED", "DOWN", "DOWN", "RUN"], tput=[1, 0, 0, 0, 0, 1], obs=[1.0, 2.0, 2.0, 0.5, 0.5, 1.5])
    assert column(sq.run_length(df, F.col("state")), "dwell") == [1, 2, 1, 1, 2, 1]
    assert column(sq.since(df, F.col("tput") > 0), "tputlag") == [0, 1, 2, 3, 4, 0]
    assert column(sq.run_while(df, F.col("state") == "DOWN"), "downrun") == [0, 0, 0, 1, 2, 0]
    assert column(sq.repeats(df, "obs"), "stale") == [0, 0, 1, 0, 1, 0]
    assert column(sq.anchored_repeats(df, "obs", 1e-9), "stale") == [0, 0, 1, 0, 1, 0]


def test_anchor_moves_only_on_a_change(spark):
    df = series(spark, obs=[0.0, 0.6, 1.2, 1.3, 0.1])
    assert column(sq.anchored_repeats(df, "obs", 1.0), "stale") == [0, 1, 0, 1, 0]


def test_cusum_closed_form_equals_the_fold(spark):
    rnd = random.Random(1)
    failed = [rnd.random() < 0.2 for _ in range(200)]
    got = sq.bernoulli_cusum(series(spark, f=failed), F.col("f"), 0.05, 0.30, 2.5)
    s, want = 0.0, []
    for f in failed:
        s = max(0.0, s + (math.log(6) if f else math.log(0.7 / 0.95)))
        want.append(s)
    assert column(got, "cusum") == pytest.approx(want, abs=1e-9)
    assert column(got, "alarm") == [x >= 2.5 for x in want]
    passes = sq.bernoulli_cusum(series(spark, f=[False] * 50), F.col("f"), 0.05, 0.30, 2.5)
    assert set(column(passes, "cusum")) == {0.0}


def test_confirmed_counts_itself(spark):
    alarm = lambda on: series(spark, a=[k in on for k in range(8)], b=[False] * 8)
    kept = lambda on: [k for k, x in enumerate(column(sq.confirmed(alarm(on), F.col("a"), F.col("b"), 3, 5), "confirmed")) if x]
    assert kept({2}) == [] and kept({1, 2, 3}) == [3] and kept({2, 3, 4}) == [4]


def test_suppression_equals_a_ledger(spark):
    rnd = random.Random(2)
    alarm = [rnd.random() < 0.5 for _ in range(120)]
    left, want = 0, []
    for a in alarm:
        emit = a and left == 0
        left = 3 if emit else left - a
        want.append(emit)
    assert column(sq.suppressed(series(spark, a=alarm), F.col("a"), 3), "emitted") == want


def test_veto(spark):
    def blame(peaks):
        df = spark.createDataFrame([(0, m, p) for m, p in peaks.items()], "g int, machine string, peak double")
        return detect.blamed(df, ("g",), "machine", F.col("machine") == "ASM2").first().machine

    assert blame({"ASM2": 1.5, "A2": 1.0, "B2": 0.2}) == "A2"
    assert blame({"ASM2": 3.0, "A2": 1.0, "B2": 0.2}) == "ASM2"
    assert blame({"ASM2": 1.5}) == "ASM2"


def test_suppressed_alarms_keep_their_score(spark):
    df = spark.createDataFrame([("A", 0, 5.0, True), ("A", 1, 5.0, False)], "machine string, step int, obs double, s boolean")
    fit = spark.createDataFrame([("A", 3.0, -3.0)], "machine string, thr double, thr_low double")
    got = detect.exceedance(df, fit, F.col("s")).orderBy("step").collect()
    assert [(r.score, r.alarm) for r in got] == [(2.0, False), (2.0, True)]


def test_stability_vote(spark):
    vote = lambda *x: spark.range(1).select(calibrate.stability_vote(*map(F.lit, x))).first()[0]
    assert vote(1.0, 1.1, 5.0) == pytest.approx(1.05)
    assert vote(1.0, 2.0, 5.0) == 5.0


def test_early_credit(spark):
    c = lambda x: spark.range(1).select(metrics.early_credit(F.lit(x), F.lit(20))).first()[0]
    assert c(0) == 1.0 and c(-3) == 0.0 and c(2) > c(15) > 0 and c(21) == 0.0


def test_threshold_pickers(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 20) / 20, int(rnd.random() < 0.4)) for _ in range(80)]
    df = spark.createDataFrame(rows, "score double, y int")
    f1 = lambda t: 2 * sum(y for s, y in rows if s >= t) / (sum(s >= t for s, _ in rows) + sum(y for _, y in rows))
    best = max(sorted({s for s, _ in rows}), key=f1)
    got = calibrate.best_f1(df).first()
    assert (got.thr, got.f1) == (best, pytest.approx(f1(best)))
    recall = lambda t: sum(y for s, y in rows if s >= t) / sum(y for _, y in rows)
    assert calibrate.recall_floor(df, 0.7).first().thr == max(s for s, _ in rows if recall(s) >= 0.7)
    assert calibrate.recall_floor(df.withColumn("y", F.lit(0)), 0.7).first().thr == 1.0
    pairs = [(a > b) + 0.5 * (a == b) for a, x in rows if x for b, y in rows if not y]
    assert metrics.auc(df).first().auc == pytest.approx(sum(pairs) / len(pairs))


def test_range_pr_auc(spark):
    df = spark.createDataFrame([(0, s, y) for s, y in zip([0.1, 0.2, 0.9, 0.95, 0.1, 0.2], [0, 0, 1, 1, 0, 0], strict=True)], "g int, score double, y long")
    assert metrics.range_pr_auc(df, "score", "y", ("g",)).first().pr_auc == pytest.approx(1, abs=0.02)
    assert metrics.range_pr_auc(df.withColumn("y", F.lit(0).cast("long")), "score", "y", ("g",)).count() == 0


def test_reconstruct_any_width(spark):
    rnd = random.Random(4)
    x = [rnd.randint(-500, 500) for _ in range(105)]
    df = series(spark, cents=x)
    ranges = spark.createDataFrame([(1, s, w) for w in range(1, 106) for s in (0, (105 - w) // 2, 105 - w)], "machine long, s long, w long").distinct()
    for r in features.reconstruct(ranges, features.cover_bank(df, (1, 2, 4, 8, 16, 32, 64))).collect():
        part = x[r.s : r.s + r.w]
        assert r["mean"] == pytest.approx(sum(part) / r.w / 100) and (r.lo, r.hi) == (min(part), max(part))
        assert r.rms == pytest.approx(math.sqrt(sum(v * v for v in part) / r.w) / 100)


def test_channels_may_be_swapped(spark):
    rnd = random.Random(5)
    rows = [(c, k, rnd.randint(0, 99)) for c in "abc" for k in range(40)]
    s = sq.Series(keys=("channel",))

    def of(names):
        df = spark.createDataFrame([(names[c], k, v) for c, k, v in rows], "channel string, step int, cents long")
        f = features.invariant(features.window_features(df, 16, 8, s=s), ("start",), ("hi", "slope"))
        return sorted(map(tuple, f.collect()))

    assert of({"a": "a", "b": "b", "c": "c"}) == of({"a": "c", "b": "a", "c": "b"})


def test_overlap_by_bins(spark):
    rnd = random.Random(6)
    span = lambda: (a := rnd.randint(-40, 60), a + rnd.randint(1, 50))
    w, t = [(1, *span()) for _ in range(40)], [(1, *span(), k) for k in range(40)]
    got = labels.overlap(spark.createDataFrame(w, "g int, w0 long, w1 long").distinct(), spark.createDataFrame(t, "g int, t0 long, t1 long, k int"), ("g",), 16)
    want = sorted((a, b, k, min(b, d) - max(a, c)) for _, a, b in set(w) for _, c, d, k in t if a < d and c < b)
    assert sorted((r.w0, r.w1, r.k, r.shared) for r in got.collect()) == want


def test_hops(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("a", "d")], "src string, dst string")
    got = {(r.src, r.dst): r.hop for r in graph.hops(e, 3).collect()}
    assert got["a", "a"] == 0 and got["a", "c"] == 2 and got["a", "e"] == 2 and got["e", "c"] == 2
    assert ("e", "a") not in {(r.src, r.dst): r.hop for r in graph.hops(e, 3, directed=True).collect()}


def test_contracts(spark, tmp_path):
    df = spark.createDataFrame([(1, 6, "a"), (2, 6, None)], "id long, schema_version int, s string")
    assert {r.rule: r.n for r in contracts.violations(df, {"s": F.col("s") == "a", "id": F.col("id") > 0}).collect()} == {"s": 1, "id": 0}
    contracts.assert_schema(df, {"id": "bigint"}, 6)
    for columns, version in (({"id": "string"}, 6), ({"nope": "int"}, None), ({}, 5)):
        with pytest.raises(contracts.ContractError):
            contracts.assert_schema(df, columns, version)
    one, two = (contracts.content_digest(d).first() for d in (df.repartition(3), df.orderBy(F.desc("id")).coalesce(1)))
    assert one == two and one != contracts.content_digest(df.unionByName(df.limit(1))).first()
    import hashlib

    got = spark.createDataFrame([("x",), ("é",)], "s string").select("s", contracts.bucket_of(F.col("s")).alias("b")).collect()
    assert all(r.b == int(hashlib.sha256(r.s.encode()).hexdigest(), 16) % 100 for r in got)


def test_storage(spark, tmp_path):
    import hashlib

    (tmp_path / "m.json").write_text(json.dumps({"manifest": {"rows": [{"id": "F-1"}, {"id": "F-2"}], "fault_episodes": [7, 9]}}))
    assert {(r.id, r.episode_id) for r in storage.read_manifest(spark, str(tmp_path / "m.json")).collect()} == {("F-1", 7), ("F-2", 9)}
    (tmp_path / "bad.json").write_text(json.dumps({"rows": [{"id": "F-1"}], "fault_episodes": [7, 9]}))
    with pytest.raises(contracts.ContractError):
        storage.read_manifest(spark, str(tmp_path / "bad.json"))
    (tmp_path / "runs.jsonl").write_text('# c\n\n{"run_id":"a","job_name":"j","wall_seconds":1.5,"status":"ok"}\n')
    assert storage.read_run_log(spark, str(tmp_path / "runs.jsonl")).first().wall_seconds == 1.5
    (tmp_path / "runs2.jsonl").write_text('{"run_id":"a"}\n')
    with pytest.raises(contracts.ContractError):
        storage.read_run_log(spark, str(tmp_path / "runs2.jsonl"))
    (tmp_path / "a.csv").write_text("metric,value\nf1,0.5\n")
    (tmp_path / "b.csv").write_text("f1,p99\n0.5,x\n")
    assert [tuple(r) for r in storage.read_gate_csv(spark, str(tmp_path / "a.csv")).collect()] == [("f1", 0.5)]
    assert sorted(map(tuple, storage.read_gate_csv(spark, str(tmp_path / "b.csv")).collect()), key=str) == [("f1", 0.5), ("p99", None)]
    df = spark.range(10).withColumn("a", F.col("id") % 3)
    out = storage.write_sorted(df, str(tmp_path / "t"), ["id"])
    files = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in (tmp_path / "t").glob("*.parquet")}
    assert storage.read_checksummed(spark, out, files).columns == ["a", "id"]
    with pytest.raises(contracts.ContractError):
        storage.read_checksummed(spark, out, {k: "0" for k in files})
    assert storage.write_partitioned(df, str(tmp_path / "p"), "a").count() == 3
    assert spark.read.parquet(str(tmp_path / "p")).filter("a = 1").count() == 3


def test_streamed_state_equals_the_batch_form(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts", "event_id")
    rows = e.withColumn("k", F.ntile(5).over(Window.orderBy("ts", "event_id")))
    for k in range(1, 6):
        part = rows.filter(F.col("k") == k).drop("k").coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "s"))
    got = replay.drained(replay.cusum_states(replay.events_stream(spark, str(tmp_path / "s"), glob="*.parquet")), "update")
    assert got.count() > got.select("user_id").distinct().count()  # several batches
    want = sq.bernoulli_cusum(telemetry(spark, sf), F.col("state") == "DOWN", 1 / 402, 0.25, 3.0)
    want = {r.machine: r.c for r in want.groupBy("machine").agg(F.max_by("cusum", "step").alias("c")).collect()}
    last = {r.user_id: r.c for r in got.groupBy("user_id").agg(F.max_by("cusum", "n").alias("c")).collect()}
    assert last == pytest.approx(want)
    twice = replay.events_stream(spark, str(tmp_path / "s"), glob="*.parquet")
    assert replay.drained(replay.ingested(twice)).count() == e.count()


def test_plant_conserves_parts(spark):
    p = series_udf.plant(spark, 3)
    g = p.groupBy("episode_id", "machine").agg(F.sum("tput").alias("made"), F.max_by("level", "step").alias("level"), F.min("level").alias("lo"), F.max("level").alias("hi"))
    made = {(r.episode_id, r.machine): r for r in g.collect()}
    for e in range(3):
        for m in range(5):
            a, b = made[e, f"M{m}"], made[e, f"M{m + 1}"]
            assert a.made - b.made == a.level and a.lo >= 0 and a.hi <= 10
    assert p.filter("tput = 1 and state <> 'RUN'").count() == 0


def test_echo_cascade_by_hand_and_by_brute_force(spark):
    rng = random.Random(4)
    rows = [(ln, m, t, rng.randint(0, 9), rng.random() < 0.3) for ln in range(3) for m in range(4) for t in range(40) if rng.random() < 0.9]
    score, alarm = {r[:3]: r[3] for r in rows}, {r[:3]: r[4] for r in rows}
    stays = dict(alarm)
    for t in range(40):
        for ln, m in ((a, b) for a in range(3) for b in range(4)):
            for u in range(m) if stays.get((ln, m, t)) else ():
                near = range(t - 2 - (m - u), t + 1)
                if any(stays.get((ln, u, k)) for k in near) and max(score.get((ln, u, k), -1) for k in near) >= score[ln, m, t]:
                    stays[ln, m, t] = False
    schema = "line long, place long, step long, score long, alarm boolean"
    got = graph.echo_cascade(spark.createDataFrame(rows, schema), 4, 2)
    assert sorted(map(tuple, got.collect())) == sorted((*k, score[k]) for k, v in stays.items() if v)
    assert 0 < sum(stays.values()) < sum(alarm.values())
    odd = [(1, 0, 0, None, True), (1, 1, 0, 3, True), (1, 1, 1, None, True), (1, 1, 0, 3, True)]
    assert sorted(map(str, graph.echo_cascade(spark.createDataFrame(odd, schema), 2, 2).collect())) == sorted(["Row(line=1, place=0, step=0, score=None)", "Row(line=1, place=1, step=0, score=3)", "Row(line=1, place=1, step=1, score=None)"])
    assert graph.echo_cascade(spark.createDataFrame([], schema), 2, 2).count() == 0


def test_partial_correlation_against_residuals(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    z = rng.integers(0, 50, 300)
    x, y = z + rng.integers(0, 20, 300), 2 * z + rng.integers(0, 20, 300)
    df = spark.createDataFrame([("a", int(p), int(q), int(s)) for p, q, s in zip(x, y, z)] + [("b", 1, 2, 3)] * 4 + [("a", None, 1, 1)], "g string, x long, y long, z long")
    got = {r.g: r for r in graph.partial_correlation(df, ("g",)).collect()}
    rest = lambda v: v - np.polyval(np.polyfit(z, v, 1), z)
    assert got["a"].n == 300 and got["a"].r == pytest.approx(np.corrcoef(rest(x), rest(y))[0, 1], abs=1e-9)
    assert got["b"].n == 4 and got["b"].r is None
