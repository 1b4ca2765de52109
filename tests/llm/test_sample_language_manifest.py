"""Importance resampling, language identification and the Merkle manifest against plain versions, odd rows included."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from oracle import connect, difference
from pyspark.sql import functions as F

from gaugeline.llm import importance, language, merkle, queries
from gaugeline.llm.common import numbered, table, written

ODD = "doc_id long, text string, source string, lang string, n_chars long, score string, rank int, weight int, __leaf string, h string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with the operators' own names."""
    long = " ".join(f"w{k % 700}" for k in range(40_000))
    rows = [(1, None, "a", None, None), (2, "", None, "", 0), (3, " \t\n", "a", "en", 3), (4, long, "b", "en", len(long)), (5, "One two THREE", "a", "en", 13), (5, "One two THREE", "a", "en", 13), (5, "one two", "a", "en", 7), (None, "x y " * 30, "b", "de", 120)]
    rows += [(k, " ".join(f"é{k}x{j}" for j in range(25)), "s", ("de", "fr", "日本")[k % 3], 2**63 - 1 if k == 15 else 9) for k in range(10, 31)] + [(40, "x" * 3_000_000, "b", "en", 3_000_000)]
    return spark.createDataFrame([(*r, "s", 1, 2, "x", "h") for r in rows], ODD)


@pytest.mark.parametrize("name", ["op11_importance", "op13_merkle"])
def test_equals_sql(spark, sf, name):
    assert difference(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLES[name]) == ""


def test_numbered_splits_equal_rows(spark):
    rows = written(spark.range(3000).select((F.col("id") % 3 == 0).cast("int").alias("v"), F.lit("x").alias("x")))
    got = numbered(rows, [F.col("v").desc()], "place").orderBy("place").collect()
    assert [r.place for r in got] == list(range(3000)) and [r.v for r in got] == [1] * 1000 + [0] * 2000


# --- 11

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_buckets(text, longest=1):
    w = WORDS.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    return [zlib.crc32(b" ".join(w[i : i + n])) % 10_000 for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("longest", [1, 3])
def test_buckets_of_any_slices(longest):
    rnd = random.Random(3)
    for _ in range(60):
        text = "".join(rnd.choice("aB3é ,\n漢\x00z") for _ in range(rnd.randint(0, 200)))
        for at_once in (1, 7, 1 << 20):
            words = [w for some in importance.runs_of_words(text.encode(), at_once) for w in some]
            assert words == WORDS.findall(text.encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
        got = np.concatenate([np.empty(0, "i8"), *importance.buckets_of(text.encode(), longest=longest)])
        assert sorted(got) == sorted(plain_buckets(text, longest))


@pytest.mark.parametrize("longest", [1, 2])
def test_resampling_by_brute_force(spark, odd, longest):
    target = spark.createDataFrame([(0, "one two two é11x3"), (1, None)], "item_id long, text string")
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    s, t = np.zeros(10_000), np.zeros(10_000)
    for _, text in docs:
        np.add.at(s, plain_buckets(text, longest), 1)
    for text in ("one two two é11x3",):
        np.add.at(t, plain_buckets(text, longest), 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10_000) / ((a + 1) * (t.sum() + 10_000)))) for a, b in zip(s, t)]
    want = []
    for k, text in docs:
        x = plain_buckets(text, longest)
        weight = math.floor(sum(gain[b] for b in x) / len(x)) if x else 0
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        want.append((k, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(plain_buckets(text)) >= 20))
    can = sorted((w for w in want if w[4]), key=lambda w: (-w[3], w[0] is None, w[0]))
    got = importance.resample(odd, target, longest=longest, percent=40)
    assert got.columns == [c for c in odd.columns if c not in ("score", "rank", "weight")] + ["n_features", "weight", "score", "rank"]
    rows = got.collect()
    as_text = lambda x: sorted(map(repr, x))
    assert as_text((r.doc_id, r.n_features, r.weight, r.score) for r in rows) == as_text(w[:4] for w in want)
    assert [(r.rank, r.doc_id, r.score) for r in sorted((r for r in rows if r["rank"]), key=lambda r: r["rank"])] == [(i + 1, w[0], w[3]) for i, w in enumerate(can[: 40 * len(can) // 100])]


def test_resampling_prefers_the_target(spark, sf):
    docs = table(spark, sf, "documents")
    got = importance.resample(docs, docs.filter("lang = 'fr'"), percent=10).filter("rank is not null")
    share = lambda df: df.filter("lang = 'fr'").count() / df.count()
    assert share(got) > 4 * share(docs)


def test_resampling_of_empty_tables(spark, odd):
    assert importance.resample(odd.limit(0), odd).count() == 0
    got = importance.resample(odd, odd.limit(0))
    assert got.count() == odd.count() and got.filter("rank is not null").count() == 10 * 23 // 100


# --- 12


def test_subwords_by_brute_force():
    rnd = random.Random(5)
    for n in (0, 1, 3, 50, 400):
        text = "".join(rnd.choice("aBé -9\n漢z") for _ in range(n))
        b = (" " + text.lower() + " ").encode().translate(language._PARTED)
        grams = [b[i : i + w] for w in (2, 3, 4) for i in range(len(b) - w + 1)]
        assert language.subword_counts(text).sum() == len([g for g in grams if b" " not in g[1:-1] and g != b"  "])
    text = "".join(rnd.choice("abé \n") for _ in range(5000))
    whole = language.subword_counts(text)
    held, language.AT_ONCE = language.AT_ONCE, 64
    try:
        assert (language.subword_counts(text) == whole).all()
    finally:
        language.AT_ONCE = held


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = language.identify(docs)
    assert got.filter("held_out <> (crc32(string(doc_id)) % 3 = 1)").count() == 0
    held = got.filter("held_out and lang is not null")
    assert held.filter("lang = lang_pred").count() >= 0.99 * held.count()
    assert held.filter("rejected").count() <= 0.05 * held.count()
    # a language that it never saw is rejected far more often than those that it knows
    model = language.train(docs.filter("lang <> 'de'"))
    unseen = language.identify(docs.select("doc_id", "text", "lang"), model).groupBy((F.col("lang") == "de").alias("de")).agg(F.avg(F.col("rejected").cast("int")).alias("share"))
    share = {r.de: r.share for r in unseen.collect()}
    assert share[True] > 5 * share[False]


def test_labels_and_ids_are_no_inputs(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = language.train(docs)
    a = language.identify(docs, model).select("text", "lang_pred", "score").distinct()
    b = language.identify(docs.select((F.col("doc_id") + 7).alias("doc_id"), "text", F.lit("xx").alias("lang")), model).select("text", "lang_pred", "score").distinct()
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    # what is held out has no part in the model
    other = language.train(docs.withColumn("lang", F.when(language.held_out(), F.lit("zz")).otherwise(F.col("lang"))))
    assert other.languages == model.languages and (other.embedding == model.embedding).all() and other.least == model.least


def test_language_of_odd_rows(spark, odd):
    got = language.identify(odd)
    assert got.count() == odd.count() and {"held_out", "lang_pred", "score", "rejected", "__leaf", "h"} <= set(got.columns)
    rows = got.collect()
    learned = {r.lang for r in odd.collect() if r.lang is not None}
    for r in rows:
        none = not any(map(str.isalpha, r.text or ""))
        assert (r.lang_pred == "und") == none and (none or r.lang_pred in learned) and 0 <= r.score <= 1
    assert {r.lang_pred for r in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(odd.limit(0)).count() == 0


def test_model_of_few_and_many_languages():
    texts = {"a": "ka ko ke ", "b": "zu zi za ", "c": "mno mni mna "}
    rows, names = [], []
    for k, (name, t) in enumerate(texts.items()):
        for j in range(30):
            found = language.subword_counts(t * (1 + j % 3))
            at = np.flatnonzero(found)
            rows.append((at, found[at].astype(float)))
            names.append(name)
    model = language.fit(rows, names, [j % 5 == 0 for j in range(len(rows))])
    p = model.shares(np.stack([language.subword_counts(t) for t in texts.values()]).astype(float))
    assert list(p.argmax(1)) == [0, 1, 2] and np.allclose(p.sum(1), 1) and 0 < model.least <= 1
    assert language.fit(rows[:30], names[:30], [False] * 30).languages == ["a"] and language.fit([], [], []).languages == []


# --- 13


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves, arity=2):
    """The root, and the path of each leaf."""
    level, held, paths = list(leaves), [[k] for k in range(len(leaves))], [[] for _ in leaves]
    while len(level) > 1:
        new, new_held = [], []
        for i in range(0, len(level), arity):
            run = level[i : i + arity]
            for j in range(len(run)):
                for k in held[i + j]:
                    paths[k].append(("".join(run[:j]), "".join(run[j + 1 :])))
            new.append(H(*run))
            new_held.append([k for x in held[i : i + arity] for k in x])
        level, held = new, new_held
    return level[0], paths


def plain_manifest(rows, arity=2):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, more=0: H(*map(field, (r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + more, r.text)))
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
    below = {g: plain_tree([leaf(r) for r in groups[g]], arity) for g in names}
    root, above = plain_tree([below[g][0] for g in names], arity)
    out = []
    for g, over in zip(names, above):
        for r, path in zip(groups[g], below[g][1]):
            path = path + over
            told = leaf(r, int(r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0))
            for before, after in path:
                told = H(before, told, after)
            out.append((r.doc_id, leaf(r), below[g][0], root, H(*[b + a for b, a in path]), told, told == root))
    return sorted(map(repr, out))


@pytest.mark.parametrize(("arity", "block"), [(2, 1024), (2, 2), (2, 4), (3, 9), (5, 5)])
def test_manifest_by_brute_force(spark, odd, arity, block):
    changed, where = merkle.tampering()
    got = merkle.manifest(odd, tampered=changed, where=where, arity=arity, block=block, paths=True)
    want = plain_manifest(odd.collect(), arity)
    assert sorted(repr(tuple(r)[:7]) for r in got.collect()) == want
    assert "False" in "".join(want)
    # the proofs hold in Spark as well
    assert got.filter(merkle.root_of(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 9, 65])
def test_manifest_of_any_size(spark, n):
    docs = spark.createDataFrame([(k, f"t{k}", "s", "x" if k % 5 else None, k) for k in range(n)], "doc_id long, text string, source string, lang string, n_chars long")
    changed, where = merkle.tampering()
    got = merkle.manifest(docs, tampered=changed, where=where, block=4)
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_manifest(docs.collect()) if n else got.count() == 0


def test_many_groups(spark):
    docs = spark.createDataFrame([(k, f"t{k}", "s", f"g{k % 37}", k) for k in range(200)], "doc_id long, text string, source string, lang string, n_chars long")
    held, merkle.MAX_BROADCAST_GROUPS = merkle.MAX_BROADCAST_GROUPS, 3
    try:
        changed, where = merkle.tampering()
        assert sorted(repr(tuple(r)) for r in merkle.manifest(docs, tampered=changed, where=where, block=4).collect()) == plain_manifest(docs.collect())
    finally:
        merkle.MAX_BROADCAST_GROUPS = held
