"""The stages one after the other, each on its own input."""

import collections

from pyspark.sql import functions as F

import corpus_pipeline as cp
from gaugeline.llm import mixing
from gaugeline.llm.common import table, written


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns, before = docs.columns, docs
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "source_mix", "packing"]
    seen = []
    for _, stage in cp.STAGES[:-1]:
        after = written(stage(spark, before, sf))
        assert after.columns == columns and dict(after.dtypes) == dict(docs.dtypes)
        seen.append((before, after))
        before = after
    (a, b), (_, c), (_, d), (_, e) = seen
    assert b.join(a, columns, "left_anti").count() == 0 and 0 < b.count() <= a.count()
    assert c.count() == b.count() and c.filter(F.length("text") != F.col("n_chars")).count() == 0
    assert d.count() == d.select("doc_id").distinct().count() < c.count()
    want = {r.doc_id: r.copies for r in mixing.mix(d).filter("copies > 0").collect()}
    assert collections.Counter(r.doc_id for r in e.collect()) == want
    got = cp.run(spark, sf).toPandas()
    assert set(got.doc_id) <= set(want) and len(got) >= e.count()
    assert got.groupby("sequence_id").length.sum().max() <= 2048


NAMES = {"score": "string", "size": "string", "copies": "string", "predicted": "string", "removed_lines": "string", "__text": "string", "__id": "string", "__h": "int", "__i": "int", "__own_3": "string", "n_chars": "int"}


def test_stages_on_odd_rows_and_names(spark, sf):
    """Nulls, empty, very long and repeated texts, ties, and columns of the operators' own names through all stages."""
    good = table(spark, sf, "documents").join(table(spark, sf, "labels").filter("quality = 1"), "doc_id").orderBy("doc_id").limit(4).collect()
    long = "\n".join(f"{r.text} {k}" for k in range(40) for r in good)
    texts = [(1, None, "a"), (2, "", None), (3, " \n\t", "a"), (4, long, "b"), *[(10 + k, r.text, "a") for k, r in enumerate(good)], (20, good[0].text, "b"), (21, good[1].text, None), (21, good[1].text, None), (None, good[2].text, "b"), (None, "\n".join(r.text for r in good), "")]
    docs = spark.createDataFrame([(*t, *[k if kind == "int" else f"v{k}" for kind in NAMES.values()]) for k, t in enumerate(texts)], f"doc_id long, text string, source string, {', '.join(f'`{c}` {t}' for c, t in NAMES.items())}")
    before, sizes = docs, []
    for name, stage in cp.STAGES[:-1]:
        after = written(stage(spark, before, sf))
        assert after.dtypes == docs.dtypes
        other = [c for c in NAMES if c != "n_chars"]
        assert {tuple(r) for r in after.select(*other).collect()} <= {tuple(r) for r in docs.select(*other).collect()}, name
        assert name != "line_dedup" or after.count() == before.count() and after.filter("n_chars <> length(text)").count() == 0
        assert stage(spark, docs.filter("false"), sf).count() == 0
        sizes.append(after.count())
        before = after
    assert 0 < sizes[2] < sizes[1] == sizes[0] <= len(texts)
    pieces = cp.packed(spark, before, sf).toPandas()
    assert len(pieces) >= sizes[3] and pieces.groupby("sequence_id").length.sum().max() <= 2048
    assert cp.packed(spark, docs.filter("false"), sf).count() == 0
    assert cp.packed(spark, docs, sf).count() >= len(texts)  # all odd rows
