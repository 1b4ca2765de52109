"""Where operators once did less than the whole job."""

import random

from gaugeline.llm import lines, simhash, syncmers


def sentence(rnd, n):
    return " ".join(f"v{rnd.randint(0, 10**9)}" for _ in range(n))


def deduped(spark, docs, **more):
    df = spark.createDataFrame([(k, "\n".join(t)) for k, t in docs], "doc_id long, text string")
    return {r.doc_id: (r.text.split("\n"), r.removed_lines) for r in lines.dedup_lines(df, **more).collect()}


def test_lines_of_uneven_counts_go(spark):
    rnd = random.Random(1)
    blank, passage = [], [sentence(rnd, 40) for _ in range(3)]
    for x in passage:
        blank += [x, ""]
    near = [sentence(rnd, 12) for _ in range(24)]
    docs = [(k, [sentence(rnd, 8), "", sentence(rnd, 9)]) for k in range(30)]
    docs += [(100 + k, [sentence(rnd, 5), *blank[:-1], sentence(rnd, 6)]) for k in range(3)]
    docs += [(200, near)] + [(200 + k, [sentence(rnd, 12) if j in (k, 6 + k) else x for j, x in enumerate(near)]) for k in range(1, 6)]
    got = deduped(spark, docs)
    for k, t in docs:
        if k in (101, 102):
            assert got[k] == ([t[0], t[-1]], 5)
        elif k > 200:
            assert [x for j, x in enumerate(t) if j in (k - 200, k - 194)] == [x for x in got[k][0] if x not in near]
            assert got[k][1] >= 17  # what is left of the first lines alone has 50 words or fewer
        else:
            assert got[k] == (t, 0)


def test_lines_by_brute_force(spark):
    rnd = random.Random(9)
    pool = [sentence(rnd, n) for n in (0, 1, 3, 8, 12, 20, 20, 30, 45, 60)]
    docs = [(k, [rnd.choice(pool) if rnd.random() < 0.9 else sentence(rnd, 5) for _ in range(rnd.randint(1, 25))]) for k in range(60)]
    got = deduped(spark, docs, by_chance=1)
    seen = {}
    for k, t in docs:
        n = [len(x.split()) for x in t]
        core, any_ = set(), set()
        for i in range(len(t)):
            for j in range(i, len(t)):
                if sum(n[i : j + 1]) > 50:
                    first = seen.setdefault(tuple(t[i : j + 1]), (k, i))
                    if first != (k, i) and (first[0] != k or i >= first[1] + j + 1 - i):
                        any_ |= set(range(i, j + 1))
                        if sum(n[i + 1 : j + 1]) <= 50 and sum(n[i:j]) <= 50:
                            core |= set(range(i, j + 1))
        kept, out = got[k][0], []
        assert len(t) - got[k][1] == (0 if kept == [""] and got[k][1] else len(kept))
        # every line of a core goes, and none that is in no repeated passage
        it = iter(kept)
        must = [x for i, x in enumerate(t) if i not in any_]
        assert all(any(x == y for y in it) for x in must)
        it = iter([x for i, x in enumerate(t) if i not in core])
        assert kept == [""] or all(any(x == y for y in it) for x in kept)


def test_lines_of_repeated_rows_go(spark):
    rnd = random.Random(2)
    passage, alone = [sentence(rnd, 20) for _ in range(4)], [sentence(rnd, 20) for _ in range(5)]
    docs = [(1, [sentence(rnd, 5), *passage]), (2, [*passage, sentence(rnd, 5)]), (2, None), (3, alone), (3, alone)]
    docs[2] = docs[1]
    df = spark.createDataFrame([(k, "\n".join(t)) for k, t in docs], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in lines.dedup_lines(df).collect())
    assert got == [(1, "\n".join(docs[0][1]))] + [(2, docs[1][1][-1])] * 2 + [(3, "\n".join(alone))] * 2


def test_syncmers_of_short_texts_and_long_words(spark):
    rnd = random.Random(4)
    w = sentence(rnd, 16).split()
    plain, long = sentence(rnd, 40), "".join(rnd.choice("abcdefgh") for _ in range(4000))
    texts = [" ".join(w), " ".join(w[:-1]), plain, f"{plain} {long}", f"{plain} {long} {plain} " + sentence(rnd, 90)]
    got = [r for r in sorted(syncmers.with_edits(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())]
    assert got[0].near_next > 0.6 and got[0].near_edited > 0.3 and got[1].near_edited > 0.3
    assert 0 < got[2].near_next < 0.3 and got[3].near_next > 0.5


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_no_two_kept_texts_are_similar(spark):
    rnd = random.Random(3)
    rows = []
    for g in range(12):
        base = [f"w{rnd.randint(0, 5000)}" for _ in range(rnd.choice([30, 60, 120]))]
        for _ in range(14):
            w = list(base)
            for _ in range(rnd.randint(0, len(w) // 30)):
                w[rnd.randrange(len(w))] = f"x{rnd.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(w)))
    kept = {r.doc_id: r.text for r in simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not [(a, b) for a in kept for b in kept if a < b and jaccard(kept[a], kept[b]) >= 0.8]
    text = dict(rows)
    assert all(k in kept or any(jaccard(text[j], text[k]) >= 0.8 for j in text if j != k) for k in text)
    assert len(kept) >= 12 and 0 in kept


def test_rows_are_dropped_by_text_not_by_id(spark):
    rnd = random.Random(5)
    a, b, c = (sentence(rnd, 60) for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (None, b), (None, c), (None, c)]
    kept = simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("1", a), ("2", b), ("None", c)])
