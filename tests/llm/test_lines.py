"""Line dedup against a brute-force version of its chunks and cores, and the passages that it must take."""

import collections
import random
import struct

import pytest
import xxhash

from gaugeline.llm import lines
from gaugeline.llm.common import table


def sentence(rnd, n):
    return " ".join(f"v{rnd.randint(0, 10**9)}" for _ in range(n))


def deduped(spark, docs, **more):
    df = spark.createDataFrame([(k, "\n".join(t)) for k, t in docs], "doc_id long, text string")
    return {r.doc_id: (r.text.split("\n"), r.removed_lines) for r in lines.dedup_lines(df, **more).collect()}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chained(*parts, seed=42):
    for p in parts:
        seed = xxhash.xxh64_intdigest(p if isinstance(p, bytes) else struct.pack("<q", signed(p)), seed)
    return seed


def slow(docs, by_chance=None):
    """The lines to cut of {id: lines}, by a literal reading of the module's docstring."""
    n = collections.Counter(x for t in docs.values() for x in t if x.split())
    windows = []  # (id, start, end, cut start, cut end, count of a line, times more)
    for k, t in docs.items():
        at = 0
        while at < len(t):
            end = at
            while end < len(t) and (not t[end].split() or n[t[end]] > 1):
                end += 1
            worded = [i for i in range(at, end) if t[i].split()]
            r = [signed(chained(chained(t[a].encode()), chained(t[b].encode()))) for a, b in zip(worded, worded[1:], strict=False)]
            cuts = [0] + [j for j in range(2, len(worded) - 1) if r[j - 1] < r[j - 2] and r[j - 1] < r[j]] + [len(worded)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                for a_, b_ in ((a, b), (a + 1, b), (a, b - 1), (a + 1, b - 1)):
                    if b_ - a_ > 1:
                        windows.append((k, worded[a_], worded[b_ - 1] + 1, worded[a_], worded[b_ - 1] + 1, min(n[t[worded[i]]] for i in range(a_, b_)) if by_chance else None, by_chance))
            words = [min(51, len(t[i].split())) for i in worded]
            for i in range(len(worded)):
                to = next((j for j in range(i, len(worded)) if sum(words[i : j + 1]) > 50), None)
                since = next((j for j in range(i, -1, -1) if sum(words[j : i + 1]) > 50), None)
                if to is not None:
                    core = sum(words[i + 1 : to + 1]) <= 50
                    upto = worded[to] + 1 if core else worded[i + 1]
                    windows.append((k, worded[i], worded[to] + 1, worded[i], upto, None if core else n[t[worded[i]]], 2))
                if since is not None and sum(words[since:i]) > 50:
                    windows.append((k, worded[since], worded[i] + 1, worded[i - 1] + 1, worded[i] + 1, n[t[worded[i]]], 2))
                    if to is not None and sum(words[i + 1 : to + 1]) > 50:
                        windows.append((k, worded[since], worded[to] + 1, worded[i - 1] + 1, worded[i + 1], None, 2))
            at = end + 1
    of = collections.defaultdict(list)
    for w in windows:
        of[w[-1] == 2, tuple(docs[w[0]][w[1] : w[2]])].append(w)
    cut = collections.defaultdict(set)
    for same in of.values():
        first = min(w[:2] for w in same)
        for k, s, e, a, b, count, more in same:
            if (k, s) == first or (k == first[0] and s < first[1] + e - s) or (count is not None and count > more * len(same)):
                continue
            cut[k].add((a, b))
    out = {}
    for k, parts in cut.items():  # parts that touch are one
        gone = set()
        for a, b in sorted(parts):
            gone |= set(range(a, b))
        out[k] = gone
    return out


def agree(got, docs, **more):
    cut = slow(docs, **more)
    for k, t in docs.items():
        kept = [x for i, x in enumerate(t) if i not in cut.get(k, ())]
        assert got[k] == (kept or [""], len(cut.get(k, ()))), k


def test_like_brute_force_on_real_texts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    got = {r.doc_id: (r.text.split("\n"), r.removed_lines) for r in lines.dedup_lines(docs).collect()}
    agree(got, {r.doc_id: r.text.split("\n") for r in docs.collect()})
    assert sum(n for _, n in got.values()) > 20


@pytest.mark.parametrize(("seed", "more"), [(1, {}), (2, {}), (3, {"by_chance": 8})])
def test_like_brute_force_on_random_lines(spark, seed, more):
    rnd = random.Random(seed)
    pool = ["", "", " \t"] + [sentence(rnd, rnd.choice([1, 4, 9, 16, 30, 51, 70])) for _ in range(40)]
    passages = [[rnd.choice(pool) for _ in range(rnd.randint(2, 14))] for _ in range(8)]
    docs = {}
    for k in range(70):
        t = []
        for _ in range(rnd.randint(0, 5)):
            t += rnd.choice(passages) if rnd.random() < 0.5 else [rnd.choice(pool) if rnd.random() < 0.3 else sentence(rnd, 3)]
        docs[k] = t or [""]
    agree(deduped(spark, docs.items(), **more), docs, **more)


def test_a_short_passage_of_lines_goes(spark):
    rnd = random.Random(11)
    passage = [sentence(rnd, 8) for _ in range(4)]
    docs = [(k, [sentence(rnd, 9), *passage, sentence(rnd, 7)]) for k in range(10)]
    got = deduped(spark, docs)
    assert all(got[k] == ((t, 0) if k == 0 else ([t[0], t[-1]], 4)) for k, t in docs)


def test_a_line_elsewhere_opens_no_hole(spark):
    rnd = random.Random(12)
    passage = [sentence(rnd, 5) for _ in range(8)]
    docs = [(k, [sentence(rnd, 9), *passage, sentence(rnd, 7)]) for k in range(3)] + [(9, [sentence(rnd, 6), passage[4], sentence(rnd, 6)])]
    got = deduped(spark, docs)
    assert got[9] == (docs[3][1], 0)
    assert all(got[k] == ((t, 0) if k == 0 else ([t[0], t[-1]], 8)) for k, t in docs[:3])


def test_common_lines_side_by_side_stay(spark):
    rnd = random.Random(13)
    licence, header = "a licence line of few words", "a header of few words"
    docs = [(k, [header, licence, sentence(rnd, 9)] if k < 4 else [header, sentence(rnd, 9), licence]) for k in range(60)]
    got = deduped(spark, docs, by_chance=8)
    assert all(got[k] == (t, 0) for k, t in docs)
    # without that wish a repeated chunk goes, and single lines stay
    got = deduped(spark, docs)
    assert all(got[k] == ((t[2:], 2) if 0 < k < 4 else (t, 0)) for k, t in docs)


def test_recall_of_planted_passages(spark):
    """Passages of two lines or more among other repeated lines: how many of their copies' lines go."""
    rnd = random.Random(21)
    common = [sentence(rnd, rnd.randint(3, 9)) for _ in range(6)]
    passages = [[sentence(rnd, rnd.randint(4, 14)) for _ in range(rnd.randint(2, 9))] for _ in range(60)]
    docs, planted = [], {}
    for k in range(400):
        parts = [[sentence(rnd, 7)] if rnd.random() < 0.7 else [rnd.choice(common)] for _ in range(8)]
        held = rnd.sample(range(60), rnd.randint(0, 2))
        for j in held:
            parts.insert(rnd.randint(0, len(parts)), passages[j])
        docs.append((k, [x for p in parts for x in p]))
        planted[k] = held
    got, seen, gone, n = deduped(spark, docs), set(), 0, 0
    for k, _ in docs:
        for j in planted[k]:
            if j in seen:
                n += len(passages[j])
                gone += sum(x not in got[k][0] for x in passages[j])
            seen.add(j)
    assert n > 1000 and gone >= 0.9 * n, gone / n


def test_passages_that_change_places(spark):
    rnd = random.Random(14)
    a, b, c = ([sentence(rnd, 20) for _ in range(5)] for _ in range(3))
    orders = [a + b + c, c + a + b, b + c + a, a + c + b]
    got = deduped(spark, [(k, [sentence(rnd, 4), *t, sentence(rnd, 4)]) for k, t in enumerate(orders)])
    assert [got[k][1] for k in range(4)] == [0, 15, 15, 15]


def test_equal_keys_of_other_bytes_cut_nothing(spark):
    rnd = random.Random(15)
    copied = [sentence(rnd, 20) for _ in range(5)]
    both = [[sentence(rnd, 20) for _ in range(3)] for _ in range(40)]
    docs = [(k, [sentence(rnd, 5), *both[k % 40], sentence(rnd, 5)]) for k in range(80)] + [(k, [sentence(rnd, 5), *copied]) for k in (100, 101)]
    whole, few = deduped(spark, docs), deduped(spark, docs, key_bits=3)
    for k, t in docs:
        assert whole[k][1] == (3 if 40 <= k < 80 else 5 if k == 101 else 0)
        assert few[k][1] <= whole[k][1] and few[k][0] in (t, whole[k][0]) or set(whole[k][0]) <= set(few[k][0])
    assert sum(n for _, n in few.values()) < sum(n for _, n in whole.values())  # there were such keys


def test_columns_of_any_name_stay(spark):
    rnd = random.Random(16)
    t = "\n".join(sentence(rnd, 20) for _ in range(4))
    df = spark.createDataFrame([(1, t, 5, "x", 7, None), (2, t, 6, "y", 8, None)], "doc_id long, text string, __lines int, `__id` string, removed_lines int, __cuts string")
    got = sorted(lines.dedup_lines(df).collect())
    assert lines.dedup_lines(df).columns == ["doc_id", "text", "__lines", "__id", "__cuts", "removed_lines"]
    assert [tuple(r) for r in got] == [(1, t, 5, "x", None, 0), (2, "", 6, "y", None, 4)]
