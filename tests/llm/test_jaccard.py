import random
import re

import numpy as np
import pytest

from glosswork.llm import jaccard
from glosswork.llm.graph import components, forest
from glosswork.llm.jaccard import boundary, fits, join, keep_first, least_overlap, linked, partners


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(pairs):
    sets = [shingles(t) for _, t in pairs]
    up = list(range(len(pairs)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    lists = {}
    for i, s in enumerate(sets):
        near = {}
        for g in s:
            for j in lists.setdefault(g, []):
                near[j] = near.get(j, 0) + 1
            lists[g].append(i)
        for j, o in near.items():
            if 100 * o >= 75 * (len(s) + len(sets[j]) - o):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(pairs):
        if k is not None:
            r = top(i)
            least[r] = min(k, least.get(r, k))
    return sorted((str(k), len(s), str(least.get(top(i)))) for i, ((k, _), s) in enumerate(zip(pairs, sets)))


def check(df, **how):
    pairs = [(r[0], r[1]) for r in df.select("*").collect()]
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in join(df, **how).collect()) == brute(pairs)


def test_sizes_and_bounds():
    for a in range(1, 60):
        for b in range(a, 90):
            o = least_overlap(a, b, 75)
            assert 100 * o >= 75 * (a + b - o) and 100 * (o - 1) < 75 * (a + b - o + 1)
            assert (b in partners(a, 75)) == fits(a, b, 75) == (a in partners(b, 75))
    # five sets of 4 whose shingles are all shared: one subset of 4 each costs less than scanning long lists
    assert boundary([(4, 4, 2, 5)], 100.0, 75) >= 4 and boundary([(20, 20, 6, 5)], 0.0, 75) < 20


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_tables(spark, sf):
    check(spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "text"))


def test_small_sets_near_the_bound_and_a_large_group(spark):
    rnd = random.Random(5)
    texts = []
    for n in range(1, 16):  # sets around the boundary, with one or two words changed
        for _ in range(6):
            w = [rnd.choice("abcd") for _ in range(n + 4)]
            texts.append(" ".join(w))
            w[rnd.randrange(len(w))] = rnd.choice("abcdxyz")
            texts.append(" ".join(w[: rnd.randrange(max(1, len(w) - 2), len(w) + 1)]))
    base = [f"w{i}" for i in range(120)]
    for _ in range(250):  # near copies of one text, at about the threshold from each other
        w = list(base)
        for _ in range(rnd.randrange(0, 6)):
            w[rnd.randrange(len(w))] = f"n{rnd.randrange(10**6)}"
        texts.append(" ".join(w))
    common = " ".join(f"c{i}" for i in range(60))
    texts += [f"{common} " + " ".join(f"u{i}x{j}" for j in range(25 + i % 20)) for i in range(120)]  # one passage in all
    texts += ["Same Text here"] * 40 + ["same text here"]
    rnd.shuffle(texts)
    df = spark.createDataFrame([(i * 3 + 1, t) for i, t in enumerate(texts)], "doc_id long, text string")
    check(df.repartition(5), block=16, per_bucket=20_000)


def test_odd_rows(weird, nothing, spark):
    check(spark.createDataFrame([(r[0], r[1]) for r in weird.collect()], "doc_id long, text string"))
    assert join(weird).count() == 11 and join(nothing).count() == 0
    assert keep_first(weird).columns == weird.columns


def test_keep_first(spark):
    rows = [(3, "a b c d e f g h i j k l m n o p q r s t u v w x y z"), (9, "a b c d e f g h i j k l m n o p q r s t u v w x y changed"), (5, "other"), (5, "other"), (5, "else"), (None, "x"), (None, "y"), (None, "x"), (7, None), (8, ""), (8, "")]
    got = keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((str(r.doc_id), r.text and r.text[:5]) for r in got.collect() if r.text is not None) == [("3", "a b c"), ("5", "else"), ("5", "other"), ("8", ""), ("8", ""), ("None", "x"), ("None", "y")]
    assert got.filter("text is null").count() == 1


def test_linked_equals_counting():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 30, 20)).astype(np.uint64) for _ in range(60)]
    want = [(i, j) for i in range(60) for j in range(i + 1, 60) for o in [len(np.intersect1d(sets[i], sets[j]))] if o and 100 * o >= 60 * (len(sets[i]) + len(sets[j]) - o)]
    assert sorted(linked(sets, np.array([len(s) for s in sets]), 60, most=600)) == want


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, i) for i in range(5001, 5300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), jaccard.shared_folder(spark), "t").collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    roots = dict(forest(*zip(*[e for e in edges if e[0] != e[1]])))
    assert got == {x: roots.get(x, x) for x in nodes}
