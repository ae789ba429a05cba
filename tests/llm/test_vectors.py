from collections import Counter

import numpy as np

from glosswork.llm.vectors import KdTree, top_k


def brute(rows, top=10):
    held = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for q, qv in held:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in held if i != q and len(v) == len(qv))[:top]
            out.update((q, r, i, -s) for r, (s, i) in enumerate(best, 1))
    return out


def check(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert Counter(map(tuple, top_k(df, **kw).collect())) == brute(rows)


def test_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
    assert Counter(map(tuple, top_k(df, shard_rows=300, leaf=16, block=3, lane=3).collect())) == brute(rows)


def test_ties_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 0.5, -0.25]) for i in range(0, 400)] + [(i, rng.normal(size=3).tolist()) for i in range(400, 700)]
    rows += [(None, [1.0, 1.0, 1.0]), (701, None), (702, [1.0, None, 2.0]), (703, [float("nan"), 1.0, 1.0]), (704, [float("inf"), 0.0, 0.0]), (800, [1.0, 2.0]), (801, [3.0, 1.0]), (900, []), (901, []), (650, [9.0, 9.0, 9.0]), (650, [9.0, 9.0, 9.0]), (300, [0.5, 2.0, 1.0])]
    check(spark, rows, shard_rows=64, leaf=8, block=4)


def test_large_components_and_negative_ids(spark):
    check(spark, [(100 * i, [1e5 * i, -1e5, 3.0]) for i in range(-20, 20)])


def test_few_and_none(spark):
    check(spark, [(0, [1.0]), (1, [2.0]), (100, [3.0])])
    check(spark, [])


def test_search_skips_most_of_a_clustered_shard():
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(40, 8)) * 1000
    v = np.vstack([c + rng.normal(size=(200, 8)) * 5 for c in centers]).astype(np.int64)
    t = KdTree(np.arange(len(v)), v, 50)
    seen = []

    class Watch(np.ndarray):
        def __matmul__(self, other):
            seen.append(len(self))
            return np.asarray(self) @ np.asarray(other)

    t.vectors = t.vectors.view(Watch)
    got = t.search(v[7], 7, [], 10)
    want = sorted((-int(s), i) for i, s in enumerate(v @ v[7]) if i != 7)[:10]
    assert got == want and sum(seen) < len(v) / 4


def test_scores_beyond_doubles_and_products_beyond_longs(spark):
    check(spark, [(100 * i, [3e5 + i, -3e5, 1.0]) for i in range(4)] + [(i, [1e5 * i, 1e5, -1.0]) for i in range(1, 30)])
    big = [(100, [1e12, -1e12, 1.0])] + [(i, [1e12, 1e12 + i, 1.0]) for i in range(1, 9)]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    want = sorted((-sum(int(np.floor(1024 * a)) * int(np.floor(1024 * b)) for a, b in zip(big[0][1], v)), i) for i, v in big[1:])
    assert [(r.vec_id, r.score) for r in top_k(df).orderBy("rank").collect()] == [(i, -s) for s, i in want]


def test_further_columns(spark):
    df = spark.sql("SELECT CAST(id AS long) AS vec_id, array(1.0D, id) AS embedding, 5 AS dim, 'f' AS file, array(1) AS VEC_ID2, interval 1 day AS block FROM range(250)")
    assert top_k(df).count() == 30
