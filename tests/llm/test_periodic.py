import hashlib
import random
import re
import zlib
from fractions import Fraction

from glosswork.llm.periodic import periodic_runs, query

WORD = r"[^\x20\x09-\x0D]+"


def smallest_period(w):
    fail, k = [0], 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = fail[k - 1]
        k += w[i] == w[k]
        fail.append(k)
    return len(w) - fail[-1]


def plain_runs(w):
    """Every maximal stretch of every period, kept where the period is the stretch's smallest."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q) and smallest_period(w[i : j + q]) == q:
                out.append((i, j - i + q, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_text(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def check(df, pairs, **how):
    got = sorted(((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.text) for r in periodic_runs(df, **how).collect()), key=str)
    want = []
    for doc_id, text in pairs:
        w = re.findall(WORD, text or "")
        runs = [(0, len(w), 1)] if len(w) > 3000 and len(set(w)) == 1 else plain_runs(w)
        want.append((str(doc_id), len(w), runs, plain_text(w, runs)))
    assert got == sorted(want, key=str)
    return got


def texts(n, rng):
    """Few words, so that runs meet, lie in each other and end together; some with long periods."""
    for i in range(n):
        w = [rng.choice("abc"[: 1 + i % 3]) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            w += [rng.choice("ab cd efg".split()) for _ in range(rng.randrange(1, 40))] * rng.randrange(2, 7) + ["end"] * rng.randrange(9)
        yield " ".join(w)


def test_runs_of_random_texts(spark):
    pairs = list(enumerate(texts(300, random.Random(5))))
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(4)
    got = check(df, pairs)
    assert sum(len(r[2]) for r in got) > 200
    # the same by ranges of lags over tasks
    assert check(df, pairs, long=100, work=500) == got


def test_odd_rows(spark, weird, nothing):
    pairs = [(r[0], r[1]) for r in weird.collect()]
    check(weird, pairs)
    check(weird, pairs, long=1000, work=1 << 24)
    copies = [(i, "one two " * 300 + str(i % 2)) for i in range(60)]
    check(spark.createDataFrame(copies, "doc_id long, text string"), copies, long=500, work=10_000)
    assert periodic_runs(nothing).count() == 0


def test_long_text_of_few_repeats(spark):
    rng = random.Random(1)
    w = [str(rng.randrange(5000)) for _ in range(9000)]
    w[1000:1000] = w[:700] * 5
    for how in ({}, {"long": 1000, "work": 1 << 22}):
        r = periodic_runs(spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string"), **how).first()
        assert [tuple(x) for x in r.runs if x.period > 1] == [x for x in plain_runs(w[:6000]) if x[2] > 1] and any(x.period == 700 for x in r.runs)


def test_query_by_the_contract(spark):
    sf = "/root/testdata/sf0.001"
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        w = re.findall(WORD, r.text or "")
        n, h = len(w), zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        top = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((r.doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha("".join("%d,%d,%d\n" % x for x in runs)), sha(plain_text(w, runs))))
    df = query(spark, sf)
    assert df.columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(tuple(x)[:8] for x in df.collect()) == sorted(want) and sum(x[1] for x in want) > 10
