import re
from collections import defaultdict

from glosswork.llm.mixing import apply_mix, mix_sources

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water(sizes, weights=(1, 2, 3), cap=3):
    """Targets by repeated sharing, as the contract words it."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, left = {}, float(sum(sizes.values()))
    while True:
        free = [s for s in order if s not in full]
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > cap * sizes[s]]
        if not over:
            return full | {s: left * w[s] / total for s in free}
        for s in over:
            full[s] = cap * sizes[s]
            left -= cap * sizes[s]


def verify(rows):
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    expected = water(sizes)
    for s in sizes:
        assert abs(expected[s] - target[s]) < 1e-6 * max(1, expected[s])
        assert abs(taken[s] - target[s]) <= 0.5 + 1e-6


def test_targets_and_budgets(small):
    rows = mix_sources(small).collect()
    assert len(rows) == small.count()
    verify(rows)


def test_rerun_agrees(small):
    once, again = (sorted((r.doc_id, r.taken) for r in mix_sources(small.repartition(n)).collect()) for n in (1, 5))
    assert once == again


def test_odd_rows(weird, nothing):
    rows = mix_sources(weird).collect()
    assert len(rows) == 11
    verify(rows)
    assert mix_sources(nothing).count() == 0


def test_capped_source(spark):
    rows = [(i, "a b c", "big") for i in range(100)] + [(1000, "a b", "tiny")]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    verify(got)
    assert {r.taken for r in got if r.source == "tiny"} == {6}


def test_apply_cuts_and_repeats(weird, small):
    for df in (weird, small):
        want = sum(r.taken for r in mix_sources(df).collect())
        out = apply_mix(df)
        assert out.columns == df.columns
        at = df.columns.index("text")
        got = [len(WORD.findall(r[at])) for r in out.collect()]
        assert sum(got) == want and all(got)
