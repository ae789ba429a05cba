import random
import re
from collections import Counter, defaultdict

import pytest

from glosswork.llm import repeats
from glosswork.llm.repeats import repeated


def check(df, least=50, **how):
    """Rows against all windows of all texts: what is covered, that words are equal, and where rows lead."""
    pairs = [(r[0], r[1]) for r in df.collect()]
    toks = {}
    for _, t in pairs:
        toks[t or ""] = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    copies, where = Counter(t or "" for _, t in pairs), defaultdict(set)
    for t, w in toks.items():
        for j in range(len(w) - least + 1):
            where[tuple(w[j : j + least])].add((t, j))
    shared = {t: {j for j in range(len(w) - least + 1) if copies[t] > 1 or len({x for x, _ in where[tuple(w[j : j + least])]}) > 1} for t, w in toks.items()}
    got = repeated(df, least, **how).collect()
    ids = defaultdict(list)
    for k, t in pairs:
        ids[k].append(t or "")
    lead, rows = {}, Counter()
    for r in got:
        t = next(x for x in ids[r.doc_id] if len(toks[x]) == r.n_words) if len(ids[r.doc_id]) > 1 else ids[r.doc_id][0]
        rep = ids[r.rep_doc_id][0]
        n = r.end_word - r.start_word
        assert n >= least and toks[t][r.start_word : r.end_word] == toks[rep][r.rep_start_word : r.rep_start_word + n]
        rows[r.doc_id, r.start_word] += 1
        for j in range(n - least + 1):
            at = lead.setdefault((t, r.start_word + j), (rep, r.rep_start_word + j))
            assert at == (rep, r.rep_start_word + j)  # one passage for a window, alike in copies
    assert {t: {j for x, j in lead if x == t} for t in toks} == shared

    def root(at):
        while lead[at] != at:
            at = lead[at]
        return at

    for w, texts in where.items():
        if len({t for t, _ in texts}) > 1:
            assert len({root(at) for at in texts}) == 1  # all texts that share a window lead to the same words
    return got


def test_passages_of_different_partners_stay_apart(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    got = check(spark.createDataFrame([(1, f"{a} {b}"), (2, f"{a} u"), (3, f"v {b}"), (4, f"{b} w")], "doc_id long, text string"))
    assert {(r.doc_id, r.start_word, r.end_word) for r in got} == {(1, 0, 60), (2, 0, 60), (1, 60, 120), (3, 1, 61), (4, 0, 60)}
    assert len({(r.rep_doc_id, r.rep_start_word) for r in got}) == 2


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_tables(spark, sf):
    check(spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "text"), cells=1 << 20)


@pytest.mark.parametrize("group", [4, 256])
def test_shared_passages_in_small_alphabets(spark, monkeypatch, group):
    """Passages at many places, partners that are no neighbours, periodic texts, and groups that are split."""
    monkeypatch.setattr(repeats, "GROUP", group)
    rnd = random.Random(group)
    new = lambda n: [f"n{rnd.randrange(10**7)}" for _ in range(n)]
    passages = [new(rnd.randrange(8, 40)) for _ in range(12)]
    texts = []
    for _ in range(120):
        w = []
        for _ in range(rnd.randrange(1, 7)):
            w += rnd.choice(passages) if rnd.random() < 0.6 else new(rnd.randrange(1, 25))
        texts.append(" ".join(w))
    common = new(30)
    texts += [" ".join(new(rnd.randrange(0, 9)) + common + rnd.choice(passages)[: rnd.randrange(1, 9)] + new(3)) for _ in range(150)]
    texts += ["la " * 90, "la " * 40 + "b " + "la " * 60, "x y " * 50, texts[0], texts[0], texts[5].upper(), "", None]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6), 20, k=5, cells=1 << 16)


def test_odd_rows(spark, weird, nothing):
    check(spark.createDataFrame([(r[0], r[1]) for r in weird.collect()], "doc_id long, text string"))
    assert repeated(weird).count() == 0 and repeated(nothing).count() == 0
