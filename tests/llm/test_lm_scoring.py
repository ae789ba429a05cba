import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from glosswork.llm.attention import Model, powers
from glosswork.llm.hashing import sequences, words
from glosswork.llm.common import documents, shared_folder
from glosswork.llm.lm_scoring import fit, score_texts, survey
from glosswork.llm.subwords import shared


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aAbZé漢 \n\t\x0b\x85\xa0"), max_size=30), max_size=6))
def test_word_hashes(texts):
    import pyarrow as pa

    from glosswork.llm.hashing import utf8

    data, offsets = utf8(pa.array(["skip", *texts], pa.string())[1:])
    h, s, e, n = words(data, offsets)
    want = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    assert n.tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert [bytes(data[a:b]).decode() for a, b in zip(s, e)] == flat
    names = {}
    for w, x in zip(flat, h.tolist()):
        assert names.setdefault(x, lower(w)) == lower(w)
    assert len(names) == len({lower(w) for w in flat})
    runs, m = sequences(h, n, 3)
    grams = [tuple(map(lower, ws[i : i + 3])) for ws in want for i in range(len(ws) - 2)]
    assert m.tolist() == [max(0, len(w) - 2) for w in want] and len(runs) == len(grams)
    assert len(set(runs.tolist())) == len(set(grams))


def base(pairs):
    held = [zlib.crc32(str(k).encode()) % 7 == 2 if k is not None else False for k, _ in pairs]
    toks = [[*re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")), None] for _, t in pairs]
    c = Counter(w for ws, h in zip(toks, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted((str(k), h, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for (k, _), ws, h in zip(pairs, toks, held))


def check(pairs, rows):
    assert base(pairs) == sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
    assert all(np.isfinite(r.score) and r.score < 0 for r in rows)


def test_scores(small, weird, nothing):
    pairs = [(r.doc_id, r.text) for r in small.collect()]
    rows = score_texts(small, head=50).collect()
    check(pairs, rows)
    check(pairs, score_texts(small).collect())
    check([(r[0], r[1]) for r in weird.collect()], score_texts(weird, head=2).collect())
    assert score_texts(nothing).count() == 0


def naive(m, ids):
    """Scores one text token by token, from the trained embeddings."""
    s, d, p = m.block, m.dim, m.p
    seq = [m.size - 1, *ids]
    total = 0.0
    for i, target in enumerate([*ids, m.size - 1]):
        first = max(0, (i // s - 1) * s)
        e = p["emb"][m.place[seq[first : i + 1]]].astype(float)
        q = e[-1] @ p["q"]
        a = (e @ p["k"]) @ q / np.sqrt(d) + p["r"][np.arange(len(e))[::-1]]
        a = np.exp(a - a.max())
        o = (a / a.sum()) @ (e @ p["v"])
        g, c = divmod(m.class_of[target], m.each)
        for logits, k in ((o @ p["o"] + e[-1] @ p["e"] + p["b"], g), (np.concatenate([o, e[-1], [1]]) @ p["c"][g], c)):
            total += logits[k] - np.log(np.exp(logits - logits.max()).sum()) - logits.max()
        total += m.within[target]
    return total / np.log(10)


def test_batches_equal_token_by_token_and_held_out_beats_counts(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    ids = [shared().ids(t).astype(np.int64) for t in texts]
    counts = np.bincount(np.concatenate(ids[:700]), minlength=50257)
    counts[-1] = 700
    m = Model(counts).train(np.concatenate(ids[:300]), np.array([len(i) for i in ids[:300]]))
    few = [np.empty(0, np.int64), *(i[:n] for i, n in zip(ids[700:], (1, 15, 16, 17, 31, 32, 33, 100)))]
    got = m.score(np.concatenate(few), np.array([len(i) for i in few]))
    assert np.allclose(got, [naive(m, i.tolist()) for i in few], rtol=2e-3)
    one_class = np.exp(m.within)
    assert np.allclose(np.bincount(m.class_of, one_class)[np.unique(m.class_of)], 1)  # with softmaxes over groups and classes, ids sum to 1
    held = ids[700:]
    n = sum(len(i) + 1 for i in held)
    model = m.score(np.concatenate(held), np.array([len(i) for i in held])).sum() / n
    p = np.log10((counts + 1) / (counts.sum() + len(counts)))
    plain = (p[np.concatenate(held)].sum() + p[-1] * len(held)) / n
    pairs = Counter()
    for i in ids[:700]:
        seq = [50256, *i.tolist(), 50256]
        pairs.update(zip(seq, seq[1:]))
    firsts = Counter()
    for (x, _), c in pairs.items():
        firsts[x] += c
    share = (counts + 1) / (counts.sum() + len(counts))
    bigram = np.mean([np.log10((pairs[x, y] + 50 * share[y]) / (firsts[x] + 50)) for i in held for seq in [[50256, *i.tolist(), 50256]] for x, y in zip(seq, seq[1:])])
    print(f"held-out log10 a subword: attention {model:.3f}, smoothed bigram {bigram:.3f}, unigram {plain:.3f}")
    assert model > plain + 0.1


def test_large_weights_stay_finite():
    m = Model(np.arange(1, 40)).begin(np.arange(39))
    for k in ("q", "k", "o", "e", "c"):
        m.p[k] = m.p[k] * 1e4
    s = m.freeze().score(np.arange(30), np.array([30]))
    assert np.isfinite(s).all()


def test_every_training_document_takes_part_in_the_fit(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").withColumn("held_out", F.lit(False))
    ids = [shared().ids(r.text).astype(np.int64) for r in docs.collect()]
    counts = np.bincount(np.concatenate(ids), minlength=50257)
    counts[-1] = len(ids)
    m, known = fit(survey(docs, shared_folder(spark)), counts), np.flatnonzero(counts >= 3)
    assert (m.place[known] > 0).all()  # ids of every document have embeddings of their own
    drawn = Model(counts).begin(known).p["emb"]
    moved = np.abs(m.p["emb"] - drawn).sum(1) > 0
    assert moved[m.place[known]].all()  # and each was learned from


def test_survey_keeps_every_document_with_its_ids(spark, weird):
    """Held-out documents too, so that scoring encodes no text again; they count for nothing."""
    from pyspark.sql import functions as F

    docs = documents(weird).withColumn("held_out", F.coalesce(F.col("doc_id") == 7, F.lit(False)))
    rows = survey(docs, shared_folder(spark)).collect()
    kept = [r for r in rows if r.kind == 2]
    want = [(str(r.doc_id), r.text, r.held_out, shared().ids(r.text or "").tolist()) for r in docs.collect()]
    assert sorted(want, key=str) == sorted(((str(r.doc_id), r.text, r.key < 0, np.frombuffer(r.ids, "<u2").tolist()) for r in kept), key=str)
    counts = Counter(i for _, _, held, ids in want if not held for i in [*ids, 50256])
    got = Counter()
    for r in rows:
        if r.kind == 1:
            got[r.key] += r.n
    assert got == counts


def test_exponentials_out_of_range():
    z = np.array([[1e4, 0, -1e4], [-1e4, -1e4, -1e4], [1, 2, 3]], np.float32)
    made, total, top = powers(z)
    assert np.allclose(np.log(total) + top, np.logaddexp.reduce(z.astype(float), 1), atol=1e-3)
    assert np.allclose((made / total[:, None]).sum(1), 1)
    q, k, val = np.full((1, 2, 1), 1e3, np.float32), np.array([[[1], [2], [3]]], np.float32), np.array([[[5, 1], [6, 1], [7, 1]]], np.float32)
    _, o = Model.attended(q, k, val, np.zeros((2, 3), np.float32))
    assert np.allclose(o[..., 0] / o[..., 1], 7)


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(5)
    m = Model(rng.integers(1, 50, 30), groups=3, each=4, dim=4, block=3).begin(np.arange(29))
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    ids, counts = rng.integers(0, 29, 20), np.array([12, 8])
    inputs, targets, owner = m.blocks(ids, counts)
    at = np.flatnonzero(owner >= 0)
    x, y = m.place[np.concatenate([inputs[at - 1], inputs[at]], 1)], targets[at]
    g, rows = m.gradient(x, y)
    loss = lambda: -sum(naive(m, i.tolist()) * np.log(10) - sum(m.within[[*i, m.size - 1]]) for i in np.split(ids, [12])) / (y >= 0).sum()
    for name, spots in {"o": [(1, 2)], "e": [(0, 1)], "b": [(2,)], "c": [(1, 0, 2), (2, 5, 1), (0, 8, 3)], "q": [(1, 1)], "k": [(2, 3)], "v": [(0, 2)], "r": [(1,)], "emb": [(int(rows[3]), 1)]}.items():
        for i in spots:
            if name == "c" and m.p["c"][i[0], -1, i[2]] < -1e3:
                continue
            old = m.p[name][i]
            m.p[name][i] = old + 1e-5
            up = loss()
            m.p[name][i] = old - 1e-5
            down = loss()
            m.p[name][i] = old
            got = g[name][(3, 1)] if name == "emb" else g[name][i]
            assert abs((up - down) / 2e-5 - got) < 1e-4, (name, i)
