"""The index against searches that look at everything, and numbering, places and query texts against plain versions."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glosswork.functions import text as T
from glosswork.operators import cards as C
from glosswork.operators import corpus as K
from glosswork.operators import ingest as I
from glosswork.operators import ranks
from glosswork.operators import search as X
from glosswork.operators import selection as Q


def library(spark, n, rng, words=40):
    """Sentences of frequent and rare words in two languages; many have equal scores."""
    vocabulary = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 5))) for _ in range(words)]
    pick = lambda: vocabulary[min(int(rng.expovariate(0.12)), words - 1)]
    rows = [(i * 3 + 1, "en" if i % 5 else "de", " ".join(pick() for _ in range(rng.randrange(1, 12)))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, language string, full_text string"), sorted(set(vocabulary))


def test_best_of_chunks_are_those_of_a_full_search(spark):
    rng = random.Random(3)
    s, vocabulary = library(spark, 4000, rng)
    forms = K.sentence_forms(s)
    posts, stats = K.postings(forms), K.index_stats(forms)
    terms = [(w, False, i % 3) for i, w in enumerate(vocabulary)] + [("ab", True, 0), ("c", True, 2), ("nosuch", False, 1), ("zz", True, 1), (vocabulary[0], False, 2)]
    searched = spark.createDataFrame(terms, "term string, is_prefix boolean, chunk int")
    words = X.vocabulary(posts)
    mine = F.col("language") == "en"
    every = Q.bm25(posts, stats, searched).join(s.filter(mine).select("id"), "id", "left_semi")
    everywhere = {(r.chunk, r.id): r.bm25 for r in every.collect()}
    for cells in (1, 7):
        blocks = X.posting_blocks(posts, cells).cache()
        for limit in (5, 100):
            got = {(r.chunk, r.id): r.bm25 for r in X.best(blocks, words, stats, searched, mine, limit).collect()}
            assert all(abs(everywhere[k] - v) < 1e-9 for k, v in got.items())
            for chunk in range(3):
                order = sorted((round(v, 9), i) for (c, i), v in everywhere.items() if c == chunk)
                assert {(chunk, i) for _, i in order[:limit]} <= got.keys()
        few = X.skipped(blocks, stats, searched, mine, 5).agg(F.sum("postings").alias("p"), F.sum("unopened").alias("u")).first()
        assert 0 < few.u < few.p
    fewer = {(r.chunk, r.id) for r in X.best(blocks, words, stats, searched.filter("chunk < 0"), mine, 5).collect()}
    assert fewer == set()


def test_prefixes_meet_the_vocabulary_by_bounds(spark):
    rng = random.Random(7)
    forms = sorted({"".join(rng.choice("abé漢") for _ in range(rng.randrange(1, 7))) for _ in range(3000)})
    wide = ["a", "ab", "aé", "é", "漢a", "abababab", "b", ""]
    words = X.vocabulary(spark.createDataFrame([(f,) for f in [*forms, *forms[:50], ""]], "form string"))
    assert words.count() > len(forms) / X.FORMS
    got = {(r.form, r.term) for r in X.beginning(words, spark.createDataFrame([(w,) for w in wide], "term string")).collect()}
    assert got == {(f, w) for f in forms for w in wide if w and f.startswith(w)}
    small = spark.createDataFrame([(f,) for f in forms[:200]], "form string")
    assert {(r.form, r.term) for r in Q.with_prefix(small, spark.createDataFrame([(w,) for w in wide], "term string")).collect()} == {(f, w) for f in forms[:200] for w in wide if w and f.startswith(w)}


def test_substrings_by_lists_of_pairs(spark):
    rng = random.Random(11)
    texts = [(i, "".join(rng.choice("abc漢😀") for _ in range(rng.randrange(12)))) for i in range(1500)] + [(9999, None)]
    wanted = ["a", "ab", "漢", "ab漢", "aaaa", "abab", "😀a", "x", ""]
    df, forms = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(w,) for w in [*wanted, "ab"]], "form string")
    want = {(i, w) for i, t in texts for w in wanted if w and t and w in t}
    for cells in (1, 5):
        assert {(r.id, r.form) for r in X.holding(X.gram_lists(df, cells), df, forms).collect()} == want
    assert {(r.id, r.form) for r in Q.holding(df, forms).collect()} == want


def plain_places(text, forms):
    found = []
    for form in forms:
        start = text.find(form)
        while form and start >= 0:
            found.append((start, start + len(form), form))
            start = text.find(form, start + len(form))
    out, last = [], 0
    for place in sorted(found, key=lambda p: (p[0], -p[1])):
        if place[0] >= last:
            out.append(place)
            last = place[1]
    return out


def test_places_of_ten_thousand_forms(spark):
    rng = random.Random(2)
    forms = list({"".join(rng.choice("abcde漢") for _ in range(rng.randrange(1, 9))) for _ in range(14000)})[:10_000] + [""]
    texts = [(i, "".join(rng.choice("abcde漢 ") for _ in range(rng.randrange(80)))) for i in range(60)] + [(100, None), (101, "")]
    df = spark.createDataFrame(texts, "id long, full_text string")
    want = sorted((i, *p) for i, t in texts for p in plain_places(t or "", forms))
    assert sorted(tuple(r) for r in Q.occurrences(df, forms).collect()) == want
    assert sorted(tuple(r) for r in Q.occurrences(df, spark.createDataFrame([(f,) for f in forms], "form string"), most=3000).collect()) == want
    assert Q.occurrences(df, []).collect() == []


def test_numbers_by_ranges(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"), (F.col("id") % 3).alias("k"))
    got = ranks.numbered(df, [F.desc("k"), F.asc("x")], "n").collect()
    order = sorted(got, key=lambda r: (-r.k, r.x))
    assert [r.n for r in order] == list(range(5000))
    assert ranks.numbered(df.limit(0), ["x"]).collect() == []


def test_first_of_many_copies(spark):
    rows = [(i, "en", "One common example sentence." if i % 3 == 0 else f"Sentence number {'abc' * (i % 7)} goes on and {chr(97 + i % 26)} on.", None) for i in range(3000, 0, -1)]
    df = spark.createDataFrame(rows, "ordinal long, language string, text string, translation string")
    held = spark.createDataFrame([("en", "One common example sentence.")], "language string, full_text string")
    first = {}
    for o, _, t, _ in sorted(rows):
        first.setdefault(t.lower(), o)
    got = I.judge(df).collect()
    assert {r.ordinal for r in got if r.skip_reason != "duplicate"} == set(first.values()) and len(got) == 3000
    again = {r.ordinal: r.skip_reason for r in I.judge(df, stored=held).collect()}
    assert again[3] == "stored" and again[6] == "duplicate"


TERMS = ["is:due", "IS:DUE", "-is:new", 'deck:"A B"', r"tag:a\ b", '"open', "x", 'a"b c"d', "\\"]


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(st.tuples(st.lists(st.sampled_from(TERMS), max_size=4).map("  ".join), st.booleans(), st.booleans(), st.sampled_from(["current", "configured", "all"]), st.sampled_from(["", 'My "D\\eck"', "x"]), st.sampled_from(["", "other"])), min_size=60, max_size=60))
def test_query_texts_of_columns(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, q string, due boolean, new boolean, scope string, current string, configured string")
    got = df.select("i", C.terms_of(F.col("q")).alias("t"), C.due_query_of(F.col("q"), F.col("due"), F.col("new"), C.deck_scope_of(F.col("scope"), F.col("current"), F.col("configured"))).alias("d")).collect()
    for r in got:
        q, due, new, scope, current, configured = rows[r.i]
        assert r.t == C.search_terms(q)
        assert r.d == C.due_query(q, due, new, C.deck_scope(scope, current, configured))


def test_selection_with_and_without_the_index(spark):
    s, _ = library(spark, 900, random.Random(8))
    s = s.withColumn("translation", F.lit(None).cast("string")).withColumn("word_count", T.count_words(F.col("full_text"), F.col("language")))
    forms = K.sentence_forms(s)
    posts, stats = K.postings(forms), K.index_stats(forms)
    due = spark.createDataFrame([(i, w, w, w, w, "", 5, 2500, 0.0, 0, float(i)) for i, w in enumerate("a b c d ab ba cc dd abc".split())], "card_id long, target_word string, lemma string, word_form string, match_key string, definition string, interval long, factor long, overdue double, due_in_days long, priority double")
    keyed = Q.due_keys(due)
    x = Q.expansions(keyed, K.word_forms(s))
    index = {"blocks": X.posting_blocks(posts, 3), "words": X.vocabulary(posts)}
    rows = [sorted((r.id, round(r.bm25, 9), round(r.score, 9), r.cards) for r in Q.candidates(s, forms, posts, stats, keyed, x, "en", limit=6, per_query=3, index=i).collect()) for i in (None, index)]
    assert rows[0] == rows[1] and rows[0]
