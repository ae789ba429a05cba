"""Steps whose work may not grow faster than the tables, and what they give."""

from pyspark.sql import functions as F

from glosswork.functions import text as T
from glosswork.operators import corpus as K
from glosswork.operators import search as X

TEXTS = [(1, "en", "The studies were running and the boxes went."), (2, "de", "Die Kinder liefen, die Kinder."), (3, "en", "123 ..."), (4, None, "Seen cities"), (5, "fr", "les villes")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_word_maps_stay_in_their_rows(spark):
    df = spark.createDataFrame(TEXTS, "id long, language string, full_text string")
    got = K.word_map(df)
    assert "Exchange" not in plan(got)
    words = df.select("id", "language", F.explode(T.forms(F.col("full_text"))).alias("form"))
    want = words.select("id", "form", T.lemma(F.col("form"), F.col("language")).alias("base")).filter("base <> ''").distinct()
    assert {(r.id, f, b) for r in got.collect() for f, b in r.word_map.items()} == {tuple(r) for r in want.collect()}
    assert 3 not in {r.id for r in got.collect()}


def test_word_forms_make_forms_once(spark):
    df = spark.createDataFrame(TEXTS, "id long, language string, full_text string")
    assert plan(K.word_forms(df)).count("regexp_extract_all") == 1
    assert {tuple(r) for r in K.word_forms(df).collect()} == {tuple(r) for r in K.word_forms(df, K.sentence_forms(df)).collect()}


def test_lists_of_wanted_grams_are_those_of_the_index(spark):
    texts = spark.createDataFrame([(i, "abcd ef"[i % 5 :] + "bc" * (i % 3)) for i in range(60)] + [(99, "")], "id long, text string")
    wanted = spark.createDataFrame([("bcb",), ("a",), ("zz",)], "form string")
    every, grams = X.gram_lists(texts, 3), X.wanted_grams(wanted)
    rows = lambda df: sorted((r.gram, r.cell, r.ids) for r in df.collect())
    want = rows(every.join(grams, "gram", "left_semi"))
    assert rows(X.gram_lists(texts, 3, grams)) == want and want
    old, X.ASKED = X.ASKED, 1  # too many to ask a text for
    try:
        assert rows(X.gram_lists(texts, 3, grams)) == want
    finally:
        X.ASKED = old
    assert {tuple(r) for r in X.holding(every, texts, wanted).collect()} == {(r.id, f) for r in texts.collect() for f in ("bcb", "a") if f in r.text}
