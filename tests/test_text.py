import pytest
from pyspark.sql import functions as F

from glosswork.functions import html as H
from glosswork.functions import languages as L
from glosswork.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("word", "want"), [("Students,", "students"), ("mother-in-law", "motherinlaw"), ("can't", "cant"), ("食べる", "食べる"), ("mañana", "manana"), ("по́вод", "повод"), ("Straße", "strasse")])
def test_form(spark, word, want):
    assert one(spark, T.form(F.col("w")), w=word) == want == T.plain_form(word)


@pytest.mark.parametrize(("word", "lang", "want"), [("Forgotten", "en", "forget"), ("studies", "en", "study"), ("reviewed", "en", "review"), ("cards", "en", "card"), ("improved", "en", "improve"), ("Students,", "en", "student"), ("running", "en", "run"), ("Hunde", "de", "hund"), ("mañana", "es", "manana"), ("glass", "en", "glass")])
def test_lemma(spark, word, lang, want):
    assert one(spark, T.matching_key(F.col("w"), F.col("l"), "lemma_family"), w=word, l=lang) == want
    assert T.plain_lemma(T.plain_form(word), lang) == want


def test_tokens_lose_nothing(spark):
    for t in ("Review, then remember.", "a  b\n\nc", "", "по́вод — да", "x²½ it's"):
        assert "".join(one(spark, T.split_tokens(F.col("t")), t=t)) == t
    assert one(spark, T.split_tokens(F.col("t")), t="Review, then remember.") == ["Review", ", ", "then", " ", "remember", "."]


@pytest.mark.parametrize(("text", "lang", "n"), [("One short sentence.", "en", 3), ("猫が魚を食べる。", "ja", 3), ("", "en", 0)])
def test_count_words(spark, text, lang, n):
    assert one(spark, T.count_words(F.col("t"), F.col("l")), t=text, l=lang) == n


@pytest.mark.parametrize(("text", "lang", "want"), [("der Hund", "de", ["Hund"]), ("el gato", "es", ["gato"]), ("в доме", "ru", ["доме"]), ("the the", "en", ["the"])])
def test_content_words(spark, text, lang, want):
    assert one(spark, T.target_tokens(F.col("t"), lang), t=text) == want
    assert one(spark, T.target_tokens(F.col("t"), "es", more=("xx",)), t="xx casa") == ["casa"]


def test_sentences(spark):
    assert one(spark, T.sentences(F.col("t")), t="One.  Two!\nthree\n\n four? 猫が魚を食べる。犬が走っている。") == ["One.", "Two!", "three four?", "猫が魚を食べる。", "犬が走っている。"]


def test_flags(spark):
    flags = lambda t: one(spark, T.quality_flags(F.col("t")), t=t)
    assert flags("Bad <i>markup</i>.") == ["markup_or_pipe"]
    assert flags("12 34") == ["no_letters"]
    assert flags("see https://example.com or a@b.co!!!") == ["url_or_email", "repeated_punctuation"]
    assert flags("(" + "x" * 36 + " " + "y " * 120) == ["too_long_chars", "oversized_token", "unbalanced_brackets"]


def test_markup(spark):
    assert one(spark, H.strip_tags(F.col("t")), t="<style>a{}</style><b>Hi</b>\n there<script>x</script>") == "Hi there"
    assert one(spark, H.image_sources(F.col("t")), t="""<img src="a.png"><IMG class=x src='b&amp;c.png'><img src="a.png"><img src="javascript:x">""") == ["a.png", "b&c.png"]
    assert one(spark, H.audio_sources(F.col("t")), t='<audio src="z.mp3"></audio>[sound:a.mp3]') == ["a.mp3", "z.mp3"]
    assert one(spark, H.display_kind(F.col("a"), F.col("t")), a="auto", t="[sound:a.mp3]") == "audio"
    assert one(spark, H.visible_part(F.col("t")), t='<div class="hidden">{{A}}<p>{{B}}</p></div>{{C}}<i style="display: none">{{D}}</i>') == "{{C}}"
    assert one(spark, H.unescape(F.col("t")), t="&eacute;&amp;") == "é&"
    assert one(spark, H.script_safe(F.col("t")), t='{"a":"</script>"}') == '{"a":"<\\/script>"}'


def test_urls(spark):
    assert one(spark, L.fill_url(F.lit(L.dictionary_url("en")), F.col("w"), F.lit("en")), w="a b") == "https://en.wiktionary.org/wiki/a%20b"
    assert one(spark, L.fill_url(F.lit("javascript:{word}"), F.col("w"), F.lit("en")), w="a") is None
