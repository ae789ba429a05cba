"""The sentence library: forms of sentences, postings, statistics, and keeping them up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions import languages as L
from glosswork.functions import text as T


def sentence_forms(sentences: DataFrame) -> DataFrame:
    """id, language, forms: the distinct normal forms of each sentence, sorted."""
    return sentences.select("id", "language", F.array_sort(F.array_distinct(T.forms(F.col("full_text")))).alias("forms"))


def postings(forms: DataFrame) -> DataFrame:
    """(form, id, length): an inverted index with one posting for each form of a sentence; length counts its forms."""
    return forms.select("id", "language", F.size("forms").alias("length"), F.explode("forms").alias("form"))


def index_stats(forms: DataFrame) -> DataFrame:
    """sentences and average length over the whole index, all languages."""
    return forms.agg(F.count(F.lit(1)).alias("total"), F.avg(F.size("forms")).alias("avg_length"))


def word_forms(sentences: DataFrame, forms: DataFrame | None = None) -> DataFrame:
    """Distinct (form, base) pairs of all words, from their ``sentence_forms`` if given. Stems are made once for each
    distinct form."""
    forms = sentence_forms(sentences) if forms is None else forms
    # of the outer form no test of the array's size is inferred, which would make all forms twice
    found = forms.select("language", F.explode_outer("forms").alias("form")).distinct().filter("form is not null")
    return found.select("form", T.lemma(F.col("form"), F.col("language")).alias("base")).filter("base <> ''").distinct()


def word_map(sentences: DataFrame) -> DataFrame:
    """(id, word_map): each sentence's forms with their bases. A form's base follows from the form and the sentence's
    language, so that nothing leaves its row; sentences without a pair have none."""
    forms = F.array_sort(F.array_distinct(T.forms(F.col("full_text"))))
    held = T.once(sentences.select("id", "language", "full_text"), forms=forms)
    pairs = T.once(held, pairs=F.zip_with("forms", T.lemmas(F.col("forms"), F.col("language")), lambda f, b: F.struct(f.alias("form"), b.alias("base"))))
    return pairs.select("id", F.map_from_entries(F.filter("pairs", lambda p: p["base"] != "")).alias("word_map")).filter(F.size("word_map") > 0)


def add_word_forms(held: DataFrame, new: DataFrame) -> DataFrame:
    """New pairs that are not held yet, once each."""
    cleaned = new.select(T.form(F.col("form")).alias("form"), T.form(F.col("base")).alias("base")).filter("form <> '' and base <> ''").distinct()
    return cleaned.join(held, ["form", "base"], "left_anti")


def add_sentences(held: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` whose (language, full_text) isn't held; of rows that are equal in that, the one of least id."""
    first = new.groupBy("language", "full_text").agg(F.min("id").alias("id"))
    fresh = first.join(held.select("language", "full_text"), ["language", "full_text"], "left_anti")
    return new.join(fresh.select("id", "language", "full_text"), ["id", "language", "full_text"], "left_semi").dropDuplicates(["id", "language", "full_text"]).select(new.columns)


def held_ids(held: DataFrame, new: DataFrame) -> DataFrame:
    """(language, full_text, id, inserted) of every distinct text of ``new``: the id that it has in the library after an insert."""
    first = new.groupBy("language", "full_text").agg(F.min("id").alias("new_id"))
    met = first.join(held.groupBy("language", "full_text").agg(F.min("id").alias("old_id")), ["language", "full_text"], "left")
    return met.select("language", "full_text", F.coalesce("old_id", "new_id").alias("id"), F.col("old_id").isNull().alias("inserted"))


def recounted(sentences: DataFrame) -> DataFrame:
    """``sentences`` with a word count of their own where 0 or none is stored."""
    count = F.when(F.coalesce("word_count", F.lit(0)) > 0, F.col("word_count")).otherwise(T.count_words(F.coalesce("full_text", F.lit("")), F.col("language")))
    return sentences.withColumn("word_count", count.cast("int"))


def of_language(language: Column, wanted: str) -> Column:
    return F.array_contains(L.match_codes(F.lit(wanted)), language)


def library_counts(sentences: DataFrame) -> DataFrame:
    """By language: sentences, how many have a translation, words."""
    translated = F.coalesce("translation", F.lit("")) != ""
    return sentences.groupBy("language").agg(F.count(F.lit(1)).alias("sentences"), F.sum(translated.cast("long")).alias("translated"), F.sum("word_count").cast("long").alias("words"))


def delete_newest(sentences: DataFrame, language: str, n: int) -> DataFrame:
    """``sentences`` without the ``n`` newest of a language; 0 deletes all of it."""
    own = sentences.filter(of_language(F.col("language"), language))
    gone = own.orderBy(F.desc("id")).limit(n).select("id") if n else own.select("id")
    return sentences.join(gone, "id", "left_anti").select(sentences.columns)


def index_gaps(sentences: DataFrame, forms: DataFrame) -> DataFrame:
    """Ids that have no entry in the index."""
    return sentences.select("id").subtract(forms.select("id"))


def backfill_index(sentences: DataFrame, forms: DataFrame) -> DataFrame:
    """``forms`` with the entries that sentences lack; entries of sentences that are gone stay, as an index never deletes."""
    missing = sentences.join(forms.select("id"), "id", "left_anti")
    return forms.select("id", "language", "forms").unionByName(sentence_forms(missing))


def backfill_word_forms(word_forms: DataFrame, word_map: DataFrame) -> DataFrame:
    """``word_forms`` with the pairs of an older (word_form, lemma) table that it lacks, blank ones left out."""
    old = word_map.select(F.col("word_form").alias("form"), F.col("lemma").alias("base")).filter("form <> '' and base <> ''")
    return word_forms.select("form", "base").unionByName(old).distinct()


def once(meta: DataFrame, key: str) -> bool:
    """Whether a repair is still to be done: no row (key, value) marks it."""
    return meta.filter(F.col("key") == key).isEmpty()


def marked(meta: DataFrame, key: str) -> DataFrame:
    """``meta`` with the mark of a repair."""
    done = meta.sparkSession.createDataFrame([(key, "1")], "key string, value string")
    return meta.filter(F.col("key") != key).select("key", "value").unionByName(done)


def top_up(counts: DataFrame, target: int) -> DataFrame:
    """How many sentences each language lacks."""
    return counts.select("language", F.greatest(F.lit(0), F.lit(target) - F.col("sentences")).cast("long").alias("missing"))
