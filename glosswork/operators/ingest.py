"""From rows of text to accepted sentences: cleaning, first-wins de-duplication, filters with reasons, limits, pairing.

Order is part of the meaning, so rows carry an ``ordinal`` (an ascending long, another one for each row); ids follow it.
The filters are one conditional expression. For the de-duplication the least ordinal of each key is found first, which
combines before its shuffle, and rows meet it by their own ordinal: no task gets the copies of one sentence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions import text as T

REASONS = ("empty", "duplicate", "word_count", "quality", "no_words", "stored")


#: More sentences than any text of under 2 GB can hold; keys up to 2 ** 33 fit beside them.
PLACES = 1 << 30


def split_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang") -> DataFrame:
    """(ordinal, language, text, translation) of every sentence; ordinal orders by key and place."""
    parts = docs.select(F.col(key).alias("k"), F.col(language).alias("language"), F.posexplode_outer(T.sentences(F.col(text))).alias("place", "text"))
    # of the outer form no test of the array's size is inferred, which would split each text twice
    return parts.filter("place is not null").select((F.col("k") * PLACES + F.col("place")).alias("ordinal"), "language", "text", F.lit(None).cast("string").alias("translation"))


def text_key(text: Column) -> Column:
    return F.lower(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")))


def _cleaned(rows: DataFrame) -> DataFrame:
    return rows.withColumn("text", T.clean(F.col("text"))).withColumn("translation", F.nullif(T.clean(F.col("translation")), F.lit("")))


def _own(cleaned: DataFrame, *limits) -> DataFrame:
    """``cleaned`` with word_count, flags and what a row by itself is skipped for."""
    counted = T.once(cleaned, word_count=T.count_words(F.col("text"), F.col("language")), flags=T.quality_flags(F.col("text")))
    return counted.withColumn("own", reason(*limits))


def _first(cleaned: DataFrame, stored: DataFrame | None) -> DataFrame:
    """(ordinal, known) of each key's first row."""
    keyed = cleaned.groupBy("language", text_key(F.col("text")).alias("key"))
    if stored is None:
        return keyed.agg(F.min("ordinal").alias("ordinal")).select("ordinal", F.lit(False).alias("known"))
    # a key's first row alone may be in the library
    held = stored.select(F.col("language").alias("l"), F.col("full_text").alias("f"), F.lit(True).alias("known")).distinct()
    first = keyed.agg(F.min(F.struct("ordinal", "text")).alias("r")).select("r.ordinal", F.col("language").alias("l"), F.col("r.text").alias("f"))
    return first.join(held, ["l", "f"], "left").select("ordinal", F.coalesce("known", F.lit(False)).alias("known"))


def judge(rows: DataFrame, min_words: int = 4, max_words: int = 15, strict: bool = True, stored: DataFrame | None = None) -> DataFrame:
    """``rows`` cleaned, with word_count, flags and skip_reason (null: accepted).

    A later row of equal text is a duplicate whatever became of the first. ``stored`` has (language, full_text) that
    are in the library already.
    """
    cleaned = _cleaned(rows)
    judged = _own(cleaned, min_words, max_words, strict).join(_first(cleaned, stored), "ordinal", "left")
    why = F.when(F.col("own") == "empty", F.col("own")).when(F.col("known").isNull(), "duplicate").when(F.col("own").isNull() & F.col("known"), "stored").otherwise(F.col("own"))
    return judged.withColumn("skip_reason", why).select(*cleaned.columns, "word_count", "flags", "skip_reason")


def accept(rows: DataFrame, min_words: int = 4, max_words: int = 15, strict: bool = True, stored: DataFrame | None = None, limit: int = 0) -> DataFrame:
    """What ``accepted`` gives of the judged ``rows``; rows that are skipped by themselves stay out of the join."""
    cleaned = _cleaned(rows)
    first = _first(cleaned, stored).filter(~F.col("known")).select("ordinal")
    return accepted(fit(cleaned, min_words, max_words, strict).join(first, "ordinal"), limit)


def fit(cleaned: DataFrame, min_words: int = 4, max_words: int = 15, strict: bool = True) -> DataFrame:
    """Cleaned rows that nothing of their own keeps out, as judged."""
    counted = T.once(cleaned, word_count=T.count_words(F.col("text"), F.col("language"))).filter(F.col("word_count").between(min_words, max_words))
    flagged = T.once(counted, flags=T.quality_flags(F.col("text"))).filter(reason(min_words, max_words, strict).isNull())
    return flagged.withColumn("skip_reason", F.lit(None).cast("string"))


def reason(min_words: int = 4, max_words: int = 15, strict: bool = True, duplicate: Column | None = None, known: Column | None = None) -> Column:
    """Why a cleaned row (text, word_count, flags) isn't taken; null if it is."""
    never = F.lit(False)
    return (
        F.when(F.col("text") == "", "empty")
        .when(never if duplicate is None else duplicate, "duplicate")
        .when(~F.col("word_count").between(min_words, max_words), "word_count")
        .when((F.size("flags") > 0) & F.lit(strict), "quality")
        .when(~F.col("text").rlike("[A-Za-z]") & (~F.col("text").rlike(r"\p{L}") | (F.size(T.forms(F.col("text"))) == 0)), "no_words")  # such a letter stays in a form
        .when(never if known is None else known, "stored")
    )


def accepted(judged: DataFrame, limit: int = 0) -> DataFrame:
    """Sentences (id, language, full_text, translation, word_count, quality_flags); the first ``limit`` in order, if given."""
    out = judged.filter("skip_reason is null").select(F.col("ordinal").alias("id"), "language", F.col("text").alias("full_text"), "translation", "word_count", F.array_join("flags", ",").alias("quality_flags"))
    return out.orderBy("id").limit(limit) if limit else out


def import_metrics(judged: DataFrame, limit: int = 0) -> DataFrame:
    """processed, inserted, skipped, limit_reached; rows after the limit's last one aren't counted."""
    ok = F.col("skip_reason").isNull()
    if limit:
        last = judged.filter(ok).orderBy("ordinal").limit(limit).agg(F.max("ordinal").alias("last"), F.count(F.lit(1)).alias("n"))
        judged = judged.join(F.broadcast(last)).filter((F.col("n") < limit) | (F.col("ordinal") <= F.col("last")))
    inserted = F.sum(ok.cast("long"))
    return judged.agg(F.count(F.lit(1)).alias("processed"), F.coalesce(inserted, F.lit(0)).alias("inserted"), F.coalesce(F.sum((~ok).cast("long")), F.lit(0)).alias("skipped"), F.coalesce((inserted >= limit) if limit else F.lit(False), F.lit(False)).alias("limit_reached"))


def skip_funnel(judged: DataFrame) -> DataFrame:
    return judged.groupBy("language", F.coalesce("skip_reason", F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def pair_translations(targets: DataFrame, natives: DataFrame, links: DataFrame) -> DataFrame:
    """targets (id, language, text) with the first available native text in the order of links (source_id, translation_id, link_order)."""
    own = links.join(targets.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    # only natives that a kept link names are looked at
    linked = natives.join(own.select(F.col("translation_id").alias("id")), "id", "left_semi").select(F.col("id").alias("translation_id"), F.col("text").alias("native"))
    first = own.join(linked, "translation_id").groupBy("source_id").agg(F.min_by("native", "link_order").alias("translation"))
    return targets.join(first.withColumnRenamed("source_id", "id"), "id", "left")


def linked_natives(links: DataFrame) -> DataFrame:
    return links.agg(F.count_distinct("translation_id").alias("linked"))
