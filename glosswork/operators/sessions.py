"""What a learner has seen: recency, summaries, progress, favourites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.functions import languages as L


def recent(events: DataFrame, keep: int = 200) -> DataFrame:
    """(owner, id, place): the last ``keep`` distinct ids by their last time, oldest first. events: owner, id, ts, seq."""
    last = events.filter("id > 0").groupBy("owner", "id").agg(F.max(F.struct("ts", "seq")).alias("at"))
    newest = last.withColumn("r", F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("at"), F.desc("id")))).filter(F.col("r") <= keep)
    return newest.withColumn("place", F.row_number().over(Window.partitionBy("owner").orderBy("at", "id"))).select("owner", "id", "place")


def sanitised(ids: Column, keep: int = 200) -> Column:
    """Stored ids as they can be used: whole numbers over 0, each where it came first, the last ``keep`` of them."""
    numbers = F.array_distinct(F.filter(F.transform(ids, lambda i: F.trim(i).try_cast("long")), lambda i: i > 0))
    return F.slice(numbers, F.greatest(F.size(numbers) - keep, F.lit(0)) + 1, F.lit(keep))


def inflated_limit(base: int, avoided: int | Column) -> int | Column:
    """How many candidates to ask for when some sentences are to be avoided."""
    return F.least(avoided, F.lit(200)) + base if isinstance(avoided, Column) else base + min(avoided, 200)


def session_summary(results: DataFrame) -> DataFrame:
    """(owner, cards, sentences, forgotten, remembered, words, text) from (owner, answered, unknown) rows, one for each
    sentence; with a column ``words`` (and ``seq``), the distinct forgotten words in order end the text."""
    with_words = "words" in results.columns
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", "words"))), lambda x: x["words"]) if with_words else F.array().cast("array<array<string>>")
    s = results.groupBy("owner").agg(F.sum("answered").alias("cards"), F.count(F.lit(1)).alias("sentences"), F.sum("unknown").alias("forgotten"), *([listed.alias("all")] if with_words else []))
    words = F.filter(F.array_distinct(F.flatten("all")), lambda w: F.trim(w) != "") if with_words else F.array().cast("array<string>")
    s = s.withColumn("remembered", F.col("cards") - F.col("forgotten")).withColumn("words", words)
    plural = lambda n, w: F.concat(F.col(n).cast("string"), F.lit(f" {w}"), F.when(F.col(n) == 1, "").otherwise("s"))
    text = F.concat(F.lit("Reviewed "), plural("cards", "card"), F.lit(" across "), plural("sentences", "sentence"), F.lit(". Remembered: "), F.col("remembered").cast("string"), F.lit(". Forgotten: "), F.col("forgotten").cast("string"), F.lit("."))
    more = F.when(F.size("words") > 0, F.concat(F.lit("\n\nForgotten words:\n- "), F.array_join("words", "\n- "))).otherwise("")
    return s.select("owner", "cards", "sentences", "forgotten", "remembered", "words", F.concat(text, more).alias("text"))


def today_progress(reviewed: DataFrame, goal: DataFrame) -> DataFrame:
    """done and total: distinct goal cards that were reviewed, and how many there are."""
    wanted = goal.select("card_id").distinct()
    done = wanted.join(reviewed.select("card_id").distinct().withColumn("seen", F.lit(1)), "card_id", "left")
    return done.agg(F.count("seen").alias("done"), F.count(F.lit(1)).alias("total"))


def favourites(events: DataFrame) -> DataFrame:
    """(owner, id, saved_at): ids toggled an odd number of times, with the last toggle. ``newest_first`` orders them."""
    s = events.groupBy("owner", "id").agg(F.count(F.lit(1)).alias("toggles"), F.max("ts").alias("saved_at"))
    return s.filter("toggles % 2 = 1").select("owner", "id", "saved_at")


def favourites_of(saved: DataFrame, path: str = "", language: str = "") -> DataFrame:
    """Favourites (database_path, language, saved_at, ...) of one library, whatever the case of its path, and one language."""
    if path:
        saved = saved.filter(F.lower(F.coalesce("database_path", F.lit(""))) == path.lower())
    if language:
        saved = saved.filter(L.language_code(F.col("language")) == L.language_code(F.lit(language)))
    return saved


def newest_first(saved: DataFrame, by: str = "owner") -> DataFrame:
    """``saved`` with each owner's place by time, the newest first, then by id."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("saved_at"), "id"))
    return saved.withColumn("place", place.cast("long"))


def speech_key(voice: Column, text: Column) -> Column:
    """The name under which spoken text is cached."""
    return F.sha2(F.concat(F.lit("edge-tts-v1"), F.lit("\0"), voice, F.lit("\0"), text), 256)


def favourite_key(path, id_):
    return F.sha2(F.concat(path, F.lit("\0"), id_.cast("string")), 256)


def evict(entries: DataFrame, now: int, max_age_s: int = 7 * 86400, max_bytes: int = 100 << 20) -> DataFrame:
    """Cache entries (name, used_at, size) that go: too old, then oldest until the rest fits.

    Sizes add up by hours first, of which an age has a bounded number, and then inside each hour.
    """
    young = entries.filter(F.col("used_at") >= now - max_age_s).withColumn("hour", F.expr("used_at div 3600"))
    hours = young.groupBy("hour").agg(F.sum("size").alias("held"))
    newer = hours.select("hour", F.coalesce(F.sum("held").over(Window.orderBy(F.desc("hour")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("newer"))
    inside = F.sum("size").over(Window.partitionBy("hour").orderBy(F.desc("used_at"), F.desc("name")).rowsBetween(Window.unboundedPreceding, 0))
    kept = young.withColumn("upto", inside).join(newer, "hour").filter(F.col("newer") + F.col("upto") <= max_bytes)
    return entries.join(kept.select("name"), "name", "left_anti")
