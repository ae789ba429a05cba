"""Settings as columns: a raw map of strings becomes typed values within bounds; profiles are merged and upserted as rows.

A raw setting is a text, as forms and files give it; lists are separated by commas, semicolons or line ends. What can't be
read takes its default. Everything works on whole tables of decks or profiles at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions import languages as L

# Defaults of the settings, by kind; choices start with the default.
COUNTS = {"max_due_cards": 20, "candidate_limit": 50, "query_term_limit": 40, "max_new_cards": 10}  # 1 or more
AMOUNTS = {"max_imported_sentences": 100_000, "future_due_days": 0}  # 0 or more
SWITCHES = {
    "require_target_on_question": True, "include_due_cards": True, "include_new_cards": False, "include_learning_cards": True,
    "strict_import_filter": True, "keep_downloaded_archives": False,
}
CHOICES = {"deck_scope": ("current", "configured", "all"), "matching_mode": ("lemma_family", "exact_form"), "target_extraction_mode": ("content_words", "all_words", "first_word")}
TEXTS = {"target_field": "Front", "dictionary_field": "Back"}
WORDS_BETWEEN = (4, 15)
EASES = {"known_ease": 3, "unknown_ease": 1}
FONT = (34, 18, 72)
PROFILE_KEYS = ("name", "profile_name", "deck_name", "deck_names", "match", "match_mode", "enabled")


def _at(raw: Column, name: str) -> Column:
    return F.trim(F.coalesce(F.try_element_at(raw, F.lit(name)), F.lit("")))


def whole(raw: Column, name: str, default: int, least: int = 1) -> Column:
    """A whole number of at least ``least``; the default where it can't be read, or, from 1 on, is less."""
    read = F.coalesce(_at(raw, name).try_cast("int"), F.lit(default))
    return F.when(read > 0, read).otherwise(default) if least == 1 else F.greatest(F.lit(0), read)


def switch(raw: Column, name: str, default: bool) -> Column:
    said = F.lower(_at(raw, name))
    return F.when(said.isin("1", "true", "yes", "on"), True).when(said.isin("0", "false", "no", "off"), False).otherwise(default)


def choice(raw: Column, name: str, allowed: tuple[str, ...]) -> Column:
    said = F.lower(_at(raw, name))
    return F.when(said.isin(*allowed), said).otherwise(allowed[0])


def listed(raw: Column, name: str, separators: str = r"[,;\n]+") -> Column:
    return F.filter(F.transform(F.split(_at(raw, name), separators), lambda x: F.trim(x)), lambda x: x != "")


def normalise(raw: Column) -> Column:
    """A struct of all settings from a map of raw texts."""
    text = lambda n, default: F.coalesce(F.nullif(_at(raw, n), F.lit("")), F.lit(default)).alias(n)
    low, high = (whole(raw, n, d) for n, d in zip(("min_sentence_words", "max_sentence_words"), WORDS_BETWEEN))
    language = L.language_code(_at(raw, "language"))
    query = F.coalesce(F.nullif(_at(raw, "custom_search_query"), F.lit("")), F.when(~F.map_contains_key(raw, F.lit("custom_search_query")), F.nullif(_at(raw, "search_query"), F.lit(""))), F.lit("is:due"))
    return F.struct(
        *[choice(raw, n, c).alias(n) for n, c in CHOICES.items()], *[text(n, d) for n, d in TEXTS.items()], text("deck_name", ""), query.alias("custom_search_query"),
        language.alias("language"), L.language_code(_at(raw, "native_language")).alias("native_language"),
        F.coalesce(F.nullif(_at(raw, "dictionary_url_template"), F.lit("")), F.when(language == "ja", L.dictionary_url("ja")).otherwise(L.dictionary_url(""))).alias("dictionary_url_template"),
        *[whole(raw, n, d).alias(n) for n, d in COUNTS.items()], *[whole(raw, n, d, 0).alias(n) for n, d in AMOUNTS.items()],
        F.least(low, high).alias("min_sentence_words"), F.greatest(low, high).alias("max_sentence_words"),
        *[switch(raw, n, d).alias(n) for n, d in SWITCHES.items()], *[F.least(F.lit(4), whole(raw, n, d)).alias(n) for n, d in EASES.items()],
        F.least(F.lit(FONT[2]), F.greatest(F.lit(FONT[1]), whole(raw, "font_size", FONT[0]))).alias("font_size"),
        listed(raw, "note_types").alias("note_types"), listed(raw, "included_card_templates").alias("included_card_templates"),
        listed(raw, "ignored_target_words", r"[\s,;]+").alias("ignored_target_words"),
    )


def without(raw: Column, keys) -> Column:
    """A map without some keys, given as an array column or as names."""
    names = keys if isinstance(keys, Column) else F.array(*[F.lit(k) for k in keys])
    return F.map_filter(raw, lambda k, v: ~F.array_contains(names, k))


def merged(raw: Column, profile: Column) -> Column:
    """A deck's settings: the profile's go first; one that sets the language and no dictionary clears the dictionary."""
    own = without(profile, PROFILE_KEYS)
    base = without(raw, F.map_keys(own))
    cleared = F.map_contains_key(own, F.lit("language")) & ~F.map_contains_key(own, F.lit("dictionary_url_template"))
    return F.map_concat(F.when(cleared, without(base, ("dictionary_url_template",))).otherwise(base), own)


def upsert_profile(profiles: DataFrame, new: DataFrame) -> DataFrame:
    """``profiles`` (place, deck_name, settings) with ``new`` (deck_name, settings) in the place of the first one for exactly
    its deck, compared without case and spaces around, or behind them all, in order of deck name."""
    key = F.lower(F.trim("deck_name"))
    first = profiles.groupBy(key.alias("key")).agg(F.min("place").alias("place"))
    last = F.broadcast(profiles.agg(F.coalesce(F.max("place"), F.lit(-1)).alias("last")))  # one row
    named = new.withColumn("key", key).withColumn("settings", F.when(F.trim(F.coalesce(F.try_element_at("settings", F.lit("name")), F.lit(""))) != "", F.col("settings")).otherwise(F.map_concat(without(F.col("settings"), ("name",)), F.create_map(F.lit("name"), F.trim("deck_name")))))
    met = named.join(first, "key", "left").join(last)
    added = F.col("last") + F.rank().over(_by_deck(met))
    placed = met.select(F.coalesce("place", added).cast("long").alias("place"), F.trim("deck_name").alias("deck_name"), "settings")
    return profiles.join(placed.select("place"), "place", "left_anti").select(F.col("place").cast("long").alias("place"), "deck_name", "settings").unionByName(placed)


def _by_deck(met: DataFrame):
    from pyspark.sql import Window

    return Window.partitionBy(F.col("place").isNull()).orderBy("key")  # a settings list


def library_path(root: str, path: Column, legacy: str, default: str) -> Column:
    """Where a library lies: an old default is the new one; relative paths stay under ``root``, null if they leave it."""
    plain = F.regexp_replace(F.trim(F.coalesce(path, F.lit(""))), r"\\", "/")
    named = F.when((plain == "") | (F.lower(plain) == legacy.lower()), default).otherwise(plain)
    parts = F.filter(F.split(named, "/"), lambda p: ~p.isin("", "."))
    # how deep each step is below the root: never under it
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("now"), F.lit(0).alias("least")), lambda a, p: F.struct((a["now"] + F.when(p == "..", -1).otherwise(1)).alias("now"), F.least(a["least"], a["now"] + F.when(p == "..", -1).otherwise(1)).alias("least")), lambda a: a["least"])
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    absolute = named.rlike(r"^(/|[A-Za-z]:/|[A-Za-z][A-Za-z0-9+.-]+://)")
    return F.when(absolute, named).when(depth >= 0, F.concat(F.lit(root.rstrip("/") + "/"), F.array_join(kept, "/")))


def preset(detected: DataFrame) -> DataFrame:
    """(confident, settings) from what was detected (target_field, translation_field, audio_field, included_templates,
    target_on_question), besides other columns: nothing is set unless fields and a template were found."""
    sure = (F.col("target_field") != "") & (F.col("translation_field") != "") & (F.size("included_templates") > 0)
    pairs = {
        "target_field": F.col("target_field"), "dictionary_field": F.col("translation_field"), "audio_field": F.col("audio_field"),
        "included_card_templates": F.array_join("included_templates", ", "), "require_target_on_question": F.col("target_on_question").cast("string"),
        "custom_search_query": F.lit("is:due"), "matching_mode": F.lit("lemma_family"), "target_extraction_mode": F.lit("content_words"),
        "min_sentence_words": F.lit(str(WORDS_BETWEEN[0])), "max_sentence_words": F.lit(str(WORDS_BETWEEN[1])),
    }
    chosen = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])
    found = ("target_field", "translation_field", "audio_field", "included_templates", "target_on_question")
    return detected.select(*[c for c in detected.columns if c not in found], F.coalesce(sure, F.lit(False)).alias("confident"), F.when(sure, chosen).otherwise(F.create_map().cast("map<string,string>")).alias("settings"))
