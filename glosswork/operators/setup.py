"""Deck profiles, automatic configuration, and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.functions import languages as L
from glosswork.functions import text as T

# Common English words, and what field names hint at.
ENGLISH_WORDS = """
a about after all also an and answer are as at back be because been before book but by can card cat come day definition do dog down
each english example find first for from get give go good had has have he help her here him his house how i if in into is it know
language learn like look make meaning more my new no not now of on one only or other our out people read review say see sentence she
so some take text than that the their them then there these they thing this time to translation two up use very want was we well what
when which who will with word work would write yes you your
""".split()
TARGET_HINTS = ("front", "target", "word", "expression", "vocabulary", "term", "phrase", "lemma", "plain word", "foreign", "question")
TRANSLATION_HINTS = ("back", "english", "translation", "meaning", "definition", "answer", "gloss", "native")
AUDIO_HINTS = ("audio", "sound", "pronunciation", "voice", "wordaudio")
ALIAS_PREFIXES = ("plain ", "clean ", "normalized ")
SAMPLES, SAMPLE_CHARS = 80, 500


def match_score(candidate: Column, deck: Column, mode: Column) -> Column:
    """How well a profile's deck name fits a deck; -1 if it doesn't."""
    c, d = F.lower(F.trim(candidate)), F.lower(F.trim(deck))
    n = F.length(c)
    exact = F.when(d == c, 10000 + n)
    no = F.lit(-1)
    return (
        F.when((c == "") | (d == ""), no)
        .when(mode == "exact", F.coalesce(exact, no))
        .when(mode == "prefix", F.when(F.startswith(d, c), 5000 + n).otherwise(no))
        .when(mode == "contains", F.when(F.contains(d, c), 1000 + n).otherwise(no))
        .when(mode == "regex", F.when(F.regexp_like(F.trim(deck), F.concat(F.lit("(?i)"), F.trim(candidate))), 100).otherwise(no))
        .otherwise(F.coalesce(exact, F.when(F.startswith(d, F.concat(c, F.lit("::"))), 7000 + n), no))
    )


def match_profiles(decks: DataFrame, profiles: DataFrame) -> DataFrame:
    """(deck, profile, score): the best enabled profile, the earliest of equals. ``profiles``: place, profile, deck_names, match, enabled."""
    side = F.broadcast(profiles.filter("enabled").select("place", "profile", "match", F.explode("deck_names").alias("name")))  # a settings list
    scored = decks.join(side).withColumn("score", match_score(F.col("name"), F.col("deck"), F.col("match"))).filter("score >= 0")
    best = scored.groupBy("deck").agg(F.max_by(F.struct("profile", "score"), F.struct("score", -F.col("place"))).alias("b"))
    return best.select("deck", "b.profile", "b.score")


def _hits(key: Column, hints: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for h in hints:
        out = out | key.contains(h)
    return out


def field_samples(values: DataFrame) -> DataFrame:
    """The first 80 values of each field that aren't blank, cut at 500 characters. values: field, place, value."""
    cleaned = values.withColumn("value", F.substring(T.clean(F.col("value")), 1, SAMPLE_CHARS)).filter("value <> ''")
    turn = F.row_number().over(Window.partitionBy("field").orderBy("place"))
    return cleaned.withColumn("turn", turn).filter(F.col("turn") <= SAMPLES).drop("turn")


def field_scores(fields: DataFrame, samples: DataFrame, language: str, preferred: tuple[str, str] = ("Front", "Back")) -> DataFrame:
    """(field, place, target, translation, audio): how well each field fits each role, but for the choice of target."""
    code = next((k for k, v in L.PROFILES.items() if language in (k, v[1])), language)
    name, three, ignored = L.PROFILES.get(code, (language, language, ()))
    own = tuple({language.lower(), code, name.lower(), three})
    tokens = samples.select("field", F.explode(F.regexp_extract_all(F.lower("value"), F.lit(r"[\p{L}\p{Nl}\p{No}]+"), F.lit(0))).alias("w"))
    ratio = tokens.groupBy("field").agg(F.avg(F.col("w").isin(*ENGLISH_WORDS).cast("double")).alias("english"), F.avg((F.col("w").isin(*ignored) if ignored else F.lit(False)).cast("double")).alias("own"))
    seen = samples.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.max(F.lower("value").contains("[sound:")).alias("sound"))
    rows = fields.join(ratio, "field", "left").join(seen, "field", "left").fillna({"english": 0.0, "own": 0.0, "n": 0, "sound": False}).withColumn("key", T.field_key(F.col("field")))
    rows = rows.withColumn("most", F.max("n").over(Window.partitionBy()))  # a note's fields
    k = F.col("key")
    points = lambda c, p: F.when(c, float(p)).otherwise(0.0)
    target = points(k.isin(*own), 120) + points(_hits(k, own), 70) + points(_hits(k, TARGET_HINTS), 45) - points(_hits(k, TRANSLATION_HINTS), 90) + points(k == preferred[0].lower(), 12)
    if code != "en":
        target = target + F.col("own") * 80 - F.col("english") * 70
    translation = F.when(k.isin(*TRANSLATION_HINTS), 150.0).when(_hits(k, TRANSLATION_HINTS), 70.0).otherwise(0.0) - points(_hits(k, AUDIO_HINTS), 100) + points(k == preferred[1].lower(), 15) + F.when(F.col("most") > 0, 100.0 * F.col("n") / F.col("most")).otherwise(0.0) + F.col("english") * 70
    audio = points(_hits(k, AUDIO_HINTS), 100) + points(F.col("sound"), 150)
    return rows.select("field", "place", target.alias("target"), translation.alias("translation"), audio.alias("audio"))


def choose_fields(scores: DataFrame) -> DataFrame:
    """One row: target, translation (another field) and audio (only with points); the earliest of equals."""
    best = lambda c: F.max_by("field", F.struct(F.col(c), -F.col("place")))
    target = scores.agg(best("target").alias("target_field"))
    rest = scores.join(F.broadcast(target), F.col("field") != F.col("target_field"))
    return target.join(rest.agg(best("translation").alias("translation_field"))).join(scores.agg(F.max(F.struct("audio", -F.col("place"), "field")).alias("a"))).select("target_field", "translation_field", F.when(F.col("a.audio") > 0, F.col("a.field")).otherwise("").alias("audio_field"))


def question_aliases(target: str, fields: list[str]) -> set[str]:
    key = " ".join(target.split()).lower()
    names = {" ".join(f.split()).lower() for f in fields}
    return {key} | {key[len(p) :] for p in ALIAS_PREFIXES if key.startswith(p) and key[len(p) :] in names}


def split_templates(shown: DataFrame, aliases: set[str]) -> DataFrame:
    """(template, cards, included): templates (template, fields, cards) whose question shows the target."""
    return shown.select("template", "cards", F.arrays_overlap(F.transform("fields", lambda f: T.field_key(f)), F.array(*[F.lit(a) for a in sorted(aliases)])).alias("included"))


def field_names(notes: DataFrame) -> DataFrame:
    return notes.select(F.explode(F.map_keys("fields")).alias("field")).distinct()


def _check(name: str, rows: DataFrame, status: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(name).alias("name"), status.alias("status"), detail.alias("detail"))


def library_check(sentences: DataFrame | None, forms: DataFrame | None, word_forms: DataFrame | None, language: str, spark=None) -> DataFrame:
    """One row: an error for missing tables, a warning for nothing to read or a broken index, else what there is."""
    from glosswork.operators.corpus import of_language

    missing = sorted(n for n, t in {"sentences": sentences, "forms": forms, "word_forms": word_forms}.items() if t is None)
    if missing:
        spark = spark or next(t for t in (sentences, forms, word_forms) if t is not None).sparkSession
        return _check("library", spark.range(1), F.lit("error"), F.lit("missing table(s): " + ", ".join(missing)))
    own = of_language(F.col("language"), language)
    translated = own & (F.coalesce("translation", F.lit("")) != "")
    s = sentences.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(own, 1)).alias("own"), F.count(F.when(translated, 1)).alias("translated"))
    one = s.join(forms.agg(F.count(F.lit(1)).alias("indexed"))).join(word_forms.agg(F.count(F.lit(1)).alias("pairs")))  # three rows of counts
    ok = (F.col("own") > 0) & (F.col("indexed") == F.col("total"))
    detail = (
        F.when(F.col("total") == 0, F.lit("no sentences"))
        .when(F.col("own") == 0, F.format_string(f"%d sentences, none of language {language}", "total"))
        .when(F.col("indexed") != F.col("total"), F.format_string("%d sentences, %d in the index", "total", "indexed"))
        .otherwise(F.format_string(f"%d sentences, %d of language {language}, %d translated, %d word forms", "total", "own", "translated", "pairs"))
    )
    return _check("library", one, F.when(ok, "ok").otherwise("warning"), detail)


def settings_check(settings: DataFrame) -> DataFrame:
    """``settings``: one row with s, the settings. Warns of an ease for known and unknown alike and of a scope without a deck."""
    s = F.col("s")
    issues = F.array_compact(F.array(F.when(s["min_sentence_words"] > s["max_sentence_words"], "fewest words exceed most"), F.when(s["known_ease"] == s["unknown_ease"], "known and unknown ease are alike"), F.when((s["deck_scope"] == "configured") & (s["deck_name"] == ""), "configured scope without a deck")))
    fine = F.concat(F.lit("language="), s["language"], F.lit(", field="), s["target_field"], F.lit(", matching="), s["matching_mode"])
    return _check("settings", settings, F.when(F.size(issues) > 0, "warning").otherwise("ok"), F.when(F.size(issues) > 0, F.array_join(issues, "; ")).otherwise(fine))


def host_checks(spark, answers: bool, snapshots: bool, background: bool, log_bytes: int | None) -> DataFrame:
    """What the host offers: answering, undo, work in the background, a log."""
    rows = [
        ("scheduler", "ok" if answers else "error", "native answers" if answers else "no native answers"),
        ("undo", "ok" if snapshots else "error", "snapshots" if snapshots else "no snapshots"),
        ("background", "ok" if background else "warning", "in the background" if background else "imports wait"),
        ("log", "ok", "will be written" if log_bytes is None else f"{log_bytes} bytes"),
    ]
    return spark.createDataFrame(rows, "name string, status string, detail string")


def card_checks(found: DataFrame, target: str, solutions: list[str], allowed: list[str], most: int = 200) -> DataFrame:
    """Three rows on the cards that the due search finds (card_id, found, template, question, fields): whether there are any,
    whether their notes have the fields, and whether questions show the target. The latter two look at the first ``most``."""
    from glosswork.operators.cards import shows_target

    counted = found.agg(F.count(F.lit(1)).alias("n"))
    search = _check("search", counted, F.when(F.col("n") > 0, "ok").otherwise("warning"), F.format_string("%d cards", "n"))
    first = found.orderBy("found", "card_id").limit(most)
    names = first.select(F.explode(F.map_keys("fields")).alias("f")).agg(F.collect_set(F.lower("f")).alias("held"), F.array_join(F.array_sort(F.collect_set("f")), ", ").alias("shown"))
    lost = F.array_join(F.filter(F.array(*[F.lit(s) for s in solutions]) if solutions else F.array().cast("array<string>"), lambda s: ~F.array_contains("held", F.lower(s))), ", ")
    has_target = F.array_contains("held", target.lower())
    fields = _check(
        "fields", names, F.when(F.size("held") == 0, "warning").when(~has_target, "error").when(lost != "", "warning").otherwise("ok"),
        F.when(F.size("held") == 0, "no fields to read").when(~has_target, F.concat(F.lit(f"no field {target} among "), F.col("shown"))).when(lost != "", F.concat(F.lit("missing: "), lost)).otherwise(f"target={target}; solutions={', '.join(solutions)}"),
    )
    sides = first.select("template", shows_target(F.col("question"), target).alias("shown"))
    by_template = sides.groupBy("template").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("shown"), 1)).alias("on"))
    told = by_template.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("on"), F.lit(0)).alias("on"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("template", "n"))), lambda x: F.format_string("%s=%d", x["template"], x["n"])), ", ").alias("all"))
    off = F.col("n") - F.col("on")
    directions = _check(
        "directions", told, F.when((F.col("n") == 0) | ((off > 0) & F.lit(not allowed)), "warning").otherwise("ok"),
        F.when(F.col("n") == 0, "no cards to inspect").otherwise(F.concat(F.format_string("%d show the target, %d do not; templates: ", F.col("on"), off), F.col("all"), F.lit(f"; included: {', '.join(allowed)}" if allowed else ""))),
    )
    return search.unionByName(fields).unionByName(directions)


def diagnostics(settings: DataFrame, library: DataFrame, host: DataFrame, cards: DataFrame) -> DataFrame:
    """(name, status, detail) of all nine checks; see the functions that make each."""
    return settings_check(settings).unionByName(library).unionByName(host).unionByName(cards)


def report(checks: DataFrame) -> DataFrame:
    """One row: whether no check is an error, whether any warns."""
    return checks.agg((F.count(F.when(F.col("status") == "error", 1)) == 0).alias("ok"), (F.count(F.when(F.col("status") == "warning", 1)) > 0).alias("warnings"))
