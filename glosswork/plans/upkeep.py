"""Queries on cards and notes, answers, sessions, settings and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.operators import answers as A
from glosswork.operators import cards as C
from glosswork.operators import ingest as I
from glosswork.operators import schedule as P
from glosswork.operators import selection as Q
from glosswork.operators import sessions as E
from glosswork.operators import settings as G
from glosswork.operators import setup as U
from glosswork.plans.catalog import answered, card_table, entry, indexed, library, ranked, table, targets, word_pairs
from glosswork.plans.pieces import NOW, TODAY, USN, sql
from glosswork.sources import sinks as W

# ---- cards, notes and templates


def _host(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cards, notes and note types as a host has them: every seventh card has no note, every fifth asks for no template."""
    i = F.col("item_id")
    b = table(spark, sf, "benchmark")
    cards = b.select(i.alias("card_id"), (i * 10).alias("nid"), F.when(i % 5 == 4, 3).otherwise(i % 2).alias("ord"))
    notes = b.filter(i % 7 != 6).select((i * 10).alias("nid"), (i % 2).alias("mid"), F.create_map(F.lit("Front"), F.col("text"), F.lit("Back"), F.concat(F.lit("meaning "), i)).alias("fields"))
    face = lambda name, q: F.struct(F.lit(name).alias("name"), F.lit(q).alias("qfmt"), F.lit("{{FrontSide}}").alias("afmt"))
    both = F.array(face("Read", "{{Front}}"), face("", "{{Back}}"))
    kinds = spark.range(2).select(F.col("id").alias("mid"), F.when(F.col("id") == 0, "Basic").otherwise("Other").alias("name"), both.alias("templates"))
    return cards, notes, kinds


@entry("""SELECT card_id, CASE WHEN lost THEN '' WHEN card_id % 2 = 0 THEN 'Basic' ELSE 'Other' END AS note_type, CASE WHEN NOT lost AND ord = 0 THEN 'Read' ELSE 'Card ' || ord + 1 END AS template,
CASE WHEN lost OR ord > 1 THEN '' WHEN ord = 0 THEN '{{Front}}' ELSE '{{Back}}' END AS question, CASE WHEN lost THEN NULL ELSE text END AS front FROM (SELECT item_id AS card_id, text, item_id % 7 = 6 AS lost, CASE WHEN item_id % 5 = 4 THEN 3 ELSE item_id % 2 END AS ord FROM benchmark)""")
def card_rows(spark, sf):
    return C.card_rows(*_host(spark, sf)).select("card_id", "note_type", "template", "question", F.try_element_at("fields", F.lit("Front")).alias("front"))


_SPECS = [("Picture", "", "auto", True), ("back", "Meaning", "text", False), ("Sound", "", "auto", True), ("None", "", "auto", False)]


@entry("""SELECT card_id, field, label, display, text, media, autoplay FROM (
SELECT item_id AS card_id, 'Picture' AS field, 'Picture' AS label, 'image' AS display, '' AS text, 'p' || item_id || '.png' AS media, false AS autoplay FROM benchmark WHERE item_id % 3 = 0
UNION ALL SELECT item_id, 'Picture', 'Picture', 'text', 'no & picture', '', false FROM benchmark WHERE item_id % 3 <> 0
UNION ALL SELECT item_id, 'back', 'Meaning', 'text', 'meaning ' || item_id, '', false FROM benchmark
UNION ALL SELECT item_id, 'Sound', 'Sound', 'audio', '', 's' || item_id || '.mp3', true FROM benchmark WHERE item_id % 4 = 0)""")
def solution_fields(spark, sf):
    i = F.col("item_id")
    picture = F.when(i % 3 == 0, F.concat(F.lit('<img src="p'), i, F.lit('.png">'))).otherwise("<b>no &amp; picture</b>")
    sound = F.when(i % 4 == 0, F.concat(F.lit("[sound:s"), i, F.lit(".mp3]"))).otherwise(" ")
    fields = F.create_map(F.lit("Picture"), picture, F.lit("Back"), F.concat(F.lit("meaning "), i), F.lit("Sound"), sound)
    shown = table(spark, sf, "benchmark").select(i.alias("card_id"), F.explode(C.solution_values(fields, _SPECS)).alias("s")).select("card_id", "s.*")
    return shown.withColumn("media", F.array_join("media", ","))


@entry(sql("SELECT card_id, match_key, row_number() OVER (ORDER BY priority DESC, due_in_days, card_id, match_key) AS place FROM targets", "targets"))
def due_order(spark, sf):
    return C.in_due_order(targets(spark, sf)).select("card_id", "match_key", "place")


@entry(sql("SELECT coalesce(CASE WHEN outcome = 'target_not_on_question' THEN 'card_template' ELSE outcome END, 'kept') AS outcome, count(*) AS n FROM (SELECT CASE WHEN ord = 1 AND (outcome IN ('target_field', 'target_not_on_question', 'new_card_limit') OR outcome IS NULL) THEN 'card_template' ELSE outcome END AS outcome FROM judged_cards) GROUP BY ALL", "judged_cards"))
def template_filter(spark, sf):
    return C.skip_reasons(C.judge_cards(card_table(spark, sf), TODAY, future_days=10, note_types=("Basic",), allowed=("card 1",), max_new=3))


# ---- selection


@entry(sql("SELECT id, cards FROM ranked WHERE id NOT IN (SELECT id FROM ranked ORDER BY cards DESC, round(score, 9) DESC, round(bm25, 9), word_count, id LIMIT 3) ORDER BY cards DESC, round(score, 9) DESC, round(bm25, 9), word_count, id LIMIT 1", "ranked"))
def select_task_shown(spark, sf):
    """The best sentence once the three best have been shown."""
    rounded = lambda df: df.withColumn("score", F.round("score", 9)).withColumn("bm25", F.round("bm25", 9))
    rows = W.written(rounded(ranked(spark, sf)), f"{W.scratch_folder(spark)}/ranked")  # one search for both
    best = [r.id for r in rows.orderBy(*Q.best_first()).select("id").limit(3).collect()]
    return Q.select_task(Q.unshown(rows, best)).select("id", "cards")


@entry("SELECT count(DISTINCT doc_id + k) AS linked FROM documents, (VALUES (1), (2), (3)) t(k) WHERE lang = 'de'")
def linked_natives(spark, sf):
    d = table(spark, sf, "documents").filter("lang = 'de'")
    return I.linked_natives(d.select(F.explode(F.array(*[F.col("doc_id") + k for k in (1, 2, 3)])).alias("translation_id")))


@entry("SELECT user_id AS owner, 50 + least(count(DISTINCT event_id), 200) AS most FROM events GROUP BY user_id")
def inflated_limits(spark, sf):
    counts = table(spark, sf, "events").groupBy(F.col("user_id").alias("owner")).agg(F.count_distinct("event_id").alias("n"))
    return counts.select("owner", E.inflated_limit(50, F.col("n")).cast("long").alias("most"))


# ---- answers


@entry(sql(f"SELECT 'contextual' AS path, card_id, factor, ivl, type, id FROM stepped JOIN (SELECT card_id AS c, list_extract(free, row_number() OVER (ORDER BY card_id)) AS id FROM stepped, (SELECT list(x ORDER BY x) AS free FROM (SELECT unnest(generate_series({NOW}000, {NOW}000 + 4000)) AS x) WHERE x % 3 <> 1)) ON c = card_id", "stepped"))
def answer_fallback(spark, sf):
    """The host's path fails before its first card, so the contextual one writes; ids of a third of the log are taken."""
    cards = card_table(spark, sf).filter("odid = 0").withColumn("left", F.lit(0))
    plan = cards.select("card_id", F.when(F.col("card_id") % 3 == 0, 1).otherwise(3).alias("ease"), (F.col("card_id") % 3 == 0).alias("is_unknown"))

    def host(asked):
        raise A.PartlyAnswered("no scheduler", [])

    taken = spark.range(4000).select((F.col("id") + NOW * 1000).alias("id")).filter("id % 3 = 1")
    done = A.answer(plan, cards, TODAY, NOW, USN, host, taken)
    return done.cards.join(done.log.select(F.col("cid").alias("card_id"), "id"), "card_id").select(F.lit(done.path).alias("path"), "card_id", "factor", "ivl", "type", "id")


@entry(sql(f"SELECT {NOW}000 + row_number() OVER (ORDER BY card_id) - 1 AS id, card_id AS cid FROM stepped QUALIFY card_id % 2 = 0", "stepped"))
def revlog_undo(spark, sf):
    """The log once the answers of odd cards are taken back."""
    log = P.log_rows(answered(spark, sf), NOW)
    return P.without_log(log, log.filter("cid % 2 = 1")).select("id", "cid")


@entry("""SELECT card_id, max(k IN ('k1', 'k4') OR card_id % 9 = 0) AS is_unknown, array_to_string(list_sort(list_distinct(list(k))), ',') AS keys FROM (SELECT user_id AS card_id, 'k' || event_id % 6 AS k FROM events) GROUP BY card_id""")
def answer_plan_unknown(spark, sf):
    """A plan in which some words and some cards are unknown."""
    e = table(spark, sf, "events")
    flat = e.select(F.concat(F.lit("k"), F.col("event_id") % 6).alias("key"), F.array("user_id").alias("card_ids"))
    return P.answer_plan(flat, ["k1", "k4"], e.select(F.col("user_id").alias("card_id")).filter("card_id % 9 = 0")).select("card_id", "is_unknown", F.array_join("keys", ",").alias("keys"))


# ---- sessions


@entry("""SELECT owner, words, 'Reviewed ' || cards || ' card' || CASE WHEN cards = 1 THEN '' ELSE 's' END || ' across ' || sentences || ' sentence' || CASE WHEN sentences = 1 THEN '' ELSE 's' END || '. Remembered: ' || cards - forgotten || '. Forgotten: ' || forgotten || '.' || CASE WHEN words = '' THEN '' ELSE chr(10) || chr(10) || 'Forgotten words:' || chr(10) || '- ' || replace(words, ',', chr(10) || '- ') END AS text FROM (
SELECT owner, sum(answered)::BIGINT AS cards, count(*) AS sentences, sum(unknown)::BIGINT AS forgotten, coalesce(string_agg(w, ',' ORDER BY first) FILTER (w <> '' AND first = event_id), '') AS words
FROM (SELECT *, CASE WHEN unknown = 1 THEN 'w' || event_id % 5 ELSE '' END AS w, min(event_id) FILTER (unknown = 1) OVER (PARTITION BY owner, event_id % 5) AS first FROM (SELECT user_id AS owner, event_id, event_id % 4 + 1 AS answered, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS unknown FROM events)) GROUP BY owner)""")
def forgotten_words(spark, sf):
    unknown = F.col("event_type") == "error"
    e = table(spark, sf, "events").select(F.col("user_id").alias("owner"), F.col("event_id").alias("seq"), (F.col("event_id") % 4 + 1).alias("answered"), unknown.cast("long").alias("unknown"), F.when(unknown, F.array(F.concat(F.lit("w"), F.col("event_id") % 5))).otherwise(F.array().cast("array<string>")).alias("words"))
    return E.session_summary(e).select("owner", F.array_join("words", ",").alias("words"), "text")


@entry("""SELECT owner, id, row_number() OVER (PARTITION BY owner ORDER BY saved_at DESC, id) AS place FROM (SELECT user_id AS owner, event_id % 50 AS id, max(ts) AS saved_at FROM events WHERE event_type = 'click' GROUP BY ALL HAVING count(*) % 2 = 1) WHERE id % 2 = 0 AND id % 3 = 1""")
def favorites_listed(spark, sf):
    """Favourites of one library and language, the newest first."""
    e = table(spark, sf, "events").filter("event_type = 'click'")
    saved = E.favourites(e.select(F.col("user_id").alias("owner"), (F.col("event_id") % 50).alias("id"), "ts"))
    saved = saved.withColumn("database_path", F.when(F.col("id") % 2 == 0, "/Lib/A").otherwise("/lib/b")).withColumn("language", F.when(F.col("id") % 3 == 1, "deu").otherwise("en-GB"))
    return E.newest_first(E.favourites_of(saved, "/lib/a", "de_AT")).select("owner", "id", "place")


@entry("""SELECT event_id AS name FROM (SELECT event_id, used, sum(CASE WHEN used >= latest - 86400 THEN event_id % 97 + 1 END) OVER (ORDER BY used DESC, event_id DESC) AS held, latest FROM (SELECT event_id, floor(epoch(ts))::BIGINT AS used, max(floor(epoch(ts))::BIGINT) OVER () AS latest FROM events)) WHERE used < latest - 86400 OR held > 20000""")
def cache_eviction(spark, sf):
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    e = table(spark, sf, "events").select(F.col("event_id").alias("name"), at.alias("used_at"), (F.col("event_id") % 97 + 1).alias("size"))
    latest = e.agg(F.max("used_at")).first()[0]
    return E.evict(e, latest, 86400, 20000).select("name")


# ---- settings and setup


@entry("""SELECT event_id, least(low, high) AS min_words, greatest(low, high) AS max_words, greatest(18, least(72, CASE WHEN event_id % 100 > 0 THEN event_id % 100 ELSE 34 END)) AS font, event_type IN ('view') AS new_cards, least(4, CASE WHEN event_id % 7 > 0 THEN event_id % 7 ELSE 3 END) AS ease,
CASE WHEN event_id % 3 = 0 THEN 'all' ELSE 'current' END AS scope FROM (SELECT *, CASE WHEN event_id % 20 > 0 THEN event_id % 20 ELSE 4 END AS low, CASE WHEN user_id % 15 > 0 THEN user_id % 15 ELSE 15 END AS high FROM events)""")
def settings_bounds(spark, sf):
    """Settings read from text, brought within bounds."""
    i = F.col("event_id")
    text = lambda c: F.concat(F.lit(" "), c.cast("string"))
    raw = F.create_map(F.lit("min_sentence_words"), text(i % 20), F.lit("max_sentence_words"), text(F.col("user_id") % 15), F.lit("font_size"), text(i % 100), F.lit("include_new_cards"), F.when(F.col("event_type") == "view", "Yes").otherwise("maybe"), F.lit("known_ease"), text(i % 7), F.lit("deck_scope"), F.when(i % 3 == 0, " ALL").otherwise("elsewhere"))
    s = G.normalise(F.col("raw"))
    return table(spark, sf, "events").select("event_id", raw.alias("raw")).select("event_id", s.alias("s")).select("event_id", F.col("s.min_sentence_words").alias("min_words"), F.col("s.max_sentence_words").alias("max_words"), F.col("s.font_size").alias("font"), F.col("s.include_new_cards").alias("new_cards"), F.col("s.known_ease").alias("ease"), F.col("s.deck_scope").alias("scope"))


@entry("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'fr' ELSE 'en' END AS language, CASE WHEN event_id % 4 = 0 AND event_id % 8 <> 0 THEN '' WHEN event_id % 8 = 0 THEN 'http://p' ELSE 'http://g' END AS dictionary, '20' AS due, 0 AS meta FROM events""")
def profile_merge(spark, sf):
    i = F.col("event_id")
    base = F.create_map(F.lit("language"), F.lit("en"), F.lit("dictionary_url_template"), F.lit("http://g"), F.lit("max_due_cards"), F.lit("20"))
    own = F.when(i % 8 == 0, F.create_map(F.lit("name"), F.lit("P"), F.lit("language"), F.lit("fr"), F.lit("dictionary_url_template"), F.lit("http://p"))).when(i % 4 == 0, F.create_map(F.lit("enabled"), F.lit("true"), F.lit("language"), F.lit("fr"))).otherwise(F.create_map(F.lit("deck_name"), F.lit("D")))
    m = table(spark, sf, "events").select("event_id", G.merged(base, own).alias("m"))
    at = lambda n: F.coalesce(F.try_element_at("m", F.lit(n)), F.lit(""))
    return m.select("event_id", at("language").alias("language"), at("dictionary_url_template").alias("dictionary"), at("max_due_cards").alias("due"), F.size(F.filter(F.map_keys("m"), lambda k: k.isin(*G.PROFILE_KEYS))).alias("meta"))


@entry("""SELECT n_nationkey AS place, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS deck_name, CASE WHEN n_nationkey % 2 = 0 THEN 'new' || n_nationkey ELSE 'old' END AS v, CASE WHEN n_nationkey % 4 = 0 THEN 'named' WHEN n_nationkey % 4 = 2 THEN lower(n_name) END AS name FROM nation
UNION ALL SELECT (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY lower(r_name)), r_name, 'new', r_name FROM region""")
def profile_upsert(spark, sf):
    """Profiles of nations' decks, every second one given anew under its name in other letters, and regions' behind them."""
    n, i, r = table(spark, sf, "nation"), F.col("n_nationkey"), table(spark, sf, "region")
    held = n.select(i.alias("place"), F.col("n_name").alias("deck_name"), F.create_map(F.lit("v"), F.lit("old")).alias("settings"))
    again = n.filter("n_nationkey % 2 = 0").select(F.concat(F.lit(" "), F.lower("n_name"), F.lit(" ")).alias("deck_name"), F.create_map(F.lit("v"), F.concat(F.lit("new"), i), F.lit("name"), F.when(i % 4 == 0, "named").otherwise(" ")).alias("settings"))
    more = r.select(F.col("r_name").alias("deck_name"), F.create_map(F.lit("v"), F.lit("new")).alias("settings"))
    at = lambda k: F.try_element_at("settings", F.lit(k)).alias(k)
    return G.upsert_profile(held, again.unionByName(more)).select("place", "deck_name", at("v"), at("name"))


@entry("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN '/home/lib/default.db' WHEN 1 THEN '/home/lib/default.db' WHEN 2 THEN '/home/lib/x/' || event_id WHEN 3 THEN NULL WHEN 4 THEN '/abs/' || event_id ELSE '/home/lib/b' END AS path FROM events""")
def library_paths(spark, sf):
    i = F.col("event_id")
    raw = F.when(i % 6 == 0, " ").when(i % 6 == 1, "OLD\\corpus.db").when(i % 6 == 2, F.concat(F.lit("x/./"), i)).when(i % 6 == 3, "a/../../secret").when(i % 6 == 4, F.concat(F.lit("/abs/"), i)).otherwise("a/../b")
    return table(spark, sf, "events").select("event_id", G.library_path("/home/lib", raw, "old/corpus.db", "default.db").alias("path"))


@entry("""SELECT event_id, event_id % 4 < 2 AS confident, CASE WHEN event_id % 4 < 2 THEN 10 ELSE 0 END AS settings, CASE WHEN event_id % 4 < 2 THEN 'Read' || user_id || ', Hear' END AS templates, CASE WHEN event_id % 4 < 2 THEN event_type END AS audio FROM events""")
def setup_preset(spark, sf):
    """Settings from what was detected of each row: all, no target field, or no template."""
    k = F.col("event_id") % 4
    some = F.array(F.concat(F.lit("Read"), "user_id"), F.lit("Hear"))
    d = table(spark, sf, "events").select(
        "event_id", F.when(k == 2, "").otherwise("Word").alias("target_field"), F.lit("Back").alias("translation_field"), F.col("event_type").alias("audio_field"),
        F.when(k == 3, F.array().cast("array<string>")).otherwise(some).alias("included_templates"), (k == 0).alias("target_on_question"))
    at = lambda n: F.try_element_at("settings", F.lit(n))
    return G.preset(d).select("event_id", "confident", F.size("settings").alias("settings"), at("included_card_templates").alias("templates"), at("audio_field").alias("audio"))


@entry(sql("""SELECT 'settings' AS name, 'warning' AS status, 'known and unknown ease are alike' AS detail
UNION ALL SELECT 'library', CASE WHEN t = f THEN 'ok' ELSE 'warning' END, t || ' sentences, ' || o || ' of language en, ' || tr || ' translated, ' || w || ' word forms' FROM (SELECT (SELECT count(*) FROM sentences) AS t, (SELECT count(*) FROM forms) AS f, (SELECT count(*) FROM sentences WHERE language = 'en') AS o, (SELECT count(*) FROM sentences WHERE language = 'en' AND word_count > 8) AS tr, (SELECT count(*) FROM word_forms) AS w)
UNION ALL SELECT * FROM (VALUES ('scheduler', 'error', 'no native answers'), ('undo', 'ok', 'snapshots'), ('background', 'warning', 'imports wait'), ('log', 'ok', '12 bytes'))
UNION ALL SELECT 'search', 'ok', count(*) || ' cards' FROM cards WHERE (queue IN (2, 3) OR type = 2) AND due <= 100
UNION ALL SELECT 'fields', 'warning', 'missing: Audio'
UNION ALL SELECT 'directions', 'warning', count(*) FILTER (ord = 0) || ' show the target, ' || count(*) FILTER (ord = 1) || ' do not; templates: Card 1=' || count(*) FILTER (ord = 0) || ', Reverse=' || count(*) FILTER (ord = 1) FROM (SELECT * FROM cards WHERE (queue IN (2, 3) OR type = 2) AND due <= 100 ORDER BY found, card_id LIMIT 200)""", "sentences", "forms", "word_forms", "cards"))
def diagnostics(spark, sf):
    """All nine checks: settings, library, what the host offers, and the cards that the due search finds."""
    raw = spark.range(1).select(G.normalise(F.create_map(F.lit("known_ease"), F.lit("2"), F.lit("unknown_ease"), F.lit("2"))).alias("s"))
    s = library(spark, sf).withColumn("translation", F.when(F.col("word_count") > 8, F.col("full_text")))
    shelf = U.library_check(s, indexed(spark, sf), word_pairs(spark, sf), "en")
    found = card_table(spark, sf).filter(f"(queue in (2, 3) or type = 2) and due <= {TODAY}")
    return U.diagnostics(raw, shelf, U.host_checks(spark, False, True, False, 12), U.card_checks(found, "Front", ["Back", "Audio"], []))
