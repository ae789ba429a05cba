"""Collecting due targets: query text, search predicates, ordered filters with reasons, explosion, limits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.functions import html as H
from glosswork.functions import scheduling as S
from glosswork.functions import text as T

FALLBACK_FIELDS = ("Back", "Definition", "Meaning", "Translation", "English", "Native", "Answer")


TERM = r'(?:[^\s"\\]|\\.|"(?:[^"\\]|\\.)*"?)+'


def search_terms(query: str) -> list[str]:
    """Terms of a search, split at white space outside quotes; a backslash keeps the next character."""
    return re.findall(TERM, query)


def terms_of(query: Column) -> Column:
    """``search_terms`` of a column."""
    return F.regexp_extract_all(query, F.lit(TERM), F.lit(0))


def without_due(query: str) -> str:
    return " ".join(t for t in search_terms(query) if t.lower() != "is:due")


def deck_scope(scope: str, current: str, configured: str = "") -> str:
    name = {"current": current, "configured": configured or current}.get(scope, "")
    return 'deck:"%s"' % name.replace("\\", "\\\\").replace('"', '\\"') if name else ""


def due_query(custom: str, use_due: bool, use_new: bool, scope: str) -> str:
    """The search for cards that are due, or new, or both."""
    rest = without_due(custom)
    parts = ["(%s)" % custom] if use_due and custom else []
    if use_new:
        parts.append("(%s)" % " ".join(filter(None, ["is:new", rest])))
    text = "nid:0" if not parts else parts[0] if len(parts) == 1 else "(%s)" % " OR ".join(parts)
    if not use_new and "-is:new" not in text and parts:
        text += " -is:new"
    return " ".join(filter(None, [text, scope]))


def deck_scope_of(scope: Column, current: Column, configured: Column) -> Column:
    """``deck_scope`` of columns."""
    name = F.when(scope == "current", current).when(scope == "configured", F.coalesce(F.nullif(configured, F.lit("")), current)).otherwise("")
    quoted = F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(F.coalesce(name, F.lit("")) == "", "").otherwise(F.concat(F.lit('deck:"'), quoted, F.lit('"')))


def due_query_of(custom: Column, use_due: Column, use_new: Column, scope: Column) -> Column:
    """``due_query`` of columns, a search for each row of settings."""
    rest = F.array_join(F.filter(terms_of(custom), lambda t: F.lower(t) != "is:due"), " ")
    due = F.when(use_due & (custom != ""), F.concat(F.lit("("), custom, F.lit(")")))
    new = F.when(use_new, F.concat(F.lit("(is:new"), F.when(rest != "", F.concat(F.lit(" "), rest)).otherwise(""), F.lit(")")))
    text = F.when(due.isNotNull() & new.isNotNull(), F.concat(F.lit("("), due, F.lit(" OR "), new, F.lit(")"))).otherwise(F.coalesce(due, new, F.lit("nid:0")))
    seen = F.when(~use_new & due.isNotNull() & ~F.contains(text, F.lit("-is:new")), F.concat(text, F.lit(" -is:new"))).otherwise(text)
    return F.when(scope != "", F.concat(seen, F.lit(" "), scope)).otherwise(seen)


def future_query(custom: str, days: int, scope: str) -> str:
    """The search for cards due within ``days`` with the filter's other terms."""
    if days <= 0:
        return ""
    inner = " ".join(filter(None, [f"prop:due<={days}", without_due(custom)]))
    return " ".join(filter(None, [f"({inner}) -is:new", scope]))


def predicate(query: str, today: int, columns: dict[str, Column]) -> Column:
    """A search as a column over queue, type, due, ord, template, deck, tags, nid. Bad terms raise ValueError."""
    tokens = re.findall(r'[()]|(?:[^\s()"\\]|\\.|"(?:[^"\\]|\\.)*"?)+', query)
    state = S.card_state(columns["queue"], columns["type"])

    def term(t: str) -> Column:
        if t.startswith("-"):
            return ~term(t[1:])
        key, _, value = t.partition(":")
        value = value.replace('\\"', "\x00").strip('"').replace("\x00", '"')
        if key == "is":
            learning = columns["queue"].isin(1, 3) | columns["type"].isin(1, 3)
            known = {"new": state == S.NEW, "learn": learning, "due": (S.is_review(columns["queue"], columns["type"]) & (columns["due"] <= today)) | learning}
            if value in known:
                return known[value]
        elif key == "card":
            return columns["ord"] == int(value) - 1 if value.isdigit() else F.lower(columns["template"]) == value.lower()
        elif key == "deck":
            return (F.lower(columns["deck"]) == value.lower()) | F.lower(columns["deck"]).startswith(value.lower() + "::")
        elif key == "tag":
            return F.array_contains(columns["tags"], value)
        elif key == "nid":
            return columns["nid"] == int(value)
        elif key == "prop" and (m := re.fullmatch(r"due<=(-?\d+)", value)):
            return S.is_review(columns["queue"], columns["type"]) & (S.days_until(columns["due"], today) <= int(m[1]))
        raise ValueError(f"unknown search term {t!r}")

    def either(at: int) -> tuple[Column, int]:
        left, at = both(at)
        while at < len(tokens) and tokens[at] == "OR":
            right, at = both(at + 1)
            left = left | right
        return left, at

    def both(at: int) -> tuple[Column, int]:
        out = None
        while at < len(tokens) and tokens[at] not in (")", "OR"):
            if tokens[at] == "(":
                one, end = either(at + 1)
                at = end + 1
            else:
                one, at = term(tokens[at]), at + 1
            out = one if out is None else out & one
        return (F.lit(True) if out is None else out), at

    return either(0)[0]


def lookup(fields: Column, name: Column) -> Column:
    """A note's field by its exact name, else by one that compares equal."""
    alike = F.map_values(F.map_filter(fields, lambda k, v: T.field_key(k) == T.field_key(name)))
    return F.coalesce(F.try_element_at(fields, name), F.get(alike, F.lit(0)))


def definition(fields: Column, target: str, dictionary_field: str = "") -> Column:
    """The first of the usual fields that isn't blank, else any other than the target."""
    named = [F.nullif(F.trim(lookup(fields, F.lit(n))), F.lit("")) for n in (dictionary_field, *FALLBACK_FIELDS) if n]
    other = F.filter(F.map_values(F.map_filter(fields, lambda k, v: T.field_key(k) != T.field_key(F.lit(target)))), lambda v: F.trim(v) != "")
    return F.coalesce(*named, F.get(other, F.lit(0)), F.lit(""))


def shows_target(question: Column, target: str) -> Column:
    """Whether a template's question side shows the field; a blank field name is always shown."""
    if not target.strip():
        return F.lit(True)
    return F.coalesce(F.exists(H.template_fields(question), lambda n: T.field_key(n) == T.field_key(F.lit(target))), F.lit(False))


def allowed_template(ord_: Column, name: Column, allowed: list[str]) -> Column:
    """Whether a card's template is listed by number, ``card:n``, ``Card n`` or name; an empty list allows all."""
    if not allowed:
        return F.lit(True)
    labels = F.array((ord_ + 1).cast("string"), F.concat(F.lit("card:"), ord_ + 1), F.concat(F.lit("card "), ord_ + 1), T.field_key(name))
    return F.arrays_overlap(labels, F.array(*[T.field_key(F.lit(a)) for a in allowed]))


def card_rows(cards: DataFrame, notes: DataFrame, note_types: DataFrame) -> DataFrame:
    """Cards with what their note and template say: note_type, template, question, answer, fields.

    ``cards`` has card_id, nid, ord and more, ``notes`` nid, mid, fields, ``note_types`` mid, name, templates (an array of
    name, qfmt, afmt). A card without a note has null fields; one whose template isn't there is ``Card n`` without a question.
    """
    kinds = note_types.select("mid", F.col("name").alias("note_type"), "templates")
    met = cards.join(notes.select("nid", "mid", "fields"), "nid", "left").join(kinds, "mid", "left")
    own = F.get("templates", F.col("ord").cast("int"))
    name = F.coalesce(F.nullif(F.trim(own["name"]), F.lit("")), F.concat(F.lit("Card "), (F.col("ord") + 1).cast("string")))
    return met.select(*cards.columns, F.coalesce("note_type", F.lit("")).alias("note_type"), name.alias("template"), F.coalesce(own["qfmt"], F.lit("")).alias("question"), F.coalesce(own["afmt"], F.lit("")).alias("answer"), "fields")


def solution_values(fields: Column, specs: list[tuple[str, str, str, bool]]) -> Column:
    """What is shown once a card is answered: (field, label, display, text, media, autoplay) of each of ``specs`` (field,
    label, display, autoplay) whose field isn't blank, in order. Pictures and sounds without an address are text."""

    def one(name: str, label: str, display: str, autoplay: bool) -> Column:
        # what is used several times is bound, else each use doubles the plan of what it holds
        def shown(raw: Column) -> Column:
            held = F.struct(F.filter(H.image_sources(raw), H.media_path_ok).alias("images"), F.size(H.image_sources(raw)).alias("n"), H.audio_sources(raw).alias("sounds"))
            return T.let(held, lambda h: T.let(H.kind_of(F.lit(display), h["n"], F.size(h["sounds"])), lambda kind: of_kind(raw, h, kind)))

        def of_kind(raw: Column, h: Column, kind: Column) -> Column:
            media = F.when(kind == "image", h["images"]).when(kind == "audio", h["sounds"]).otherwise(F.array().cast("array<string>"))
            text = F.when((kind == "text") | (F.size(media) == 0), F.trim(H.unescape(H.strip_tags(raw)))).otherwise("")
            return F.struct(F.lit(name).alias("field"), F.lit(label or name).alias("label"), kind.alias("display"), text.alias("text"), media.alias("media"), (F.lit(autoplay) & (kind == "audio")).alias("autoplay"))

        return T.let(F.coalesce(lookup(fields, F.lit(name)), F.lit("")), lambda raw: F.when(F.trim(raw) != "", shown(raw)))

    return F.array_compact(F.array(*[one(*s) for s in specs]))


def in_due_order(targets: DataFrame) -> DataFrame:
    """``targets`` with their place: the most pressing first, then the sooner due, then by card and key.

    Places are counted in ranges of priority, each of which is a group, so that no task sees all targets.
    """
    order = [F.desc("priority"), F.asc("due_in_days"), F.asc("card_id"), F.asc("match_key")]
    step = targets.withColumn("step", F.floor(F.col("priority") * 8).cast("long"))
    sizes = step.groupBy("step").agg(F.count(F.lit(1)).alias("held"))
    ahead = sizes.select("step", F.coalesce(F.sum("held").over(Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    placed = step.withColumn("inside", F.row_number().over(Window.partitionBy("step").orderBy(*order))).join(ahead, "step")
    return placed.select(*targets.columns, (F.col("ahead") + F.col("inside")).cast("long").alias("place"))


def judge_cards(cards: DataFrame, today: int, target: str = "Front", future_days: int = 0, note_types: tuple[str, ...] = (), allowed: tuple[str, ...] = (), use_new: bool = True, max_new: int = 10) -> DataFrame:
    """Cards with ``state`` and ``skip_reason`` (null: kept), tests in order.

    ``cards``: card_id, found (search order), queue, type, due, odid, ord, template, question, note_type, fields. The cap
    on new cards counts in search order among those that nothing else rejects.
    """
    state = S.card_state(F.col("queue"), F.col("type"))
    target_text = F.coalesce(lookup(F.col("fields"), F.lit(target)), F.lit(""))
    reason = (
        F.when(F.col("fields").isNull(), "load_error")
        .when(F.col("odid") != 0, "filtered_deck")
        .when((state == S.NEW) & F.lit(not use_new), "card_state")
        .when(~S.inside_window(F.col("queue"), F.col("type"), F.col("due"), today, future_days), "future_window")
        .when(~F.col("note_type").isin(*note_types) if note_types else F.lit(False), "note_type")
        .when(~allowed_template(F.col("ord"), F.col("template"), list(allowed)), "card_template")
        .when(T.clean(H.strip_tags(target_text)) == "", "target_field")
        .when(~shows_target(F.col("question"), target), "target_not_on_question")
    )
    judged = cards.withColumn("state", state).withColumn("target_text", H.unescape(H.strip_tags(target_text))).withColumn("skip_reason", reason)
    fresh = F.col("skip_reason").isNull() & (F.col("state") == S.NEW)
    # the first new cards in search order: a limit, not a window over all cards
    first = judged.filter(fresh).orderBy("found", "card_id").limit(max_new).select("card_id", F.lit(True).alias("early"))
    return judged.join(first, "card_id", "left").withColumn("skip_reason", F.when(fresh & F.col("early").isNull(), "new_card_limit").otherwise(F.col("skip_reason"))).drop("early")


def due_targets(judged: DataFrame, today: int, language: str, mode: str = "exact_form", tokens: str = "content_words", target: str = "Front") -> DataFrame:
    """One row for each distinct key of each kept card, in token order, with due metrics."""
    overdue, in_days, priority = S.due_metrics(F.col("queue"), F.col("type"), F.col("due"), today)
    kept = judged.filter("skip_reason is null")
    exploded = kept.select("*", F.posexplode(T.target_tokens(F.col("target_text"), language, tokens)).alias("place", "word"))
    lang = F.lit(language)
    keyed = exploded.withColumn("word_form", T.form(F.col("word"))).withColumn("lemma", T.lemma(F.col("word_form"), lang))
    keyed = keyed.withColumn("match_key", F.col("word_form" if mode == "exact_form" else "lemma")).filter("match_key <> ''")
    once = Window.partitionBy("card_id", "match_key").orderBy("place")
    return (
        keyed.withColumn("turn", F.row_number().over(once)).filter("turn = 1")
        .select("card_id", F.col("word").alias("target_word"), "lemma", "word_form", "match_key", definition(F.col("fields"), target).alias("definition"), F.col("ivl").alias("interval"), F.when(F.col("factor") == 0, 2500).otherwise(F.col("factor")).alias("factor"), overdue.alias("overdue"), in_days.alias("due_in_days"), priority.alias("priority"))
    )



def limit_cards(targets: DataFrame, n: int) -> DataFrame:
    """All rows of the first ``n`` distinct cards in due order: priority, then days, then id."""
    cards = targets.groupBy("card_id").agg(F.max(F.struct("priority", (-F.col("due_in_days")).alias("d"))).alias("best"))
    first = cards.orderBy(F.desc("best.priority"), F.desc("best.d"), "card_id").limit(max(1, n)).select("card_id")
    return targets.join(F.broadcast(first), "card_id", "left_semi")  # n rows


def skip_reasons(judged: DataFrame) -> DataFrame:
    return judged.groupBy(F.coalesce("skip_reason", F.lit("kept")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
