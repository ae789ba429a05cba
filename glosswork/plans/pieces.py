"""SQL for the pieces that the catalogue's statements share, each a named subquery over the provided tables."""

from __future__ import annotations

import re

from glosswork.functions import languages as L
from glosswork.functions import text as T

TODAY, NOW, USN = 100, 1_700_000_000, 7


def form(w: str) -> str:
    return rf"regexp_replace(strip_accents(replace(replace(lower({w}), '’', ''''), 'ß', 'ss')), '[^\p{{L}}]', '', 'g')"


def words(t: str) -> str:
    w = T.WORD.replace("'", "''")
    return f"regexp_extract_all({t}, '{w}')"


def _single(x: str) -> str:
    return f"CASE WHEN length({x}) > 2 AND right({x}, 1) = substr({x}, length({x}) - 1, 1) AND contains('{T.CONSONANTS}', right({x}, 1)) THEN left({x}, length({x}) - 1) ELSE {x} END"


def english(t: str) -> str:
    irregular = " ".join(f"WHEN {t} = '{a}' THEN '{b}'" for a, b in T.IRREGULAR.items())
    cut = lambda n: f"left({t}, length({t}) - {n})"
    return (
        f"CASE {irregular} WHEN length({t}) <= 3 THEN {t} WHEN length({t}) > 4 AND {t} LIKE '%ies' THEN {cut(3)} || 'y' WHEN length({t}) > 5 AND {t} LIKE '%ing' THEN {_single(cut(3))} "
        f"WHEN length({t}) > 4 AND {t} LIKE '%ed' THEN {_single(cut(2))} WHEN length({t}) > 4 AND {t} LIKE '%es' THEN {cut(2)} WHEN {t} LIKE '%s' AND {t} NOT LIKE '%ss' THEN {cut(1)} ELSE {t} END"
    )


def german(t: str) -> str:
    ends = " ".join(f"WHEN length({t}) >= {4 + len(e)} AND {t} LIKE '%{e}' THEN left({t}, length({t}) - {len(e)})" for e in T.GERMAN_ENDINGS)
    return f"CASE WHEN length({t}) <= 4 THEN {t} {ends} ELSE {t} END"


def lemma(t: str, lang: str) -> str:
    return f"CASE WHEN {lang} = 'en' THEN {english(t)} WHEN {lang} = 'de' THEN {german(t)} ELSE {t} END"


def clean(t: str) -> str:
    return f"trim(regexp_replace({t}, '{T.SPACE}', ' ', 'g'))"


def strip(t: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({t}, '(?is)<(?:script|style)\b.*?</(?:script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


_URL = T.URL
_BLOCKED = ", ".join(f"'{w}'" for w in L.PROFILES["en"][2])
_FLAGS = rf"""list_filter([
  CASE WHEN NOT regexp_matches(text, '\p{{L}}') THEN 'no_letters' END, CASE WHEN regexp_matches(text, '{_URL}') THEN 'url_or_email' END,
  CASE WHEN regexp_matches(text, '\.{{3,}}|!{{3,}}|\?{{3,}}') THEN 'repeated_punctuation' END, CASE WHEN length(text) > 240 THEN 'too_long_chars' END,
  CASE WHEN len(list_filter({words('text')}, lambda w: length(w) > 35)) > 0 THEN 'oversized_token' END,
  CASE WHEN length(replace(text, '(', '')) <> length(replace(text, ')', '')) OR length(replace(text, '[', '')) <> length(replace(text, ']', '')) THEN 'unbalanced_brackets' END,
  CASE WHEN regexp_matches(text, '[{{}}<>|]') THEN 'markup_or_pipe' END], lambda f: f IS NOT NULL)"""

# name -> (subqueries it needs, text)
PIECES: dict[str, tuple[tuple[str, ...], str]] = {
    "raw": ((), r"""SELECT doc_id * 1073741824 + i - 1 AS ordinal, language, ss[i] AS text FROM (
  SELECT doc_id, language, ss, unnest(generate_series(1, len(ss))) AS i FROM (
    SELECT doc_id, lang AS language, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\s*[\r\n]+\s*', ' ', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS ss
    FROM documents))"""),
    "judged": (("raw",), f"""SELECT *, CASE WHEN text = '' THEN 'empty' WHEN turn > 1 THEN 'duplicate' WHEN word_count NOT BETWEEN 4 AND 15 THEN 'word_count' WHEN len(flags) > 0 THEN 'quality'
  WHEN len(list_filter({words('text')}, lambda w: {form('w')} <> '')) = 0 THEN 'no_words' END AS skip_reason
FROM (SELECT *, row_number() OVER (PARTITION BY language, lower(replace(lower(text), 'ß', 'ss')) ORDER BY ordinal) AS turn, len({words('text')})::INTEGER AS word_count, {_FLAGS} AS flags
  FROM (SELECT ordinal, language, {clean('text')} AS text FROM raw))"""),
    "sentences": (("judged",), "SELECT ordinal AS id, language, text AS full_text, word_count, array_to_string(flags, ',') AS quality_flags FROM judged WHERE skip_reason IS NULL"),
    "forms": (("sentences",), f"SELECT id, language, list_sort(list_distinct(list_filter(list_transform({words('full_text')}, lambda w: {form('w')}), lambda f: f <> ''))) AS forms FROM sentences"),
    "posts": (("forms",), "SELECT id, language, len(forms) AS length, unnest(forms) AS form FROM forms"),
    "stats": (("forms",), "SELECT count(*) AS total, avg(len(forms)) AS avg_length FROM forms"),
    "word_forms": (("posts",), f"SELECT DISTINCT form, {lemma('form', 'language')} AS base FROM posts"),
    "cards": ((), f"""SELECT item_id AS card_id, item_id AS nid, item_id AS found, CASE WHEN item_id % 5 = 4 THEN 1 ELSE 0 END AS ord, [2, 2, 0, 1, 3, 2, 2][(item_id % 7 + 1)::INTEGER] AS queue,
  [2, 2, 0, 1, 3, 2, 2][(item_id % 7 + 1)::INTEGER] AS type, {TODAY} + item_id % 61 - 30 AS due, item_id % 40 AS ivl, 1300 + (item_id % 17) * 100 AS factor, item_id % 9 AS reps, item_id % 4 AS lapses,
  CASE WHEN item_id % 13 = 12 THEN 5 ELSE 0 END AS odid, CASE WHEN item_id % 11 = 10 THEN 'Other' ELSE 'Basic' END AS note_type,
  text AS front, 'meaning ' || item_id AS back FROM benchmark"""),
    "judged_cards": (("cards",), f"""SELECT *, CASE WHEN skip_reason IS NULL AND state = 'new' AND row_number() OVER (PARTITION BY skip_reason IS NULL AND state = 'new' ORDER BY found, card_id) > 3 THEN 'new_card_limit' ELSE skip_reason END AS outcome FROM (
  SELECT *, CASE WHEN odid <> 0 THEN 'filtered_deck' WHEN dated AND coalesce(nullif(due, 0), {TODAY}) > {TODAY + 10} THEN 'future_window' WHEN note_type <> 'Basic' THEN 'note_type'
    WHEN front = '' THEN 'target_field' WHEN ord = 1 THEN 'target_not_on_question' END AS skip_reason FROM (
    SELECT *, CASE WHEN queue = 0 OR type = 0 THEN 'new' WHEN queue IN (1, 3) OR type IN (1, 3) THEN 'learning' ELSE 'review' END AS state, (queue IN (2, 3) OR type = 2) AS dated FROM cards))"""),
    "metrics": (("cards",), f"""SELECT *, CASE WHEN dated AND d <= 0 THEN -d ELSE 0 END::DOUBLE AS overdue, CASE WHEN dated AND d > 0 THEN d ELSE 0 END::BIGINT AS due_in_days,
  CASE WHEN dated AND d > 0 THEN greatest(0.5::DOUBLE, 6.0::DOUBLE / (d + 1)) WHEN dated THEN 10.0::DOUBLE + least(-d, 30)::DOUBLE / 3.0::DOUBLE ELSE 10.0::DOUBLE END AS priority
FROM (SELECT card_id, due - {TODAY} AS d, (queue IN (2, 3) OR type = 2) AS dated FROM cards)"""),
    "targets": (("judged_cards", "metrics"), f"""SELECT card_id, target_word, lemma, word_form, word_form AS match_key, back AS definition, ivl AS interval, factor, overdue, due_in_days, priority FROM (
  SELECT *, row_number() OVER (PARTITION BY card_id, word_form ORDER BY place) AS turn FROM (
    SELECT *, {lemma('word_form', "'en'")} AS lemma FROM (
      SELECT *, {form('target_word')} AS word_form FROM (
        SELECT *, unnest(ws) AS target_word, unnest(generate_series(1, len(ws))) AS place FROM (
          SELECT *, CASE WHEN len(content) > 0 THEN content ELSE list_slice(all_words, 1, 1) END AS ws FROM (
            SELECT c.*, m.overdue, m.due_in_days, m.priority, {words('c.front')} AS all_words, list_filter({words('c.front')}, lambda w: {form('w')} NOT IN ({_BLOCKED}) AND {english(form('w'))} NOT IN ({_BLOCKED})) AS content
            FROM judged_cards c JOIN metrics m USING (card_id) WHERE outcome IS NULL))))
    WHERE word_form <> ''))
WHERE turn = 1"""),
    "resolved": (("targets", "word_forms"), """SELECT key, base FROM (SELECT key, base, row_number() OVER (PARTITION BY key ORDER BY key <> base, base) AS turn FROM (
  SELECT k.key, w.base FROM (SELECT DISTINCT unnest([match_key, lemma]) AS key FROM targets) k JOIN word_forms w ON k.key = w.form
  UNION ALL SELECT DISTINCT k.key, k.key FROM (SELECT DISTINCT unnest([match_key, lemma]) AS key FROM targets) k JOIN word_forms w ON k.key = w.base)) WHERE turn = 1"""),
    "due": (("targets", "resolved"), "SELECT t.*, coalesce(a.base, b.base, t.match_key) AS due_key FROM targets t LEFT JOIN resolved a ON a.key = t.match_key LEFT JOIN resolved b ON b.key = t.lemma"),
    "expanded": (("due", "word_forms"), """SELECT k.base, list_sort(list_distinct(list_append(coalesce(f.found, []), k.base))) AS forms, CASE WHEN f.found IS NULL AND g.form IS NULL THEN k.base ELSE '' END AS prefix
FROM (SELECT DISTINCT due_key AS base FROM due) k LEFT JOIN (SELECT base, list(form) AS found FROM word_forms GROUP BY base) f ON f.base = k.base LEFT JOIN (SELECT DISTINCT form FROM word_forms) g ON g.form = k.base"""),
    "terms": (("ordered",), """SELECT term, is_prefix, ((row_number() OVER (ORDER BY turn, place) - 1) // 40)::INTEGER AS chunk FROM (
  SELECT turn, unnest(forms) AS term, false AS is_prefix, unnest(generate_series(1, len(forms))) AS place FROM ordered UNION ALL SELECT turn, prefix, true, len(forms) + 1 FROM ordered WHERE prefix <> '')"""),
    "ordered": (("expanded", "due"), "SELECT e.*, row_number() OVER (ORDER BY w.weight DESC, e.base) AS turn FROM expanded e JOIN (SELECT due_key, sum(priority) AS weight FROM due GROUP BY due_key) w ON w.due_key = e.base"),
    "hits": (("posts", "terms"), "SELECT chunk, term, id, count(*) AS f, min(length) AS length FROM (SELECT DISTINCT t.chunk, t.term || CASE WHEN t.is_prefix THEN '*' ELSE '' END AS term, p.id, p.length, p.form FROM posts p JOIN terms t ON CASE WHEN t.is_prefix THEN starts_with(p.form, t.term) ELSE p.form = t.term END) GROUP BY chunk, term, id"),
    "scored": (("hits", "stats"), """SELECT chunk, id, -sum(idf * (f * 2.2) / (f + 1.2 * (0.25 + 0.75 * length / avg_length))) AS bm25 FROM (
  SELECT h.*, s.avg_length, CASE WHEN ln((s.total - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((s.total - n + 0.5) / (n + 0.5)) END AS idf
  FROM (SELECT *, count(*) OVER (PARTITION BY chunk, term) AS n FROM hits) h, stats s) GROUP BY chunk, id"""),
    "compat": (("scored", "sentences"), """SELECT id, bm25 FROM (SELECT id, arg_min(bm25, chunk) AS bm25, min(chunk) AS chunk, arg_min(r, chunk) AS r FROM (
  SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY round(bm25, 9), id) AS r FROM scored WHERE id IN (SELECT id FROM sentences WHERE language = 'en')) WHERE r <= 100 GROUP BY id) ORDER BY chunk, r LIMIT 200"""),
    "matched": (("forms", "expanded"), "SELECT DISTINCT p.id, e.base FROM (SELECT id, unnest(forms) AS form FROM forms) p JOIN (SELECT base, prefix, unnest(forms) AS form FROM expanded) e ON p.form = e.form OR (e.prefix <> '' AND starts_with(p.form, e.prefix))"),
    "ranked": (("compat", "matched", "due", "sentences"), """SELECT s.id, s.language, s.full_text, s.word_count, c.bm25, m.score, m.cards FROM compat c JOIN sentences s USING (id) JOIN (
  SELECT m.id, sum(CASE WHEN d.priority = 0 THEN 10 + least(d.overdue, 30) / 3 ELSE d.priority END) AS score, count(DISTINCT d.card_id) AS cards FROM matched m JOIN due d ON d.due_key = m.base GROUP BY m.id) m USING (id)
WHERE s.word_count BETWEEN 4 AND 15"""),
    "stepped": (("cards",), f"""SELECT card_id, is_unknown, factor AS old_factor, ivl AS old_ivl, due AS old_due, lapses AS old_lapses, reps AS old_reps, type AS old_type, queue AS old_queue,
  CASE WHEN is_unknown THEN greatest(1300, factor - 200) ELSE factor END AS factor, CASE WHEN is_unknown THEN 0 ELSE grown END::BIGINT AS ivl, CASE WHEN is_unknown THEN {NOW} ELSE {TODAY} + grown END::BIGINT AS due,
  CASE WHEN is_unknown THEN 1 ELSE 2 END AS queue, CASE WHEN is_unknown THEN CASE WHEN review THEN 3 ELSE 1 END ELSE 2 END AS type, CASE WHEN is_unknown THEN 1001 ELSE 0 END AS "left",
  lapses + CASE WHEN is_unknown AND review THEN 1 ELSE 0 END AS lapses, reps + 1 AS reps, CASE WHEN is_unknown THEN CASE WHEN review THEN 2 ELSE 0 END ELSE CASE WHEN review THEN 1 ELSE 0 END END AS log_type
FROM (SELECT *, card_id % 3 = 0 AS is_unknown, (type = 2 OR queue = 2) AS review, greatest(greatest(1, ivl) + 1, round_even(greatest(1, ivl) * greatest(1.3::DOUBLE, greatest(1300, factor) / 1000.0::DOUBLE), 0)) AS grown FROM cards WHERE odid = 0)"""),
}


def _searched(suffix: str, terms: str, found: str) -> None:
    """The pieces of a selection again, under names with ``suffix``, from other ``terms`` and what is ``found`` of their scores."""
    own = ("terms", "hits", "scored", "compat", "ranked")
    new = {"terms": terms, "compat": found}
    for name in own:
        needs, text = PIECES[name]
        named = re.sub(rf"(?<=FROM |JOIN )({'|'.join(own)})\b", rf"\1{suffix}", new.get(name, text))
        PIECES[name + suffix] = (tuple(n + suffix if n in own else n for n in needs), named)


#: Every match, scored against all terms.
_searched("_every", PIECES["terms"][1].replace("// 40)", "// 1000000000)"), "SELECT id, bm25 FROM scored WHERE id IN (SELECT id FROM sentences WHERE language = 'en')")


def sql(final: str, *needed: str, recursive: bool = False, **more: str) -> str:
    """``final`` with the subqueries that it needs, each once, in order, and behind them those of its own in ``more``."""
    done: dict[str, str] = {}

    def need(name: str) -> None:
        for n in PIECES[name][0]:
            need(n)
        done.setdefault(name, PIECES[name][1])

    for n in needed:
        need(n)
    done |= more
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(f"{n} AS ({text})" for n, text in done.items()) + "\n" + final if done else final
