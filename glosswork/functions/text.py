"""Sentence and word functions as Spark columns: splitting, tokens, normal forms, stems, counts, quality.

Everything stays in built-in functions. ``fold`` covers Latin, Greek and Cyrillic letters by a table that a rule builds,
and the ligatures of running text; ``fold_exactly`` is an Arrow function for every code point, meant for a distinct
vocabulary. Stems name their argument many times, so they are given columns, or bind it with ``let``.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache, reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from glosswork.functions.languages import PROFILES

# A letter is any letter or letter-like number with combining marks after it; words may hold apostrophes and hyphens.
LETTER = r"[\p{L}\p{Nl}\p{No}][\x{300}-\x{36f}]*"
WORD = rf"(?:{LETTER})+(?:['\x{{2019}}\-](?:{LETTER})+)*"
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}\x{FEFF}]+"
SENTENCE_END = r"(?<=[.!?])\s+|(?<=[。！？])\s*"
# The same for texts without the full-width marks: it looks back from white space alone.
ASCII_END = r"\s(?<=[.!?]\s)\s*"
ASCII_WORD = "[A-Za-z]++(?:['-][A-Za-z]++)*+"
#: What SPACE holds, as text.
SPACES = "".join(chr(i) for i in (*range(9, 14), *range(0x1C, 0x20), 0x85, 0xFEFF)) + "".join(c for c in map(chr, range(0x3001)) if unicodedata.category(c)[0] == "Z")
SCRIPT = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"

# Irregular English forms.
IRREGULAR = {
    "ate": "eat", "better": "good", "best": "good", "bought": "buy", "children": "child", "forgot": "forget",
    "forgotten": "forget", "gone": "go", "improved": "improve", "mice": "mouse", "ran": "run", "saw": "see",
    "seen": "see", "studies": "study", "went": "go", "wrote": "write", "written": "write",
}
CONSONANTS = "bcdfghjklmnpqrstvwxyz"
GERMAN_ENDINGS = ("ern", "em", "er", "en", "es", "e", "n", "s")
# Letters that fold to several, or that fold alike without being one letter with marks.
LIGATURES = {"ß": "ss", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ĳ": "ij", "ŉ": "n", "ς": "σ"}


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def split_tokens(text: Column) -> Column:
    """Words and what stands between them, in order; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s){WORD}|(?:(?!{WORD}).)+"), F.lit(0))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def clean(text: Column) -> Column:
    """Runs of any white space as one space, none at the ends."""
    plain = is_ascii(text) & ~text.rlike(r"[\t-\r\x1c-\x1f]|  ")
    return F.trim(F.when(plain, text).otherwise(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")))


def sentences(text: Column) -> Column:
    """Sentences of a text whose lines are joined; empty ones are left out."""
    # a run of white space is an end or lies within a sentence, so lines are joined in the few that hold a line's end
    given = F.coalesce(text, F.lit(""))
    wide = reduce(Column.__or__, (text.contains(c) for c in "。！？"))
    parts = F.when(wide, F.split(given, SENTENCE_END)).otherwise(F.split(given, ASCII_END))
    joined = lambda s: F.when(s.contains("\n") | s.contains("\r"), F.regexp_replace(s, r"\s*[\r\n]+\s*", " ")).otherwise(s)
    return F.filter(F.transform(parts, lambda s: F.trim(joined(s), F.lit(SPACES))), lambda s: s != "")


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """Latin, Greek and Cyrillic code points whose decomposition without marks is one other character."""
    source, target = [], []
    for low, high in ((0xC0, 0x250), (0x370, 0x530), (0x1E00, 0x2000)):
        for i in range(low, high):
            plain = "".join(x for x in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(x))
            if plain != chr(i) and len(plain) == 1 and chr(i) == chr(i).lower():
                source.append(chr(i))
                target.append(plain)
    return "".join(source), "".join(target)


def fold(lowered: Column, marks: str = r"()[\x{300}-\x{36f}]") -> Column:
    """Lower-case letters without accents; ``marks`` are removed but for what its group takes."""
    long = lowered
    for one, several in LIGATURES.items():
        long = F.replace(long, F.lit(one), F.lit(several))
    plain = F.translate(F.when(lowered.rlike(f"[{''.join(LIGATURES)}]"), long).otherwise(lowered), *_fold_table())
    # plain ASCII, as most words are, is done
    return F.when(lowered.rlike(r"[^\x00-\x7f]"), F.regexp_replace(plain, marks, "$1")).otherwise(lowered)


def once(df: DataFrame, **values: Column) -> DataFrame:
    """``df`` with columns that filters and columns after them don't compute again, as they would if merged with them."""
    return df.select("*", F.explode_outer(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))).alias("_once")).select(*df.columns, *[f"_once.{k}" for k in values])


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@F.pandas_udf(StringType())
def fold_exactly(s: pd.Series) -> pd.Series:
    """The same for every code point."""

    def one(t):
        if t is None:
            return None
        d = "".join(c for c in unicodedata.normalize("NFKD", t.casefold()) if not unicodedata.combining(c) or ord(c) in (0x3099, 0x309A))
        return unicodedata.normalize("NFC", d)

    return s.map(one)


def form(word: Column) -> Column:
    """A word's normal form: lower case, no accents, letters only."""
    lowered = F.replace(F.lower(F.coalesce(word, F.lit(""))), F.lit("’"), F.lit("'"))
    return F.regexp_replace(fold(lowered), r"[^\p{L}]", "")


def forms(text: Column) -> Column:
    """The normal forms of a text's words, in order, empty ones left out: what ``form`` gives for each of ``words``.

    The text is folded once as a whole; what joins letters or letter-like numbers inside a word closes up, and then these
    numbers go, so that words are runs of letters.
    """
    # marks that follow no letter are in no word, and part words as they stand
    folded = fold(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("’"), F.lit("'")), r"([\p{L}\p{Nl}\p{No}])[\x{300}-\x{36f}]+")
    closed = F.regexp_replace(folded, r"(?<=[\p{L}\p{Nl}\p{No}])['-](?=[\p{L}\p{Nl}\p{No}])", "")
    bare = F.when(folded.rlike(r"[\p{Nl}\p{No}]"), F.regexp_replace(closed, r"[\p{Nl}\p{No}]", "")).otherwise(closed)
    return F.regexp_extract_all(bare, F.lit(r"\p{L}+"), F.lit(0))


def _cut(text: Column, n: int) -> Column:
    return F.substring(text, F.lit(1), F.length(text) - n)


def _single_end(stem: Column) -> Column:
    end = F.right(stem, F.lit(1))
    return F.when((F.length(stem) > 2) & (end == F.substring(stem, -2, 1)) & end.isin(*CONSONANTS), _cut(stem, 1)).otherwise(stem)


def stem_english(t: Column) -> Column:
    irregular = F.try_element_at(F.create_map(*[F.lit(x) for p in IRREGULAR.items() for x in p]), t)
    n = F.length(t)
    return (
        F.when(irregular.isNotNull(), irregular)
        .when(n <= 3, t)
        .when((n > 4) & t.endswith("ies"), F.concat(_cut(t, 3), F.lit("y")))
        .when((n > 5) & t.endswith("ing"), _single_end(_cut(t, 3)))
        .when((n > 4) & t.endswith("ed"), _single_end(_cut(t, 2)))
        .when((n > 4) & t.endswith("es"), _cut(t, 2))
        .when(t.endswith("s") & ~t.endswith("ss"), _cut(t, 1))
        .otherwise(t)
    )


def stem_german(t: Column) -> Column:
    out = F.when(F.length(t) <= 4, t)
    for e in GERMAN_ENDINGS:
        out = out.when((F.length(t) >= 4 + len(e)) & t.endswith(e), _cut(t, len(e)))
    return out.otherwise(t)


def _is_language(language: Column, names: str) -> Column:
    """Whether it is one of ``names``, the code without its region; none is English."""
    return F.coalesce(F.lower(language), F.lit("")).rlike(rf"^\s*({names})\s*([-_].*)?$")


def lemma(word_form: Column, language: Column) -> Column:
    """The stem of a normal form, where the language has stems."""
    return F.when(_is_language(language, "en|eng|"), stem_english(word_form)).when(_is_language(language, "de|deu"), stem_german(word_form)).otherwise(word_form)


def lemmas(word_forms: Column, language: Column) -> Column:
    """``lemma`` of each of an array's forms; the language is looked at once."""
    return F.when(_is_language(language, "en|eng|"), F.transform(word_forms, stem_english)).when(_is_language(language, "de|deu"), F.transform(word_forms, stem_german)).otherwise(word_forms)


def matching_key(word: Column, language: Column, mode: str = "exact_form") -> Column:
    return form(word) if mode == "exact_form" else let(form(word), lambda f: lemma(f, language))


def count_words(text: Column, language: Column) -> Column:
    """Words; characters of unsegmented scripts count a third of a word each, rounded up."""
    plain = F.when(is_ascii(text), F.regexp_count(text, F.lit(ASCII_WORD))).otherwise(F.regexp_count(text, F.lit(WORD)))
    bare = F.regexp_replace(text, SCRIPT, " ")
    script = F.length(text) - F.length(F.regexp_replace(text, SCRIPT, ""))
    return F.when(~is_ascii(text) & text.rlike(SCRIPT), F.floor((script + 2) / 3) + F.regexp_count(bare, F.lit(WORD))).otherwise(plain).cast("int")


def tokens(text: Column, language: Column) -> Column:
    """(text, lemma) of each word, in order; the lemma is the stem of the word's normal form."""
    return F.transform(words(text), lambda w: F.struct(w.alias("text"), let(form(w), lambda f: lemma(f, language)).alias("lemma")))


def plain_form(word: str) -> str:
    """``form`` for a word of the settings."""
    d = unicodedata.normalize("NFKD", word.casefold())
    kept = "".join(c for c in d if not unicodedata.combining(c) or ord(c) in (0x3099, 0x309A))
    return "".join(c for c in unicodedata.normalize("NFC", kept) if c.isalpha())


def plain_lemma(form_: str, code: str) -> str:
    """``lemma`` for a form of the settings."""
    t, n = form_, len(form_)
    if code == "de":
        return next((t[: -len(e)] for e in GERMAN_ENDINGS if n > 4 and n >= 4 + len(e) and t.endswith(e)), t)
    if code != "en" or t in IRREGULAR or n <= 3:
        return IRREGULAR.get(t, t) if code == "en" else t
    for end, least, put in (("ies", 5, "y"), ("ing", 6, None), ("ed", 5, None), ("es", 5, ""), ("s", 4, "")):
        if n >= least and t.endswith(end) and not (end == "s" and t.endswith("ss")):
            stem = t[: -len(end)]
            return stem + put if put is not None else stem[:-1] if len(stem) > 2 and stem[-1] == stem[-2] and stem[-1] in CONSONANTS else stem
    return t


def blocked_words(language: str, more: tuple[str, ...] = ()) -> list[str]:
    """Forms and lemmas of a language's ignored words."""
    code = next((k for k, v in PROFILES.items() if language.lower() in (k, v[1])), language.lower())
    forms = {plain_form(w) for w in (*PROFILES.get(code, ("", "", ()))[2], *more)} - {""}
    return sorted(forms | {plain_lemma(f, code) for f in forms})


def target_tokens(text: Column, language: str, mode: str = "content_words", more: tuple[str, ...] = ()) -> Column:
    """The words of a field that are targets: all, the first, or those that aren't ignored (the first if all are)."""
    all_words = words(text)
    if mode == "all_words":
        return all_words
    if mode == "first_word":
        return F.slice(all_words, 1, 1)
    blocked = blocked_words(language, more)
    if not blocked:
        return all_words
    is_content = lambda w: ~let(form(w), lambda f: f.isin(*blocked) | lemma(f, F.lit(language)).isin(*blocked))
    return let(all_words, lambda ws: let(F.filter(ws, is_content), lambda c: F.when(F.size(c) > 0, c).otherwise(F.slice(ws, 1, 1))))


# Fixed value: what counts as an address.
URL = r"(?i)https?://|www\.|[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[a-z]{2,}"
FLAGS = ("no_letters", "url_or_email", "repeated_punctuation", "too_long_chars", "oversized_token", "unbalanced_brackets", "markup_or_pipe")


def quality_flags(text: Column) -> Column:
    """What is wrong with a sentence, in a fixed order; empty if nothing is."""
    n = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    # words are looked at only where a run of what they are made of is long enough
    run = text.rlike(r"(?:^| )[^ ]{36}") & text.rlike(r"[\p{L}\p{Nl}\p{No}\x{300}-\x{36f}'\x{2019}-]{36}")
    long = F.when(run, F.exists(words(text), lambda w: F.length(w) > 35)).otherwise(False)
    # every address holds one of these
    address = text.contains("@") | text.contains("://") | F.lower(text).contains("www.")
    tests = (
        ~text.rlike(r"\p{L}"),
        address & text.rlike(URL),
        text.contains("...") | text.contains("!!!") | text.contains("???"),
        F.length(text) > 240,
        long,
        (n("(") != n(")")) | (n("[") != n("]")),
        reduce(Column.__or__, (text.contains(c) for c in "{}<>|")),
    )
    return F.array_remove(F.array(*[F.when(t, F.lit(f)).otherwise("") for f, t in zip(FLAGS, tests)]), "")


def display_text(value: Column) -> Column:
    return clean(value)


def field_key(value: Column) -> Column:
    """How field names compare: white space collapsed, case folded."""
    return F.lower(F.replace(clean(value), F.lit("ß"), F.lit("ss")))

# what workers run of this module travels with its data, so they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
