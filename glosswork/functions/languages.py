"""Languages: codes, aliases, dictionary addresses and words that are no targets on their own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIKTIONARY = "https://en.wiktionary.org/wiki/{word}"

# Code, name, three-letter corpus code, ignored target words.
PROFILES = {
    "ar": ("Arabic", "ara", ()),
    "da": ("Danish", "dan", ("af", "at", "de", "den", "det", "der", "en", "et", "i", "med", "og", "pa", "til")),
    "de": ("German", "deu", ("am", "an", "auf", "aus", "das", "dem", "den", "der", "des", "die", "ein", "eine", "einem", "einen", "einer", "eines", "im", "in", "mit", "zu", "zum", "zur")),
    "el": ("Greek", "ell", ()),
    "en": ("English", "eng", ("a", "an", "and", "of", "the", "to")),
    "es": ("Spanish", "spa", ("a", "al", "de", "del", "el", "en", "la", "las", "los", "un", "una", "y")),
    "fi": ("Finnish", "fin", ()),
    "fr": ("French", "fra", ("a", "au", "aux", "de", "des", "du", "en", "et", "la", "le", "les", "un", "une")),
    "it": ("Italian", "ita", ("a", "al", "con", "da", "del", "di", "e", "gli", "i", "il", "in", "la", "le", "lo", "un", "una")),
    "ja": ("Japanese", "jpn", ()),
    "ko": ("Korean", "kor", ()),
    "nl": ("Dutch", "nld", ("aan", "de", "een", "en", "het", "in", "met", "op", "te", "van")),
    "pl": ("Polish", "pol", ()),
    "pt": ("Portuguese", "por", ("a", "as", "com", "da", "das", "de", "do", "dos", "e", "em", "o", "os", "um", "uma")),
    "ru": ("Russian", "rus", ("а", "без", "в", "во", "до", "за", "и", "из", "к", "как", "ко", "на", "не", "но", "о", "об", "от", "по", "с", "со", "у", "что", "это")),
    "sv": ("Swedish", "swe", ("att", "av", "de", "den", "det", "en", "ett", "i", "med", "och", "pa", "till")),
    "tr": ("Turkish", "tur", ()),
    "uk": ("Ukrainian", "ukr", ()),
    "zh": ("Chinese", "cmn", ()),
}
UNSEGMENTED = ("ja", "zh")
_JISHO = "https://jisho.org/search/{word}"


def dictionary_url(code: str) -> str:
    return _JISHO if code == "ja" else WIKTIONARY


def _map(pairs) -> Column:
    return F.create_map(*[F.lit(x) for p in pairs for x in p])


def language_code(raw: Column) -> Column:
    """The code before any region part, lower-cased, with three-letter codes mapped; ``en`` where nothing is left."""
    base = F.lower(F.trim(F.regexp_extract(F.coalesce(raw, F.lit("")), r"^([^-_]*)", 1)))
    base = F.when(base == "", "en").otherwise(base)
    return F.coalesce(F.try_element_at(_map((v[1], k) for k, v in PROFILES.items()), base), base)


def corpus_code(raw: Column) -> Column:
    """The three-letter code; three letters pass through."""
    code = language_code(raw)
    return F.coalesce(F.try_element_at(_map((k, v[1]) for k, v in PROFILES.items()), code), code)


def match_codes(raw: Column) -> Column:
    """All codes under which rows of a language can be stored."""
    kept = F.lower(F.trim(raw))
    return F.array_distinct(F.filter(F.array(language_code(raw), corpus_code(raw), kept), lambda c: c.isNotNull() & (c != "")))


def is_unsegmented(code: Column) -> Column:
    return language_code(code).isin(*UNSEGMENTED)


def fill_url(template: Column, word: Column, language: Column) -> Column:
    """A dictionary address; null unless it is http(s) with a host."""
    url = F.replace(F.replace(F.replace(template, F.lit("{word_raw}"), word), F.lit("{word}"), F.replace(F.url_encode(word), F.lit("+"), F.lit("%20"))), F.lit("{language}"), language)
    return F.when(url.rlike(r"^(?i:https?)://[^/\s]+"), url)


# Where sentence collections and their links are published.
SENTENCES_URL = "https://downloads.tatoeba.org/exports/per_language/{code}/{code}_sentences.tsv.bz2"
LINKS_URL = "https://downloads.tatoeba.org/exports/links.tar.bz2"


def sentences_url(raw: Column) -> Column:
    """The address of a language's sentences; any three letters are taken as a code."""
    base = F.lower(F.trim(F.coalesce(F.nullif(F.trim(raw), F.lit("")), F.lit("en"))))
    code = F.when(F.length(base) == 3, base).otherwise(corpus_code(base))
    return F.replace(F.lit(SENTENCES_URL), F.lit("{code}"), code)
