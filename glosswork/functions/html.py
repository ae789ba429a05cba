"""Reading markup of notes and templates with built-in functions."""

from __future__ import annotations

import json
import sys
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from glosswork.functions.text import let

# Names in templates that are no fields.
NO_FIELDS = ("FrontSide", "Tags", "Deck", "Subdeck", "Card")


def strip_tags(text: Column) -> Column:
    """Text without scripts, styles and tags, white space collapsed."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def _entities() -> Column:
    """Names of entities, with or without their semicolon, and what they stand for, from the standard's table: one value, as
    a literal for each name would make plans of thousands of nodes wherever text is unescaped."""
    return F.from_json(F.lit(json.dumps(html5)), "map<string,string>")


def _code_point(n: Column) -> Column:
    """The character of a number: as Windows reads 128 to 159, nothing for controls, a mark for what is no character."""
    windows = [bytes([i]).decode("cp1252", "replace") if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(i) for i in range(0x80, 0xA0)]
    plain = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    none = n.between(1, 8) | (n == 11) | n.between(14, 31) | n.between(127, 159) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    return (
        F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "�")
        .when(n.between(0x80, 0x9F), F.get(F.lit(windows), (n - 0x80).cast("int")))
        .when(n == 13, "\r").when(none, "").otherwise(plain)
    )


def _entity(e: Column, known: Column, closed: bool = False) -> Column:
    """What one entity, from its ampersand on, stands for; itself where it is none. ``closed``: no shorter name at its head."""
    name = F.substring(e, F.lit(2), F.length(e))
    hexadecimal, decimal = F.regexp_extract(name, r"^#[xX]([0-9a-fA-F]+)", 1), F.regexp_extract(name, r"^#([0-9]+)", 1)
    number = F.when(hexadecimal != "", F.when(F.length(F.ltrim(F.lit("0"), hexadecimal)) > 8, F.lit(1 << 40)).otherwise(F.conv(F.right(hexadecimal, F.lit(8)), 16, 10).cast("long"))).when(decimal != "", F.coalesce(decimal.try_cast("long"), F.lit(1 << 40)))
    begun = F.filter(F.transform(F.sequence(F.length(name) - 1, F.lit(2), F.lit(-1)), lambda n: F.substring(name, F.lit(1), n)), lambda p: F.map_contains_key(known, p))
    headed = let(F.get(begun, F.lit(0)), lambda p: F.when(p.isNotNull(), F.concat(F.try_element_at(known, p), F.substring(name, F.length(p) + 1, F.length(name)))))
    return (
        F.when(name.startswith("#"), F.coalesce(let(number, lambda n: F.when(n.isNotNull(), _code_point(n))), e))
        .when(F.map_contains_key(known, name), F.try_element_at(known, name))
        .otherwise(e if closed else F.coalesce(F.when(F.length(name) > 2, headed), e))
    )


def unescape(text: Column, closed: bool = False) -> Column:
    """Every named and numeric entity, as browsers read them; texts without an ampersand are left as they are. ``closed``:
    those alone that a semicolon ends, as stricter readers do; a name that runs out without one stays."""
    pattern = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]{0,31});" if closed else r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"

    def read(t: Column) -> Column:
        found = let(_entities(), lambda known: F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda e: _entity(e, known, closed)))
        return F.array_join(F.zip_with(F.split(t, pattern, -1), found, lambda p, e: F.concat(p, F.coalesce(e, F.lit("")))), "")

    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), read(t)).otherwise(t))


def escape(text: Column) -> Column:
    """Text that can stand in markup and in quoted attributes."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def token_html(token: Column, colour: str = "inherit") -> Column:
    """A token (text, is_word, is_target, match_key, card_ids) as markup: words are spans with what a click needs."""
    ids = F.transform(token["card_ids"], lambda c: c.cast("string"))
    attributes = {
        "class": F.when(token["is_target"], "word target").otherwise("word context"), "data-key": token["match_key"], "data-word": token["text"],
        "data-card-id": F.coalesce(F.get(ids, F.lit(0)), F.lit("")), "data-card-ids": F.array_join(ids, ","), "style": F.lit(f"color:{colour} !important;"),
    }
    shown = F.concat_ws(" ", F.lit("<span"), *[F.concat(F.lit(f'{k}="'), escape(v), F.lit('"')) for k, v in attributes.items()])
    return F.when(token["is_word"], F.concat(shown, F.lit(">"), escape(token["text"]), F.lit("</span>"))).otherwise(escape(token["text"]))


def image_sources(text: Column) -> Column:
    """Distinct image addresses in order, without scripts and inline pages."""
    found = F.regexp_extract_all(text, F.lit(r"""(?is)<img\b[^>]*?\bsrc\s*=\s*(["'])(.*?)\1"""), F.lit(2))
    plain = F.filter(F.transform(found, lambda s: F.trim(unescape(s))), lambda s: (s != "") & ~F.lower(s).startswith("javascript:") & ~F.lower(s).startswith("data:text/html"))
    return F.array_distinct(plain)


def audio_sources(text: Column) -> Column:
    """Sound marks first, then addresses of audio elements."""
    marks = F.regexp_extract_all(text, F.lit(r"(?i)\[sound:([^\]]+)\]"), F.lit(1))
    tags = F.regexp_extract_all(text, F.lit(r"""(?is)<(?:audio|source)\b[^>]*?\bsrc\s*=\s*(["'])(.*?)\1"""), F.lit(2))
    return F.array_distinct(F.filter(F.transform(F.concat(marks, tags), lambda s: F.trim(unescape(s))), lambda s: s != ""))


def display_kind(asked: Column, text: Column) -> Column:
    """text, image or audio as asked, else by what the field holds."""
    return kind_of(asked, F.size(image_sources(text)), F.size(audio_sources(text)))


def kind_of(asked: Column, images: Column, sounds: Column) -> Column:
    """The same from the counts of what the field holds."""
    return F.when(asked.isin("text", "image", "audio"), asked).when(sounds > 0, "audio").when(images > 0, "image").otherwise("text")


def template_fields(template: Column) -> Column:
    """Field names that a card template shows."""
    inner = F.regexp_extract_all(template, F.lit(r"\{\{([^{}]+)\}\}"), F.lit(1))
    names = F.transform(inner, lambda e: F.trim(F.regexp_extract(F.regexp_replace(F.trim(e), r"^[#/^]\s*", ""), r"([^:]*)$", 1)))
    return F.array_distinct(F.filter(names, lambda n: (n != "") & ~n.isin(*NO_FIELDS)))


class _Visible(HTMLParser):
    """Collects text outside hidden elements."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.text = [], []

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            return
        a = {k: (v or "") for k, v in attrs}
        style = "".join(a.get("style", "").lower().split())
        now = "hidden" in a or "hidden" in a.get("class", "").lower().split() or "display:none" in style or "visibility:hidden" in style
        self.hidden.append((tag, now or (self.hidden[-1][1] if self.hidden else False)))

    def handle_endtag(self, tag):
        for i in range(len(self.hidden) - 1, -1, -1):
            if self.hidden[i][0] == tag:
                del self.hidden[i:]
                break

    def handle_data(self, data):
        if not (self.hidden and self.hidden[-1][1]):
            self.text.append(data)


@F.pandas_udf(StringType())
def visible_part(s: pd.Series) -> pd.Series:
    """A template without hidden elements; for the few distinct templates there are."""

    def one(t):
        if t is None:
            return None
        p = _Visible()
        p.feed(t)
        p.close()
        return "".join(p.text)

    return s.map(one)


def script_safe(json: Column) -> Column:
    """JSON that can stand inside a script element."""
    t = F.replace(json, F.lit("</"), F.lit("<\\/"))
    return F.replace(F.replace(t, F.lit(" "), F.lit("\\u2028")), F.lit(" "), F.lit("\\u2029"))


def media_path_ok(path: Column) -> Column:
    """Remote addresses, or relative paths that stay inside their folder."""
    remote = path.rlike(r"^(?i:https?)://")
    clean = ~path.rlike(r"^([/\\]|[A-Za-z]:)") & ~path.rlike(r"(^|[/\\])\.\.([/\\]|$)")
    return remote | clean


def media_resolved(path: Column, folder: str) -> Column:
    """The address of a media file: remote and file addresses as they are, others under ``folder``; null where they leave it."""
    plain = F.regexp_replace(path, r"\\", "/")
    parts = F.filter(F.split(plain, "/"), lambda p: ~p.isin("", "."))
    step = lambda a, p: F.when(a.isNull(), a).when(p != "..", F.concat(a, F.array(p))).when(F.size(a) > 0, F.slice(a, F.lit(1), F.size(a) - 1))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    inside = F.concat(F.lit(f"file://{folder.rstrip('/')}/"), F.array_join(F.transform(kept, lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))), "/"))
    return F.when(path.rlike(r"^(?i:https?|file):"), path).when(~plain.startswith("/") & (F.size(kept) > 0), inside)

# what workers run of this module travels with its data, so they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
