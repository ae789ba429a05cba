"""Finding the sentence that covers most due words.

Postings are joined to the due side by form, which prunes files where they are clustered by form; the planner sends the
due side to all tasks where it is small. ``search`` has the index by which a search ends early and prefixes and substrings
are met; without it every posting is scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.functions import scheduling as S
from glosswork.functions import text as T
from glosswork.operators import search as X
from glosswork.operators.corpus import of_language
from glosswork.operators.places import occurrences  # noqa: F401  one of the steps
from glosswork.operators.ranks import numbered
from glosswork.sources import sinks as W


def resolve_bases(keys: DataFrame, word_forms: DataFrame) -> DataFrame:
    """(key, base) for keys that word_forms has: a form that is its own base first, then the least base."""
    by_form = keys.join(word_forms, F.col("key") == F.col("form")).select("key", "base")
    by_base = word_forms.select("base").join(keys, F.col("key") == F.col("base")).select("key", "base").distinct()  # of the keys' rows, not of all
    rank = F.struct((F.col("key") != F.col("base")).alias("other"), "base")
    return by_form.unionByName(by_base).groupBy("key").agg(F.min(rank).alias("r")).select("key", F.col("r.base").alias("base"))


def due_keys(targets: DataFrame, word_forms: DataFrame | None = None) -> DataFrame:
    """Targets with ``due_key``: in family mode (word_forms given) the base of the first of their names that resolves."""
    if word_forms is None:
        return targets.withColumn("due_key", F.coalesce(F.nullif("match_key", F.lit("")), F.nullif("word_form", F.lit("")), T.form(F.col("target_word")))).filter("due_key <> ''")
    names = F.array(*[T.form(F.col(c)) for c in ("match_key", "lemma", "word_form", "target_word")])
    rows = targets.withColumn("row", F.struct("card_id", "match_key", "target_word"))
    tried = rows.select("row", F.posexplode(names).alias("place", "key")).filter("key <> ''")
    bases = resolve_bases(tried.select("key").distinct(), word_forms)
    first = tried.join(bases, "key").groupBy("row").agg(F.min_by("base", "place").alias("base"))
    key = F.coalesce("base", F.nullif("match_key", F.lit("")), F.nullif("lemma", F.lit("")))
    return rows.join(first, "row", "left").withColumn("due_key", key).drop("row", "base").filter("due_key is not null")


def expansions(due: DataFrame, word_forms: DataFrame | None = None) -> DataFrame:
    """(base, forms, prefix): all forms under which a key is searched; a key that no pair knows is searched as a prefix."""
    bases = due.select(T.form(F.col("due_key")).alias("base")).filter("base <> ''").distinct()
    if word_forms is None:
        return bases.select("base", F.array("base").alias("forms"), F.lit("").alias("prefix"))
    named = word_forms.join(bases, "base", "left_semi").groupBy("base").agg(F.collect_set("form").alias("found"))
    as_form = word_forms.select(F.col("form").alias("base")).join(bases, "base", "left_semi").distinct().withColumn("is_form", F.lit(True))
    met = bases.join(named, "base", "left").join(as_form, "base", "left")
    forms = F.array_sort(F.array_distinct(F.concat(F.array("base"), F.coalesce("found", F.array().cast("array<string>")))))
    return met.select("base", forms.alias("forms"), F.when(F.col("found").isNull() & F.col("is_form").isNull(), F.col("base")).otherwise("").alias("prefix"))


def weights(expanded: DataFrame, due: DataFrame) -> DataFrame:
    """Expansions with the weight of their key, by which a search takes them: heavier keys first, then by name."""
    weight = due.groupBy(T.form(F.col("due_key")).alias("base")).agg(F.sum("priority").alias("weight"))
    return expanded.join(weight, "base")


def terms(weighted: DataFrame, per_query: int | None = 40) -> DataFrame:
    """(term, is_prefix, chunk): forms in order of their keys, prefixes after them, in chunks of a query; None for one chunk."""
    listed = weighted.select("weight", "base", F.posexplode(F.concat(F.transform("forms", lambda f: F.struct(f.alias("term"), F.lit(False).alias("is_prefix"))), F.when(F.col("prefix") != "", F.array(F.struct(F.col("prefix").alias("term"), F.lit(True).alias("is_prefix")))).otherwise(F.array().cast("array<struct<term:string,is_prefix:boolean>>")))).alias("place", "t"))
    if per_query is None:
        return listed.select("t.term", "t.is_prefix", F.lit(0).alias("chunk"))
    size = max(1, min(per_query, 40))
    ordered = numbered(listed.select("weight", "base", "place", "t"), [F.desc("weight"), F.asc("base"), F.asc("place")], "n")
    return ordered.select("t.term", "t.is_prefix", F.floor(F.col("n") / size).cast("int").alias("chunk"))


def match_query(ordered_terms: DataFrame) -> DataFrame:
    """The text of each chunk's query, for display."""
    shown = F.when(F.col("is_prefix"), F.concat("term", F.lit("*"))).otherwise(F.concat(F.lit('"'), "term", F.lit('"')))
    return ordered_terms.groupBy("chunk").agg(F.array_join(F.array_sort(F.collect_set(shown)), " OR ").alias("query"))


def with_prefix(forms: DataFrame, wide: DataFrame) -> DataFrame:
    """Distinct ``forms`` (form), of some sentences, with the rows of ``wide`` whose ``term`` they begin with: an equal join on
    their beginnings of the terms' lengths. ``search.beginning`` is the same for a whole vocabulary."""
    lengths = wide.agg(F.collect_set(F.length("term")).alias("lengths"))  # one row
    begins = F.explode(F.transform(F.filter("lengths", lambda n: n <= F.length("form")), lambda n: F.substring(F.col("form"), F.lit(1), n))).alias("term")
    return forms.filter("form <> ''").distinct().join(F.broadcast(lengths)).select("form", begins).join(wide.filter("term <> ''"), "term")


def bm25(postings: DataFrame, stats: DataFrame, searched: DataFrame, words: DataFrame | None = None, mine: Column | None = None) -> DataFrame:
    """(chunk, id, bm25) of every match: lower is better. A term's frequency counts its matching forms, its document count
    sentences.

    ``searched``: term, is_prefix, chunk. Prefixes meet the distinct vocabulary, in the blocks of ``words`` if given. ``mine``:
    a test of ``language`` that scored sentences pass; those of others are counted alone. Wanted forms, matches and counts
    are written: known to be few, forms and counts go to the postings instead of all postings to them by form.
    """
    folder = W.scratch_folder(postings.sparkSession)
    searched = W.written(searched, f"{folder}/searched")
    exact = searched.filter("not is_prefix").select("chunk", "term", F.col("term").alias("form"))
    wide = searched.filter("is_prefix").select("term", "chunk")
    by_prefix = (with_prefix(postings.select("form"), wide) if words is None else X.beginning(words, wide)).select("chunk", F.concat("term", F.lit("*")).alias("term"), "form")
    wanted = W.written(exact.unionByName(by_prefix).distinct(), f"{folder}/wanted")
    met = postings.select("form", "id", "length", (F.lit(True) if mine is None else mine).alias("mine")).join(wanted, "form")
    hits = W.written(met.groupBy("chunk", "term", "id").agg(F.count(F.lit(1)).alias("f"), F.first("length").alias("length"), F.first("mine").alias("mine")), f"{folder}/hits")
    seen = W.written(hits.groupBy("chunk", "term").agg(F.count(F.lit(1)).alias("n")), f"{folder}/seen")
    scored = hits.filter("mine").join(seen, ["chunk", "term"]).join(F.broadcast(stats))  # one row
    part = X.part(X.idf(F.col("n"), F.col("total")), F.col("f"), F.col("length"), F.col("avg_length"))
    return scored.groupBy("chunk", "id").agg((-F.sum(part)).alias("bm25"))


def per_chunk(limit: int) -> int:
    """How many sentences of a chunk a search takes."""
    return max(2 * limit, 20)


def compatible(scored: DataFrame, limit: int) -> DataFrame:
    """What a search in chunks returns: the best ``max(2 * limit, 20)`` of each chunk, each sentence as its first chunk
    has it, ``4 * limit`` in all."""
    # sums of equal parts in another order are equal scores
    ranked = scored.withColumn("r", F.row_number().over(Window.partitionBy("chunk").orderBy(F.round("bm25", 9), "id"))).filter(F.col("r") <= per_chunk(limit))
    first = ranked.groupBy("id").agg(F.min(F.struct("chunk", "r", "bm25")).alias("b"))
    return first.select("id", "b.*").orderBy("chunk", "r").limit(4 * limit).select("id", "bm25")


def holding(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, form) for every text (id, text) and wanted ``form`` that stands in it: an equal join on the text's pieces of the forms' lengths."""
    wanted = wanted.select("form").filter("form <> ''").distinct()
    lengths = wanted.agg(F.collect_set(F.length("form")).alias("lengths"))  # one row
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.length("text") - n + 1), lambda i: F.substring(F.col("text"), i, n))
    pieces = F.flatten(F.transform(F.filter("lengths", lambda n: n <= F.length("text")), cut))
    return texts.join(F.broadcast(lengths)).select("id", F.explode(F.array_distinct(pieces)).alias("form")).join(wanted, "form")


def substring_candidates(sentences: DataFrame, expanded: DataFrame, limit: int, lists: DataFrame | None = None) -> DataFrame:
    """For scripts without spaces: sentences that hold forms as they are, by how many, shortest and oldest first.

    ``lists``: the ``search.gram_lists`` of the sentences' texts; without them every text is cut to pieces.
    """
    texts, wanted = sentences.select("id", F.col("full_text").alias("text")), expanded.select(F.explode("forms").alias("form"))
    met = holding(texts, wanted) if lists is None else X.holding(lists, texts, wanted)
    counted = sentences.select("id", "word_count").join(met.groupBy("id").agg(F.count(F.lit(1)).alias("matches")), "id")
    return counted.orderBy(F.desc("matches"), "word_count", "id").limit(max(4 * limit, 20)).select("id", (-F.col("matches")).cast("double").alias("bm25"))


def matched_keys(candidates: DataFrame, forms: DataFrame, expanded: DataFrame) -> DataFrame:
    """(id, base): keys that each candidate has, by form or by prefix."""
    own = forms.join(candidates.select("id"), "id").select("id", F.explode_outer("forms").alias("form")).filter("form is not null")
    by_form = own.join(expanded.select("base", F.explode("forms").alias("form")), "form").select("id", "base")
    prefixes = with_prefix(own.select("form"), expanded.filter("prefix <> ''").select("base", F.col("prefix").alias("term")))
    by_prefix = own.join(prefixes.select("form", "base"), "form").select("id", "base")
    return by_form.unionByName(by_prefix).distinct()


def matched_in_text(candidates: DataFrame, sentences: DataFrame, expanded: DataFrame) -> DataFrame:
    """The same where words have no spaces: a form anywhere in the letters of the sentence."""
    letters = sentences.join(candidates.select("id"), "id").select("id", T.form(F.col("full_text")).alias("text"))
    wanted = expanded.select("base", F.explode("forms").alias("f")).select("base", T.form(F.col("f")).alias("form")).distinct()
    return holding(letters, wanted).join(wanted, "form").select("id", "base").distinct()


def match_score(priority: Column, overdue: Column) -> Column:
    return F.when(F.coalesce(priority, F.lit(0.0)) == 0, 10.0 + F.least(overdue, F.lit(30.0)) / 3.0).otherwise(priority)


def score(matched: DataFrame, due: DataFrame) -> DataFrame:
    """(id, score, cards, keys): a card that meets two keys counts twice for the score and once for the coverage."""
    side = due.select(F.col("due_key").alias("base"), "card_id", match_score(F.col("priority"), F.col("overdue")).alias("gain"))
    return matched.join(side, "base").groupBy("id").agg(F.sum("gain").alias("score"), F.count_distinct("card_id").alias("cards"), F.array_sort(F.collect_set("base")).alias("keys"))


def best_first(avoid: list[int] = ()) -> list[Column]:
    """Order of candidates: not recently shown, more cards, higher score, translated, bm25, shorter, older."""
    recent = F.col("id").isin(*avoid) if avoid else F.lit(False)
    return [recent.asc(), F.desc("cards"), F.desc("score"), (F.trim(F.coalesce("translation", F.lit(""))) == "").asc(), F.asc("bm25"), F.asc("word_count"), F.asc("id")]


def candidates(sentences: DataFrame, forms: DataFrame, posts: DataFrame, stats: DataFrame, due: DataFrame, expanded: DataFrame, language: str, limit: int = 50, min_words: int = 2, max_words: int = 12, per_query: int = 40, shown: list[int] = (), mode: str = "compatible", unsegmented: bool = False, index: dict[str, DataFrame] | None = None) -> DataFrame:
    """Sentences that match, with everything that ranks them.

    ``compatible`` takes what a search in chunks of terms with its limits returns, ``exhaustive`` every match. ``index``
    may have ``blocks`` and ``words`` (``search.posting_blocks``, ``search.vocabulary``), by which the first ends early, and
    ``lists`` (``search.gram_lists``) for scripts without spaces.
    """
    mine = of_language(F.col("language"), language)
    own, index = sentences.filter(mine), index or {}
    if unsegmented:
        found = substring_candidates(own, expanded, limit * 4, index.get("lists"))
        keys = matched_in_text(found, own, expanded)
    else:
        searched = terms(weights(expanded, due), per_query if mode == "compatible" else None)
        words = index.get("words")
        if mode == "compatible" and "blocks" in index and words is not None:
            found = compatible(X.best(index["blocks"], words, stats, searched, mine, per_chunk(limit)), limit)
        else:
            scored = bm25(posts, stats, searched, words, mine)
            # every match meets its sentence below; a limit counts those that are there
            found = compatible(scored.join(own.select("id"), "id", "left_semi"), limit) if mode == "compatible" else scored.select("id", "bm25")
        if mode == "compatible":
            # 4 * limit rows, looked at twice
            found = F.broadcast(W.written(found, f"{W.scratch_folder(sentences.sparkSession)}/found"))
        keys = matched_keys(found, forms, expanded)
    rows = own.join(found, "id").join(score(keys, due), "id").filter(F.col("word_count").between(min_words, max_words))
    return unshown(rows, shown)


def unshown(rows: DataFrame, shown: list[int]) -> DataFrame:
    return rows.filter(~F.col("id").isin(*shown)) if shown else rows


def select_task(ranked: DataFrame, avoid: list[int] = ()) -> DataFrame:
    return ranked.orderBy(*best_first(avoid)).limit(1)


def card_map(matched: DataFrame, due: DataFrame) -> DataFrame:
    """(id, base, card_ids), sorted."""
    return matched.join(due.select(F.col("due_key").alias("base"), "card_id").distinct(), "base").groupBy("id", "base").agg(F.array_sort(F.collect_set("card_id")).alias("card_ids"))


def annotate(sentences: DataFrame, expanded: DataFrame, due: DataFrame, language: str, mode: str = "exact_form") -> DataFrame:
    """(id, place, text, is_word, is_target, match_key, card_ids) of every token of some sentences."""
    parts = sentences.select("id", F.posexplode(T.split_tokens(F.col("full_text"))).alias("place", "text"))
    lang = F.lit(language)
    keyed = parts.withColumn("is_word", F.col("text").rlike(rf"^{T.WORD}$")).withColumn("form", F.when(F.col("is_word"), T.form(F.col("text"))))
    cards = due.groupBy(F.col("due_key").alias("base")).agg(F.collect_set("card_id").alias("ids"))
    side = expanded.join(cards, "base")
    by_form = side.select("base", "ids", F.explode("forms").alias("form"))
    own = keyed.select("form").filter("form <> ''").distinct()
    by_prefix = with_prefix(own, side.filter("prefix <> ''").select("base", "ids", F.col("prefix").alias("term"))).select("base", "ids", "form")
    of = by_form.unionByName(by_prefix).groupBy("form").agg(F.min("base").alias("base"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("card_ids"))
    met = keyed.join(of, "form", "left")
    key = F.when(F.col("is_word"), F.coalesce("base", T.matching_key(F.col("text"), lang, mode))).otherwise("")
    return met.select("id", "place", "text", "is_word", F.col("base").isNotNull().alias("is_target"), key.alias("match_key"), F.coalesce("card_ids", F.array().cast("array<bigint>")).alias("card_ids"))


def target_words(due: DataFrame) -> DataFrame:
    """One row for each card in review order, with the interval that a good answer gives."""
    order = [F.desc("priority"), F.asc("due_in_days"), F.asc(F.lower("target_word")), F.asc("due_key")]
    first = due.withColumn("turn", F.row_number().over(Window.partitionBy("card_id").orderBy(*order))).filter("turn = 1")
    return first.select("card_id", "target_word", "definition", "priority", "due_in_days", S.days_label(S.next_interval(F.col("interval"), F.col("factor"))).alias("good_interval"), F.lit("today").alias("again_interval"))
