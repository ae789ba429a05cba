"""An index for searches that end early: posting blocks, sorted vocabulary blocks, and lists of character grams.

Sentences are dealt over cells of about ``CELL`` by a hash of their id. A posting block holds the sentences of one form,
language, length and cell. All of a block's rows have one BM25 part, its bound, as a form counts once in a sentence; what
a search returns from a chunk of terms follows from bounds first:

* the best ``limit`` sentences of a chunk score no less than the ``limit``-th best one of any single term does by that
  term alone. Counts of blocks give that threshold; no sentence is looked at;
* a sentence of length L has at most L of the chunk's terms. Terms in order of weight, those whose heaviest L together
  stay under the threshold are inessential at that length: a sentence that has no other term can't be returned, so
  only the blocks of the others are opened;
* found sentences whose parts, with the most that inessential terms may add, stay under the threshold of what is
  summed so far are dropped; the others meet the inessential blocks of their own cell and length.

The rows that come back hold every sentence of the best ``limit`` of each chunk with its exact score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.functions import text as T
from glosswork.sources import sinks as W

K1, B = 1.2, 0.75
#: Sentences of a cell, and forms of a vocabulary block.
CELL, FORMS = 1 << 14, 256
#: Bounds are sums of the same numbers in another order; this is more than that can differ.
SLACK = 1e-9


def cell(id_: Column, cells: int) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(cells)).cast("int")


def cells_of(sentences: int) -> int:
    return max(1, -(-sentences // CELL))


def posting_blocks(postings: DataFrame, cells: int) -> DataFrame:
    """(form, language, length, cell, n, ids) of ``postings`` (form, id, language, length); a block has a cell's sentences at most."""
    key = ["form", "language", "length", "cell"]
    # in ranges of the whole key, a frequent form lies in several; the blocks are made where the ranges are
    dealt = postings.select("form", "language", "length", cell(F.col("id"), cells).alias("cell"), "id").repartitionByRange("form", "length", "language", "cell")
    blocks = dealt.groupBy(*key).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return blocks.select("form", "language", "length", "cell", F.size("ids").cast("long").alias("n"), "ids")


def vocabulary(forms: DataFrame) -> DataFrame:
    """(head, first, last, forms): distinct ``forms`` (form) in sorted blocks of one first character each."""
    listed = forms.filter("form <> ''").select("form").distinct().repartitionByRange("form").sortWithinPartitions("form").withColumn("at", F.monotonically_increasing_id())
    # a block is a run of one range, so its rows lie in one task before and after they are gathered
    block = listed.groupBy(F.substring("form", 1, 1).alias("head"), F.floor(F.col("at") / FORMS).alias("block"))
    return block.agg(F.min("form").alias("first"), F.max("form").alias("last"), F.array_sort(F.collect_list("form")).alias("forms")).drop("block")


def beginning(words: DataFrame, wide: DataFrame) -> DataFrame:
    """(form, and the columns of ``wide``) of the forms of ``vocabulary`` that begin with a ``term`` of ``wide``: by blocks' bounds."""
    may = (F.col("head") == F.substring("term", 1, 1)) & (F.col("last") >= F.col("term")) & ((F.col("first") <= F.col("term")) | F.startswith("first", F.col("term")))
    met = words.join(wide.filter("term <> ''"), may)
    return met.select(F.explode(F.filter("forms", lambda f: F.startswith(f, F.col("term")))).alias("form"), *wide.columns)


def idf(n: Column, total: Column) -> Column:
    value = F.log((total - n + 0.5) / (n + 0.5))
    return F.when(value <= 0, F.lit(1e-6)).otherwise(value)


def part(weight: Column, f: Column, length: Column, average: Column) -> Column:
    """What a term adds to a sentence's score."""
    return weight * (f * (K1 + 1)) / (f + K1 * (1 - B + B * length / average))


def bounded(blocks: DataFrame, stats: DataFrame, exact: DataFrame, mine: Column, limit: int) -> DataFrame:
    """(chunk, term, length, held, part, bound, essential) of every term (chunk, term) and length in sentences
    that are ``mine`` by language.

    ``bound`` is the most that the term and all lighter ones of its chunk give a sentence of that length.
    """
    met = blocks.select("form", "language", "length", "n").join(exact, F.col("form") == F.col("term")).groupBy("chunk", "term", "language", "length").agg(F.sum("n").alias("n"))
    seen = met.groupBy("chunk", "term").agg(F.sum("n").alias("n")).join(F.broadcast(stats))  # one row
    weighted = seen.select("chunk", "term", idf(F.col("n"), F.col("total")).alias("weight"), "avg_length")
    in_order = weighted.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("weight", "term"))).alias("terms"))  # a chunk's terms
    own = met.filter(mine).groupBy("chunk", "term", "length").agg(F.sum("n").alias("held")).join(weighted, ["chunk", "term"])
    parts = own.withColumn("part", part(F.col("weight"), F.lit(1), F.col("length"), F.col("avg_length")))
    upto = Window.partitionBy("chunk", "term").orderBy("length")
    reached = parts.withColumn("upto", F.sum("held").over(upto)).filter(F.col("upto") >= limit)
    least = reached.groupBy("chunk").agg(F.max("part").alias("least"))
    met = parts.join(in_order, "chunk").join(least, "chunk", "left")
    place = F.array_position("terms", F.struct("weight", "term")).cast("int")
    # the heaviest ``length`` of the term and those before it
    heaviest = F.slice("terms", F.greatest(F.lit(1), F.col("place") - F.col("length") + 1), F.least(F.col("length"), F.col("place")))
    total = F.aggregate(heaviest, F.lit(0.0), lambda a, t: a + t["weight"])
    bound = part(total, F.lit(1), F.col("length"), F.col("avg_length"))
    return met.withColumn("place", place).withColumn("bound", bound).select("chunk", "term", "length", "held", "part", "bound", F.coalesce(F.col("bound") * (1 + SLACK) >= F.col("least"), F.lit(True)).alias("essential"))


def best(blocks: DataFrame, words: DataFrame, stats: DataFrame, searched: DataFrame, mine: Column, limit: int) -> DataFrame:
    """(chunk, id, bm25): the best ``limit`` sentences of each chunk of ``searched`` (term, is_prefix, chunk), and some others,
    with the scores that ``selection.bm25`` gives them. Lower is better. Bounds and found sentences are written, as each
    is looked at several times."""
    folder = W.scratch_folder(blocks.sparkSession)
    searched = W.written(searched.distinct(), f"{folder}/searched")
    known = W.written(bounded(blocks, stats, searched.filter("not is_prefix").select("chunk", "term"), mine, limit), f"{folder}/known")
    own = blocks.filter(mine).withColumnRenamed("form", "term")
    # by themselves these tables are small, and known to be, so that they go to the blocks and not all blocks to them by form
    parts = W.written(known.select("chunk", "term", "length", "part", "essential"), f"{folder}/parts")
    opened = lambda which: own.join(parts.filter(which).select("chunk", "term", "length", "part"), ["term", "length"])
    found = opened("essential").select("chunk", F.explode("ids").alias("id"), "length", "cell", "part")
    prefixes = searched.filter("is_prefix").select("term", "chunk")
    if not prefixes.isEmpty():
        begun = W.written(beginning(words, prefixes), f"{folder}/begun")
        met = blocks.join(begun, "form").select("chunk", "term", "language", "length", "cell", F.explode("ids").alias("id"))
        met = met.groupBy("chunk", "term", "id", "language", "length", "cell").agg(F.count(F.lit(1)).alias("f"))
        seen = met.groupBy("chunk", "term").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(stats))  # one row
        scored = part(idf(F.col("n"), F.col("total")), F.col("f"), F.col("length"), F.col("avg_length"))
        found = found.unionByName(met.filter(mine).join(seen, ["chunk", "term"]).select("chunk", "id", "length", "cell", scored.alias("part")))
    summed = W.written(found.groupBy("chunk", "id").agg(F.sum("part").alias("so_far"), F.first("length").alias("length"), F.first("cell").alias("cell")), f"{folder}/summed")
    turn = F.row_number().over(Window.partitionBy("chunk").orderBy(F.desc("so_far")))
    least = summed.select("chunk", "so_far").withColumn("turn", turn).filter(F.col("turn") <= limit).groupBy("chunk").agg(F.min("so_far").alias("least"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == limit).select("chunk", "least")
    more = known.filter("not essential").groupBy("chunk", "length").agg(F.max("bound").alias("more"))
    may = (F.col("so_far") + F.coalesce("more", F.lit(0.0))) * (1 + SLACK) >= F.col("least")
    left = summed.join(more, ["chunk", "length"], "left").join(least, "chunk", "left").filter(F.col("least").isNull() | may)
    left = W.written(left.select("chunk", "id", "length", "cell", "so_far"), f"{folder}/left")
    rest = opened("not essential").join(left.select("chunk", "id", "length", "cell"), ["chunk", "length", "cell"]).filter(F.array_contains("ids", F.col("id"))).select("chunk", "id", "part")
    return left.select("chunk", "id", F.col("so_far").alias("part")).unionByName(rest).groupBy("chunk", "id").agg((-F.sum("part")).alias("bm25"))


def skipped(blocks: DataFrame, stats: DataFrame, searched: DataFrame, mine: Column, limit: int) -> DataFrame:
    """(chunk, postings, unopened): of each chunk's exact terms, how many postings there are and how many are not opened
    to find sentences."""
    known = bounded(blocks, stats, searched.filter("not is_prefix").select("chunk", "term").distinct(), mine, limit)
    return known.groupBy("chunk").agg(F.sum("held").alias("postings"), F.sum(F.when(F.col("essential"), 0).otherwise(F.col("held"))).alias("unopened"))


# ---- scripts without spaces


def grams(text: Column) -> Column:
    """Distinct single characters and pairs of neighbours."""
    n = F.length(text)
    of = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(of(1), of(2)))


#: Up to so many wanted grams a text is asked for each; for more it is cut into its own.
ASKED = 256


def wanted_grams(wanted: DataFrame) -> DataFrame:
    """(gram): what ``holding`` looks up for the ``wanted`` forms (form)."""
    return wanted.filter("form <> ''").select(F.explode(_pairs(F.col("form"))).alias("gram")).distinct()


def _pairs(form: Column) -> Column:
    """What a form that stands in a text has of the text's grams: its pairs, or itself if it is one character."""
    return F.when(F.length(form) == 1, F.array(form)).otherwise(F.filter(grams(form), lambda g: F.length(g) == 2))


def gram_lists(texts: DataFrame, cells: int, wanted: DataFrame | None = None) -> DataFrame:
    """(gram, cell, ids): an inverted index of ``texts`` (id, text) by characters and pairs; a list has a cell's sentences at
    most. ``wanted``: the lists of these grams (gram) alone, for a search that no index was built for."""
    where = cell(F.col("id"), cells).alias("cell")
    asked = None if wanted is None else [r.gram for r in wanted.limit(ASKED + 1).collect()]
    if asked is not None and len(asked) <= ASKED:
        found = F.filter(F.lit(asked) if asked else F.array().cast("array<string>"), lambda g: F.contains(F.col("text"), g))
        each = T.once(texts.select("id", "text", where), found=found).select("id", "cell", F.explode("found").alias("gram"))
    else:
        each = texts.select("id", where, F.explode_outer(grams(F.col("text"))).alias("gram")).filter("gram is not null")
        each = each if wanted is None else each.join(wanted, "gram", "left_semi")
    return each.groupBy("gram", "cell").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def holding(lists: DataFrame, texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, form) for every text (id, text) and wanted ``form`` that stands in it: in each cell the lists of the form's pairs
    are intersected, and what is left is verified by the text."""
    forms = wanted.select("form").filter("form <> ''").distinct()
    asked = forms.select("form", _pairs(F.col("form")).alias("grams")).select("form", F.size("grams").alias("needed"), F.explode("grams").alias("gram"))
    met = lists.join(asked, "gram").groupBy("form", "cell", "needed").agg(F.collect_list("ids").alias("lists")).filter(F.size("lists") == F.col("needed"))
    shortest = F.array_sort(F.col("lists"), lambda a, b: F.size(a) - F.size(b))
    both = F.aggregate(F.slice(shortest, 2, F.size("lists")), F.get(shortest, F.lit(0)), lambda a, b: F.array_intersect(a, b))
    may = met.select("form", F.explode(both).alias("id"))
    return texts.select("id", "text").join(may, "id").filter(F.contains("text", F.col("form"))).select("id", "form")
