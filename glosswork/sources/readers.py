"""Reading sentence files: plain text, subtitles, delimited rows, links and word forms, compressed or not.

All readers give (ordinal, language, text, translation), ordinals counting in source order: by file, then by place in it.
Files are read by blocks, each from the line that it begins with, however long a sentence or a quoted field is: what is
open at a block's ends is put together over the blocks' edges afterwards, and only edges are shuffled for it. That holds
for compressed files whose format can be split, too. Archives are streamed member by member.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glosswork.functions import languages as L
from glosswork.functions import text as T

COLUMNS = ("c0", "c1", "c2", "c3")


def looks_like_code(value: Column, default: str) -> Column:
    """Two or three lower-case letters that name a known language or the default."""
    known = sorted({*L.PROFILES, *(v[1] for v in L.PROFILES.values()), default.lower()})
    return value.rlike("^[A-Za-z]{2,3}$") & F.lower(value).isin(*known)


def parse_row(parts: Column, default: str) -> Column:
    """(language, text, translation) of a delimited row by its shape; null where there is no text to take."""
    p = F.transform(parts, lambda x: F.trim(F.coalesce(x, F.lit(""))))
    n = F.size(p)
    at = lambda i: F.get(p, F.lit(i))
    own = F.lit(default)
    row = lambda lang, text, tr: F.struct(L.language_code(lang).alias("language"), text.alias("text"), F.nullif(tr, F.lit("")).alias("translation"))
    none = F.lit(None).cast("string")
    number = at(0).rlike(r"^\p{Nd}+$")
    return (
        F.when(n == 0, None)
        .when(number & (n >= 3) & ~looks_like_code(at(1), default), row(own, at(1), at(2)))
        .when(number & (n >= 3), row(at(1), at(2), at(3)))
        .when(number & (n == 2), row(own, at(1), none))
        .when(number, None)
        .when(looks_like_code(at(0), default) & (n >= 2), row(at(0), at(1), at(2)))
        .when(n >= 2, row(own, at(0), at(1)))
        .otherwise(row(own, at(0), none))
    )


# ---- what runs across lines


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): the lines of all files, in order inside a block."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", r"^\x{FEFF}", "").alias("value"))


def _joined(pieces: DataFrame, glue: str) -> DataFrame:
    """(file, block, place, text) of ``pieces`` (file, block, place, text, opens, ends): those that end open are one with the
    piece behind that opens open. Blocks have two edges at most, and edges alone meet here."""
    whole = pieces.filter("not opens and not ends").select("file", "block", "place", "text")
    order = Window.partitionBy("file").orderBy("block", "place")  # two rows a block
    linked = F.col("opens") & F.coalesce(F.lag("ends").over(order), F.lit(False))
    edges = pieces.filter("opens or ends").withColumn("new", (~linked).cast("int")).withColumn("n", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    each = F.array_sort(F.collect_list(F.struct("block", "place", "text")))
    met = edges.groupBy("file", "n").agg(each.alias("e"))
    return whole.unionByName(met.select("file", F.get("e", F.lit(0))["block"].alias("block"), F.get("e", F.lit(0))["place"].alias("place"), F.array_join(F.transform("e", lambda x: x["text"]), glue).alias("text")))


_PIECES = "file string, block long, place long, text string, opens boolean, ends boolean"


def _piece_batch(rows: list[tuple]):
    import pyarrow as pa

    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 6, types)], ["file", "block", "place", "text", "opens", "ends"])


def _stitch(batches):
    """From lines as (file, block, parts, closed): sentences as pieces. A line's last part goes on in the next line unless closed."""
    key, place, held, first = None, 0, [], True
    for batch in batches:
        rows = []

        def emit(ends: bool) -> None:
            nonlocal place, held, first
            opens = first and key[1] > 0
            if not ends and not opens and not "".join(held).replace("\ufeff", "").strip():
                held = []  # nothing but space
            if held:
                rows.append((*key, place, " ".join(held), opens, ends))
                place, held, first = place + 1, [], False

        for file, block, parts, closed in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (file, block) != key:
                if key:
                    emit(True)
                key, place, held, first = (file, block), 0, [], True
            for i, part in enumerate(parts):
                if i:
                    emit(False)
                held.append(part)
            if closed:
                emit(False)
        yield _piece_batch(rows)
    if held:
        yield _piece_batch([(*key, place, " ".join(held), first and key[1] > 0, True)])


def _quote_state(line: str, sep: str, inside: bool) -> bool:
    """Whether a quoted field is open at the end of a line that begins inside one or not."""
    at = 0
    while True:
        if inside:
            while True:
                end = line.find('"', at)
                if end < 0:
                    return True
                at = end + 2
                if line[end + 1 : end + 2] != '"':
                    at = end + 1
                    break
            inside = False
        elif line[at : at + 1] == '"':
            at, inside = at + 1, True
            continue
        at = line.find(sep, at)  # only a field's first character opens it
        if at < 0:
            return False
        at += 1


def _block_states(sep: str):
    """From lines (file, block, value): for each block, whether it ends inside a quoted field if it begins outside, or inside."""

    def run(batches):
        import pyarrow as pa

        def out(key, ends):
            return pa.RecordBatch.from_pydict({"file": [key[0]], "block": [key[1]], "outside": [ends[0]], "inside": [ends[1]]}, schema=pa.schema([("file", pa.string()), ("block", pa.int64()), ("outside", pa.bool_()), ("inside", pa.bool_())]))

        key, ends = None, [False, True]
        for batch in batches:
            for file, block, line in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (file, block) != key:
                    if key:
                        yield out(key, ends)
                    key, ends = (file, block), [False, True]
                if '"' in line:
                    ends = [_quote_state(line, sep, x) for x in ends]
        if key:
            yield out(key, ends)

    return run


def _records(sep: str):
    """From lines (file, block, value, inside): records as pieces, ``inside`` saying how the block begins."""

    def run(batches):
        key, place, held, state, opens = None, 0, [], False, False
        for batch in batches:
            rows = []
            for file, block, line, inside in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (file, block) != key:
                    if held:
                        rows.append((*key, place, "\n".join(held), opens, True))
                    key, place, held, state, opens = (file, block), 0, [], inside, inside
                held.append(line)
                if '"' in line:
                    state = _quote_state(line, sep, state)
                if not state:
                    if opens or len(held) > 1 or line.strip():  # empty lines are no records
                        rows.append((*key, place, "\n".join(held), opens, False))
                        place += 1
                    held, opens = [], False
            yield _piece_batch(rows)
        if held:
            yield _piece_batch([(*key, place, "\n".join(held), opens, True)])

    return run


def spanning_records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(file, block, place, text): delimited records, whose quoted fields may hold line ends.

    How a block begins follows from the blocks before it: each tells how it ends for either beginning, and these answers
    are put one after the other, a row a block.
    """
    lines = _lines(spark, path)
    states = lines.mapInArrow(_block_states(sep), "file string, block long, outside boolean, inside boolean")
    each = F.array_sort(F.collect_list(F.struct("block", "outside", "inside")))
    step = lambda a, b: F.struct(F.when(a["now"], b["inside"]).otherwise(b["outside"]).alias("now"), F.concat(a["out"], F.array(F.struct(b["block"].alias("block"), a["now"].alias("begins_inside")))).alias("out"))
    start = F.struct(F.lit(False).alias("now"), F.array().cast("array<struct<block:bigint,begins_inside:boolean>>").alias("out"))
    begins = states.groupBy("file").agg(F.aggregate(each, start, step, lambda a: a["out"]).alias("b")).select("file", F.explode("b").alias("b")).select("file", "b.*")
    met = lines.join(F.broadcast(begins.filter("begins_inside")), ["file", "block"], "left")  # a row for a block that begins in a field
    return _joined(met.select("file", "block", "value", F.coalesce("begins_inside", F.lit(False)).alias("inside")).mapInArrow(_records(sep), _PIECES), "\n")


def spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether a quoted field may run over a line end: some line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()


def _delimited(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """c0 to c3 of every row, and where it was read: file, block, and place where rows are not in order of reading."""
    schema = ", ".join(f"{c} string" for c in COLUMNS)
    if not spans_lines(spark, path):
        rows = spark.read.csv(path, schema=schema, sep=sep, quote='"', escape='"', header=False, mode="PERMISSIVE")
        return rows.select(*COLUMNS, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true"}
    rows = spanning_records(spark, path, sep)
    return rows.select(F.from_csv("text", schema, options).alias("r"), "file", "block", "place").select("r.*", "file", "block", "place")


def _ordered(df: DataFrame) -> DataFrame:
    """``df`` (file, block and others) with ``ordinal``: its place among all rows, by file name, block and order of reading.

    Blocks are counted first; a row's place is the rows of the blocks before and its own in the block, which one task reads
    in order.
    """
    read = df.withColumnRenamed("place", "turn") if "place" in df.columns else df.withColumn("turn", F.monotonically_increasing_id())
    blocks = read.groupBy("file", "block").agg(F.min("turn").alias("first"), F.count(F.lit(1)).alias("held"))
    ahead = F.coalesce(F.sum("held").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each block
    starts = blocks.select("file", "block", "first", ahead.alias("ahead"))
    return read.join(starts, ["file", "block"]).withColumn("ordinal", (F.col("ahead") + F.col("turn") - F.col("first")).cast("long")).drop("file", "block", "turn", "first", "ahead")


def read_rows(spark: SparkSession, path: str, language: str, sep: str = "\t") -> DataFrame:
    """Delimited sentence rows of any of the known shapes; ragged rows and quoted fields are fine."""
    raw = _ordered(_delimited(spark, path, sep))
    last = F.greatest(*[F.when(F.col(c).isNotNull(), i + 1).otherwise(0) for i, c in enumerate(COLUMNS)])
    parsed = raw.select("ordinal", parse_row(F.slice(F.array(*COLUMNS), F.lit(1), last), language).alias("r")).filter("r is not null")
    return parsed.select("ordinal", "r.language", F.ltrim(F.regexp_replace("r.text", r"^\x{FEFF}", "")).alias("text"), "r.translation")


def read_plain(spark: SparkSession, path: str, language: str) -> DataFrame:
    """Running text: lines are joined, sentences split."""
    return _split(_lines(spark, path), language)


def read_subtitles(spark: SparkSession, path: str, language: str) -> DataFrame:
    """Subtitles: numbers, times and markup go, the rest is running text."""
    lines = _lines(spark, path).withColumn("value", F.trim("value")).filter(~F.col("value").rlike(r"^\p{Nd}+$") & ~F.col("value").contains("-->"))
    return _split(lines.withColumn("value", F.regexp_replace("value", r"<[^>]*>", "")), language)


def _split(lines: DataFrame, language: str) -> DataFrame:
    """Sentences of the lines (file, block, value) of each file, as ``text.sentences`` splits the joined lines."""
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    cut = lines.withColumn("value", line).filter("value <> ''").select("file", "block", F.filter(F.split("value", T.SENTENCE_END), lambda x: x != "").alias("parts"), F.col("value").rlike(r"[.!?。！？]$").alias("closed"))
    whole = _joined(cut.mapInArrow(_stitch, _PIECES), " ")
    trimmed = whole.withColumn("text", F.trim(F.regexp_replace("text", rf"^{T.SPACE}|{T.SPACE}$", ""))).filter("text <> ''")
    return _ordered(trimmed).select("ordinal", F.lit(language).alias("language"), "text", F.lit(None).cast("string").alias("translation"))


def read_sentences(spark: SparkSession, path: str, language: str = "en", input_format: str = "auto") -> DataFrame:
    """The reader for a file by its name, or by whether its first characters hold a tab."""
    name = path.lower().removesuffix(".bz2").removesuffix(".gz")
    head = ""
    if input_format == "auto" and not name.endswith((".srt", ".tsv", ".csv")):
        first = spark.read.text(path).limit(40).collect()
        head = "\n".join(r.value for r in first)[:4096]
    kind = input_format if input_format != "auto" else "srt" if name.endswith(".srt") else "csv" if name.endswith(".csv") else "tsv" if name.endswith(".tsv") or "\t" in head else "plain"
    if kind in ("tsv", "csv"):
        return read_rows(spark, path, language, "," if kind == "csv" else "\t")
    return (read_subtitles if kind == "srt" else read_plain)(spark, path, language)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id, language, text) rows; others are left out."""
    raw = _delimited(spark, path, "\t").select(F.col("c0").try_cast("long").alias("id"), L.language_code(F.trim("c1")).alias("language"), F.trim("c2").alias("text"))
    return raw.filter("id is not null and text is not null")


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, translation_id, link_order) of a table of links, also inside a tar archive; bad rows are left out."""
    if ".tar" in path.lower():
        files = spark.read.format("binaryFile").load(path).select("path")  # names alone; contents are streamed
        schema = "file string, block long, turn long, value string"
        lines = files.mapInPandas(_tar_lines, schema)
        ahead = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each member
        starts = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("held")).select("file", "block", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("ahead"))
        placed = lines.join(starts, ["file", "block"]).select((F.col("ahead") + F.col("turn")).cast("long").alias("ordinal"), F.split("value", r"[\t,]").alias("p"))
        raw = placed.select("ordinal", F.get("p", F.lit(0)).alias("c0"), F.get("p", F.lit(1)).alias("c1"))
    else:
        raw = _ordered(_delimited(spark, path, "," if path.lower().endswith(".csv") else "\t"))
    return raw.select(F.trim("c0").try_cast("long").alias("source_id"), F.trim("c1").try_cast("long").alias("translation_id"), F.col("ordinal").alias("link_order")).filter("source_id is not null and translation_id is not null")


def _decoded(source, most: int = 1 << 20):
    """Lines of a stream of bytes, a piece at a time."""
    import codecs

    decode, rest = codecs.getincrementaldecoder("utf-8")("replace"), ""
    while piece := source.read(most):
        *whole, rest = (rest + decode.decode(piece)).split("\n")
        yield from whole
    rest += decode.decode(b"", final=True)
    if rest:
        yield rest


def _tar_lines(batches, most: int = 100_000):
    """Lines of the tables in tar archives, with member and place; a member is read as a stream, so size doesn't matter."""
    import tarfile

    import pandas as pd
    from pyarrow.fs import FileSystem

    for b in batches:
        for path in b["path"]:
            fs, at = FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
            with fs.open_input_stream(at, compression=None) as source, tarfile.open(fileobj=source, mode="r|*") as tar:
                for block, member in enumerate(tar):
                    if not (member.isfile() and member.name.endswith((".csv", ".tsv"))):
                        continue
                    held, turn = [], 0
                    for line in _decoded(tar.extractfile(member)):
                        held.append((path, block, turn, line.rstrip("\r\n")))
                        turn += 1
                        if len(held) == most:
                            yield pd.DataFrame(held, columns=["file", "block", "turn", "value"])
                            held = []
                    if held:
                        yield pd.DataFrame(held, columns=["file", "block", "turn", "value"])


def read_word_forms(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (form, base) pairs; a row of one word is its own base; blank rows and notes are left out."""
    head = "\n".join(r.value for r in spark.read.text(path).limit(40).collect())
    sep = "," if path.lower().endswith(".csv") or ("\t" not in head and "," in head) else "\t"
    raw = _delimited(spark, path, sep).filter("c0 is not null and trim(c0) <> '' and not startswith(ltrim(c0), '#')")
    pairs = raw.select(T.form(F.col("c0")).alias("form"), T.form(F.coalesce(F.nullif(F.trim("c1"), F.lit("")), F.col("c0"))).alias("base"))
    return pairs.filter("form <> '' and base <> ''").distinct()

# what workers run of this module travels with its data, so they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
