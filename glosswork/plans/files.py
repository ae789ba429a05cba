"""Queries that write tables of the provided data as files of each kind and read them back by the readers and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from glosswork.build import build
from glosswork.functions import text as T
from glosswork.operators import corpus as K
from glosswork.plans import pieces as p
from glosswork.plans.catalog import entry, indexed, library, raw, table, word_pairs
from glosswork.plans.pieces import sql
from glosswork.sources import readers as R
from glosswork.sources import remote
from glosswork.sources import sinks as W


def place(spark, name: str) -> str:
    return f"{W.scratch_folder(spark)}/{uuid.uuid4().hex}-{name}"


def items(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", "text")


def lines(spark, rows, name: str, **options) -> str:
    """One file of ordered lines (by ``n``)."""
    path = place(spark, name)
    rows.orderBy("n").select("value").coalesce(1).write.options(**options).text(path)
    return path


def files_of_lines(spark, rows, name: str) -> str:
    """Ordered lines (by ``n``) in several files, whose names are in that order."""
    path = place(spark, name)
    rows.repartitionByRange("n").sortWithinPartitions("n").select("value").write.text(path)
    return path


_QUOTED = "CASE WHEN item_id % 3 = 0 THEN text || ' \"so\"' ELSE text END"


def _delimited(spark, sf, sep: str, name: str) -> str:
    path = place(spark, name)
    said = F.when(F.col("item_id") % 3 == 0, F.concat("text", F.lit(' "so"'))).otherwise(F.col("text"))
    rows = items(spark, sf).orderBy("item_id").select(F.lit("deu"), said, F.concat(F.lit("meaning, of "), "item_id"))
    rows.coalesce(1).write.option("sep", sep).option("quote", '"').option("escape", '"').csv(path)
    return path


_ROWS = f"SELECT row_number() OVER (ORDER BY item_id) - 1 AS ordinal, 'de' AS language, trim({_QUOTED}) AS text, 'meaning, of ' || item_id AS translation FROM benchmark"


@entry(_ROWS)
def read_csv_rows(spark, sf):
    return R.read_sentences(spark, _delimited(spark, sf, ",", "rows.csv"), "en")


@entry(_ROWS)
def read_tsv_rows(spark, sf):
    return R.read_sentences(spark, _delimited(spark, sf, "\t", "rows.txt"), "en", "tsv")


_SENTENCES = r"""SELECT row_number() OVER (ORDER BY i) - 1 AS ordinal, 'en' AS language, ss[i] AS text FROM (SELECT ss, unnest(generate_series(1, len(ss))) AS i FROM (
SELECT list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS ss FROM (SELECT string_agg(regexp_replace(text, '\s*[\r\n]+\s*', ' ', 'g'), ' ' ORDER BY item_id) AS t FROM benchmark)))"""


def _running(spark, sf):
    return items(spark, sf).select(F.col("item_id").alias("n"), F.regexp_replace("text", r"\s*[\r\n]+\s*", " ").alias("value"))


@entry(_SENTENCES)
def read_plain_text(spark, sf):
    return R.read_sentences(spark, lines(spark, _running(spark, sf), "running.txt"), "en").select("ordinal", "language", "text")


@entry(_SENTENCES)
def read_bz2_text(spark, sf):
    return R.read_sentences(spark, lines(spark, _running(spark, sf), "running.txt.bz2", compression="bzip2"), "en", "plain").select("ordinal", "language", "text")


@entry(_SENTENCES)
def read_subtitle_text(spark, sf):
    i = F.col("n")
    parts = F.array(i.cast("string"), F.lit("00:00:01,000 --> 00:00:02,000"), F.concat(F.lit("<i>"), "value", F.lit("</i>")), F.lit(""))
    rows = _running(spark, sf).select("n", F.posexplode(parts).alias("k", "value")).select((i * 4 + F.col("k")).alias("n"), "value")
    return R.read_sentences(spark, lines(spark, rows, "film.srt"), "en").select("ordinal", "language", "text")


_ONE_LINE = r"trim(regexp_replace(text, '\s*[\r\n]+\s*', ' ', 'g'))"


@entry(f"SELECT item_id AS id, 'en' AS language, {_ONE_LINE} AS text FROM benchmark WHERE item_id % 4 <> 3")
def read_id_rows(spark, sf):
    fields = F.concat_ws("\t", F.when(F.col("n") % 4 == 3, F.lit("x1")).otherwise(F.col("n").cast("string")), F.lit("eng"), "value")
    return R.read_ids(spark, lines(spark, _running(spark, sf).select("n", fields.alias("value")), "ids.tsv"))


@entry("SELECT doc_id AS source_id, doc_id * 2 + 1 AS translation_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents WHERE doc_id % 5 <> 4")
def read_link_rows(spark, sf):
    i = F.col("doc_id")
    rows = table(spark, sf, "documents").select(i.alias("n"), F.when(i % 5 == 4, F.lit("bad\trow")).otherwise(F.concat_ws("\t", i, i * 2 + 1)).alias("value"))
    got = R.read_links(spark, files_of_lines(spark, rows, "links.tsv"))
    # link_order counts bad rows too, so places among good ones are counted again here
    order = got.select("source_id", "translation_id", "link_order", (F.floor(F.col("link_order") / 5)).alias("before"))
    return order.select("source_id", "translation_id", (F.col("link_order") - F.col("before")).cast("long").alias("place"))


def _archives(folder: str):
    """Writes each task's lines as the two tables of a tar archive; gives its path."""

    def run(batches):
        import io
        import tarfile

        import pyarrow as pa
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        fs, top = FileSystem.from_uri(folder)
        name = f"{top}/{TaskContext.get().partitionId():05d}.tar.bz2"
        values = [v for batch in batches for v in batch.column(0).to_pylist()]
        fs.create_dir(top)
        with fs.open_output_stream(name, compression=None) as out, tarfile.open(fileobj=out, mode="w|bz2") as tar:
            half = len(values) // 2
            for member, part in (("a/links.csv", values[:half]), ("a/notes.txt", ["of no use"]), ("b/links.tsv", values[half:])):
                data = "".join(f"{v}\n" for v in part).encode()
                info = tarfile.TarInfo(member)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
        yield pa.RecordBatch.from_pydict({"path": [name]})

    return run


@entry("SELECT doc_id AS source_id, doc_id * 2 + 1 AS translation_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents WHERE doc_id % 5 <> 4")
def read_archived_links(spark, sf):
    """Links from tables inside tar archives, in order of archive, member and line."""
    i = F.col("doc_id")
    value = F.when(i % 5 == 4, F.lit("bad\trow")).when(i % 2 == 0, F.concat_ws("\t", i, i * 2 + 1)).otherwise(F.concat_ws(",", i, i * 2 + 1))
    folder = place(spark, "links.tar")
    rows = table(spark, sf, "documents").select(i.alias("n"), value.alias("value")).repartitionByRange("n").sortWithinPartitions("n")
    rows.select("value").mapInArrow(_archives(folder), "path string").collect()  # a row for each archive
    got = R.read_links(spark, f"{folder}/*.tar.bz2")
    return got.select("source_id", "translation_id", (F.col("link_order") - F.floor(F.col("link_order") / 5)).cast("long").alias("place"))


_BUILT = {"judged": p.PIECES["judged"][1].replace("BETWEEN 4 AND 15", "BETWEEN 2 AND 10")}


@entry(sql("SELECT count(*) AS processed, count(*) FILTER (skip_reason IS NULL) AS inserted, count(*) FILTER (skip_reason IS NOT NULL) AS skipped, false AS limit_reached FROM judged", "raw", **_BUILT))
def build_metrics(spark, sf):
    """A library built from files of delimited rows, several files in order; the metrics that the builder gives."""
    source = place(spark, "rows.tsv")
    rows = raw(spark, sf).repartitionByRange("ordinal").sortWithinPartitions("ordinal").select("language", "text")
    rows.write.option("sep", "\t").option("quote", '"').option("escape", '"').option("quoteAll", "true").csv(source)
    return build(spark, source, place(spark, "library"), "en", "tsv")


@entry(f"SELECT DISTINCT form, base FROM (SELECT {p.form('w')} AS form, CASE WHEN length(w) % 2 = 0 THEN {p.form('w')} ELSE {p.form('left(w, 3)')} END AS base FROM (SELECT unnest({p.words('text')}) AS w FROM benchmark)) WHERE form <> '' AND base <> ''")
def read_word_form_rows(spark, sf):
    w = F.col("w")
    found = items(spark, sf).select(F.explode(T.words(F.col("text"))).alias("w"))
    rows = found.select(w.alias("n"), F.when(F.length(w) % 2 == 0, w).otherwise(F.concat_ws("\t", w, F.substring(w, 1, 3))).alias("value"))
    notes = spark.createDataFrame([("", "# a note\tof no use"), ("", "")], "n string, value string")
    return R.read_word_forms(spark, lines(spark, rows.unionByName(notes), "forms.tsv"))


@entry(f"SELECT row_number() OVER (ORDER BY item_id) - 1 AS turn, 'de' AS language, {_ONE_LINE} AS text FROM benchmark")
def stream_remote_rows(spark, sf):
    """Rows unpacked and parsed while they arrive from an address; here that of a file."""
    path = lines(spark, _running(spark, sf).select("n", F.concat(F.lit("deu\t"), "value").alias("value")), "remote", compression="bzip2")
    name = next(f.path for f in spark.read.format("binaryFile").load(path).select("path").collect())
    url = name if "://" in name else "file://" + name.removeprefix("file:")
    return remote.read_remote(spark, [url], "en").select("turn", "language", "text")


# ---- libraries


@entry(sql("SELECT 'sentences' AS name, count(*) AS n FROM sentences UNION ALL SELECT 'forms', count(*) FROM forms UNION ALL SELECT 'word_forms', count(*) FROM word_forms UNION ALL SELECT 'versions', 2", "sentences", "forms", "word_forms"))
def library_versions(spark, sf):
    """A library written twice: readers see the later version, the earlier one stays behind it."""
    path = place(spark, "library")
    tables = {"sentences": library(spark, sf), "forms": indexed(spark, sf), "word_forms": word_pairs(spark, sf)}
    W.replace_library({n: t.limit(1) for n, t in tables.items()}, path, "v1")
    W.replace_library(tables, path, "v2")
    opened = W.open_read_only(spark, path)
    counts = [t.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n, t in opened.items()]
    kept = spark.createDataFrame([("versions", 1 + len(W.previous_versions(spark, path)))], "name string, n long")
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(kept)


@entry("SELECT event_id % 100 AS key, max(event_id) AS value FROM events GROUP BY 1")
def store_upsert(spark, sf):
    """A keyed store saved as JSON, changed by key, saved and read again."""
    e = table(spark, sf, "events").groupBy((F.col("event_id") % 100).alias("key")).agg(F.min("event_id").alias("first"), F.max("event_id").alias("value"))
    path = place(spark, "store.json")
    W.save_store(e.select("key", F.col("first").alias("value")), path)
    W.save_store(W.upsert(spark.read.schema("key long, value long").json(path), e.select("key", "value"), ["key"]), path)
    return spark.read.schema("key long, value long").json(path)


@entry(sql("SELECT id, array_to_string(forms, ',') AS forms FROM forms", "forms"))
def index_backfill(spark, sf):
    held = indexed(spark, sf)
    return K.backfill_index(library(spark, sf), held.filter(F.size("forms") < 9)).select("id", F.array_join("forms", ",").alias("forms"))


@entry(sql("SELECT form, base FROM word_forms", "word_forms"))
def word_form_backfill(spark, sf):
    pairs = word_pairs(spark, sf)
    old = pairs.select(F.col("form").alias("word_form"), F.col("base").alias("lemma"))
    return K.backfill_word_forms(pairs.filter("length(form) > 5"), old.unionByName(spark.createDataFrame([("", "x"), ("y", "")], old.schema)))


@entry(sql("SELECT language, full_text, min(id) AS id, min(id) NOT IN (SELECT id FROM sentences WHERE word_count BETWEEN 8 AND 11) AS inserted FROM sentences WHERE word_count > 9 GROUP BY language, full_text", "sentences"))
def inserted_ids(spark, sf):
    s = library(spark, sf)
    new = s.filter("word_count > 9").select("language", "full_text", "id")
    return K.held_ids(s.filter("word_count between 8 and 11"), new.unionByName(new.withColumn("id", F.col("id") + 1)))


@entry(sql("SELECT id, full_text FROM sentences WHERE word_count > 11", "sentences"))
def add_repeated_sentences(spark, sf):
    """Rows that come twice, under two ids, are added once."""
    s = library(spark, sf)
    new = s.filter("word_count > 9")
    return K.add_sentences(s.filter("word_count between 8 and 11"), new.unionByName(new.withColumn("id", F.col("id") + 1))).select("id", "full_text")


@entry(sql("SELECT id, word_count FROM sentences", "sentences"))
def recounted_words(spark, sf):
    s = library(spark, sf)
    return K.recounted(s.withColumn("word_count", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, F.col("word_count")))).select("id", "word_count")


@entry(sql(f"SELECT id, array_to_string(list_sort(list_distinct(list(form || '>' || base))), ',') AS pairs FROM (SELECT id, form, {p.lemma('form', 'language')} AS base FROM posts) WHERE base <> '' GROUP BY id", "posts"))
def word_maps(spark, sf):
    return K.word_map(library(spark, sf)).select("id", F.array_join(F.transform(F.array_sort(F.map_entries("word_map")), lambda e: F.concat(e["key"], F.lit(">"), e["value"])), ",").alias("pairs"))


@entry(sql("SELECT language, count(*) AS sentences, count(*) FILTER (word_count > 8)::BIGINT AS translated, sum(word_count)::BIGINT AS words FROM sentences GROUP BY language", "sentences"))
def translated_counts(spark, sf):
    return K.library_counts(library(spark, sf).withColumn("translation", F.when(F.col("word_count") > 8, F.col("full_text")).when(F.col("word_count") > 6, "")))


@entry(sql("SELECT form, base FROM word_forms WHERE length(form) > 4 UNION SELECT 'sentences', count(*)::VARCHAR FROM sentences", "word_forms", "sentences"))
def replaced_word_forms(spark, sf):
    """A library's word forms exchanged as a whole; its sentences stay."""
    path = place(spark, "library")
    W.replace_library({"sentences": library(spark, sf), "forms": indexed(spark, sf), "word_forms": word_pairs(spark, sf)}, path, "v1")
    W.replace_word_forms(spark, path, word_pairs(spark, sf).filter("length(form) > 4"), "v2")
    opened = W.open_library(spark, path)
    return opened["word_forms"].select("form", "base").unionByName(opened["sentences"].agg(F.lit("sentences").alias("form"), F.count(F.lit(1)).cast("string").alias("base")))
