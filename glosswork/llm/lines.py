"""Line dedup: lines that many documents share stay in one of them.

A document's lines are what stands between its line feeds. A line's key is the line without ASCII white space at both
ends, A-Z lower-cased; keys of ``least_chars`` code points or more are exploded as 128-bit hashes, once a document.
Distinct documents are counted for each hash, in two steps that both combine before their shuffle. Of a key that
``least_documents`` or more hold, every line goes but those in the document of the largest id; the others of a text are
put together again in their order. Texts meet the hashes that they lose by doc_id, so a line's text is never shuffled
by its key.

Keys that hold over 1/1024 of all (document, key) pairs, at most 1,024 of them, are met by broadcast where the pairs
lie, and a doc_id that so many rows repeat is dealt over several tasks.

Defined results: null or empty text is one empty line, which is never dropped; a text whose lines all go is empty; a
very long text is one row in one task, with the hashes of its lines; rows of one doc_id are one document, however often
they are repeated, and each loses the same lines; rows of null doc_id are one document that is least of all, so that it
keeps no shared line; ties can't arise, as the largest id is one document; an empty table gives no rows; further
columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.llm.common import HOT_SHARE, documents, shared_folder, spread_join, stored, table

LEAST_CHARS, LEAST_DOCUMENTS = 20, 3


def split_lines(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def line_key(line: bytes) -> bytes:
    return line.strip().lower()  # of bytes, these know ASCII alone


def long_enough(key: bytes, least_chars: int) -> bool:
    return len(key) >= least_chars and (len(key) >= 4 * least_chars or len(key.decode("utf-8", "surrogatepass")) >= least_chars)


def key_hash(key: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(key)


def _exploder(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = {key_hash(k) for k in map(line_key, split_lines(text.as_py())) if long_enough(k, least_chars)}
                ids += [doc_id] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"])

    return run


def _joiner(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, dropped in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                text = text.as_py() or ""
                lines = split_lines(text)
                gone = set(dropped.as_py() or ())
                kept = [x for x in lines if not (long_enough(k := line_key(x), least_chars) and key_hash(k) in gone)] if gone else lines
                rows.append((doc_id, b"\n".join(kept).decode("utf-8", "surrogatepass") if gone else text, len(lines), len(lines) - len(kept)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["doc_id", "text", "n_lines", "n_dropped"])

    return run


def shared_lines(lines: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(key, documents, keeper) of keys that enough documents of ``lines`` (doc_id, key) hold; keeper is the largest id."""
    held = F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("long"))
    return lines.groupBy("key").agg(held.alias("documents"), F.max("doc_id").alias("keeper")).filter(F.col("documents") >= max(2, least_documents))


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """doc_id, text (what is left of it), n_lines (before), n_dropped for every row of ``docs`` (doc_id, text)."""
    folder = shared_folder(docs.sparkSession)
    texts = documents(docs)
    lines = stored(texts.mapInArrow(_exploder(least_chars), "doc_id long, key binary"), folder, "lines")
    shared = stored(shared_lines(lines, least_documents), folder, "shared")
    is_hot = F.col("documents") * HOT_SHARE > lines.count()
    hot = F.broadcast(shared.filter(is_hot).select("key", "keeper"))
    cold = lines.join(hot.select("key"), "key", "left_anti").join(shared.filter(~is_hot).select("key", "keeper"), "key")
    met = lines.join(hot, "key").unionByName(cold).filter("doc_id is null or doc_id <> keeper")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))  # a key that is never null
    dropped = stored(met.groupBy(name.alias("name")).agg(F.collect_set("key").alias("dropped")), folder, "dropped")
    met = spread_join(texts.withColumn("name", name), dropped, "name", F.xxhash64("text"), how="left")
    return met.select("doc_id", "text", "dropped").mapInArrow(_joiner(least_chars), "doc_id long, text string, n_lines long, n_dropped long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = dedup_lines(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


NAME = "op11_line_dedup"
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
l AS (
  SELECT doc_id, r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM d),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::BIGINT) >= 3),
j AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.keeper AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY r
"""
