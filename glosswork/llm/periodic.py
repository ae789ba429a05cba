"""Periodic runs of words: where a text repeats a stretch of words four times and more without a pause.

All-lag scan: the array of a text's word ids is compared with itself shifted by each lag up to n / exponent, and the
true stretches that are long enough are its runs of that period. A stretch of ``need`` true places holds every
``need``-th place once, so a shift is compared at these places first and at all places only where one of them and its
neighbours agree; nothing is missed. Ids differ between texts, so many texts of one block are compared at once, the
longest first: those that are long enough for a lag are its beginning. A stretch that a smaller period has too, which
then divides it, has the same start and length and goes by that period.

Texts of over ``LONG`` characters are kept apart: once each, by digest, they go out as (text, range of lags) to as many
tasks as their work asks for, and their runs meet their rows by digest again. Copies of one very long text are dealt
over several tasks.

Defined results: null, empty and blank texts have no words and no runs; words are compared as they stand, byte by byte;
ties for the greatest exponent go to the smallest start, then period; repeated rows and equal texts have equal results;
a null doc_id is kept; an empty table gives no rows; further columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.llm.common import WORD, documents, shared_folder, spread_join, stored, table

LEAST, EXPONENT = 6, 4
#: Characters from which on a text's lags are dealt over tasks, and comparisons of a task.
LONG, WORK = 400_000, 1 << 33
#: Characters of a block of texts that are compared at once.
BLOCK = 4_000_000
#: Below so many places, looking at single ones first saves nothing.
SPARSE = 16

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("text", pa.string())])
DDL = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string"


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # of bytes, this knows ASCII white space alone


def _seen(x: np.ndarray, lag: int, need: int) -> bool:
    """Whether ``need`` places on end may agree at this lag: one of every ``need``-th does, with three on one side of it."""
    p = np.arange(need - 1, len(x) - lag, need)
    p = p[x[p] == x[p + lag]]
    if not len(p):
        return False
    after, before = np.minimum(p[:, None] + np.arange(1, 4), len(x) - lag - 1), np.maximum(p[:, None] - np.arange(1, 4), 0)
    return bool(((x[after] == x[after + lag]).all(1) | (x[before] == x[before + lag]).all(1)).any())


def scan(ids: np.ndarray, sizes: np.ndarray, least: int = LEAST, exponent: int = EXPONENT, first: int = 1, last: int | None = None) -> np.ndarray:
    """Rows (text, start, length, period) of the runs with periods from ``first`` to ``last``, each with its smallest one.

    ``ids``: word ids of texts of ``sizes`` words, the longest first; no id is in two texts.
    """
    ends, found = np.cumsum(sizes), []
    top = int(sizes[0]) // exponent if len(sizes) else 0
    for lag in range(first, min(top, last or top) + 1):
        texts = int(np.searchsorted(-sizes, -max(least, exponent * lag), "right"))
        if not texts:
            break
        x = ids[: ends[texts - 1]]
        need = max(1, least - lag, (exponent - 1) * lag)
        if need >= SPARSE and not _seen(x, lag, need):
            continue
        at = np.flatnonzero(x[:-lag] == x[lag:])
        if len(at) < need or not (at[need - 1 :] - at[: len(at) - need + 1] == need - 1).any():
            continue
        cut = np.flatnonzero(np.diff(at) != 1)
        s, e = at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]] + 1
        s, e = s[e - s >= need], e[e - s >= need]
        text = np.searchsorted(ends, s, "right")
        found.append(np.stack([text, s - (ends[text] - sizes[text]), e - s + lag, np.full(len(s), lag)], 1))
        if len(sizes) == 1 and e[0] - s[0] + lag == sizes[0]:
            break  # all words have this period: any further stretch is this one again
    runs = np.concatenate(found) if found else np.empty((0, 4), np.int64)
    runs = runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :3] != runs[:-1, :3]).any(1)
    runs = runs[new]
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Word ids and sizes of texts, longest first; equal words of two texts have two ids."""
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.sum():
        return np.empty(0, np.int64), sizes
    flat = np.empty(int(sizes.sum()), object)
    flat[:] = [w for t in texts for w in t]
    ids, words = pd.factorize(flat)
    return ids + np.repeat(np.arange(len(sizes)), sizes) * len(words), sizes


def collapse(words: list[bytes], runs: np.ndarray) -> str:
    """The words that are in no run (start, length, period) after its first period, joined by one space."""
    kept = words
    if len(runs):
        step = np.zeros(len(words) + 1, np.int64)
        np.add.at(step, runs[:, 0] + runs[:, 2], 1)
        np.add.at(step, runs[:, 0] + runs[:, 1], -1)
        kept = [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0)]
    return b" ".join(kept).decode("utf-8", "surrogatepass")


def _batch(ids: list, words: list[list[bytes]], runs: list[np.ndarray]) -> pa.RecordBatch:
    rows = np.concatenate(runs) if runs else np.empty((0, 3), np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(r) for r in runs])].astype(np.int32)), pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(3)], fields=list(_RUN)))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(w) for w in words], pa.int64()), lists, pa.array([collapse(w, r) for w, r in zip(words, runs)], pa.string())], schema=_OUT)


def _whole(least: int, exponent: int):
    """All lags of texts, by blocks of texts."""

    def block(ids: list, words: list[list[bytes]]) -> pa.RecordBatch:
        order = np.argsort([-len(w) for w in words], kind="stable")
        found = scan(*numbered([words[i] for i in order]), least, exponent)
        cuts = np.searchsorted(found[:, 0], np.arange(len(words) + 1))
        runs: list = [None] * len(words)
        for turn, i in enumerate(order):
            runs[i] = found[cuts[turn] : cuts[turn + 1], 1:]
        return _batch(ids, words, runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words, held = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                ids.append(doc_id)
                words.append(split_words(text))
                held += len(text)
                if held >= BLOCK:
                    yield block(ids, words)
                    ids, words, held = [], [], 0
            if ids:
                yield block(ids, words)

    return run


def _ranges(least: int, exponent: int):
    """A range of lags of one long text a row: the runs that it finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, text, part, parts in zip(*(batch.column(i) for i in range(4))):
                ids, sizes = numbered([split_words(text.as_py())])
                lags, part, parts = int(sizes[0]) // exponent, part.as_py(), parts.as_py()
                found = scan(ids, sizes, least, exponent, 1 + lags * part // parts, lags * (part + 1) // parts) if lags * (part + 1) // parts > lags * part // parts else np.empty((0, 4), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([digest.as_py()] * len(found), pa.binary()), *(pa.array(found[:, i].astype(np.int64)) for i in (1, 2, 3))], ["digest", "start", "length", "period"])

    return run


def _collapser(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, text, runs in zip(batch.column(0), batch.column(1), batch.column(2)):
            rows = np.array([[r["start"], r["length"], r["period"]] for r in runs.as_py() or ()], np.int64).reshape(-1, 3)
            yield _batch([doc_id.as_py()], [split_words(text.as_py())], [rows])


def periodic_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT, long: int = LONG, work: int = WORK) -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start and period) and text (collapsed) of ``docs`` (doc_id, text).

    A run is a stretch of words of smallest period q that has ``exponent`` * q words and ``least`` words at least, and
    that no neighbouring word extends. The text keeps the words that are in no run after its first q.
    """
    texts = documents(docs)
    is_long = F.coalesce(F.length("text") > long, F.lit(False))
    short = texts.filter(~is_long).mapInArrow(_whole(least, exponent), DDL)
    folder = shared_folder(docs.sparkSession)
    rows = stored(texts.filter(is_long).withColumn("digest", F.unhex(F.sha2("text", 256))), folder, "long")
    if rows.isEmpty():
        return short
    n = F.regexp_count(F.col("text"), F.lit(WORD)).cast("long")
    once = rows.select("digest", "text").dropDuplicates(["digest"]).withColumn("parts", F.ceil((n * n + 1) / exponent / work).cast("long"))
    parts = once.select("digest", "text", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), "parts")
    dealt = parts.repartition("digest", "part")
    found = dealt.mapInArrow(_ranges(least, exponent), "digest binary, start long, length long, period long")
    run = F.struct("start", "period", "length")
    by_text = found.groupBy("digest", "start", "length").agg(F.min("period").alias("period")).groupBy("digest").agg(F.array_sort(F.collect_list(run)).alias("runs"))
    by_text = stored(by_text.withColumn("runs", F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period")))), folder, "runs")
    met = spread_join(rows, by_text, "digest", F.monotonically_increasing_id(), how="left").select("doc_id", "text", "runs")
    return short.unionByName(met.mapInArrow(_collapser, DDL))


def greatest(runs: Column) -> Column:
    """The run of greatest exact length / period, the first one of equal ones; null if there is none."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the documents, by a hash of the id, repeat a stretch of their words to the end."""
    rows = documents(docs).withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    g = F.expr("h div 10")

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        tail = F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda i: F.get(words, (a + i % p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " "))

    # bound as a lambda's variable, words are cut out once, however often they are looked at
    once = F.get(F.transform(F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), repeated), F.lit(0))
    return rows.select("doc_id", F.when(F.col("h") % 10 == 0, F.coalesce(once, F.col("text"))).otherwise(F.col("text")).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(table(spark, sf_dir, "documents")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    top = found.withColumn("top", greatest(F.col("runs")))
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col("text"), 256).alias("collapsed_sha256"), "n_words",
    )


NAME = "op12_periodic_runs"
