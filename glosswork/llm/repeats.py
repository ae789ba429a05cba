"""Passages that repeat across documents, by sparse suffix arrays.

A text's suffixes are kept at minimisers only: of every ``least`` words in a row, the leftmost place whose k words
have the smallest hash. Places depend on content alone, so equal passages keep equal places, and every window of
``least`` words belongs to exactly one of them. Kept suffixes are dealt by the hash of their k words and sorted by
the words from there on; each is compared with its neighbours, and matches are extended to the left and the right.
A match of ``least`` words or more covers windows. Where a suffix keeps windows that its neighbours don't cover, the
windows of its group are compared by hash, so that a partner further off in the order is not missed: the result is
exact.

A window's representative is the least text (by hash) that has it, with its place there. A passage is a longest run of
windows of one representative that follow each other there too, and is returned with its place in it. So links are rows
of a text and a representative, one of which each text with a repeated window is or has: two texts share a window just
where their passages lead to the same words of the same representative. No link between two texts is lost, and none is
made a pair. Where the representative changes, a passage ends and the next begins; neighbouring ones may overlap by up to
``least - 1`` words, as their windows do.

A count sketch of fixed size, over all texts, tells suffixes whose k words no other text has; they are not sent at
all, others carry the ``2 * least - k`` words around them. Far beyond its size it tells none, and every suffix is sent: for
the ~2 suffixes that ``least - k`` words keep that is about 3 times the input, in proportion at every size. The sketch
also tells how many texts share a suffix's words: a frequent one is dealt over as many groups as its count asks for.
Each group has representatives of its own then, and only these are compared by their windows' hashes: a text leads to its
group's representative, and that one to the least of all; a row that leads to itself is the end. Copies of a text are one
text from the start.

Defined results: words are compared with A-Z lower-cased; repeats inside one document don't count; documents (rows)
with equal text of ``least`` words or more repeat as a whole, and represent themselves where no other text has the
words; of equal texts the least doc_id stands for all; null, empty and shorter texts have no passages; a very long text is
read whole, its words in slices; a null doc_id is kept; further columns are left out, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glosswork.llm import sketch
from glosswork.llm.common import documents, shared_folder, spread_join, stored, table
from glosswork.llm.hashing import blocks, mix, sequences, utf8, words

LEAST, K = 50, 10
#: Bytes of the count sketch, and where a key's two cells come from; texts for a group of a frequent suffix, and suffixes for a bucket.
CELLS, SHIFTS, GROUP, PER_BUCKET = 1 << 25, (5, 33), 256, 20_000
#: Suffixes that a task holds, with the words around them, before it deals them.
HELD = 30_000


def minimisers(h: np.ndarray, counts: np.ndarray, least: int, k: int):
    """(text, place, first, last, key) of each kept suffix: place and the first and last window of its own, in words of
    its text, and the hash of its k words."""
    runs, n = sequences(h, counts, k)
    width = least - k + 1
    none = tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, np.uint64),)
    if len(runs) < width:
        return none
    at = sliding_window_view(runs, width).argmin(1) + np.arange(len(runs) - width + 1)
    text = np.repeat(np.arange(len(n)), n)
    begin = (np.cumsum(n) - n)[text]
    own = text[: len(at)] == text[width - 1 :]
    window = np.flatnonzero(own)
    if not len(window):
        return none
    at = at[window]
    first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (text[window[1:]] != text[window[:-1]])))
    last = np.append(first[1:], len(at)) - 1
    place, b = at[first], begin[window[first]]
    return text[place], place - b, window[first] - b, window[last] - b, runs[place]


def _text_hash(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    import xxhash

    return [xxhash.xxh3_64_intdigest(data[a:b].tobytes()) - (1 << 63) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


_SEEN = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()), ("kept", pa.int64()), ("block", pa.int32()), ("data", pa.binary())])


def _surveyor(least: int, k: int, size: int):
    """A row for each text, and the task's part of the count sketch: in how many texts each key is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, seen = None, set()
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in blocks(offsets):
                h, _, _, counts = words(data, offsets[a : b + 1])
                hashes = _text_hash(data, offsets[a : b + 1])
                text, _, _, _, key = minimisers(h, counts, least, k)
                new = np.array([not (x in seen or seen.add(x)) for x in hashes], bool)
                use = new[text] if len(text) else np.empty(0, bool)
                kept = np.bincount(text[use], minlength=b - a)
                if use.any():
                    cells = np.zeros(size, np.uint8) if cells is None else cells
                    sketch.add(cells, _once(text[use], key[use]), SHIFTS)
                none = pa.nulls(b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(hashes, pa.int64()), pa.array(counts), pa.array(kept.astype(np.int64)), none.cast(pa.int32()), none.cast(pa.binary())], schema=_SEEN)
        if cells is not None:
            for i, part in sketch.pack(cells):
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 4 + [pa.array([i], pa.int32()), pa.array([part], pa.binary())], schema=_SEEN)

    return run


def _once(text: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Each text's distinct keys."""
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    return key[np.append(True, (key[1:] != key[:-1]) | (text[1:] != text[:-1]))]


def _dealer(least: int, k: int, shared_cells, buckets: int):
    """Kept suffixes that other texts may share, dealt by key and salt into buckets, with the words around them."""
    before, size = least - k, 2 * least - k
    schema = pa.schema([("bucket", pa.int32()), ("keys", pa.list_(pa.int64())), ("texts", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("firsts", pa.list_(pa.int32())), ("lasts", pa.list_(pa.int32())), ("salted", pa.list_(pa.bool_())), ("around", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, seen, held = shared_cells.value, set(), []

        def dealt() -> pa.RecordBatch:
            key, text, place, first, last, salted, around = map(np.concatenate, zip(*held))
            held.clear()
            to = (key >> np.uint64(24)).astype(np.int64) % buckets
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(buckets + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x[order])) for x in (key.view(np.int64), text, place.astype(np.int32), first.astype(np.int32), last.astype(np.int32), salted)]
            raw = around[order]
            blobs = pa.array([raw[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(np.arange(buckets, dtype=np.int32)), *lists, blobs], schema=schema).filter(pa.array(np.diff(cuts) > 0))

        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in blocks(offsets):
                h, _, _, counts = words(data, offsets[a : b + 1])
                hashes = np.array(_text_hash(data, offsets[a : b + 1]), np.int64)
                new = np.array([not (x in seen or seen.add(x)) for x in hashes.tolist()], bool)
                text, place, first, last, key = minimisers(h, counts, least, k)
                if not len(text):
                    continue
                logs = sketch.look(cells, key, SHIFTS)
                use = np.flatnonzero((logs >= 4) & new[text])  # two texts or more
                text, place, first, last, key, logs = (x[use] for x in (text, place, first, last, key, logs))
                salts = np.maximum(1, (2.0 ** (logs / 4) / GROUP).astype(np.uint64))
                salt = mix(hashes[text].view(np.uint64) + key) % salts
                start = (np.cumsum(counts) - counts)[text]
                at = (start + place - before)[:, None] + np.arange(size, dtype=np.int32)
                inside = (at >= start[:, None]) & (at < (start + counts[text])[:, None])
                around = np.where(inside, (h[np.clip(at, 0, len(h) - 1)] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), np.uint32(0))
                held.append((mix(key + salt * np.uint64(0x9E3779B97F4A7C15)), hashes[text], place, first, last, salts > 1, around))
                if sum(len(x[0]) for x in held) >= HELD:
                    yield dealt()
        if held:
            yield dealt()

    return run


def least_of(name: np.ndarray, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of some named windows of texts: the least text that has it, its first place there, and how many texts have it."""
    order = np.lexsort((at, text, name))
    n, t = name[order], text[order]
    head = np.append(True, n[1:] != n[:-1])
    new = head | np.append(True, t[1:] != t[:-1])
    first = np.flatnonzero(head)
    of = np.cumsum(head) - 1
    out = [np.empty(len(name), np.int64) for _ in range(3)]
    for x, y in zip(out, (t[first], at[order][first], np.add.reduceat(new.astype(np.int64), first))):
        x[order] = y[of]
    return out[0], out[1], out[2]


def _label(rep: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """One number for a representative and how far ahead a window is there; not 0."""
    return mix(rep.view(np.uint64) + mix(ahead.view(np.uint64))) | np.uint64(1)


def runs(label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, low, high) of every longest run of columns with one label that isn't 0."""
    wide = np.pad(label, ((0, 0), (1, 1)))
    r, low = np.nonzero((wide[:, 1:-1] != wide[:, :-2]) & (label != 0))
    _, high = np.nonzero((wide[:, 1:-1] != wide[:, 2:]) & (label != 0))
    return r, low, high


def covered(key: np.ndarray, text: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray, around: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which windows of each suffix another text has; which are its own windows; all by how far left of the place they begin.

    The third result is the hash of every window, for those that have to be compared elsewhere.
    """
    before, n = least - k, len(key)
    lefts = np.arange(before + 1)
    own = (lefts >= (place - last)[:, None]) & (lefts <= (place - first)[:, None])
    # sort by key and the words from the place on
    wide = np.empty((n, 8 + 4 * least), np.uint8)
    wide[:, :8] = key.astype(">u8").view(np.uint8).reshape(n, 8)
    wide[:, 8:] = np.ascontiguousarray(around[:, before:]).astype(">u4").view(np.uint8).reshape(n, 4 * least)
    order = np.argsort(np.ascontiguousarray(wide).view(f"S{wide.shape[1]}").ravel(), kind="stable")
    got = np.zeros((n, before + 1), bool)
    x, y = order[:-1], order[1:]
    pair = (key[x] == key[y]) & (text[x] != text[y])
    x, y = x[pair], y[pair]
    same = (around[x] == around[y]) & (around[x] != 0)
    right = np.where(same[:, before:].all(1), least, same[:, before:].argmin(1))
    back = same[:, :before][:, ::-1]
    left = np.where(back.all(1), before, back.argmin(1)) if before else np.zeros(len(x), np.int64)
    met = (lefts <= left[:, None]) & (least - lefts <= right[:, None])
    for side in (x, y):  # each suffix is once an upper and once a lower neighbour
        got[side] |= met
    got &= own
    # windows left uncovered in a group of three or more may have a partner that is no neighbour
    scale = np.uint64(0x9E3779B97F4A7C15)
    power = np.full(around.shape[1], scale, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    inverse = np.full(before + 1, pow(int(scale), -1, 1 << 64), np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse)
    sums = np.zeros((n, around.shape[1] + 1), np.uint64)
    np.cumsum(around.astype(np.uint64) * power, axis=1, out=sums[:, 1:])
    starts = before - lefts
    window = mix((sums[:, starts + least] - sums[:, starts]) * inverse[starts] + lefts.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    kinds, group = np.unique(key, return_inverse=True)
    size, missing = np.bincount(group, minlength=len(kinds)), np.bincount(group, (own & ~got).any(1), len(kinds))
    ask = np.flatnonzero(((size > 2) & (missing > 0))[group])
    if len(ask):
        r, c = np.nonzero(own[ask])
        r = ask[r]
        name = mix(window[r, c] + mix(key[r]))
        order = np.lexsort((text[r], name))
        name, who = name[order], text[r][order]
        head = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
        several = np.maximum.reduceat(who, head) != np.minimum.reduceat(who, head)
        hit = np.repeat(several, np.diff(np.append(head, len(name))))
        got[r[order][hit], c[order][hit]] = True
    return got, own, window


#: Kinds of what matching finds: a run of windows of one representative; from parts of a frequent suffix's group, each
#: window with its representative there and how many texts of the part have it.
RUN, PART = range(2)
_FOUND = pa.schema([("kind", pa.int32()), ("text_hash", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("window", pa.int64()), ("rep", pa.int64()), ("rep_first", pa.int64()), ("texts", pa.int64())])


def _matcher(least: int, k: int):
    """What matching finds, by kind; see there."""
    size = 2 * least - k

    def match(parts: list) -> Iterator[pa.RecordBatch]:
        key, text, place, first, last, salted = (np.concatenate([p[i] for p in parts]) for i in range(6))
        around = np.concatenate([p[6] for p in parts])
        key = key.view(np.uint64)
        # equal texts of several tasks are one
        order = np.lexsort((place, text, key))
        keep = order[np.append(True, (key[order][1:] != key[order][:-1]) | (text[order][1:] != text[order][:-1]) | (place[order][1:] != place[order][:-1]))]
        key, text, place, first, last, salted, around = (x[keep] for x in (key, text, place, first, last, salted, around))
        cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        # whole groups at a time
        chunks = [0]
        for c in [*cuts[1:].tolist(), len(key)]:
            if c - chunks[-1] >= 8_000 or c == len(key):
                chunks.append(c)
        for a, b in zip(chunks[:-1], chunks[1:]):
            s = slice(a, b)
            got, own, window = covered(key[s], text[s], place[s].astype(np.int64), first[s].astype(np.int64), last[s].astype(np.int64), around[s], least, k)
            far = salted[s]
            label, rep, rep_at = np.zeros(got.shape, np.uint64), np.zeros(got.shape, np.int64), np.zeros(got.shape, np.int64)
            held = np.zeros(got.shape, np.int64)
            r, c = np.nonzero(np.where(far[:, None], own, got))
            p = place[s].astype(np.int64)
            name = mix(window[r, c] + mix(key[s][r]))
            if len(r):
                rep[r, c], rep_at[r, c], held[r, c] = least_of(name, text[s][r], p[r] - c)
                label[r, c] = _label(rep[r, c], rep_at[r, c] - (p[r] - c))
                # in a part, its representatives' windows are led further by their hash, wherever they stand
                led = far[:, None] & (held > 0) & (rep == text[s][:, None])
                label[led] = 0
                r, c = np.nonzero(led)
            zero = lambda x: np.zeros(len(x), np.int64)
            at = p[r] - c
            out = [[zero(r) + PART, rep[r, c], at, at, window[r, c].view(np.int64), rep[r, c], rep_at[r, c], np.where(at == rep_at[r, c], held[r, c], 0)]]
            r, low, high = runs(label)
            out.append([zero(r) + RUN, text[s][r], p[r] - high, p[r] - low, zero(r), rep[r, high], rep_at[r, high], zero(r)])
            out = [np.concatenate(z) for z in zip(*out)]
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(f.type.to_pandas_dtype())) for x, f in zip(out, _FOUND)], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for i, bucket in enumerate(batch.column(0).to_pylist()):
                if bucket != now and parts:
                    yield from match(parts)
                    parts = []
                now = bucket
                lists = [batch.column(j)[i].values.to_numpy(zero_copy_only=False) for j in range(1, 7)]
                parts.append((*lists, np.frombuffer(batch.column(7)[i].as_py(), np.uint32).reshape(-1, size)))
        if parts:
            yield from match(parts)

    return run


def repeated(docs: DataFrame, least: int = LEAST, k: int = K, cells: int = CELLS) -> DataFrame:
    """doc_id, start_word, end_word (exclusive), n_words (the document's), rep_doc_id, rep_start_word of every passage that
    another document has too: the same words stand in document rep_doc_id from rep_start_word on."""
    folder = shared_folder(docs.sparkSession)
    texts = documents(docs)
    seen = stored(texts.mapInArrow(_surveyor(least, k, cells), "doc_id long, text_hash long, n_words long, kept long, block int, data binary"), folder, "seen")
    rows = seen.filter("block is null").select("doc_id", "text_hash", "n_words", "kept")
    counts = sketch.gathered(seen.filter("block is not null").select("block", "data"), cells, folder, "counts")
    buckets = max(16, -(-rows.agg(F.coalesce(F.sum("kept"), F.lit(0))).first()[0] // PER_BUCKET))
    dealt = texts.mapInArrow(_dealer(least, k, counts, buckets), "bucket int, keys array<long>, texts array<long>, places array<int>, firsts array<int>, lasts array<int>, salted array<boolean>, around binary")
    sorted_ = dealt.repartitionById(buckets, F.col("bucket"))
    found = stored(sorted_.mapInArrow(_matcher(least, k), "kind int, text_hash long, first int, last int, window long, rep long, rep_first long, texts long"), folder, "found")

    parts = found.filter(F.col("kind") == PART).select("window", "text_hash", "first", "texts")
    whole = parts.groupBy("window").agg(F.min(F.struct("text_hash", "first")).alias("r"), F.sum("texts").alias("texts")).filter("texts > 1")
    whole = stored(whole.select("window", F.col("r.text_hash").alias("rep"), F.col("r.first").cast("long").alias("rep_first")), folder, "whole")
    late = spread_join(parts, whole, "window", F.col("text_hash")).select("text_hash", "first", F.col("first").alias("last"), "rep", "rep_first")
    runs = found.filter(F.col("kind") == RUN).select("text_hash", "first", "last", "rep", "rep_first").unionByName(late)

    span = lambda s, e, rep, at: F.struct(s.cast("long").alias("s"), e.cast("long").alias("e"), rep.alias("rep"), at.cast("long").alias("rep_first"))
    spans = _islands(runs, "text_hash").groupBy("text_hash").agg(F.array_sort(F.collect_list(span(F.col("first"), F.col("last"), F.col("rep"), F.col("rep_first")))).alias("spans"))
    copies = rows.filter(F.col("n_words") >= least).groupBy("text_hash").agg(F.count(F.lit(1)).alias("copies"), F.max("n_words").alias("words"), F.min("doc_id").alias("rep_doc_id"))
    copies = stored(copies, folder, "copies")
    by_text = copies.join(spans, "text_hash", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<s:bigint,e:bigint,rep:bigint,rep_first:bigint>>")))
    # between and around these, windows of a copied text are its copies' alone
    ends = F.concat(F.array(F.lit(-1).cast("long")), F.transform("spans", lambda x: x["e"]))
    begins = F.concat(F.transform("spans", lambda x: x["s"]), F.array(F.col("words") - least + 1))
    gaps = F.filter(F.transform(F.arrays_zip(ends.alias("a"), begins.alias("b")), lambda x: span(x["a"] + 1, x["b"] - 1, F.col("text_hash"), x["a"] + 1)), lambda x: x["s"] <= x["e"])
    passages = by_text.select("text_hash", F.explode(F.when(F.col("copies") > 1, F.concat("spans", gaps)).otherwise(F.col("spans"))).alias("x")).select("text_hash", F.col("x.s").alias("first"), F.col("x.e").alias("last"), "x.rep", "x.rep_first")
    named = spread_join(stored(_islands(passages, "text_hash"), folder, "passages"), copies.select(F.col("text_hash").alias("rep"), "rep_doc_id"), "rep", F.col("text_hash"))
    by_text = named.groupBy("text_hash").agg(F.array_sort(F.collect_list(F.struct(F.col("first").alias("s"), F.col("last").alias("e"), "rep_doc_id", "rep_first"))).alias("spans"))
    met = spread_join(rows.select("doc_id", "text_hash", "n_words"), by_text, "text_hash", F.monotonically_increasing_id())
    out = met.select("doc_id", "n_words", F.explode("spans").alias("x"))
    return out.select("doc_id", F.col("x.s").alias("start_word"), (F.col("x.e") + least).alias("end_word"), "n_words", "x.rep_doc_id", F.col("x.rep_first").alias("rep_start_word"))


def _islands(runs: DataFrame, by: str) -> DataFrame:
    """``runs`` (first, last, rep, rep_first) of one ``by`` that follow each other, in the representative too, as one."""
    place = Window.partitionBy(by).orderBy("first")
    before = lambda c: F.lag(c).over(place)
    same = (before("last") + 1 == F.col("first")) & (before("rep") == F.col("rep")) & (before("rep_first") - before("first") == F.col("rep_first") - F.col("first"))
    cut = runs.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("island", F.sum("new").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    return cut.groupBy(by, "island").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.first("rep").alias("rep"), F.min("rep_first").alias("rep_first")).drop("island")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(table(spark, sf_dir, "documents"))


NAME = "op2_repeated_passages"
