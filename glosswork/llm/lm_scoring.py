"""Log probabilities of whole texts, by word counts and by a causal self-attention model.

Training documents are those whose crc32(doc_id as text) mod 7 isn't 2. A first pass counts their words (by 64-bit
hash of the lower-cased word, the end mark included) and subword ids, each task adding up its own counts before the
shuffle, and keeps every document with its ids, so that no text is encoded twice. The attention model (see ``attention``) has an
embedding for every id that they have three times, and is fitted on every window of every training document, in the
cluster: each round takes a share of the documents by hash, each task steps through its own from the same parameters, and
what the tasks have is averaged, an embedding by how often a task moved it. Only parameters are gathered, never texts. Its
classes and the id probabilities within them come from the neighbours and counts of all training documents. As tasks step apart, ``score`` depends in
small on how the input is split; base_score doesn't.

The second pass scores every document by the model and by the ``head`` most frequent words, a table of fixed size.
Rarer words leave the pass as (document, word, times) and meet their counts in a join; there are few of them, and no
one of them is frequent, so that join has no hot key.

Defined results: null or empty text is the end mark alone; a very long text is scored whole, and is held in memory alone
with its ids; repeated rows count and are scored each, alike; a null doc_id is a training document; ties between equally
frequent words or ids are settled by their hash or number; with no training documents every count is 0 and the model is
uniform over ids; further columns are left out, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.llm.attention import RATE, SIDE, Contexts, Learner, Model, grouped
from glosswork.llm.common import documents, shared_folder, stored, table
from glosswork.llm.hashing import blocks, utf8, words
from glosswork.llm.subwords import shared

#: Fixed size of the table of frequent words.
HEAD = 100_000
#: Rounds of the fit: the 16ths of the documents where each ends. A small first round brings the tasks to a common start.
ROUNDS = (1, 4, 16)
#: Windows of a step, steps that make a task of its own worthwhile, ids that a task holds before it steps through them.
WINDOWS, TASK_STEPS, HELD_IDS = 128, 400, 500_000
PIECE = 4096  # embedding rows that travel together
IDS = 50257  # of the tokenizer; the last of them ends a text
END_WORD = np.uint64(0x5E17D0F7E57A11ED)

#: Rows of the first pass: words' counts, ids' counts, and a document with its ids and the share of the training documents
#: that it belongs to (-1: held out).
WORDS, SUBWORDS, TEXT = range(3)
SHARES = 16
_COUNTS = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string()), ("ids", pa.binary())])
#: Small row groups, so that Spark's splits of a file hold about as much each and the fit's tasks end together.
_WRITTEN = {"compression": "zstd", "parquet.block.size": 8 << 20}
_COUNTS_DDL = "kind int, key long, n long, doc_id long, text string, ids binary"


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate(x) for x in zip(*parts))
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, n, len(keys)).astype(np.int64)


def _counter(path: str | None, ranks: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, held, ids, pending, size = shared(path, ranks), [], np.zeros(IDS, np.int64), [], 0
        for batch in batches:
            learned = [x >= 0 for x in batch.column(1).to_pylist()]
            data, offsets = utf8(batch.column(0).filter(pa.array(learned, pa.bool_())))
            for a, b in blocks(offsets):
                h, _, _, _ = words(data, offsets[a : b + 1])
                held.append(np.unique(np.append(h, np.full(b - a, END_WORD)), return_counts=True))
            if sum(len(k) for k, _ in held) > 3_000_000:
                held = [_merged(held)]
            encoded = []
            for t, counted in zip(batch.column(0), learned):
                own = coder.ids(t.as_py() or "")
                encoded.append(own.astype("<u2").tobytes())
                if counted:
                    pending.append(own)
                    size += len(own)
                if size > 500_000:
                    ids += np.bincount(np.concatenate(pending), minlength=IDS)
                    pending, size = [], 0
            if len(batch):
                sizes = pa.array([len(x) // 2 for x in encoded], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), TEXT, np.int32)), batch.column(1).cast(pa.int64()), sizes, batch.column(2), batch.column(0), pa.array(encoded, pa.binary())], schema=_COUNTS)
            ids[-1] += sum(learned)
        if pending:
            ids += np.bincount(np.concatenate(pending), minlength=IDS)
        if held:
            for kind, (keys, n) in enumerate((_merged(held), (np.flatnonzero(ids), ids[ids > 0]))):
                for a in range(0, len(keys), 100_000):
                    k = keys[a : a + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.astype(np.uint64).view(np.int64)), pa.array(n[a : a + 100_000]), *(pa.nulls(len(k), f.type) for f in list(_COUNTS)[3:])], schema=_COUNTS)

    return run


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("head_known", pa.int64()), ("head_log", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])


def _scorer(keys: np.ndarray, counts: np.ndarray, model: Model):
    """``keys``: the head's hashes in order, with their ``counts``. Rows are doc_id, held_out, text and its ids."""
    logs = np.append(np.log10(counts + 1.0), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for a, b in blocks(offsets):
                h, _, _, n = words(data, offsets[a : b + 1])
                n = n + 1
                texts = np.repeat(np.arange(b - a), n)
                ends = np.cumsum(n) - 1
                full = np.empty(len(texts), np.uint64)
                inner = np.ones(len(texts), bool)
                inner[ends] = False
                full[inner], full[ends] = h, END_WORD
                kinds, of = np.unique(full, return_inverse=True)
                at = np.searchsorted(keys, kinds)
                at[at == len(keys)] = 0
                known = keys[at] == kinds if len(keys) else np.zeros(len(kinds), bool)
                value = np.where(known, logs[at], 0.0)
                is_known = known[of]
                head_log, head_known = np.bincount(texts, value[of], b - a), np.bincount(texts, is_known, b - a).astype(np.int64)
                # the rest, once for each text and word
                (owner, kind), times = _pairs(texts[~is_known], of[~is_known], len(kinds))
                cuts = np.searchsorted(owner, np.arange(b - a + 1)).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(cuts), pa.array(kinds[kind].view(np.int64)))
                often = pa.ListArray.from_arrays(pa.array(cuts), pa.array(times.astype(np.int64)))
                ids = [np.frombuffer(x.as_buffer(), "<u2") for x in batch.column(3)[a:b]]
                score = model.score(np.concatenate(ids).astype(np.int64), np.array([len(i) for i in ids], np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(n), pa.array(head_known), pa.array(head_log), pa.array(score), rare, often], schema=_SCORES)

    return run


def _pairs(texts: np.ndarray, kinds: np.ndarray, size: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    both, times = np.unique(texts.astype(np.int64) * size + kinds, return_counts=True)
    return (both // max(1, size), both % max(1, size)), times


_PARTS = pa.schema([("piece", pa.int32()), ("weights", pa.binary()), ("sums", pa.binary())])


def _dense(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p) if k != "emb"])


def _learner(model: Model, passes: int, rate):
    """Steps through a task's texts; yields its parameters times their weights: piece -1 is all but the embeddings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, rng, pending, size = Learner(model), np.random.default_rng(11), [], 0

        def learn() -> None:
            for _ in range(passes):
                learner.learn(np.concatenate(pending), np.array([len(i) for i in pending], np.int64), WINDOWS, rate, rng)

        for batch in batches:
            for ids in batch.column(0):
                pending.append(np.frombuffer(ids.as_buffer(), "<u2").astype(np.int64))
                size += len(pending[-1]) + 1
                if size > HELD_IDS:
                    learn()
                    pending, size = [], 0
        if pending:
            learn()
        if learner.steps:
            p, moved = learner.model.p, learner.moved
            parts = [(-1, np.array([float(learner.steps)]), _dense(p) * float(learner.steps))]
            for i, a in enumerate(range(0, len(moved), PIECE)):
                w = moved[a : a + PIECE]
                parts.append((i, w, p["emb"][a : a + PIECE] * w[:, None]))
            for i, w, x in parts:
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([w.tobytes()]), pa.array([x.astype(np.float64).tobytes()])], schema=_PARTS)

    return run


def _neighbours(counts: np.ndarray):
    """A task's sums of contexts, in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, pending, size = Contexts(counts), [], 0
        for batch in batches:
            for ids in batch.column(0):
                pending.append(np.frombuffer(ids.as_buffer(), "<u2"))
                size += len(pending[-1]) + 1
                if size > HELD_IDS:
                    seen.add(pending)
                    pending, size = [], 0
        if pending:
            seen.add(pending)
        for i, a in enumerate(range(0, len(counts), PIECE)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.zeros(1).tobytes()]), pa.array([seen.sums[a : a + PIECE].astype(np.float64).tobytes()])], schema=_PARTS)

    return run


def id_classes(surveyed: DataFrame, id_counts: np.ndarray) -> np.ndarray:
    """A class for each id by what stands beside it in all training documents."""
    texts = surveyed.filter((F.col("kind") == TEXT) & (F.col("key") >= 0)).select("ids")
    tasks = surveyed.sparkSession.sparkContext.defaultParallelism
    made = texts.coalesce(tasks).mapInArrow(_neighbours(id_counts), "piece int, weights binary, sums binary")
    sums = np.zeros((len(id_counts), 2 * SIDE))
    for part in made.repartition(16, "piece").mapInArrow(_added, made.schema).collect():  # one row a piece
        x = np.frombuffer(part["sums"]).reshape(-1, 2 * SIDE)
        sums[part["piece"] * PIECE : part["piece"] * PIECE + len(x)] = x
    return grouped(sums, id_counts)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for i, w, x in zip(*(c.to_pylist() for c in batch.columns)):
            w, x = np.frombuffer(w), np.frombuffer(x)
            held[i] = (held[i][0] + w, held[i][1] + x) if i in held else (w, x)
    for i, (w, x) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([w.tobytes()]), pa.array([x.tobytes()])], schema=_PARTS)


def _take(model: Model, parts: list) -> None:
    """Averages of the tasks' parameters; an embedding that no task moved stays."""
    for part in parts:
        w, x = np.frombuffer(part["weights"]), np.frombuffer(part["sums"])
        if part["piece"] < 0:
            x, at = (x / w).astype(np.float32), 0
            for k in sorted(k for k in model.p if k != "emb"):
                n = model.p[k].size
                model.p[k], at = x[at : at + n].reshape(model.p[k].shape), at + n
        else:
            rows = np.flatnonzero(w)
            model.p["emb"][part["piece"] * PIECE + rows] = (x.reshape(len(w), -1)[rows] / w[rows, None]).astype(np.float32)


def survey(texts: DataFrame, folder: str, path: str | None = None, ranks: str | None = None) -> DataFrame:
    """(kind, key, n, doc_id, text, ids) of ``texts`` (doc_id, text, held_out): counts of the training ones by task, and every document with its share and ids."""
    share = F.when(F.col("held_out"), F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc_id", F.length("text"), F.lit("round")), F.lit(SHARES))).cast("int")
    return stored(texts.select("text", share.alias("share"), "doc_id").mapInArrow(_counter(path, ranks), _COUNTS_DDL), folder, "survey", **_WRITTEN)


def fit(surveyed: DataFrame, id_counts: np.ndarray, **shape) -> Model:
    """The model on all training documents, each of them in one of the rounds."""
    if not id_counts.any():
        return Model(id_counts, **shape).freeze()
    model = Model(id_counts, class_of=id_classes(surveyed, id_counts), **shape)
    model.begin(np.flatnonzero(id_counts >= 3))
    windows = int(id_counts.sum()) // model.block + 1
    # a small input is gone through more than once, in few tasks and in one round
    tasks = max(1, min(surveyed.sparkSession.sparkContext.defaultParallelism, windows // (WINDOWS * TASK_STEPS)))
    passes, low = -(-WINDOWS * TASK_STEPS // windows), 0
    for end in ROUNDS if tasks > 1 else ROUNDS[-1:]:
        steps = windows * passes * (end - low) / SHARES / WINDOWS / tasks
        last = end == ROUNDS[-1]
        rate = (lambda n, steps=steps: RATE * min(1.0, max(0.1, 3 * (1 - n / (steps + 1))))) if last else (lambda n: RATE)
        texts = surveyed.filter((F.col("kind") == TEXT) & (F.col("key") >= low) & (F.col("key") < end)).select("ids")
        learned = texts.coalesce(tasks).mapInArrow(_learner(model, passes, rate), "piece int, weights binary, sums binary")
        _take(model, learned.repartition(16, "piece").mapInArrow(_added, learned.schema).collect())
        low = end
    return model.freeze()


def score_texts(docs: DataFrame, head: int = HEAD, path: str | None = None, ranks: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row. ``path``, ``ranks``: the tokenizer's files."""
    folder = shared_folder(docs.sparkSession)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    marked = documents(docs).withColumn("held_out", held)
    surveyed = survey(marked, folder, path, ranks)
    counts = stored(surveyed.filter(F.col("kind") != TEXT).groupBy("kind", "key").agg(F.sum("n").alias("n")), folder, "counts")
    said = counts.filter("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    # the head: words from a frequency on that at most ``head`` words have, found by a count of words for each step of it
    step = F.floor(F.log2("n") * 8)
    steps = sorted(((r.s, r.c) for r in counts.filter("kind = 0").groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("c")).collect()), reverse=True)
    fits = [s for (s, _), c in zip(steps, np.cumsum([c for _, c in steps])) if c <= head]
    top = counts.filter("kind = 0").filter(step >= (fits[-1] if fits else 1 << 30)).select("key", "n").toArrow()
    keys, n = top["key"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(keys)
    ids = counts.filter("kind = 1").select("key", "n").toArrow()  # a row for each id at most
    id_counts = np.zeros(IDS, np.int64)
    id_counts[ids["key"].to_numpy()] = ids["n"].to_numpy()
    model = fit(surveyed, id_counts)
    run = _scorer(keys[order].copy(), n[order].copy(), model)
    texts = surveyed.filter(F.col("kind") == TEXT).select("doc_id", (F.col("key") < 0).alias("held_out"), "text", "ids")
    done = texts.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, head_known long, head_log double, score double, rare array<long>, times array<long>")
    scored = stored(done.withColumn("row", F.monotonically_increasing_id()), folder, "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    met = rare.join(counts.filter("kind = 0").select("key", "n"), "key")
    tail = met.groupBy("row").agg(F.sum("times").alias("tail_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("tail_log"))
    log = F.col("head_log") + F.coalesce("tail_log", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(said.n + said.v + 1)))
    return scored.join(tail, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(said.n).cast("long").alias("train_tokens"), log.alias("base_score"), "score",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


NAME = "op7_lm_scores"
