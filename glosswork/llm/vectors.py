"""Exact top-k by inner product with KD-trees.

Rows are cut into shards of bounded size as they are read, without a shuffle, and each shard becomes a KD-tree: median
splits along the widest side, leaves of a few vectors, and for every node the tight bounding box of what it holds. For
a query q no vector in a box scores over sum(max(q * low, q * high)), so nodes are visited best bound first and the
search ends when the best bound left can't beat the k-th result. Trees and blocks of queries are files in shared
storage, and only their names and numbers are shuffled: a task takes one block through a lane of shards, reading each
tree where it lies, and carries the k-th scores along, so later shards are mostly cut off by earlier ones. What tasks
keep (at most k rows for each query and lane) is ranked at the end, so the shuffle follows the queries and the lanes.

Components are integers floor(scale * x), so scores are exact; where sums could leave the doubles' exact range, 64-bit
integers are used, and beyond these, Python's. Scores that no 64-bit number holds are an error in the result's type.
Defined results: vectors that are null or hold null or non-finite components, and rows without id, take no part, nor do
those with a component whose scaled value leaves 64 bits; vectors meet only vectors of their length; rows with the
query's id count as its own; repeated rows of other ids are candidates each; equal scores go by the smaller id, and
equal ids in any order; a query row that is repeated is answered each time, by ranks of its own; very long vectors are
held a shard at a time; further columns are left out, whatever their names; empty tables give nothing.
"""

from __future__ import annotations

import heapq
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glosswork.llm.common import pick, shared_folder, stored, table

TOP, SCALE, EVERY = 10, 1024, 100
SHARD_ROWS, LEAF = 8192, 64
#: Queries of a block, and shards of a lane.
BLOCK, LANE = 512, 4
_EXACT, _LONG = float(1 << 53), float(1 << 62)


class KdTree:
    """Over integer vectors; nodes are (first, last) ranges of an order of the rows, with boxes and least ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.size = len(ids)
        order, spans, kids = np.arange(len(ids)), [(0, len(ids))], []
        i = 0
        while i < len(spans):
            a, b = spans[i]
            kids.append((-1, -1))
            if b - a > leaf:
                own = order[a:b]
                part = vectors[own]
                side = int(np.argmax(part.max(0) - part.min(0))) if part.shape[1] else 0
                mid = (b - a) // 2
                # equal components fall on either side: boxes stay tight and halves stay even
                order[a:b] = own[np.argpartition(part[:, side], mid) if part.shape[1] else np.arange(b - a)]
                kids[i] = (len(spans), len(spans) + 1)
                spans += [(a, a + mid), (a + mid, b)]
            i += 1
        self.ids, self.vectors = ids[order], vectors[order]
        self.spans, self.kids = spans, kids
        self.low = np.array([self.vectors[a:b].min(0) for a, b in spans])
        self.high = np.array([self.vectors[a:b].max(0) for a, b in spans])
        self.least = [int(self.ids[a:b].min()) for a, b in spans]

    def search(self, query: np.ndarray, own: int, best: list[tuple[int, int]], top: int) -> list[tuple[int, int]]:
        """The ``top`` best (-score, id) among ``best`` and this tree's rows but those of id ``own``."""
        up, down = np.maximum(query, 0), np.minimum(query, 0)
        bounds = (self.high @ up + self.low @ down).tolist()
        heap = [(-bounds[0], self.least[0], 0)]
        while heap:
            bound, least, node = heapq.heappop(heap)
            if len(best) == top and (bound, least) > best[-1]:
                break
            left, right = self.kids[node]
            if left >= 0:
                for k in (left, right):
                    heapq.heappush(heap, (-bounds[k], self.least[k], k))
                continue
            a, b = self.spans[node]
            scores = self.vectors[a:b] @ query
            ids = self.ids[a:b]
            likely = np.flatnonzero(ids != own) if len(best) < top else np.flatnonzero(((-scores <= best[-1][0]) & (ids != own)).astype(bool))
            if len(likely):
                best = sorted([*best, *((-int(s), int(v)) for s, v in zip(scores[likely], ids[likely]))])[:top]
        return best


def _number(vectors: np.ndarray, other: float) -> np.ndarray:
    """Doubles, which multiply fast, where sums of products with components up to ``other`` are exact; else integers that hold them."""
    most = max(float(np.abs(vectors.astype(np.float64)).max(initial=0)), other)
    bound = most * most * max(1, vectors.shape[1])
    return vectors.astype(np.float64) if bound < _EXACT else vectors if bound < _LONG else vectors.astype(object)


def whole_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the vector of integers, for rows that take part."""
    rows = pick(embeddings, "vec_id", "embedding").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("e"))
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fits = F.forall("e", lambda x: F.abs(F.floor(x * scale).cast("double")) < 9.2e18)
    whole = rows.filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & F.coalesce(fine, F.lit(False))).filter(F.coalesce(fits, F.lit(False)))
    return whole.select("vec_id", F.transform("e", lambda x: F.floor(x * scale)).cast("array<long>").alias("v"))


def _groups(batches: Iterator[pa.RecordBatch], most: int):
    """(ids, matrix) of up to ``most`` rows of one length, from a stream of rows."""
    held: dict[int, tuple[list, list]] = {}
    for b in batches:
        ids, v = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
        sizes = np.diff(v.offsets.to_numpy())
        flat, starts = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()
        for d in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == d)
            part = flat[(starts[at][:, None] + np.arange(d)).ravel()].reshape(len(at), d)
            own = held.setdefault(d, ([], []))
            own[0].append(ids[at])
            own[1].append(part)
            while sum(map(len, own[0])) >= most:
                i, m = np.concatenate(own[0]), np.concatenate(own[1])
                yield d, i[:most], m[:most]
                own[0][:], own[1][:] = [i[most:]], [m[most:]]
    for d, (i, m) in held.items():
        i, m = np.concatenate(i), np.concatenate(m)
        if len(i):
            yield d, i, m


def _fs(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file://{uri}")


def _packed(folder: str, most: int, leaf: int | None):
    """Rows (dim, rows, file): trees where ``leaf`` is given, else plain blocks. A file's name is its attempt's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _fs(folder)
        for d, ids, m in _groups(batches, most):
            name = uuid.uuid4().hex
            fs.create_dir(path, recursive=True)
            with fs.open_output_stream(f"{path}/{name}") as out:
                out.write(pickle.dumps((ids, m) if leaf is None else KdTree(ids, m, leaf), 5))
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([name])], names=["dim", "rows", "file"])

    return run


def _read(folder: str, name: str):
    fs, path = _fs(folder)
    with fs.open_input_file(f"{path}/{name}") as f:
        return pickle.loads(f.read())


def _searcher(folder: str, top: int):
    schema = pa.schema([("block", pa.int64()), ("turn", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, asked, trees in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                ids, queries = _read(folder, asked)
                best = [[] for _ in ids]
                most = float(np.abs(queries.astype(np.float64)).max(initial=0))
                for name in sorted(trees):
                    t = _read(folder, name)
                    held = _number(t.vectors, most)
                    kind = held.dtype
                    t.vectors, t.low, t.high = held, t.low.astype(kind), t.high.astype(kind)
                    asked_as = queries.astype(kind)
                    for i in range(len(ids)):
                        best[i] = t.search(asked_as[i], int(ids[i]), best[i], top)
                rows = [(block, i, int(q), v, -s) for i, (q, own) in enumerate(zip(ids, best)) for s, v in own]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def top_k(embeddings: DataFrame, top: int = TOP, every: int = EVERY, scale: int = SCALE, shard_rows: int = SHARD_ROWS, leaf: int = LEAF, block: int = BLOCK, lane: int = LANE) -> DataFrame:
    """query_id, rank, vec_id, score for each row whose id ``every`` divides."""
    folder = shared_folder(embeddings.sparkSession)
    files, number, packed = f"{folder}/files", F.monotonically_increasing_id(), "dim int, rows long, file string"
    rows = whole_vectors(embeddings, scale)
    trees = stored(rows.mapInArrow(_packed(files, shard_rows, leaf), packed), folder, "trees")
    # the queries are a hundredth of the rows: gathered from small tasks into whole blocks
    asked = rows.filter(F.col("vec_id") % every == 0)
    asked = asked.repartition(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-asked.count() // block)))))
    blocks = stored(asked.mapInArrow(_packed(files, block, None), packed).withColumn("block", number), folder, "blocks")
    place = F.pmod(F.xxhash64("file"), F.lit(max(1, -(-trees.count() // lane)))).alias("lane")
    lanes = trees.groupBy("dim", place).agg(F.collect_list("file").alias("trees"))  # about ``lane`` names each
    # every block of the stated queries meets every lane: names alone, a task for each pair
    pairs = stored(blocks.select("block", "dim", F.col("file").alias("asked")).join(lanes, "dim").select("block", "asked", "trees"), folder, "pairs")
    dealt = pairs.repartition(max(1, pairs.count()), "block", "trees")
    found = dealt.mapInArrow(_searcher(files, top), "block long, turn int, query_id long, vec_id long, score long")
    best = Window.partitionBy("block", "turn").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


NAME = "op6_exact_top_k"
ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS turn, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.turn AS query_row, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""
