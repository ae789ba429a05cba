"""Harmonic packing of token sequences.

Every worker packs its documents on its own. A document's full sequences come first; what is left, shorter than a
sequence, is in class capacity // length (at most ``classes``), and a bin of class j is closed when it holds j
documents, which always fit. The room that they leave is filled with the head of the documents that follow, so a
document is cut where it exceeds a sequence or fills a bin's room, and nowhere else. At the end the worker's open bins
(fewer than ``classes``, each of less than a sequence) are joined and cut into full sequences and one last, shorter
one. So a worker pads less than one sequence, however long its input, and nothing is shuffled.

Defined results: null text is empty text and still has its end id; a very long text is encoded whole, and is held in
memory alone with its ids; a null doc_id is kept; repeated rows are packed once each; further columns are left out,
whatever their names; an empty table gives no pieces. Where documents of a class are equally long, they are packed in
the order in which they are read, so pieces and sequences may differ when the input is split differently; every id is
in one piece each time. A sequence's id is its worker's number and its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from glosswork.llm.common import documents, table
from glosswork.llm.subwords import shared

CAPACITY = 1024
#: Documents shorter than capacity / CLASSES are all of the last class.
CLASSES = 32
END_ID = 0

_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


class Bin:
    """Documents of one class, and the fillers after them, as (document, first place in it, ids)."""

    def __init__(self, places: int):
        self.places, self.held, self.size = places, [], 0

    def add(self, piece: tuple) -> None:
        self.held.append(piece)
        self.size += len(piece[2])


class Packer:
    """One worker's bins. ``add`` and ``end`` give (doc, start, ids, sequence, offset) of what is packed for good."""

    def __init__(self, capacity: int, classes: int):
        self.capacity, self.classes, self.open, self.room, self.number = capacity, classes, {}, [], 0

    def _closed(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for doc, start, ids in pieces:
            yield doc, start, ids, self.number, at
            at += len(ids)
        self.number += 1

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        at, n = 0, len(ids)
        while self.room and at < n:  # closed bins first take what they still have room for
            b = self.room[-1]
            take = min(self.capacity - b.size, n - at)
            b.add((doc, at, ids[at : at + take]))
            at += take
            if b.size == self.capacity:
                yield from self._closed(self.room.pop().held)
        while n - at >= self.capacity:
            yield from self._closed([(doc, at, ids[at : at + self.capacity])])
            at += self.capacity
        if at < n:
            j = min(self.capacity // (n - at), self.classes)
            b = self.open.setdefault(j, Bin(j))
            b.add((doc, at, ids[at:]))
            if len(b.held) == j:
                del self.open[j]
                if b.size == self.capacity:
                    yield from self._closed(b.held)
                else:
                    self.room.append(b)

    def end(self) -> Iterator[tuple]:
        rest = [p for b in self.room + [self.open[j] for j in sorted(self.open)] for p in b.held]
        self.room, self.open, pieces, size = [], {}, [], 0
        for doc, start, ids in rest:
            at = 0
            while at < len(ids):
                take = min(self.capacity - size, len(ids) - at)
                pieces.append((doc, start + at, ids[at : at + take]))
                at, size = at + take, size + take
                if size == self.capacity:
                    yield from self._closed(pieces)
                    pieces, size = [], 0
        if pieces:
            yield from self._closed(pieces)


def _packing(path: str | None, ranks: str | None, capacity: int, classes: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer, end = shared(path, ranks), Packer(capacity, classes), np.array([end_id], "<u4")
        worker = TaskContext.get().partitionId() << 40

        def rows(packed: Iterator[tuple]) -> list[tuple]:
            return [(doc[0], start, len(ids), zlib.crc32(ids.tobytes()), doc[1], worker + sequence, offset) for doc, start, ids, sequence, offset in packed]

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PIECES)], schema=_PIECES)

        for batch in batches:
            out = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.concatenate([coder.ids(text.as_py() or ""), end])
                out += rows(packer.add((name, len(own)), own))
            if out:
                yield batch_of(out)
        if out := rows(packer.end()):
            yield batch_of(out)

    return run


def pack(docs: DataFrame, path: str | None = None, ranks: str | None = None, capacity: int = CAPACITY, classes: int = CLASSES, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece. ``path``, ``ranks``: the tokenizer's files."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return documents(docs).mapInArrow(_packing(path, ranks, capacity, classes, end_id), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


NAME = "op10_pack_sequences"
