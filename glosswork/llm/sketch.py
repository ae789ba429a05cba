"""A fixed-size sketch over all rows: counts by hashed cell. Its size doesn't grow with the data.

Every task adds up a sketch of its own before the shuffle, so a size that followed the data would make their sum grow
with its square. Past what a sketch can tell apart, what relies on it does more work for the same result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from glosswork.llm.common import stored

BLOCK = 1 << 18


def pack(cells: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Compressed blocks of an array of bytes."""
    for i in range(0, len(cells), BLOCK):
        if not cells[i : i + BLOCK].any():
            continue
        yield i // BLOCK, zlib.compress(cells[i : i + BLOCK].tobytes(), 1)


def _merged(parts: pa.Table) -> pa.Table:
    total = np.zeros(BLOCK, np.uint32)
    for d in parts["data"]:
        x = np.frombuffer(zlib.decompress(d.as_py()), np.uint8)
        total[: len(x)] += x
    out = np.floor(4 * np.log2(np.maximum(total, 1))).astype(np.uint8)
    return pa.table({"block": parts["block"][:1].cast(pa.int32()), "data": pa.array([zlib.compress(out[: len(x)].tobytes(), 1)], pa.binary())})


class Kept:
    """A sketch in shared storage; ``value`` is read once in each worker process, and never passes the driver."""

    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    @property
    def value(self) -> np.ndarray:
        return _read(self.path, self.size)


@lru_cache(maxsize=2)
def _read(path: str, size: int) -> np.ndarray:
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSelector, FileSystem

    fs, top = FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"file://{path}")
    out = np.zeros(size, np.uint8)
    for f in fs.get_file_info(FileSelector(top)):
        if f.base_name.endswith(".parquet"):
            for batch in pq.ParquetFile(fs.open_input_file(f.path)).iter_batches(16):
                for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                    x = np.frombuffer(zlib.decompress(data.as_py()), np.uint8)
                    out[block * BLOCK : block * BLOCK + len(x)] = x
    return out


def gathered(blocks: DataFrame, size: int, folder: str, name: str) -> Kept:
    """The whole sketch from its (block, data) parts: 4 * log2 of added counts."""
    stored(blocks.groupBy("block").applyInArrow(_merged, "block int, data binary"), folder, name)
    return Kept(f"{folder}/{name}", size)


def add(cells: np.ndarray, hashes: np.ndarray, shifts: tuple[int, ...] = (20,)) -> None:
    """Counts hashes into bytes that stop at 255, in one cell for each of ``shifts``."""
    for shift in shifts:
        at, n = np.unique(_cell(hashes, len(cells), shift), return_counts=True)
        cells[at] = np.minimum(cells[at] + np.minimum(n, 255).astype(np.uint16), 255).astype(np.uint8)


def look(cells: np.ndarray, hashes: np.ndarray, shifts: tuple[int, ...] = (20,)) -> np.ndarray:
    """The least of a hash's cells: never under what was counted for it."""
    out = cells[_cell(hashes, len(cells), shifts[0])]
    for shift in shifts[1:]:
        out = np.minimum(out, cells[_cell(hashes, len(cells), shift)])
    return out


def _cell(hashes: np.ndarray, size: int, shift: int) -> np.ndarray:
    return (hashes >> np.uint64(shift)).astype(np.int64) & (size - 1)
