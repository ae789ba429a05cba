"""Exact n-gram Jaccard join: a size-aware heavy-light join over sets of word shingles.

Sets are distinct shingle hashes of whole texts; documents with equal sets are one set from the start, so copies cost
nothing more. Two sets of sizes a <= b link when their overlap is at least c(a, b) = ceil(3 (a + b) / 7) (at 75%).

A grouped count, exact at every size, tells in how many sets each shingle is. Shingles of one set alone are counted and
never leave that step, and a set whose rarest shingles, as many as any partner must share one of
(n - ceil(0.75 n) + 1), are all its own has no partner and is done. What remains is ordered by rarity.

Light: sets up to a boundary enumerate all subsets of size c for each partner size that fits; two sets that share a
subset of the overlap that their two sizes ask for are tied. Heavy: a larger set lists itself under the shared ones of
its rarest shingles, and the inverted lists are scanned; a list ties two sets only if the overlap they need could still
follow in their orders. Sets under the boundary are in both, so pairs across it are met. The boundary is the size with
the least cost by these data: keys that enumerating would write against places that listing would scan.

Shingles of over 1/1024 of all sets (a number with a fixed bound) are known beforehand. They come last in every order
and aren't counted by key; where a set must list itself under one, sets of like size are tied to a representative.

Ties are candidates, all of them verified. A component of ties that fits one block is checked whole: a product of the
incidence matrix gives its overlaps at once. In a larger one, each set's strongest tie is verified first; sets that these
links join need no further check among each other, and only blocks of different such parts meet, every two once. What
leaves a task is a forest of verified links, never pairs of a group. Components of these links give the result.

Nothing is sampled or capped, and memory for a task is bounded by blocks and buckets. A shingle is a 64-bit hash and an
overlap is of hashes; equal sets are told by a 64-bit hash of size and shingles.

Defined results: a text with fewer words than a shingle is one shingle; without words, or null, it has no shingles
and is its own component; a very long text is one set, held in memory alone; repeated rows link as copies; a null
doc_id links like any other and is never the smallest id (a component of nulls has a null id); equal ids that differ in
text link by their texts; further columns, whatever their names, are left out by ``join`` and kept by ``keep_first``;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.llm.common import HOT_SHARE, WORD, Kept, boxed, documents, shared_folder, spread_join, stored, table, unboxed
from glosswork.llm.graph import components, forest
from glosswork.llm.hashing import blocks, mix, sequences, utf8, words

WORDS, PERCENT = 5, 75
#: Sets of a block of a component that is checked in parts, and postings of a bucket, about.
BLOCK, PER_BUCKET = 64, 1_000_000
#: Rank of the hot shingles, before their counts; no other count is as large.
HOT = 1 << 40
#: Kinds of lists: by prefix; by a subset for partners of the same size; by a subset for two different sizes.
HEAVY, EQUAL, CROSS = 0, 1, 2
#: Sizes that are tried as the boundary.
LIGHT_SIZES = 24


def least_overlap(a: int, b: int, percent: int) -> int:
    """Overlap from which sets of these sizes link: 100 o >= percent (a + b - o)."""
    return -(-percent * (a + b) // (100 + percent))


def fits(a: int, b: int, percent: int) -> bool:
    return least_overlap(a, b, percent) <= min(a, b)


@lru_cache(maxsize=4096)
def partners(n: int, percent: int) -> tuple[int, ...]:
    """Sizes with which a set of ``n`` can link."""
    return tuple(m for m in range(-(-percent * n // 100), 100 * n // percent + 1) if m and fits(n, m, percent))


def reach(n: int, at: np.ndarray, percent: int) -> np.ndarray:
    """Largest partner with which a set can link if the first shingle they share is at place ``at`` of its order."""
    return (100 + percent) * (n - at) // percent - n


def prefix(n, percent: int):
    """Shingles of the order of which any partner holds one."""
    return n - -(-percent * n // 100) + 1


def boundary(shapes: list[tuple[int, int, int, int]], mean_list: float, percent: int) -> int:
    """The largest size whose sets enumerate subsets, by least cost in keys written and places scanned.

    ``shapes``: (size, shared shingles, postings, how many sets) of the small sets; ``mean_list``: places of a list.
    """

    def cost(most: int) -> float:
        total = 0.0
        for n, shared, listed, times in shapes:
            light = n <= most
            if light:
                total += times * sum(comb(shared, least_overlap(n, m, percent)) for m in partners(n, percent) if m <= most)
            if not light or max(partners(n, percent)) > most:
                total += times * listed * (1 + mean_list)
        return total

    return min(range(LIGHT_SIZES + 1), key=lambda b: (cost(b), b))


def sets_of(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, in order of hash."""
    h, _, _, counts = words(data, offsets)
    runs, n = sequences(h, counts, k)
    out, at, first = [], np.cumsum(n) - n, np.cumsum(counts) - counts
    for i, (a, m) in enumerate(zip(at.tolist(), n.tolist())):
        if m:
            out.append(np.unique(runs[a : a + m]))
        elif counts[i]:
            whole = h[first[i] : first[i] + counts[i]]
            short, _ = sequences(whole, np.array([len(whole)]), len(whole))
            out.append(mix(short + np.uint64(len(whole))))
        else:
            out.append(runs[:0])
    return out


def name_of(s: np.ndarray) -> int:
    """A set's id: a hash of its shingles and their number."""
    x = np.array([s.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s + np.uint64(77))) if len(s) else 0, len(s)], np.uint64)
    return int(mix(mix(mix(x[:1]) + x[1:2]) + x[2:])[0].view(np.int64))


_SIGNED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("name", pa.int64()), ("key", pa.int64()), ("times", pa.int64())])


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate(x) for x in zip(*parts))
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, n, len(keys)).astype(np.int64)


def _signer(k: int):
    """A row (doc_id, text_hash, n, name) for each text, and rows (key, times) of shingles that many of the task's sets have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, often, distinct = set(), [], 0
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in blocks(offsets):
                sets = sets_of(data, offsets[a : b + 1], k)
                names = [name_of(s) for s in sets]
                new = [s for s, x in zip(sets, names) if len(s) and not (x in seen or seen.add(x))]
                distinct += len(new)
                if len(new) > 2:
                    kinds, n = np.unique(np.concatenate(new), return_counts=True)
                    many = n >= max(3, len(new) // 512)
                    often.append((kinds[many], n[many]))
                    if sum(len(x) for x, _ in often) > 1_000_000:
                        often = [_merged(often)]
                none = pa.nulls(b - a, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(2)[a:b], pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.int64()), none, none], schema=_SIGNED)
        if often:
            kinds, n = _merged(often)
            many = n >= max(16, distinct // 256)
            none = pa.nulls(int(many.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(kinds[many].view(np.int64)), pa.array(n[many])], schema=_SIGNED)

    return run


_DEALT = pa.schema([("bucket", pa.int32()), ("keys", pa.list_(pa.int64())), ("names", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64()))])
_DEALT_DDL = "bucket int, keys array<long>, names array<long>, ranks array<long>"


def _by_bucket(bucket: np.ndarray, buckets: int, *columns: np.ndarray | None) -> pa.RecordBatch:
    """A row for each bucket that has something, with its parts of the columns in order; a column may be missing."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(c[order])) if c is not None else pa.nulls(buckets, pa.list_(pa.int64())) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(buckets, dtype=np.int32)), *lists], schema=_DEALT).filter(pa.array(np.diff(cuts) > 0))


def _buckets_of(names: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(names.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _dealer(k: int, buckets: int, hot: Kept):
    """Every distinct set's shingles by key, to be counted; hot ones and, with rank -1, the set's size by name, to be passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot.value
        order = np.argsort(known["key"].view(np.uint64)) if len(known) else np.empty(0, np.int64)
        hot_keys, times = (known["key"].view(np.uint64)[order], known["times"][order]) if len(known) else (np.empty(0, np.uint64), np.empty(0, np.int64))
        seen, sets, names, held = set(), [], [], 0

        def dealt() -> Iterator[pa.RecordBatch]:
            flat, own = np.concatenate(sets), np.array(names, np.int64)
            size = np.array([len(s) for s in sets], np.int64)
            who = np.repeat(own, size)
            at = np.searchsorted(hot_keys, flat)
            at[at == len(hot_keys)] = 0
            often = hot_keys[at] == flat if len(hot_keys) else np.zeros(len(flat), bool)
            rest = flat[~often]
            yield _by_bucket((rest % np.uint64(buckets)).astype(np.int64), buckets, rest.view(np.int64), who[~often], None)
            passed = np.concatenate([own, who[often]])
            ranks = np.concatenate([np.full(len(own), -1), HOT + times[at[often]] if len(hot_keys) else np.empty(0, np.int64)])
            yield _by_bucket(_buckets_of(passed, buckets), buckets, np.concatenate([size, flat[often].view(np.int64)]), passed, ranks.astype(np.int64))

        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in blocks(offsets):
                for s in sets_of(data, offsets[a : b + 1], k):
                    name = name_of(s)
                    if len(s) and not (name in seen or seen.add(name)):
                        sets.append(s)
                        names.append(name)
                        held += len(s)
                if held >= 1_000_000:
                    yield from dealt()
                    sets, names, held = [], [], 0
        if held:
            yield from dealt()

    return run


def _in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of a task's bucket, as tuples of arrays; there is one bucket a task."""
    parts = [tuple(None if not column[i].is_valid else column[i].values.to_numpy(zero_copy_only=False) for column in batch.columns[1:]) for batch in batches for i in range(len(batch))]
    if parts:
        yield parts


def _counter(buckets: int):
    """Shingles that two sets or more have, with the number of these, and what is passed on, by the sets' names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _in_buckets(batches):
            for p in parts:
                if p[2] is not None:
                    yield _by_bucket(_buckets_of(p[1], buckets), buckets, *p)
            asked = [p for p in parts if p[2] is None]
            if not asked:
                continue
            keys, names = (np.concatenate([p[i] for p in asked]) for i in (0, 1))
            order = np.lexsort((names, keys))
            keys, names = keys[order], names[order]
            once = np.append(True, (keys[1:] != keys[:-1]) | (names[1:] != names[:-1]))  # several tasks met copies of a set
            keys, names = keys[once], names[once]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            sets = np.diff(np.append(first, len(keys)))
            ranks = np.repeat(sets, sets)
            shared = ranks > 1
            if shared.any():
                yield _by_bucket(_buckets_of(names[shared], buckets), buckets, keys[shared], names[shared], ranks[shared])

    return run


_ALIVE = pa.schema([("name", pa.int64()), ("n", pa.int32()), ("first", pa.int32()), ("listed", pa.int32()), ("keys", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64()))])


def _chooser(percent: int):
    """(name, n, first, listed, keys, ranks) of sets that can have a partner: shared shingles in order, the first of them
    at place ``first`` of the whole order, and how many of them are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _in_buckets(batches):
            keys, names, ranks = (np.concatenate([p[i] for p in parts]) for i in range(3))
            order = np.lexsort((keys, ranks, names))
            keys, names, ranks = keys[order], names[order], ranks[order]
            once = np.append(True, (keys[1:] != keys[:-1]) | (names[1:] != names[:-1]) | (ranks[1:] != ranks[:-1]))
            keys, names, ranks = keys[once], names[once], ranks[once]
            begin = np.flatnonzero(ranks == -1)  # a set's size, once each, comes before its shingles
            n, shared = keys[begin], np.diff(np.append(begin, len(keys))) - 1
            first = n - shared
            listed = np.minimum(prefix(n, percent) - first, shared)
            alive = listed > 0
            if not alive.any():
                continue
            kept = np.repeat(alive, shared + 1) & (ranks != -1)
            cuts = pa.array(np.append(0, np.cumsum(shared[alive])).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(names[begin][alive]), *(pa.array(x[alive].astype(np.int32)) for x in (n, first, listed)), pa.ListArray.from_arrays(cuts, pa.array(keys[kept])), pa.ListArray.from_arrays(cuts, pa.array(ranks[kept]))], schema=_ALIVE)

    return run


def subset_keys(values: np.ndarray, n: int, m: int, percent: int) -> np.ndarray:
    """A key for each subset of ``values`` that a set of ``n`` must share with one of ``m``."""
    c = least_overlap(n, m, percent)
    chosen = np.array(list(combinations(np.sort(values), c)), np.uint64).reshape(-1, c)
    h = np.full(len(chosen), min(n, m) * 100_003 + max(n, m), np.uint64)
    for i in range(c):
        h = mix(h * np.uint64(0x2545F4914F6CDD1D) + chosen[:, i])
    return h


def _lister(percent: int, small: int, buckets: int):
    """Postings (key, name, n, reach, kind) of the sets that can have a partner, dealt into buckets, in arrays. Hot lists aren't among them."""
    schema = pa.schema([("bucket", pa.int32()), ("keys", pa.list_(pa.int64())), ("names", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("reaches", pa.list_(pa.int32())), ("kinds", pa.list_(pa.int8()))])

    def dealt(parts: list) -> pa.RecordBatch:
        keys, names, sizes, reaches, kinds = map(np.concatenate, zip(*parts))
        keys = mix(keys + kinds.astype(np.uint64))
        at = (keys % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        cuts = np.searchsorted(at[order], np.arange(buckets + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x[order])) for x in (keys.view(np.int64), names, sizes, reaches, kinds)]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(buckets, dtype=np.int32)), *lists], schema=schema).filter(pa.array(np.diff(cuts) > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for name, n, first, listed, keys, ranks in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), batch.column(5)):
                s = keys.values.to_numpy(zero_copy_only=False).view(np.uint64)
                own = []
                if n <= small:
                    for m in partners(n, percent):
                        if m <= small and least_overlap(n, m, percent) <= len(s):
                            x = subset_keys(s, n, m, percent)
                            own.append((x, np.zeros(len(x), np.int64), EQUAL if n == m else CROSS))
                if n > small or max(partners(n, percent)) > small:
                    at = np.flatnonzero(ranks.values.to_numpy(zero_copy_only=False)[:listed] < HOT)
                    own.append((s[at], reach(n, first + at, percent), HEAVY))
                for x, far, kind in own:
                    c = len(x)
                    parts.append((x, np.full(c, name, np.int64), np.full(c, n, np.int32), far.astype(np.int32), np.full(c, kind, np.int8)))
                    held += c
            if held >= 500_000:
                yield dealt(parts)
                parts, held = [], 0
        if held:
            yield dealt(parts)

    return run


def _prefix_ties(keys: np.ndarray, names: np.ndarray, sizes: np.ndarray, reaches: np.ndarray, heavy: np.ndarray, percent: int) -> np.ndarray:
    """Ties that join, in each list, the sets of every pair in which both can reach the other's size.

    Lists are in order of size. Each set ties to the nearest earlier one with which it is such a pair. That joins what
    all pairs would: of a pair's later set and the one it tied to, the earlier set of the pair reaches both.
    """
    at = np.flatnonzero(heavy)
    keys, names, sizes, reaches = keys[at], names[at], sizes[at], reaches[at]
    if not len(keys):
        return np.empty((2, 0), np.int64)
    up = reaches >= sizes  # the smaller of two sets reaches the larger one, and so its own size
    y = np.arange(len(keys))
    earlier = np.concatenate([[-1], np.maximum.accumulate(np.where(up, y, -1))[:-1]])
    x, ties = y, []
    while len(x):
        x = earlier[x]
        ok = (x >= 0) & (keys[x] == keys[y]) & (100 * sizes[x] >= percent * sizes[y])
        x, y = x[ok], y[ok]
        fine = (reaches[x] >= sizes[y]) & (reaches[y] >= sizes[x]) & (names[x] != names[y])
        ties.append((x[fine], y[fine]))
        x, y = x[~fine], y[~fine]
    a, b = (np.concatenate(z) for z in zip(*ties))
    return np.stack([names[a], names[b]])


def _scanner(percent: int):
    """Scans a bucket's lists: ties (a, b, times), each pair once with the number of its lists; a comes before b in them."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("times", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _in_buckets(batches):
            keys, names, sizes, reaches, kinds = (np.concatenate([p[i] for p in parts]) for i in range(5))
            order = np.lexsort((names, sizes, keys))
            keys, names, sizes, reaches, kinds = keys[order], names[order], sizes[order].astype(np.int64), reaches[order], kinds[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            both = np.repeat(np.maximum.reduceat(sizes, first) > np.minimum.reduceat(sizes, first), np.diff(np.append(first, len(keys))))
            # in a list for two sizes, every set of one links with every set of the other
            tied = np.choose(kinds[1:], [np.zeros(len(keys) - 1, bool), np.ones(len(keys) - 1, bool), both[1:]])
            at = np.flatnonzero((keys[1:] == keys[:-1]) & (names[1:] != names[:-1]) & tied)
            pair = np.concatenate([np.stack([names[at], names[at + 1]]), _prefix_ties(keys, names, sizes, reaches, kinds == HEAVY, percent)], 1)
            if pair.shape[1]:
                pair, times = np.unique(pair, axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), pa.array(times.astype(np.int64))], schema=schema)

    return run


def _hot_ties(alive: DataFrame, percent: int, folder: str) -> DataFrame:
    """(a, b, times) ties of sets that are listed under a hot shingle: those of like size to the least of them, and these to
    the least of the next size. A superset of what their lists would tie."""
    step = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent))).cast("long")
    at = F.explode(F.arrays_zip(F.slice("keys", 1, F.col("listed")).alias("k"), F.slice("ranks", 1, F.col("listed")).alias("r"))).alias("x")
    own = alive.select("name", step.alias("step"), at).filter(F.col("x.r") >= HOT).select("name", F.col("x.k").alias("key"), "step")
    own = stored(own.withColumn("place", F.xxhash64("key", "step")), folder, "hot-lists")
    heads = stored(own.groupBy("key", "step").agg(F.min("name").alias("a")).withColumn("place", F.xxhash64("key", "step")), folder, "hot-heads")
    star = spread_join(own.select("name", "place"), heads.select("place", "a"), "place", F.col("name")).select("a", F.col("name").alias("b"))
    following = heads.select(F.xxhash64("key", F.col("step") + 1).alias("place"), F.col("a").alias("b")).join(heads.select("place", "a"), "place").select("a", "b")
    return star.unionByName(following).filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"))


def linked(sets: list[np.ndarray], n: np.ndarray, percent: int, most: int = 1 << 22) -> list[tuple[int, int]]:
    """Pairs (i, j) of sets that link, by products of their incidence matrix with shingles that at least two hold.

    ``n``: the sets' sizes; ``sets`` may lack shingles that no other set holds.
    """
    flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if not len(flat):
        return []
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]
    new = np.append(True, flat[1:] != flat[:-1])
    kind = np.cumsum(new) - 1
    shared = np.bincount(kind)[kind] > 1
    kind, of = np.unique(kind[shared], return_inverse=True)[1], of[shared]
    size, step = (int(kind.max()) + 1 if len(kind) else 0), max(1, most // len(sets))
    overlap = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, size, step):
        part = (kind >= a) & (kind < a + step)
        m = np.zeros((len(sets), min(step, size - a)), np.float32)
        m[of[part], kind[part] - a] = 1
        overlap += m @ m.T
    o = np.rint(overlap).astype(np.int64)
    i, j = np.nonzero(np.triu(100 * o >= percent * (n[:, None] + n[None, :] - o), 1) & (o > 0))
    return list(zip(i.tolist(), j.tolist()))


def _checker(percent: int):
    """Verified links of each group of sets (group, name, n, keys), as a forest."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(names: list[int], sizes: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        got = linked(sets, np.array(sizes, np.int64), percent) if len(sets) > 1 else []
        if got:
            a, b = zip(*forest((names[i] for i, _ in got), (names[j] for _, j in got)))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, sizes, sets = None, [], [], []
        for batch in batches:
            for group, name, n, keys in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                if group != now and sets:
                    yield from links(names, sizes, sets)
                    names, sizes, sets = [], [], []
                now = group
                names.append(name)
                sizes.append(n)
                sets.append(keys.values.to_numpy(zero_copy_only=False).view(np.uint64))
        if sets:
            yield from links(names, sizes, sets)

    return run


def _met(ties: DataFrame, alive: DataFrame, percent: int, block: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) among sets of large components that one tie of each set gives, and (group, name, n, keys) to be checked."""
    maybe = stored(components(ties.select("a", "b"), folder, "maybe"), folder, "maybe")
    sized = stored(spread_join(maybe, maybe.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "root", F.col("node")), folder, "sized")
    large = sized.filter(F.col("size") > block).select(F.col("node").alias("b"))
    best = stored(ties.join(large, "b", "left_semi").groupBy("b").agg(F.max_by("a", F.struct("times", "a")).alias("a")), folder, "best")
    payload = alive.select("name", "n", "keys")
    pairs = spread_join(best, payload.toDF("a", "na", "ka"), "a", F.col("b")).join(payload.toDF("b", "nb", "kb"), "b")
    overlap = F.size(F.array_intersect("ka", "kb"))
    fine = pairs.filter((overlap > 0) & (100 * overlap >= percent * (F.col("na") + F.col("nb") - overlap))).select("a", "b")
    links = stored(fine, folder, "tied-links")
    part = components(links, folder, "parts").withColumnRenamed("root", "part")
    # parts of half a block or more have blocks of their own, unit by unit; what is left shares unit 0
    own = stored(sized.join(part, "node", "left").withColumn("part", F.when(F.col("size") > block, F.col("part"))), folder, "own")
    parts = own.filter("part is not null").groupBy("part").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") * 2 >= block).withColumnRenamed("part", "unit")
    of_part = stored(own.filter("part is not null").select("node", "root", F.col("part").alias("unit")), folder, "of-part")
    alone = spread_join(of_part, parts.select("unit"), "unit", F.col("node")).select("node", "unit")
    units = stored(own.join(alone, "node", "left").select("node", "root", F.coalesce("unit", F.lit(0)).alias("unit")).withColumn("at", F.xxhash64("root", "unit")), folder, "units")
    counted = units.groupBy("root", "unit", "at").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    listed = counted.groupBy("root").agg(F.collect_list(F.struct("unit", "parts")).alias("all"))  # large units: at most two for each block
    sides = counted.join(listed, "root").select("at", "parts", "all")
    placed = spread_join(units, sides, "at", F.col("node")).withColumn("place", F.struct("unit", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")))
    others = F.flatten(F.transform(F.filter("all", lambda u: (u["unit"] == 0) | (u["unit"] != F.col("unit"))), lambda u: F.transform(F.sequence(F.lit(0), u["parts"] - 1), lambda i: F.struct(u["unit"].alias("unit"), i.alias("part")))))
    own_keys = placed.select(F.col("node").alias("name"), "root", "place", others.alias("others")).join(payload, "name")
    met = own_keys.select("root", "name", "n", "keys", "place", F.explode("others").alias("other"))
    return links, met.select(F.xxhash64("root", F.least("place", "other"), F.greatest("place", "other")).alias("group"), "name", "n", "keys")


def grouped(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, block: int = BLOCK, per_bucket: int = PER_BUCKET) -> DataFrame:
    """doc_id, text_hash, n_shingles, root, component_id of every row; root names a component, null without shingles."""
    folder = shared_folder(docs.sparkSession)
    texts = documents(docs)
    signed = stored(texts.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_signer(k), "doc_id long, text_hash long, n long, name long, key long, times long"), folder, "signed")
    rows = signed.filter("key is null").select("doc_id", "text_hash", "n", "name")
    held, sets = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    often = signed.filter("key is not null").groupBy("key").agg(F.sum("times").alias("times")).filter(F.col("times") >= max(64, sets // HOT_SHARE))
    stored(often, folder, "hot")  # at most 1,024 times the mean set's shingles

    buckets = max(16, -(-held // per_bucket))
    asked = texts.mapInArrow(_dealer(k, buckets, Kept(f"{folder}/hot")), _DEALT_DDL).repartitionById(buckets, F.col("bucket"))
    shared = asked.mapInArrow(_counter(buckets), _DEALT_DDL).repartitionById(buckets, F.col("bucket"))
    alive = stored(shared.mapInArrow(_chooser(percent), "name long, n int, first int, listed int, keys array<long>, ranks array<long>"), folder, "alive")

    shapes = alive.filter(F.col("n") <= LIGHT_SIZES).groupBy("n", F.size("keys").alias("shared"), "listed").agg(F.count(F.lit(1)).alias("times")).collect()
    lists = alive.select(F.explode(F.slice("keys", 1, F.col("listed"))).alias("key")).agg(F.count("key"), F.approx_count_distinct("key")).first()
    small = boundary([tuple(r) for r in shapes], lists[0] / max(1, lists[1]), percent)
    few = max(16, -(-lists[0] // per_bucket))
    postings = alive.mapInArrow(_lister(percent, small, few), "bucket int, keys array<long>, names array<long>, sizes array<int>, reaches array<int>, kinds array<tinyint>")
    found = postings.repartitionById(few, F.col("bucket")).mapInArrow(_scanner(percent), "a long, b long, times long")
    ties = found.unionByName(_hot_ties(alive, percent, folder)).groupBy("a", "b").agg(F.sum("times").alias("times"))
    links, met = _met(stored(ties, folder, "ties"), alive, percent, block, folder)
    groups = met.repartition(max(16, few), "group").sortWithinPartitions("group")
    verified = stored(groups.mapInArrow(_checker(percent), "a long, b long").unionByName(links), folder, "verified")

    found = components(verified, folder, "found").withColumnRenamed("node", "name")
    alike = rows.filter("n > 0").groupBy("name").agg(F.min("doc_id").alias("first"))
    of = stored(alike.join(found, "name", "left"), folder, "of")
    several = of.filter("root is not null")
    least = several.groupBy("root").agg(F.min("first").alias("component_id"))
    names = spread_join(several.select("name", "root"), least, "root", F.col("name")).select("name", "root", "component_id")
    names = names.unionByName(of.filter("root is null").select("name", F.col("name").alias("root"), F.col("first").alias("component_id")))
    full = spread_join(rows.filter("n > 0"), stored(names, folder, "names"), "name", F.monotonically_increasing_id())
    full = full.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "root", "component_id")
    return full.unionByName(rows.filter("n = 0").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id")))


def join(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return grouped(docs, **how).select("doc_id", "n_shingles", "component_id")


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each component: that of its smallest id (null ids last), then of the smallest text hash.

    Rows without shingles are components of their own and all stay. Columns and their order are kept.
    """
    found = stored(grouped(docs, **how), shared_folder(docs.sparkSession), "grouped").filter("root is not null")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("w"))
    times = found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("times"))
    won = first.select(F.col("w.doc_id").alias("won_id"), F.col("w.text_hash").alias("won_hash"))
    won = won.join(times, F.expr("won_id <=> doc_id and won_hash = text_hash")).select(F.xxhash64("won_id", "won_hash").alias("place"), "won_id", "won_hash", "times")
    rows = boxed(docs).withColumn("has_words", F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    asked = rows.filter("has_words").withColumn("text_hash", F.xxhash64("text")).withColumn("place", F.xxhash64("doc_id", "text_hash"))
    # a row that is repeated often is dealt over several tasks until its repeats are one
    sizes = found.select(F.xxhash64("doc_id", "text_hash").alias("place"))
    met = spread_join(asked, won, "place", F.monotonically_increasing_id(), sizes).filter("doc_id <=> won_id and text_hash = won_hash")
    columns = ["doc_id", "text", "source", "rest"]
    # equal rows are one document; there is nothing to choose where a row is alone
    alike = met.filter("times > 1").groupBy("won_id", "won_hash").agg(F.first(F.struct(*columns)).alias("r")).select("r.*")
    return unboxed(met.filter("times = 1").select(columns).unionByName(alike).unionByName(rows.filter("not has_words").select(columns)), docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


NAME = "op4_ngram_jaccard"
