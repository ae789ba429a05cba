"""Connected components of an undirected graph given by edges, without collecting a neighbourhood."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import spread_join, stored


def forest(a, b) -> list[tuple[int, int]]:
    """(node, root) for the nodes of some edges that fit into one task, each node but the roots once."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for x, y in zip(a, b):
        up.setdefault(x, x)
        up.setdefault(y, y)
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return [(x, r) for x in up if (r := top(x)) != x]


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """node and root, the least node of its component, for every node of ``edges`` (a, b: long).

    In a round every node and its neighbours are tied to the least of them, until nothing changes. Degrees are never
    gathered: a round is a grouped minimum and a join, in which a node of many neighbours is dealt over several tasks.
    Each round is written, so a lost executor repeats one round at most.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    now, before, turn = stored(both, folder, f"{name}-0"), None, 0
    while True:
        said = now.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("h")).first()
        if said == before:
            break
        before, turn = said, turn + 1
        least = now.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        tied = spread_join(now, least, "a", F.col("b")).select(F.col("b").alias("x"), F.col("m").alias("y")).unionByName(least.select(F.col("a").alias("x"), F.col("m").alias("y"))).filter("x <> y")
        both = tied.unionByName(tied.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct().select(F.col("x").alias("a"), F.col("y").alias("b"))
        now = stored(both, folder, f"{name}-{turn}")
    return now.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
