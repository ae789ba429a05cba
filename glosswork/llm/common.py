"""What the operators of this subpackage share: column picking, shared storage, table access."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of anything but the ASCII space and the five ASCII controls from tab to return.
WORD = r"[^\x20\x09-\x0D]+"

_own_folders: dict[str, str] = {}


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, found by exact case, whatever else the frame holds."""
    share_code(df.sparkSession)
    held = df.columns
    plain = df.toDF(*[f"_c{i}" for i in range(len(held))])
    return plain.select(*[F.col(f"_c{held.index(n)}").alias(n) for n in names])


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id as long and text as string, null text kept, besides the columns in ``more``."""
    return pick(df, "doc_id", "text", *more).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more)


def boxed(df: DataFrame) -> DataFrame:
    """doc_id, text and source, and the other columns as one struct, so that no name can clash."""
    share_code(df.sparkSession)
    held = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(held))])
    rest = [F.col(f"c{i}") for i, n in enumerate(held) if n not in ("doc_id", "text", "source")] or [F.lit(0).alias("none")]
    own = {n: F.col(f"c{held.index(n)}") for n in ("doc_id", "text", "source") if n in held}
    return plain.select(own["doc_id"].cast("long").alias("doc_id"), own["text"].cast("string").alias("text"), own.get("source", F.lit(None).cast("string")).alias("source"), F.struct(*rest).alias("rest"))


def unboxed(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns that ``boxed`` put away, in their order, with what doc_id, text and source have become."""
    return df.select(*[(F.col(n) if n in ("doc_id", "text", "source") else F.col(f"rest.c{i}")).alias(n) for i, n in enumerate(names)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: One thread a worker: a task is one core's work, and threads of matrix products that wait for each other cost more than
#: they gain. A worker lives on between tasks, so what a task frees goes back at once: arrays of 4 MB and more have pages of
#: their own, and Arrow keeps no pool.
WORKER_ENV = {
    "OMP_NUM_THREADS": "1",
    "OPENBLAS_NUM_THREADS": "1",
    "ARROW_DEFAULT_MEMORY_POOL": "system",
    "MALLOC_ARENA_MAX": "1",
    "MALLOC_MMAP_THRESHOLD_": str(4 << 20),
    "MALLOC_TRIM_THRESHOLD_": str(8 << 20),
}


def share_code(spark: SparkSession) -> None:
    """Lets Python workers import this package when it isn't installed on the executors, and sets ``WORKER_ENV`` for them."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    for name, value in WORKER_ENV.items():
        env.setdefault(name, value)
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir that is deleted when the application ends.

    Where that is unset, as in tests, it is under a folder of our own; that is an error on a cluster, whose machines
    wouldn't see each other's files.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_folders:
            _own_folders[app] = "file://" + tempfile.mkdtemp(prefix="glosswork-")
            _until_exit(spark, _own_folders[app])
        top = _own_folders[app]
    folder = f"{top.rstrip('/')}/glosswork-{uuid.uuid4().hex}"
    _until_exit(spark, folder)
    return folder


def _until_exit(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)


def stored(df: DataFrame, folder: str, name: str, **options) -> DataFrame:
    """Writes ``df`` under ``folder`` and reads it back: lineage ends there, and a lost executor costs no recomputation. ``options`` are the writer's."""
    path = f"{folder}/{name}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key is hot from this share of the rows on, so at most so many keys are.
HOT_SHARE = 1024


def spread_join(rows: DataFrame, side: DataFrame, key: str, turn: Column, keys: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with ``side``, which has a row for each ``key``, without a key's rows meeting in one task.

    Keys that hold over 1/1024 of the rows, of which there are at most 1,024 whatever the size, are dealt over as many
    places as their rows ask for, by ``turn`` (a long that differs between rows), and the side's row goes to each.
    Keys are counted in ``rows``, which should be a written table, or in ``keys``, which has the key of each row.
    """
    keys = rows.select(key) if keys is None else keys
    total = keys.count()
    share = F.ceil(F.count(F.lit(1)) * HOT_SHARE / max(1, total)).cast("int")
    hot = F.broadcast(keys.groupBy(key).agg(share.alias("hot_places")).filter("hot_places > 1"))
    dealt = rows.join(hot, key, "left").withColumn("hot_place", F.when(F.col("hot_places").isNull(), 0).otherwise(F.pmod(F.xxhash64(turn), F.col("hot_places"))).cast("int")).drop("hot_places")
    places = F.explode(F.expr("if(hot_places is null, array(0), sequence(0, hot_places - 1))")).alias("hot_place")
    return dealt.join(side.join(hot, key, "left").select(*side.columns, places), [key, "hot_place"], how).drop("hot_place")


class Kept:
    """A written table of bounded size, read once in each worker process: its columns as arrays. It never passes the driver."""

    def __init__(self, path: str):
        self.path = path

    @property
    def value(self) -> dict[str, np.ndarray]:
        return _columns(self.path)


@lru_cache(maxsize=2)
def _columns(path: str) -> dict[str, np.ndarray]:
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSelector, FileSystem

    fs, top = FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"file://{path}")
    parts = [pq.read_table(fs.open_input_file(f.path)) for f in fs.get_file_info(FileSelector(top)) if f.base_name.endswith(".parquet")]
    whole = pa.concat_tables(parts) if parts else None
    return {n: whole[n].to_numpy() for n in whole.column_names} if whole is not None and len(whole) else {}


def hash_sample(df: DataFrame, hash_: str, n: int, order: list[str]) -> DataFrame:
    """At most ``n`` rows by least hash: a share of the hashes that holds about twice as many, then the first of these.

    The share keeps what each task sorts, and sends on, in proportion to ``n`` and not to the number of tasks.
    """
    total = df.count()
    if total > 4 * n:
        df = df.filter(F.pmod(F.col(hash_), F.lit(1 << 20)) < int(2 * n / total * (1 << 20)) + 1)
    return df.orderBy(F.pmod(F.col(hash_), F.lit(1 << 20)), hash_, *order).limit(n)


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
