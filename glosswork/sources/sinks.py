"""Writing a library: whole new versions behind a pointer, keyed stores, and logs."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")


def replace_library(tables: dict[str, DataFrame], path: str, version: str) -> str:
    """Writes every table under a new version, then a row that names it; readers see the old version until then.

    A failed write leaves the pointer, and so the library, as it was.
    """
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy("language") if name == "sentences" else writer).parquet(f"{path}/versions/{version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").json(f"{path}/current")
    return version


def open_library(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the latest version. Versions are named so that they sort by time."""
    version = spark.read.schema("version string").json(f"{path}/current").agg(F.max("version")).first()[0]
    return {name: spark.read.parquet(f"{path}/versions/{version}/{name}") for name in ("sentences", "forms", "word_forms")}


def open_read_only(spark: SparkSession, path: str, needed: tuple[str, ...] = ("sentences", "forms", "word_forms")) -> dict[str, DataFrame]:
    """The same for a review, which never writes; a library that lacks a table is an error that names it."""
    tables = open_library(spark, path)
    missing = []
    for name in needed:
        try:
            tables[name].schema
        except Exception:  # noqa: BLE001
            missing.append(name)
    if missing:
        raise ValueError(f"missing table(s): {', '.join(missing)}")
    return tables


def replace_word_forms(spark: SparkSession, path: str, pairs: DataFrame, version: str) -> str:
    """The library with other (form, base) pairs, as a new version: all of them or, if that fails or there are none, no change."""
    if pairs.isEmpty():
        raise ValueError("no word forms to write")
    tables = open_library(spark, path)
    return replace_library({**tables, "word_forms": pairs.select("form", "base").distinct()}, path, version)


def within(spark: SparkSession, seconds: float, action: Callable[[], T]) -> T:
    """``action()``, whose jobs are cancelled after ``seconds``: a TimeoutError then."""
    context, group, late = spark.sparkContext, f"within-{uuid.uuid4().hex}", threading.Event()
    context.setJobGroup(group, "with a deadline", interruptOnCancel=True)

    def stop() -> None:
        late.set()
        context.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    timer.daemon = True
    timer.start()
    try:
        return action()
    except Exception:
        if late.is_set():
            raise TimeoutError(f"not done within {seconds:g} s") from None
        raise
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)


def previous_versions(spark: SparkSession, path: str) -> list[str]:
    """Versions before the current one, the latest last; they stay until dropped, as backups."""
    rows = spark.read.schema("version string").json(f"{path}/current").distinct().orderBy("version").collect()
    return [r.version for r in rows][:-1]


def add_missing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with the columns (name: type) that an older table lacks, empty."""
    return df.select("*", *[F.lit(None).cast(t).alias(n) for n, t in columns.items() if n not in df.columns])


def drop_library(spark: SparkSession, path: str) -> None:
    """Deletes a whole library; a folder that isn't one (without versions and pointer) is an error and stays."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not all(fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}")) for n in ("versions", "current")):
        raise ValueError(f"{path} is no library")
    fs.delete(at, True)


def _shared_top(spark: SparkSession) -> str:
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (top or f"file://{tempfile.gettempdir()}").rstrip("/")


def lasting_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in shared storage that stays when the application ends."""
    return f"{_shared_top(spark)}/glosswork-{name}-{uuid.uuid4().hex}"


def scratch_folder(spark: SparkSession) -> str:
    """A fresh folder for tables that last as long as the application, under spark.checkpoint.dir where that is set."""
    folder = f"{_shared_top(spark)}/glosswork-tables-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return folder


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a table at ``path``, read back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_store(df: DataFrame, path: str) -> None:
    """A small keyed store as JSON lines in one file: written beside and then renamed, so readers see the old or the new one."""
    spark, part = df.sparkSession, f"{path}.{uuid.uuid4().hex}.part"
    df.coalesce(1).write.json(part)
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = to_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(to_path(path)):
        old = f"{path}.{uuid.uuid4().hex}.old"
        fs.rename(to_path(path), to_path(old))
        fs.rename(to_path(part), to_path(path))
        fs.delete(to_path(old), True)
    else:
        fs.rename(to_path(part), to_path(path))


def append_log(path: str, lines: list[str], most: int = 1_000_000) -> None:
    """Adds lines to a driver's log file; one that has ``most`` bytes becomes the single older one first."""
    if os.path.exists(path) and os.path.getsize(path) >= most:
        os.replace(path, f"{path}.1")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "a", encoding="utf-8") as out:
        out.writelines(f"{line}\n" for line in lines)


def upsert(store: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``store`` with rows of ``changes`` in place of those with their keys."""
    return store.join(changes.select(keys).distinct(), keys, "left_anti").select(changes.columns).unionByName(changes)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines as rows; broken lines are kept in ``_corrupt_record``."""
    return spark.read.schema("time string, event string, detail map<string,string>, _corrupt_record string").json(path)
