"""Sentences from addresses: archives kept as files, and delimited rows parsed while they arrive."""

from __future__ import annotations

import os
import sys
import tempfile
import urllib.request
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK = 256 << 10


def fetch(url: str, folder: str, name: str = "") -> str:
    """The file at ``url`` under ``folder``, in chunks; it appears there whole or not at all, in place of an older one."""
    os.makedirs(folder, exist_ok=True)
    target = os.path.join(folder, name or os.path.basename(url))
    handle, part = tempfile.mkstemp(dir=folder, suffix=".part")
    try:
        with os.fdopen(handle, "wb") as out, urllib.request.urlopen(url, timeout=60) as source:
            while chunk := source.read(CHUNK):
                out.write(chunk)
        os.replace(part, target)
    except BaseException:
        os.unlink(part)
        raise
    return target


def _lines(url: str) -> Iterator[str]:
    """Lines of a text at ``url``, unpacked as it arrives; a last line without an end counts."""
    import bz2
    import codecs

    unpack, decode, rest = bz2.BZ2Decompressor(), codecs.getincrementaldecoder("utf-8")("replace"), ""
    with urllib.request.urlopen(url, timeout=60) as source:
        while chunk := source.read(CHUNK):
            if url.endswith(".bz2"):
                data = b""
                while chunk:  # several streams may follow each other
                    data += unpack.decompress(chunk)
                    chunk = unpack.unused_data if unpack.eof else b""
                    if unpack.eof:
                        unpack = bz2.BZ2Decompressor()
                chunk = data
            *whole, rest = (rest + decode.decode(chunk)).split("\n")
            yield from (line.rstrip("\r") for line in whole)
    rest += decode.decode(b"", final=True)
    if rest:
        yield rest.rstrip("\r")


class RemoteRows(DataSource):
    """Tab-separated rows of the addresses in option ``urls`` (one a line), each read by one task: (url, turn, parts)."""

    @classmethod
    def name(cls) -> str:
        return "remote_rows"

    def schema(self) -> str:
        return "url string, turn long, parts array<string>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["urls"].split("\n"))


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str]):
        self.urls = urls

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls if u]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for turn, line in enumerate(_lines(partition.value)):
            if line.strip():
                yield partition.value, turn, line.split("\t")


def read_remote(spark: SparkSession, urls: list[str], language: str) -> DataFrame:
    """(url, turn, language, text, translation) of delimited sentence rows at ``urls``, parsed while they stream in."""
    from pyspark.sql import functions as F

    from glosswork.sources.readers import parse_row

    spark.dataSource.register(RemoteRows)
    raw = spark.read.format("remote_rows").option("urls", "\n".join(urls)).load()
    return raw.select("url", "turn", parse_row(F.col("parts"), language).alias("r")).filter("r is not null").select("url", "turn", "r.*")

# what workers run of this module travels with its data, so they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
