"""Places of many forms in texts without spaces: one pass of an Aho-Corasick automaton over each text."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.sources import sinks as W

#: Forms of one automaton; more are dealt over several passes, so that no worker holds all of them.
MOST = 100_000


def chosen(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Of places (start, end, form) those that stand when the leftmost is taken, the longest of these, and so on behind it."""
    out, last = [], 0
    for place in sorted(found, key=lambda p: (p[0], -p[1])):
        if place[0] >= last:
            out.append(place)
            last = place[1]
    return out


def _read_forms(path: str, part: int) -> list[str]:
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSelector, FileSystem

    fs, top = FileSystem.from_uri(path if "://" in path else f"file://{path}")
    files = [f.path for f in fs.get_file_info(FileSelector(top, recursive=True)) if f.path.endswith(".parquet") and f"/part={part}/" in f.path]
    return [form for f in files for form in pq.ParquetFile(fs.open_input_file(f)).read(columns=["form"])["form"].to_pylist()]


def _finder(path: str, part: int, choose: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        forms = _read_forms(path, part)
        machine = ahocorasick.Automaton()
        for form in forms:
            machine.add_word(form, form)
        machine.make_automaton()
        for batch in batches:
            rows = []
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, ends = [], {}
                for end, form in machine.iter(text) if text and forms else ():
                    start = end + 1 - len(form)
                    if start >= ends.get(form, 0):  # finding a form goes on behind its last place
                        ends[form] = end + 1
                        found.append((start, end + 1, form))
                rows += [(id_, *p) for p in (chosen(found) if choose else found)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 4, (pa.int64(), pa.int32(), pa.int32(), pa.string()))], ["id", "start", "end", "form"])

    return run


def occurrences(texts: DataFrame, forms: DataFrame | list[str], most: int = MOST) -> DataFrame:
    """(id, start, end, form): places of ``forms`` (form) in ``texts`` (id, full_text), leftmost and longest, without overlaps.

    A form's own places don't overlap each other before places are chosen, as finding goes on after each.
    """
    spark = texts.sparkSession
    if isinstance(forms, list):
        forms = spark.createDataFrame([(f,) for f in forms], "form string")
    forms = forms.select("form").filter("form <> ''").distinct()
    parts = max(1, -(-forms.count() // most))
    path = f"{W.scratch_folder(spark)}/forms"
    forms.withColumn("part", F.pmod(F.xxhash64("form"), F.lit(parts))).write.partitionBy("part").parquet(path)
    rows, schema = texts.select("id", "full_text"), "id long, start int, end int, form string"
    if parts == 1:
        return rows.mapInArrow(_finder(path, 0, True), schema)
    found = rows.mapInArrow(_finder(path, 0, False), schema)
    for part in range(1, parts):
        found = found.unionByName(rows.mapInArrow(_finder(path, part, False), schema))
    place = F.struct("start", (-F.col("end")).alias("back"), "form")
    empty = F.lit(0), F.array().cast("array<struct<start:int,back:int,form:string>>")
    step = lambda a, p: F.when(p["start"] >= a["last"], F.struct((-p["back"]).alias("last"), F.concat(a["out"], F.array(p)).alias("out"))).otherwise(a)
    kept = F.aggregate(F.array_sort(F.collect_list(place)), F.struct(empty[0].alias("last"), empty[1].alias("out")), step, lambda a: a["out"])
    one = found.groupBy("id").agg(kept.alias("kept")).select("id", F.explode("kept").alias("p"))  # a text's places
    return one.select("id", "p.start", (-F.col("p.back")).alias("end"), "p.form")


# what workers run of this module travels with its data, so they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
