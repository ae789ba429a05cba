"""Builds a sentence library from files: ``python -m glosswork.build --input FILE --output FOLDER``, or by spark-submit."""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.operators import corpus as K
from glosswork.operators import ingest as I
from glosswork.sources import readers, sinks


def build(spark: SparkSession, source: str, output: str, language: str = "en", input_format: str = "auto", natives: str = "", native_language: str = "en", links: str = "", words: tuple[int, int] = (2, 10), strict: bool = True, word_forms: Sequence[str] = (), limit: int = 0, lemmas: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Reads, pairs, judges and writes a new version of the library at ``output``; gives its metrics' one row.

    ``natives`` and ``links`` belong together: sentences by id, and which of them translate which. ``lemmas`` gives (form,
    base) pairs of sentences in place of the stems. A failure leaves the library as it was.
    """
    if bool(natives) != bool(links):
        raise ValueError("natives and links go together")
    if natives:
        rows = readers.read_ids(spark, source).filter(K.of_language(F.col("language"), language))
        own = readers.read_ids(spark, natives).filter(K.of_language(F.col("language"), native_language))
        paired = I.pair_translations(rows, own, readers.read_links(spark, links))
        rows = paired.select(F.col("id").alias("ordinal"), "language", "text", "translation")
    else:
        rows = readers.read_sentences(spark, source, language, input_format)
    work = sinks.scratch_folder(spark)
    judged = sinks.written(I.judge(rows, *words, strict), f"{work}/judged")
    kept = I.accepted(judged, limit).withColumn("source", F.lit(source))
    sentences = sinks.written(kept, f"{work}/sentences")
    forms = sinks.written(K.sentence_forms(sentences), f"{work}/forms")
    pairs = lemmas(sentences) if lemmas else K.word_forms(sentences, forms)
    for path in word_forms:
        pairs = pairs.unionByName(readers.read_word_forms(spark, path))
    tables = {"sentences": sentences, "forms": forms, "word_forms": pairs.distinct()}
    sinks.replace_library(tables, output, time.strftime("%Y%m%dT%H%M%S"))
    return I.import_metrics(judged, limit)


def main(argv: Sequence[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--language", default="en")
    p.add_argument("--native-language", default="en")
    p.add_argument("--format", choices=("auto", "plain", "tsv", "csv"), default="auto")
    p.add_argument("--native-input", default="")
    p.add_argument("--links-input", default="")
    p.add_argument("--min-words", type=int, default=2)
    p.add_argument("--max-words", type=int, default=10)
    p.add_argument("--word-forms", action="append", default=[])
    p.add_argument("--no-strict-filter", action="store_true")
    a = p.parse_args(argv)
    if bool(a.native_input) != bool(a.links_input):
        p.error("--native-input and --links-input go together")
    spark = SparkSession.builder.getOrCreate()
    r = build(spark, a.input, a.output, a.language, a.format, a.native_input, a.native_language, a.links_input, (a.min_words, a.max_words), not a.no_strict_filter, a.word_forms).first()
    print(f"{r.inserted} sentences written to {a.output}, {r.skipped} skipped")


if __name__ == "__main__":
    main()
