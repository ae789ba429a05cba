"""Mixing sources to target weights.

Every row gets a hash-random key (md5 of its id and text). Keys are uniform, so their leading hex digits are a
ready range partitioning: rows are sorted inside (source, range), the ranges' word counts are summed, and a prefix
sum over the ranges of a source turns each local running sum into the source-wide one. Each source is then cut at
its exact word budget: whole epochs first, then the remainder in key order, the last row in part.

Only (source, range) groups are ever sorted in one task, so a source that holds a third of all rows is dealt over
16**digits groups. The table of sources is the only thing that one task sorts, as weights go by a source's rank among all:
some 50 bytes for each source, which spill where there are very many.

Defined results: null text has size 0; a very long text is counted whole, by one expression; a null source is a source of
its own, last in order; a null doc_id is an id like any other; an empty table gives an empty mix; sources without words get
target 0; rows of equal keys go by id and size, and equal rows may swap places, which changes no value; further columns,
whatever their names, are left out by ``mix_sources`` and kept by ``apply_mix``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glosswork.llm.common import WORD, documents, shared_folder, stored, table, word_count

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3


def _keyed(docs: DataFrame, digits: int) -> DataFrame:
    seed = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit("")))
    return docs.withColumn("size", word_count(F.col("text"))).withColumn("key", F.substring(F.md5(seed), 1, 16)).withColumn("range", F.substring("key", 1, digits))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """(source, source_size) -> target by weighted water-filling: no target over ``max_epochs`` times the size.

    Sources in order of cap/weight are capped as long as the level that the rest would reach exceeds their cap.
    """
    everyone = Window.partitionBy()
    place = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    level = (F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / (F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    return (
        sizes.withColumn("place", F.row_number().over(place))
        .withColumn("w", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("turn", F.row_number().over(by_ratio))
        .withColumn("level", level)
        .withColumn("open", F.col("cap") >= F.col("level") * F.col("w"))
        .withColumn("first", F.min(F.when(F.col("open"), F.col("turn"))).over(everyone))
        .withColumn("water", F.min(F.when(F.col("turn") == F.col("first"), F.col("level"))).over(everyone))
        .withColumn("target", F.when(F.col("turn") < F.coalesce("first", F.lit(1 << 30)), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("water") * F.col("w"))))
        .withColumn("budget", F.floor(F.col("target") + 0.5).cast("long"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
        .select("source", "source_size", "target", "epochs", "rest")
    )


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, digits: int = 3) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, source) as doc_id, source, key, size, source_size, target, taken."""
    folder = shared_folder(docs.sparkSession)
    rows = stored(_keyed(documents(docs, "source"), digits).select("doc_id", "source", "key", "range", "size"), folder, "keyed")
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, max_epochs)
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("start", F.coalesce(F.sum("range_size").over(upto), F.lit(0))).alias("a").join(targets.alias("b"), F.expr("a.source <=> b.source")).select("a.source", "range", "start", "source_size", "target", "epochs", "rest")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start") - F.col("ahead")))
    return (
        summed.alias("r")
        .join(starts.alias("s"), F.expr("r.source <=> s.source and r.range = s.range"))
        .withColumn("taken", F.col("epochs") * F.col("size") + part)
        .select("doc_id", "r.source", "key", "size", "source_size", "target", "epochs", F.col("taken").cast("long").alias("taken"))
    )


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, digits: int = 3) -> DataFrame:
    """The mixed corpus itself: each row as often as it is taken, the last time cut after its share of words.

    A row without words is in no mix. Rows meet their share by (doc_id, key), a hash of the whole row.
    """
    names = docs.columns
    mix = mix_sources(docs, weights, max_epochs, digits).filter("taken > 0").groupBy("doc_id", "source", "key").agg(F.first("size").alias("mix_size"), F.sum("taken").alias("mix_taken"), F.count(F.lit(1)).alias("mix_rows"))
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {n: F.col(f"c{names.index(n)}") for n in ("doc_id", "text", "source")}
    seed = F.concat(F.coalesce(at["doc_id"].cast("string"), F.lit("")), F.lit("|"), F.coalesce(at["text"], F.lit("")))
    keyed = plain.withColumn("mix_key", F.substring(F.md5(seed), 1, 16))
    each = Window.partitionBy("mix_doc", "mix_source", "mix_key").orderBy(F.lit(1))
    shares = mix.select(F.col("doc_id").alias("mix_doc"), F.col("source").alias("mix_source"), F.col("key").alias("k"), "mix_size", "mix_taken", "mix_rows")
    met = keyed.join(shares, at["doc_id"].eqNullSafe(F.col("mix_doc")) & at["source"].eqNullSafe(F.col("mix_source")) & (F.col("mix_key") == F.col("k")))
    # equal rows share what they take: the first ones take one epoch more
    alone = met.filter("mix_rows = 1").withColumn("mix_turn", F.lit(1))
    met = alone.unionByName(met.filter("mix_rows > 1").withColumn("mix_turn", F.row_number().over(each)))
    whole, left = F.expr("mix_taken div (mix_size * mix_rows)"), F.expr("mix_taken % (mix_size * mix_rows)")
    met = met.withColumn("mix_own", whole * F.col("mix_size") + F.greatest(F.lit(0), F.least(F.col("mix_size"), left - (F.col("mix_turn") - 1) * F.col("mix_size"))))
    copies = F.explode(F.expr("sequence(1, cast(ceil(mix_own / mix_size) as int))")).alias("mix_copy")
    out = met.filter("mix_own > 0").select("*", copies)
    words = F.least(F.col("mix_size"), F.col("mix_own") - (F.col("mix_copy") - 1) * F.col("mix_size"))
    cut = F.regexp_substr(at["text"], F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), words.cast("string"), F.lit("}+")))
    text = F.when(words == F.col("mix_size"), at["text"]).otherwise(cut)
    return out.select(*[(text if n == "text" else F.col(f"c{i}")).alias(n) for i, n in enumerate(names)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


NAME = "op3_mix_sources"
ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 16) AS key
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM s0),
s2 AS (SELECT *, ((place - 1) % 3 + 1)::BIGINT AS w, source_size * 3 AS cap FROM s1),
s3 AS (
  SELECT *, row_number() OVER r AS turn,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS level
  FROM s2 WINDOW r AS (ORDER BY cap / w, place), b AS (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, min(CASE WHEN cap >= level * w THEN turn END) OVER () AS first FROM s3),
s5 AS (SELECT *, min(CASE WHEN turn = first THEN level END) OVER () AS water FROM s4),
s6 AS (SELECT source, source_size, CASE WHEN turn < coalesce(first, 1000000000) THEN cap::DOUBLE ELSE least(cap::DOUBLE, water * w) END AS target FROM s5),
s7 AS (SELECT *, floor(target + 0.5)::BIGINT AS budget FROM s6),
s8 AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM s7)
SELECT d.doc_id, d.size, s.source_size, s.target,
  (s.epochs * d.size + greatest(0, least(d.size, s.budget - s.epochs * s.source_size
    - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS taken
FROM d JOIN s8 s ON d.source IS NOT DISTINCT FROM s.source
"""
