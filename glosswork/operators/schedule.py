"""From answers to card states: the plan, one step of the scheduler, review-log rows, undo, and replay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.functions import scheduling as S
from glosswork.operators.ranks import numbered
from glosswork.operators.replay import cards_after


def answer_plan(card_map: DataFrame, unknown_keys: list[str] | DataFrame, unknown_cards: list[int] | DataFrame = (), again: int = 1, good: int = 3) -> DataFrame:
    """(card_id, ease, keys, is_unknown) from (key, card_ids): a card is unknown if one of its keys is, or it is named.

    What is unknown is given as values, those of a sentence, or as tables (key), (card_id) for many answers at once.
    """
    spark = card_map.sparkSession
    keys = unknown_keys if isinstance(unknown_keys, DataFrame) else spark.createDataFrame([(k,) for k in unknown_keys], "key string")
    cards = unknown_cards if isinstance(unknown_cards, DataFrame) else spark.createDataFrame([(int(c),) for c in unknown_cards], "card_id long")
    flat = card_map.select("key", F.explode("card_ids").alias("card_id")).join(keys.select("key", F.lit(True).alias("by_key")).distinct(), "key", "left")
    plan = flat.groupBy("card_id").agg(F.array_sort(F.collect_set("key")).alias("keys"), F.max(F.coalesce("by_key", F.lit(False))).alias("by_key"))
    met = plan.join(cards.select("card_id", F.lit(True).alias("named")).distinct(), "card_id", "left")
    unknown = F.col("by_key") | F.coalesce("named", F.lit(False))
    return met.select("card_id", F.when(unknown, again).otherwise(good).alias("ease"), "keys", unknown.alias("is_unknown"))


def check_answers(answers: DataFrame, cards: DataFrame) -> DataFrame:
    """Answers that must not be written: their card is missing or sits in a filtered deck. Empty if all is well."""
    met = answers.join(cards.select("card_id", "odid"), "card_id", "left")
    return met.select("card_id", F.when(F.col("odid").isNull(), "missing").when(F.col("odid") != 0, "filtered_deck").alias("problem")).filter("problem is not null")


def step(rows: DataFrame, today: int, now: int, usn: int) -> DataFrame:
    """Card rows (with is_unknown) after their answer; before it, as old_*, stay for the log and for undo."""
    review = (F.col("type") == 2) | (F.col("queue") == 2)
    factor = F.when(F.coalesce("factor", F.lit(0)) == 0, 2500).otherwise(F.col("factor"))
    interval = S.next_interval(F.col("ivl"), F.col("factor"))
    new = {
        "factor": (F.greatest(F.lit(1300), factor - 200), factor),
        "ivl": (F.lit(0), interval),
        "due": (F.lit(now), F.lit(today) + interval),
        "queue": (F.lit(1), F.lit(2)),
        "left": (F.lit(1001), F.lit(0)),
        "type": (F.when(review, 3).otherwise(1), F.lit(2)),
        "lapses": (F.col("lapses") + review.cast("int"), F.col("lapses")),
        "log_type": (F.when(review, 2).otherwise(0), F.when(review, 1).otherwise(0)),
    }
    old = [F.col(c).alias(f"old_{c}") for c in ("factor", "ivl", "due", "queue", "left", "type", "lapses", "reps")]
    named = [F.when(F.col("is_unknown"), a).otherwise(b).cast("long").alias(c) for c, (a, b) in new.items()]
    return rows.select("card_id", "is_unknown", *old, *named, (F.col("reps") + 1).cast("long").alias("reps"), F.lit(now).cast("long").alias("mod"), F.lit(usn).cast("long").alias("usn"), F.lit(0).cast("long").alias("odue"), F.lit(0).cast("long").alias("odid"))


def free_ids(spark_rows: DataFrame, first: int, taken: DataFrame) -> DataFrame:
    """(number, id): for each of a batch's n rows, the next free id from ``first`` on; ``taken`` has ids in use."""
    n = spark_rows.count()
    spark = spark_rows.sparkSession
    used = taken.filter(F.col("id") >= first).select("id").distinct()
    free = spark.range(first, first + n + used.filter(F.col("id") < first + n + used.count()).count()).join(used, "id", "left_anti")
    return numbered(free, ["id"]).filter(F.col("number") < n)


def log_rows(stepped: DataFrame, now: int, taken: DataFrame | None = None) -> DataFrame:
    """Review-log rows; ids count up from the moment of the answer, leaving out ids that are ``taken``."""
    placed = numbered(stepped, ["card_id"])
    if taken is None:
        placed = placed.withColumn("id", F.col("number") + now * 1000)
    else:
        placed = placed.join(free_ids(stepped, now * 1000, taken), "number")
    return placed.select(F.col("id").cast("long").alias("id"), F.col("card_id").alias("cid"), "usn", F.when(F.col("is_unknown"), 1).otherwise(3).alias("ease"), "ivl", F.col("old_ivl").cast("long").alias("last_ivl"), "factor", F.lit(0).cast("long").alias("time"), F.col("log_type").alias("type"))


def without_log(log: DataFrame, undone: DataFrame) -> DataFrame:
    """``log`` without the rows (id) of answers that are taken back."""
    return log.join(undone.select("id"), "id", "left_anti").select(log.columns)


def undo(stepped: DataFrame) -> DataFrame:
    """The rows as they were."""
    names = ("factor", "ivl", "due", "queue", "left", "type", "lapses", "reps")
    return stepped.select("card_id", *[F.col(f"old_{c}").cast("long").alias(c) for c in names])


def restore(cards: DataFrame, snapshot: DataFrame) -> DataFrame:
    """``cards`` with the snapshot's rows in place of theirs."""
    kept = cards.join(snapshot.select("card_id"), "card_id", "left_anti")
    return kept.select(snapshot.columns).unionByName(snapshot)


def replay(cards: DataFrame, answers: DataFrame) -> DataFrame:
    """``cards`` (card_id, ivl, factor, lapses, reps, review) after their ``answers`` (card_id, ts, seq, is_unknown), with their number."""
    return cards_after(cards, answers)
