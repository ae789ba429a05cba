"""Queries over logs and arriving rows: sessions as data, and each stream beside the batch that gives the same rows.

A stream's rows arrive in two parts; the query runs on the first, ends, and goes on with the second from its state. Each
call works in a new folder of shared storage, which stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.operators import replay as R
from glosswork.plans.catalog import entry, oracle_of, raw, table
from glosswork.plans.pieces import sql
from glosswork.sources import sinks as W
from glosswork.streaming import streams as V


def in_two_parts(rows: DataFrame, by: str, name: str, stream: Callable[[DataFrame], DataFrame], mode: str = "update") -> str:
    """The folder of a stream that ran twice: over the rows up to the middle of ``by``, then over the others."""
    spark = rows.sparkSession
    folder = W.lasting_folder(spark, name)
    rows = W.written(rows, f"{W.scratch_folder(spark)}/rows")  # each of the parts would make all rows anew
    ends = rows.agg(F.min(by).alias("a"), F.max(by).alias("b")).first()
    first = F.col(by) < (ends.a + (ends.b - ends.a) / 2 if ends.a is not None else None)
    for part in (first, ~first):
        rows.filter(part).write.mode("append").parquet(f"{folder}/in")
        V.run_once(stream(spark.readStream.schema(rows.schema).parquet(f"{folder}/in")), folder, mode)
    return folder


def _log(spark, sf) -> DataFrame:
    """Events as the log of one session for each user."""
    i = F.col("event_id")
    kind = F.create_map(*[F.lit(x) for pair in (("view", "select"), ("click", "answer"), ("purchase", "answer"), ("error", "undo"), ("signup", "collect")) for x in pair])
    return table(spark, sf, "events").select(
        F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("ts"), i.alias("seq"), F.try_element_at(kind, F.col("event_type")).alias("kind"), F.when(i % 7 != 0, i).alias("task"),
        F.when(F.col("event_type") == "signup", F.sequence(i % 50, i % 50 + 9)).otherwise(F.sequence(i % 50, i % 50 + 2)).alias("cards"),
        F.when(F.col("event_type") == "purchase", F.sequence(i % 4, i % 4 + 56, F.lit(4).cast("long"))).otherwise(F.array().cast("array<bigint>")).alias("unknown"),
    )


_PAIR = "STRUCT(task BIGINT, cards BIGINT[])"
_SESSIONS = sql(
    """SELECT session, active, answered, waiting, known, shown, done, total, CASE WHEN active IS NOT NULL THEN 'answer' WHEN ended THEN 'end' WHEN due IS NULL THEN 'collect' WHEN to_do > 0 THEN 'search' WHEN fresh THEN 'end' ELSE 'collect' END AS needs FROM (
SELECT session, active, len(hist) AS answered, len(waiting) AS waiting, len(known) AS known, shown, len(list_filter(list_distinct(goal), lambda c: list_contains(seen, c))) AS done, len(list_distinct(goal)) AS total, ended, due, fresh,
  len(list_filter(due, lambda c: NOT list_contains(known, c) AND (fresh OR NOT list_contains(seen, c)))) AS to_do
FROM (SELECT *, list_distinct(flatten(list_transform(hist, lambda h: h.cards))) AS seen FROM s QUALIFY row_number() OVER (PARTITION BY session ORDER BY n DESC) = 1))""",
    recursive=True,
    e="""SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_type AS kind, CASE WHEN event_id % 7 <> 0 THEN event_id END AS task,
  [event_id % 50, event_id % 50 + 1, event_id % 50 + 2] AS cards, list_transform(generate_series(0, 9), lambda x: x + event_id % 50) AS fresh_cards, event_id % 4 AS k FROM events""",
    s=f"""SELECT DISTINCT session, 0::BIGINT AS n, NULL::BIGINT AS active, []::BIGINT[] AS acards, []::{_PAIR}[] AS hist, []::{_PAIR}[] AS waiting, []::BIGINT[] AS known, 0::BIGINT AS shown, NULL::BIGINT[] AS due, []::BIGINT[] AS goal, false AS goal_set, false AS fresh, false AS ended FROM e
UNION ALL SELECT session, n,
  CASE WHEN asks AND task IS NOT NULL THEN task WHEN answers THEN CASE WHEN len(waiting) > 0 THEN waiting[1].task END WHEN undoes THEN hist[-1].task ELSE active END,
  CASE WHEN asks AND task IS NOT NULL THEN cards WHEN answers THEN CASE WHEN len(waiting) > 0 THEN waiting[1].cards ELSE [] END WHEN undoes THEN hist[-1].cards ELSE acards END,
  CASE WHEN answers THEN list_append(hist, {{'task': active, 'cards': acards}}) WHEN undoes THEN hist[1:len(hist) - 1] ELSE hist END,
  CASE WHEN answers THEN waiting[2:] WHEN undoes AND active IS NOT NULL AND active <> hist[-1].task THEN list_concat([{{'task': active, 'cards': acards}}], waiting) ELSE waiting END,
  CASE WHEN answers THEN list_distinct(list_concat(known, list_filter(acards, lambda c: kind = 'click' OR c % 4 <> k))) WHEN undoes THEN list_filter(known, lambda c: NOT list_contains(hist[-1].cards, c)) ELSE known END,
  shown + CASE WHEN asks AND task IS NOT NULL THEN 1 ELSE 0 END,
  CASE WHEN collects THEN fresh_cards WHEN asks AND task IS NULL AND NOT fresh THEN NULL ELSE due END,
  CASE WHEN collects AND NOT goal_set THEN fresh_cards ELSE goal END, goal_set OR collects,
  CASE WHEN collects THEN true WHEN asks AND task IS NOT NULL THEN false ELSE fresh END,
  CASE WHEN collects THEN false WHEN asks AND task IS NULL AND fresh THEN true ELSE ended END
FROM (SELECT s.* EXCLUDE (n), e.n, e.kind, e.task, e.cards, e.fresh_cards, e.k, e.kind = 'view' AND active IS NULL AS asks, e.kind IN ('click', 'purchase') AND active IS NOT NULL AS answers, e.kind = 'error' AND len(hist) > 0 AS undoes, e.kind = 'signup' AS collects
  FROM s JOIN e ON e.session = s.session AND e.n = s.n + 1)""",
)


@entry(_SESSIONS)
def session_states(spark, sf):
    """Every session's state after its log."""
    return R.sessions(_log(spark, sf))


@entry(_SESSIONS)
def session_states_streamed(spark, sf):
    """The same from a stream of the log."""
    folder = in_two_parts(_log(spark, sf), "ts", "sessions", V.session_stream)
    return V.latest(spark, folder, "session")


@entry(oracle_of("recent_history"))
def recent_history_streamed(spark, sf):
    """Recent sentences of each user from a stream of views."""
    e = table(spark, sf, "events").filter("event_type = 'view'")
    views = e.select(F.col("user_id").alias("owner"), F.rint(F.col("value") * 10).cast("long").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))
    held = V.latest(spark, in_two_parts(views, "ts", "recent", V.recent_stream), "owner")
    return held.select("owner", F.posexplode("ids").alias("at", "id")).select("owner", "id", (F.col("at") + 1).cast("long").alias("place"))


@entry(oracle_of("import_accepted"))
def import_streamed(spark, sf):
    """Accepted sentences of arriving documents; which texts were there before is known by state alone."""
    folder = in_two_parts(raw(spark, sf), "ordinal", "ingest", V.ingest_stream, "append")
    return V.results(spark, folder).select("id", "language", "full_text", "word_count", "quality_flags")
