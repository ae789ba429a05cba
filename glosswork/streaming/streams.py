"""Incremental forms of ingest, recency, sessions and review; batch and stream give the same result.

State is kept by key in Spark's state store and holds what a key needs alone: that a text was seen, a learner's recent
sentences, a session's lists, a card's schedule. ``run_once`` feeds what has arrived and ends; started again on the
same folder it goes on from its state.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glosswork.functions import text as T
from glosswork.operators import ingest
from glosswork.operators import replay as R


#: Where the session names no state store: one that keeps its rows on disk, within so many MB of an executor's memory.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = {
    PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "400",
}


def _in_mode(mode: str, stream: DataFrame) -> DataFrame:
    stream.output_mode = mode
    return stream


def run_once(stream: DataFrame, folder: str, mode: str = "update") -> None:
    """Takes in all that has arrived and adds what comes out under ``folder``/out, each batch once, with its number as ``epoch``.
    A stream that says what mode it has runs in that one."""
    mode = getattr(stream, "output_mode", mode)

    def add(batch: DataFrame, epoch: int) -> None:
        # a batch that is repeated after a failure replaces itself
        batch.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")

    spark = stream.sparkSession
    ours = {} if spark.conf.get(PROVIDER, None) else {k: v for k, v in ON_DISK.items() if spark.conf.get(k, None) is None}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:  # a query that goes on keeps the store that it began with
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(add).trigger(availableNow=True).start()
    finally:
        for k in ours:
            spark.conf.unset(k)
    query.awaitTermination()


def results(spark: SparkSession, folder: str) -> DataFrame:
    """All that came out, with ``epoch``."""
    return spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")


def latest(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """What came out last for each key."""
    out = results(spark, folder)
    names = [c for c in out.columns if c not in (key, "epoch")]
    return out.groupBy(key).agg(F.max_by(F.struct(*names), "epoch").alias("r")).select(key, "r.*")


# ---- ingest


def first_texts(rows: DataFrame) -> DataFrame:
    """Of arriving rows (ordinal, language, text, translation), the first of each text: duplicates are known by the state
    store alone, whatever the library holds.

    A text's state is its first row and the times of the first and the last batch that had it; it is new where these
    are one. Each batch shows every text that it has, so this is a stream in mode ``update``.
    """
    cleaned = rows.withColumn("text", T.clean(F.col("text"))).withColumn("translation", F.nullif(T.clean(F.col("translation")), F.lit("")))
    stamped = cleaned.select(F.unhex(F.md5(F.concat_ws("\0", "language", ingest.text_key(F.col("text"))))).alias("key"), F.struct("ordinal", "language", "text", "translation").alias("row"), F.current_timestamp().alias("at"))
    held = stamped.groupBy("key").agg(F.min("row").alias("row"), F.min("at").alias("first"), F.max("at").alias("last"))
    return _in_mode("update", held.filter("first = last").select("row.*"))


def ingest_stream(rows: DataFrame, min_words: int = 4, max_words: int = 15, strict: bool = True) -> DataFrame:
    """Accepted sentences of arriving rows, as ``ingest.accepted`` of ``ingest.judge`` gives them if rows arrive in order."""
    return _in_mode("update", ingest.accepted(ingest.fit(first_texts(rows), min_words, max_words, strict)))


# ---- what a learner has seen


def _recent_of(keep: int):
    def step(key, frames, state: GroupState):
        import pandas as pd

        held = {i: (at, n) for i, at, n in json.loads(state.get[0])} if state.exists else {}
        for frame in frames:
            for id_, at, n in zip(frame["id"].tolist(), frame["at"].tolist(), frame["seq"].tolist()):
                held[id_] = max(held.get(id_, (at, n)), (at, n))
        order = sorted(held.items(), key=lambda x: (x[1], x[0]))[-keep:]
        state.update((json.dumps([[i, *x] for i, x in order]),))
        yield pd.DataFrame({"owner": [key[0]], "ids": [[i for i, _ in order]]})

    return step


def recent_stream(events: DataFrame, keep: int = 200, lateness: str = "30 days") -> DataFrame:
    """(owner, ids) after each batch: the last ``keep`` distinct ids of events (owner, id, ts, seq), oldest first.

    A key's state is these ids with their last time, which is enough for any later event. Events that are later than
    ``lateness`` behind the latest one are left out, by the watermark.
    """
    own = events.filter("id > 0").withWatermark("ts", lateness).select("owner", "id", "ts", F.unix_micros("ts").alias("at"), "seq")
    return own.groupBy("owner").applyInPandasWithState(_recent_of(keep), "owner long, ids array<long>", "held string", "update", GroupStateTimeout.EventTimeTimeout)


def _place(row: dict) -> tuple:
    """Order of a session's rows, as a sort of the log has it: what is null comes first."""
    ts, seq = row["ts"], row["seq"]
    return ts is not None, ts or 0, seq is not None, seq or 0


def _session_step(key, frames, state: GroupState):
    import pandas as pd

    held = json.loads(state.get[0]) if state.exists else R.begin()
    rows = [r for frame in frames for r in json.loads(f"[{','.join(frame['row'])}]")]
    for r in sorted(rows, key=_place):
        R.advance(held, r["kind"], r["task"], r["cards"] or [], r["unknown"] or [])
    state.update((json.dumps(held),))
    yield pd.DataFrame({"row": [json.dumps(R.shown_state(None if pd.isna(key[0]) else int(key[0]), held))]})


def session_stream(log: DataFrame) -> DataFrame:
    """``replay.sessions`` of an arriving log: each session's state after each batch.

    A row of the log goes to its session as one string, and a state comes back as one: columns of their own, lists and
    times above all, would be turned into a frame anew for every session of every batch, which costs more than the step.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp")) if log.schema["ts"].dataType.typeName().startswith("timestamp") else F.col("ts")
    row = F.to_json(F.struct(at.alias("ts"), "seq", "kind", "task", "cards", "unknown"), {"ignoreNullFields": "false"})
    made = log.select("session", row.alias("row")).groupBy("session").applyInPandasWithState(_session_step, "row string", "held string", "update", GroupStateTimeout.NoTimeout)
    fields = F.from_json("row", "array<string>").alias("x")
    return made.select(fields).select(*[F.col("x")[i].cast(c.split()[1]).alias(c.split()[0]) for i, c in enumerate(R.STATE.split(", "))])


def recent_counts(events: DataFrame, lateness: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Answers by window and kind, late ones up to ``lateness`` included."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def review_stream(answers: DataFrame, start: Callable[[int], tuple[int, int, int, int, bool]] = lambda card: (1, 2500, 0, 0, True)) -> DataFrame:
    """Card states after each batch of answers (card_id, ts, seq, is_unknown), kept by card: the scheduler's step as a fold."""
    import pandas as pd

    def step(key, batches, state: GroupState):
        held = tuple(state.get if state.exists else start(int(key[0])))
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"], kind="stable")
        for unknown in rows["is_unknown"]:
            held = R.card_step(*held, bool(unknown))
        state.update(held)
        yield pd.DataFrame([(key[0], *held)], columns=["card_id", "ivl", "factor", "lapses", "reps", "review"])

    schema = "card_id long, ivl long, factor long, lapses long, reps long, review boolean"
    kept = "ivl long, factor long, lapses long, reps long, review boolean"
    return answers.groupBy("card_id").applyInPandasWithState(step, schema, kept, "update", GroupStateTimeout.NoTimeout)


# what workers run of this module travels with its data, so they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
