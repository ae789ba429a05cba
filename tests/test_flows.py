"""Logs folded as data against a session that is played step by step, streams against batches, and tables that change."""

import random

from pyspark.sql import functions as F

from glosswork.operators import answers as A
from glosswork.operators import ingest as I
from glosswork.operators import replay as R
from glosswork.plans import catalog
from glosswork.sources import sinks as W
from glosswork.streaming import streams as V

SCHEMA = "session long, ts long, seq long, kind string, task long, cards array<long>, unknown array<long>"


def played(spark, rng, session, steps):
    """A session as a learner plays it with ``answers.Session``, its log, and what it holds in the end."""
    due = [[rng.randrange(20) for _ in range(4)] for _ in range(6)]
    log, state = [], {"collected": 0, "tasks": 0}

    def note(kind, task=None, cards=(), unknown=()):
        log.append((session, len(log) // 3, len(log), kind, task, sorted(set(cards)), list(unknown)))

    def collect():
        cards = due[state["collected"] % len(due)]
        state["collected"] += 1
        note("collect", cards=cards)
        return spark.createDataFrame([(c,) for c in cards], "card_id long")

    def choose(left, shown, recent):
        cards = sorted({r.card_id for r in left.collect()})[:2]
        state["tasks"] += 1
        if state["tasks"] % 5 == 0:
            note("select")
            return spark.createDataFrame([], "id long, card_ids array<long>")
        note("select", state["tasks"], cards)
        return spark.createDataFrame([(state["tasks"], cards)], "id long, card_ids array<long>")

    s = A.Session(collect, choose)
    s.next()
    for _ in range(steps):
        if s.active is not None and rng.random() < 0.7:
            unknown = [c for c in s.active.card_ids if rng.random() < 0.4]
            note("answer", unknown=unknown)
            s.answered([c for c in s.active.card_ids if c not in unknown], unknown)
        elif s.history:
            note("undo")
            s.undo()
    done, total = s.progress()
    return log, (session, s.active.id if s.active else None, len(s.history), len(s.waiting), len(s.known), len(s.shown), done, total)


def test_sessions_from_their_logs(spark):
    rng = random.Random(6)
    logs, want = zip(*(played(spark, rng, i, 9) for i in range(4)))
    rows = [r for log in logs for r in log]
    rng.shuffle(rows)
    got = R.sessions(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(tuple(r)[:8] for r in got) == sorted(want)
    assert all((r.needs == "answer") == (r.active is not None) for r in got)


def test_a_stream_goes_on_from_its_state(spark):
    rng = random.Random(9)
    kinds = ["select"] * 3 + ["answer"] * 3 + ["undo", "collect"]
    rows = [(i % 5, i // 2, i, rng.choice(kinds), None if rng.random() < 0.2 else i, rng.sample(range(9), 3), rng.sample(range(9), 4)) for i in range(400)] + [(9, 0, 1, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    folder = W.lasting_folder(spark, "test")
    for part in ("seq < 100", "seq between 100 and 300", "seq > 300"):
        df.filter(part).write.mode("append").parquet(f"{folder}/in")
        V.run_once(V.session_stream(spark.readStream.schema(df.schema).parquet(f"{folder}/in")), folder)
    whole = R.sessions(df)
    assert sorted(map(tuple, V.latest(spark, folder, "session").select(whole.columns).collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)


def test_a_streamed_session_is_that_of_the_batch_on_odd_rows(spark):
    big = (1 << 53) + 1  # no double holds it
    rows = [
        (1, None, 2, "collect", None, [1, 2], None), (1, 5, 3, "select", big, [1], None), (1, 5, None, "undo", None, None, None), (1, 6, 4, 'no "kind"', None, [3], [3]),
        (None, 1, 1, "collect", None, [4], []), (None, 2, 2, "select", 7, [4], []), (2, 1, 1, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("ts"))
    folder = W.lasting_folder(spark, "test")
    df.write.parquet(f"{folder}/in")
    live = V.session_stream(spark.readStream.schema(df.schema).parquet(f"{folder}/in"))
    assert live.schema == R.sessions(df).schema
    V.run_once(live, folder)
    whole = R.sessions(df)
    got = V.results(spark, folder).select(whole.columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, whole.collect()), key=str)
    assert {r.active for r in got} == {None, 7, big}


def test_recent_ids_as_a_stream(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(3), rng.randrange(1, 30), 1_700_000_000 + rng.randrange(5000), i) for i in range(900)]
    df = spark.createDataFrame(rows, "owner long, id long, at long, seq long").selectExpr("owner", "id", "timestamp_seconds(at) as ts", "seq")
    folder = W.lasting_folder(spark, "test")
    for part in ("seq < 500", "seq >= 500"):  # times go back and forth between the parts
        df.filter(part).write.mode("append").parquet(f"{folder}/in")
        V.run_once(V.recent_stream(spark.readStream.schema(df.schema).parquet(f"{folder}/in"), keep=7), folder)
    latest = {}
    for owner, id_, at, seq in rows:
        latest.setdefault(owner, {})[id_] = max(latest.get(owner, {}).get(id_, (0, 0)), (at, seq))
    want = {o: [i for i, _ in sorted(x.items(), key=lambda p: (p[1], p[0]))[-7:]] for o, x in latest.items()}
    assert {r.owner: r.ids for r in V.latest(spark, folder, "owner").collect()} == want


def test_changed_tables_are_read_anew(spark, tmp_path):
    for n in (1, 2):
        docs = [(i, f"One plain sentence number {'abc'[i]} is here.", "en") for i in range(n)]
        spark.createDataFrame(docs, "doc_id long, text string, lang string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        assert catalog.queries()["language_counts"](spark, str(tmp_path)).first().sentences == n


def test_a_streamed_import_needs_no_python_for_each_text(spark, tmp_path):
    docs = [(i, f"One plain sentence number {'abcdefg'[i % 7]} is here. ONE plain sentence is here.", "en") for i in range(40)]
    rows = I.split_documents(spark.createDataFrame(docs, "doc_id long, text string, lang string")).repartition(5)
    rows.write.parquet(f"{tmp_path}/in")
    live = V.ingest_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    assert "Pandas" not in live._jdf.queryExecution().analyzed().toString()
    V.run_once(live, f"file://{tmp_path}/out")
    want = I.accept(rows).select("id", "full_text")  # the least ordinal of a batch, in whatever order its rows are read
    assert sorted(map(tuple, V.results(spark, f"file://{tmp_path}/out").select("id", "full_text").collect())) == sorted(map(tuple, want.collect()))
