import pytest
from pyspark.sql import functions as F

from glosswork.functions import scheduling as S
from glosswork.operators import cards as C
from glosswork.operators import corpus as K
from glosswork.operators import ingest as I
from glosswork.operators import schedule as P
from glosswork.operators import selection as Q
from glosswork.operators import sessions as E
from glosswork.operators import setup as U
from glosswork.sources import readers, sinks

DUE = "card_id long, target_word string, lemma string, word_form string, match_key string, definition string, interval long, factor long, overdue double, due_in_days long, priority double"


def due(spark, *rows):
    return spark.createDataFrame([(c, w, w, w, w, "", 5, 2500, 0.0, 0, p) for c, w, p in rows], DUE)


def corpus(spark, *texts):
    rows = spark.createDataFrame([(i + 1, "en", t, None, None) for i, t in enumerate(texts)], "id long, language string, full_text string, translation string, quality_flags string")
    from glosswork.functions import text as T

    return rows.withColumn("word_count", T.count_words(F.col("full_text"), F.col("language")))


def pick(spark, texts, targets, pairs=None, **how):
    s = corpus(spark, *texts)
    forms = K.sentence_forms(s)
    pairs = spark.createDataFrame(pairs, "form string, base string") if pairs else None
    d = Q.due_keys(due(spark, *targets), pairs)
    x = Q.expansions(d, pairs)
    rows = Q.candidates(s, forms, K.postings(forms), K.index_stats(forms), d, x, "en", limit=50, **how)
    return rows, d, x


def test_coverage_then_priority(spark):
    rows, *_ = pick(spark, ["We review daily.", "We review word cards."], [(1, "review", 10.0), (2, "word", 10.0)])
    assert Q.select_task(rows).first().id == 2
    rows, *_ = pick(spark, ["Review now.", "Learn word cards."], [(1, "review", 1.0), (1, "word", 9.0)])
    assert Q.select_task(rows).first().id == 2


def test_shown_and_avoided(spark):
    texts, d = ["One review sentence.", "Two review examples."], [(1, "review", 10.0)]
    assert Q.select_task(pick(spark, texts, d, shown=[1])[0]).first().id == 2
    rows = pick(spark, texts, d)[0]
    assert Q.select_task(rows, [1]).first().id == 2 and Q.select_task(rows, [1, 2]).first().id == 1


def test_families_and_prefixes(spark):
    rows, d, x = pick(spark, ["She went, home."], [(12345, "go", 10.0)], [("went", "go")])
    token = Q.annotate(rows, x, d, "en", "lemma_family").filter("is_target").first()
    assert (token.text, token.match_key, token.card_ids) == ("went", "go", [12345])
    rows, d, x = pick(spark, ["Computing feels useful."], [(7, "comput", 10.0)], [("home", "home")])
    assert x.first().prefix == "comput" and rows.count() == 1
    rows, *_ = pick(spark, ["They ran outside."], [(9, "run", 10.0)], [("ran", "run"), ("run", "run")])
    assert rows.count() == 1
    assert pick(spark, ["Ich sehe Hunde.", "Der Hund schlaft."], [(1, "hund", 1.0)])[0].first().id == 2


def test_modes_agree_on_small_libraries(spark):
    texts = [f"w{i} review and word{i % 7} go" for i in range(60)]
    d = [(1, "review", 1.0), (2, "word3", 2.0), (3, "go", 0.5)]
    a = {(r.id, round(r.bm25, 9), r.score) for r in pick(spark, texts, d)[0].collect()}
    b = {(r.id, round(r.bm25, 9), r.score) for r in pick(spark, texts, d, mode="exhaustive")[0].collect()}
    assert a == b


def test_scripts_without_spaces(spark):
    s = spark.createDataFrame([(1, "ja", "猫が魚を食べる。", None, 3)], "id long, language string, full_text string, translation string, word_count int")
    forms = K.sentence_forms(s)
    d = Q.due_keys(due(spark, (88, "食べる", 10.0)))
    rows = Q.candidates(s, forms, K.postings(forms), K.index_stats(forms), d, Q.expansions(d), "ja", unsegmented=True)
    assert rows.first().keys == ["食べる"]
    found = Q.occurrences(spark.createDataFrame([(1, "baaa"), (2, None)], "id long, full_text string"), ["aa", "ba", ""]).collect()
    assert [(r.start, r.end, r.form) for r in found] == [(0, 2, "ba")]


def test_import_rules(spark):
    rows = spark.createDataFrame([(1, "de", "Der Regen kommt heute spaet.", None), (2, "de", "der  Regen kommt heute spaet.", None), (3, "de", "Mehr unter https://example.com bitte schauen.", None), (4, "de", " ", None), (5, "de", "Kurz.", None)], "ordinal long, language string, text string, translation string")
    got = {r.ordinal: r.skip_reason for r in I.judge(rows).collect()}
    assert got == {1: None, 2: "duplicate", 3: "quality", 4: "empty", 5: "word_count"}
    m = I.import_metrics(I.judge(rows), 1).first()
    assert (m.processed, m.inserted, m.skipped, m.limit_reached) == (1, 1, 0, True)


def test_pairing(spark):
    t = spark.createDataFrame([(1, "de", "Der Regen kommt spaet."), (2, "de", "Ganz allein hier.")], "id long, language string, text string")
    n = spark.createDataFrame([(10, "en", "The rain comes late."), (11, "en", "Examples are useful.")], "id long, language string, text string")
    links = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (10, 1, 2)], "source_id long, translation_id long, link_order long")
    assert {r.id: r.translation for r in I.pair_translations(t, n, links).collect()} == {1: "The rain comes late.", 2: None}


def test_query_text():
    deck = C.deck_scope("current", "Vocabulary")
    assert C.due_query("is:due", True, False, deck) == '(is:due) -is:new deck:"Vocabulary"'
    assert C.due_query("is:due -card:Reverse", True, True, deck) == '((is:due -card:Reverse) OR (is:new -card:Reverse)) deck:"Vocabulary"'
    assert C.future_query("is:due -card:2 -card:3 -card:Reverse", 3, deck) == '(prop:due<=3 -card:2 -card:3 -card:Reverse) -is:new deck:"Vocabulary"'
    assert C.future_query('is:due deck:"Spanish Vocabulary" -tag:"hard words"', 3, "") == '(prop:due<=3 deck:"Spanish Vocabulary" -tag:"hard words") -is:new'
    assert C.due_query("", False, False, "") == "nid:0"
    with pytest.raises(ValueError):
        C.predicate("is:odd", 1, {c: F.lit(1) for c in ("queue", "type", "due")})


def test_limits_by_card(spark):
    rows = due(spark, (1, "first", 12.0), (1, "second", 12.0), (2, "third", 10.0), (3, "fourth", 9.0))
    assert sorted(r.card_id for r in C.limit_cards(rows, 2).collect()) == [1, 1, 2]


def test_answer_plan(spark):
    m = spark.createDataFrame([("review", [10]), ("word", [10, 20])], "key string, card_ids array<long>")
    got = {r.card_id: (r.ease, r.keys, r.is_unknown) for r in P.answer_plan(m, ["word"]).collect()}
    assert got == {10: (1, ["review", "word"], True), 20: (1, ["word"], True)}
    assert P.answer_plan(m, [], ["10"]).filter("is_unknown").first().card_id == 10


def test_step_log_and_undo(spark):
    cards = spark.createDataFrame([(10, 2500, 5, 100, 2, 0, 2, 0, 0, True), (20, 2500, 5, 100, 2, 0, 2, 0, 0, False)], "card_id long, factor long, ivl long, due long, queue long, left long, type long, lapses long, reps long, is_unknown boolean")
    s = P.step(cards, 100, 1000, 7)
    got = {r.card_id: r for r in s.collect()}
    assert (got[10].type, got[10].queue, got[10].ivl, got[10].left, got[10].lapses, got[10].factor) == (3, 1, 0, 1001, 1, 2300)
    assert (got[20].ivl, got[20].due, got[20].type) == (12, 112, 2)
    assert [r.id for r in P.log_rows(s, 1000, spark.createDataFrame([(1_000_000,)], "id long")).orderBy("cid").collect()] == [1_000_001, 1_000_002]
    names = ["card_id", "factor", "ivl", "due", "queue", "left", "type", "lapses", "reps"]
    back = P.restore(s.select(*[F.col(n).cast("long") for n in names]), P.undo(s))
    assert {(r.card_id, r.ivl, r.lapses, r.due) for r in back.collect()} == {(10, 5, 0, 100), (20, 5, 0, 100)}


def test_half_even_intervals(spark):
    got = spark.createDataFrame([(1, 2500), (5, 1300), (0, 0)], "i long, f long").select(S.next_interval(F.col("i"), F.col("f")).alias("n"))
    assert [r.n for r in got.collect()] == [2, 6, 2]


def test_sessions(spark):
    e = spark.createDataFrame([("a", 1, 1, 1), ("a", 2, 2, 2), ("a", 3, 3, 3), ("a", 1, 4, 4)], "owner string, id long, ts long, seq long")
    assert [r.id for r in E.recent(e, 3).orderBy("place").collect()] == [2, 3, 1]
    s = spark.createDataFrame([("a", 2, 1), ("a", 2, 0)], "owner string, answered long, unknown long")
    assert E.session_summary(s).first().text == "Reviewed 4 cards across 2 sentences. Remembered: 3. Forgotten: 1."
    p = E.today_progress(spark.createDataFrame([(10,), (99,), (20,)], "card_id long"), spark.createDataFrame([(10,), (20,), (30,)], "card_id long")).first()
    assert (p.done, p.total) == (2, 3)
    c = spark.createDataFrame([("old", 0, 5), ("x", 1_000_000, 60), ("y", 1_000_001, 60)], "name string, used_at long, size long")
    assert sorted(r.name for r in E.evict(c, 1_000_002, 7 * 86400, 100).collect()) == ["old", "x"]


def test_setup(spark):
    assert U.question_aliases("Plain Word", ["Word", "Plain Word"]) == {"plain word", "word"}
    s = corpus(spark, "A good example sentence.")
    row = U.library_check(s, K.sentence_forms(s).limit(0), K.word_forms(s), "en").first()
    assert row.status == "warning" and row.detail == "1 sentences, 0 in the index"
    assert U.library_check(s, K.sentence_forms(s), K.word_forms(s), "en").first().status == "ok"
    assert U.library_check(s, None, K.word_forms(s), "en").first()[1:] == ("error", "missing table(s): forms")
    assert U.library_check(s.limit(0), K.sentence_forms(s).limit(0), K.word_forms(s), "en").first().detail == "no sentences"
    assert U.library_check(s, K.sentence_forms(s), K.word_forms(s), "de").first().detail == "1 sentences, none of language de"


def test_readers(spark, tmp_path):
    import bz2
    import io
    import tarfile

    f = tmp_path / "a.tsv.bz2"
    f.write_bytes(bz2.compress("1\tdeu\tDer Regen kommt spaet.\tThe rain comes late.\n42\tTwo cats sleep.\n\"quo\"\"ted\"\tx\n42\n".encode()))
    got = [(r.language, r.text, r.translation) for r in readers.read_sentences(spark, str(f)).orderBy("ordinal").collect()]
    assert got == [("de", "Der Regen kommt spaet.", "The rain comes late."), ("en", "Two cats sleep.", None), ("en", 'quo"ted', "x")]
    p = tmp_path / "b.txt"
    p.write_text("﻿猫が魚を食べる。犬が走っている。\n", encoding="utf-8")
    assert [r.text for r in readers.read_sentences(spark, str(p), "ja").orderBy("ordinal").collect()] == ["猫が魚を食べる。", "犬が走っている。"]
    t = tmp_path / "c.srt"
    t.write_text("1\n00:01 --> 00:02\n<i>Hello</i>\nthere. Bye.\n")
    assert [r.text for r in readers.read_sentences(spark, str(t)).orderBy("ordinal").collect()] == ["Hello there.", "Bye."]
    w = tmp_path / "w.csv"
    w.write_text("# note\nwent,go.\nrun\n\n")
    assert sorted((r.form, r.base) for r in readers.read_word_forms(spark, str(w)).collect()) == [("run", "run"), ("went", "go")]
    data = b"1\t10\nx\t2\n1\t11\n"
    with tarfile.open(tmp_path / "links.tar.bz2", "w:bz2") as tar:
        info = tarfile.TarInfo("links.csv")
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))
    assert [(r.source_id, r.translation_id) for r in readers.read_links(spark, str(tmp_path / "links.tar.bz2")).orderBy("link_order").collect()] == [(1, 10), (1, 11)]


def test_versions(spark, tmp_path):
    s = corpus(spark, "A good example sentence.")
    tables = {"sentences": s, "forms": K.sentence_forms(s), "word_forms": K.word_forms(s)}
    for v in ("v1", "v2"):
        sinks.replace_library(tables, str(tmp_path), v)
    assert sinks.open_library(spark, str(tmp_path))["sentences"].count() == 1
    assert (tmp_path / "versions/v1/forms").exists()


def test_streams_equal_batches(spark, tmp_path):
    from glosswork.streaming import streams

    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame([(1, "One good example here. one Good example here.", "en"), (2, "Another good example here. One good example here.", "en"), (3, "Short. Another good example here. A third good example.", "en")], schema)
    src, folder = str(tmp_path / "in"), f"file://{tmp_path}/ingest"
    for part in ("doc_id < 3", "doc_id < 2", "doc_id > 1"):  # what came before comes again
        docs.filter(part).write.mode("append").parquet(src)
        streams.run_once(streams.ingest_stream(I.split_documents(spark.readStream.schema(schema).parquet(src))), folder, "append")
    names = ["id", "full_text", "word_count", "quality_flags"]
    want = I.accepted(I.judge(I.split_documents(docs))).select(names).collect()
    assert sorted(map(tuple, streams.results(spark, folder).select(names).collect())) == sorted(map(tuple, want)) and len(want) == 3

    answers = spark.createDataFrame([(c, t, t, (c * t) % 3 == 0) for c in (1, 2, 3) for t in range(1, 8)], "card_id long, ts long, seq long, is_unknown boolean")
    answers.write.parquet(str(tmp_path / "answers"))
    live = streams.review_stream(spark.readStream.schema(answers.schema).parquet(str(tmp_path / "answers")))
    q = live.writeStream.format("memory").queryName("cards_live").outputMode("update").option("checkpointLocation", str(tmp_path / "ck2")).start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("cards_live").collect()}
    cards = spark.createDataFrame([(c, 1, 2500, 0, 0, True) for c in (1, 2, 3)], "card_id long, ivl long, factor long, lapses long, reps long, review boolean")
    assert got == {(r.card_id, r.ivl, r.factor, r.lapses, r.reps, r.review) for r in P.replay(cards, answers).collect()}
