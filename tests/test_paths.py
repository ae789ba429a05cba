"""Readers and sinks over files, entities and forms against plain versions, answers and sessions."""

import html
import io
import tarfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glosswork import build
from glosswork.functions import html as H
from glosswork.functions import text as T
from glosswork.operators import answers as A
from glosswork.operators import schedule as P
from glosswork.operators import settings as G
from glosswork.sources import readers as R
from glosswork.sources import remote
from glosswork.sources import sinks as W


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(st.lists(st.sampled_from(["&amp;", "&amp", "&ampx", "&#233;", "&#xE9", "&#0;", "&#128;", "&#xD800;", "&#99999999999;", "&#x1F600;", "&notit;", "&nosuch;", "&", "&&lt;;", "&copy2", "é", " ", "<b>", "&#1;", "&#x10FFFF;", "&hellip;", "&CounterClockwiseContourIntegral;"]), max_size=8).map("".join), min_size=100, max_size=100))
def test_entities(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", H.unescape(F.col("t")).alias("u"))
    assert {r.i: r.u for r in df.collect()} == {i: html.unescape(t) for i, t in enumerate(texts)}


def test_forms_with_numbers_inside(spark):
    texts = ["a’²’a", "a--²", "a-²--b", "x²-’y", "Ⅷ-a²", "²", "a-Ⅷ-b", "in²g ’²’"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(T.forms(F.col("t")).alias("f"))
    assert [r.f for r in df.collect()] == [["aa"], ["a"], ["a", "b"], ["x", "y"], ["a"], [], ["ab"], ["ing"]]


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(st.text(alphabet=st.sampled_from("abßÉéñ'’-²Ⅷ5 .,́ﬁçÅ漢"), max_size=30), min_size=200, max_size=200))
def test_forms_of_a_text_are_those_of_its_words(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    each = F.filter(F.transform(T.words(F.col("t")), lambda w: T.form(w)), lambda f: f != "")
    assert df.select("t", T.forms(F.col("t")).alias("a"), each.alias("b")).filter("a <> b").collect() == []


def test_many_files_in_order(spark, tmp_path):
    for i in range(90):
        (tmp_path / f"f{i:03d}.txt").write_text(f"Text {i} begins. It ends here" + (" and is long" * (90 - i)))
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 27))
    try:
        got = R.read_plain(spark, str(tmp_path), "en").orderBy("ordinal").collect()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)
    assert [r.ordinal for r in got] == list(range(180)) and [r.text for r in got[::2]] == [f"Text {i} begins." for i in range(90)]


def test_rows_in_file_order_whatever_their_size(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("eng\tfirst\n")
    (tmp_path / "b.tsv").write_text("".join(f"eng\trow {i}\n" for i in range(5000)))
    got = [r.text for r in R.read_rows(spark, str(tmp_path), "en").orderBy("ordinal").collect()]
    assert got == ["first", *(f"row {i}" for i in range(5000))]


def test_quoted_line_ends_are_found(spark, tmp_path):
    (tmp_path / "q.csv").write_text('eng,"two\nlines, one field",x\neng,plain,y\n')
    assert R.spans_lines(spark, str(tmp_path / "q.csv"))
    assert [r.text for r in R.read_sentences(spark, str(tmp_path / "q.csv")).orderBy("ordinal").collect()] == ["two\nlines, one field", "plain"]


def test_links_in_an_archive(spark, tmp_path):
    with tarfile.open(tmp_path / "links.tar.bz2", "w:bz2") as tar:
        for name, data in (("readme.md", b"1\t2"), ("links.csv", b"3\t4\r\nbad\n5\t6"), ("more.tsv", b"7\t8\n")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    got = R.read_links(spark, str(tmp_path / "links.tar.bz2")).orderBy("link_order").collect()
    assert [tuple(r)[:2] for r in got] == [(3, 4), (5, 6), (7, 8)] and [r.link_order for r in got] == [0, 2, 3]


def test_fetch_is_all_or_nothing(tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x" * 700_000)
    assert len(open(remote.fetch((tmp_path / "a.bin").as_uri(), str(tmp_path / "kept")), "rb").read()) == 700_000
    with pytest.raises(OSError):
        remote.fetch((tmp_path / "none").as_uri(), str(tmp_path / "kept"))
    assert [f.name for f in (tmp_path / "kept").iterdir()] == ["a.bin"]


def test_builder_and_library_upkeep(spark, tmp_path):
    (tmp_path / "de.tsv").write_text("1\tdeu\tDer Regen kommt sehr spaet.\n2\tdeu\tZu kurz\n")
    (tmp_path / "en.tsv").write_text("9\teng\tThe rain comes very late.\n")
    (tmp_path / "links.tsv").write_text("1\t8\n1\t9\n")
    (tmp_path / "forms.tsv").write_text("kam\tkommen\n")
    m = build.build(spark, str(tmp_path / "de.tsv"), str(tmp_path / "lib"), "de", "auto", str(tmp_path / "en.tsv"), "en", str(tmp_path / "links.tsv"), (3, 9), word_forms=[str(tmp_path / "forms.tsv")]).first()
    assert (m.processed, m.inserted, m.skipped) == (2, 1, 1)
    lib = W.open_read_only(spark, str(tmp_path / "lib"))
    row = lib["sentences"].first()
    assert (row.full_text, row.translation, row.source) == ("Der Regen kommt sehr spaet.", "The rain comes very late.", str(tmp_path / "de.tsv"))
    assert lib["word_forms"].filter("form = 'kam' and base = 'kommen'").count() == 1
    with pytest.raises(ValueError):
        build.build(spark, str(tmp_path / "de.tsv"), str(tmp_path / "lib"), natives="x")
    with pytest.raises(ValueError):
        W.drop_library(spark, str(tmp_path))
    W.drop_library(spark, str(tmp_path / "lib"))
    assert not (tmp_path / "lib").exists() and (tmp_path / "de.tsv").exists()
    assert W.add_missing(spark.range(1), {"id": "long", "source": "string"}).columns == ["id", "source"]


def test_deadline(spark):
    assert W.within(spark, 60, lambda: spark.range(10).count()) == 10
    slow = F.udf(lambda x: __import__("time").sleep(30) or x, "long")
    with pytest.raises(TimeoutError):
        W.within(spark, 1, lambda: spark.range(4).select(slow("id")).collect())


def test_log_rotates(tmp_path):
    path = str(tmp_path / "x" / "log.jsonl")
    for i in range(3):
        W.append_log(path, ["a" * 60], most=100)
    assert sum(len(open(f).read()) for f in (path, path + ".1")) == 183


CARDS = "card_id long, ivl long, factor long, due long, lapses long, reps long, left long, type long, queue long, odid long"


def test_answer_paths(spark):
    cards = spark.createDataFrame([(i, 5, 2500, 100, 0, 1, 0, 2, 2, 7 if i == 3 else 0) for i in (1, 2, 3)], CARDS)
    plan = spark.createDataFrame([(1, 3, False), (2, 1, True)], "card_id long, ease int, is_unknown boolean")
    done = A.answer(plan, cards, 100, 1000, 7, lambda asked: cards.join(asked, "card_id"))
    assert done.path == "native" and done.cards.count() == 2
    done = A.answer(plan, cards, 100, 1000, 7)
    assert done.path == "contextual" and {r.card_id: r.ivl for r in done.cards.collect()} == {1: 12, 2: 0} and done.snapshot.count() == 2
    with pytest.raises(A.PartlyAnswered):
        A.answer(plan, cards, 100, 1000, 7, lambda asked: (_ for _ in ()).throw(A.PartlyAnswered("late", [1])))
    for bad in (3, 9):  # in a filtered deck; missing
        with pytest.raises(ValueError):
            A.answer(spark.createDataFrame([(1, 3, False), (bad, 3, False)], plan.schema), cards, 100, 1000, 7)
    taken = spark.createDataFrame([(1_000_001,), (1_000_003,)], "id long")
    assert sorted(r.id for r in P.free_ids(spark.range(4), 1_000_000, taken).collect()) == [1_000_000, 1_000_002, 1_000_004, 1_000_005]


def test_session(spark):
    calls = []

    def collect():
        calls.append(1)
        return spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "card_id long, word string")

    def choose(due, shown, recent):
        sentences = spark.createDataFrame([(10, 1), (11, 2), (12, 3), (13, 3)], "id long, card long")
        ok = sentences.join(due.select(F.col("card_id").alias("card")), "card", "left_semi")
        return (ok.filter(~F.col("id").isin(*shown)) if shown else ok).orderBy("id").limit(1)

    s = A.Session(collect, choose)
    assert s.next().id == 10
    assert s.answered([1], []).id == 11 and s.progress() == (1, 3)
    assert s.answered([], [2]).id == 12  # a forgotten card is hidden until cards are collected anew
    assert s.undo().id == 11 and s.progress() == (1, 3)
    assert s.answered([2], []).id == 12  # the interrupted task comes next
    assert s.answered([], [3]).id == 13 and len(calls) == 2  # collected anew: card 3 is due again
    assert s.answered([3], []) is None and s.progress() == (3, 3) and s.recent == [10, 11, 12, 13]


def test_settings(spark):
    raw = spark.createDataFrame([({"max_due_cards": "-3", "note_types": " A, B;C\n,", "font_size": "x", "require_target_on_question": "off", "search_query": "tag:x", "language": "deu_DE", "ignored_target_words": "a b, c"},), ({},)], "raw map<string,string>")
    a, b = (r.s for r in raw.select(G.normalise(F.col("raw")).alias("s")).collect())
    assert (a.max_due_cards, a.note_types, a.font_size, a.require_target_on_question, a.custom_search_query, a.language, a.ignored_target_words) == (20, ["A", "B", "C"], 34, False, "tag:x", "de", ["a", "b", "c"])
    assert (b.min_sentence_words, b.max_sentence_words, b.known_ease, b.custom_search_query, b.target_field) == (4, 15, 3, "is:due", "Front")
