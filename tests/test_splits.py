"""Files that are read in many small blocks give the rows that they give as wholes."""

import bz2
import csv
import io
import random
import re
from contextlib import contextmanager

import pytest

from glosswork.sources import readers as R


@contextmanager
def blocks_of(spark, size):
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    old = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in old.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def plain_sentences(text):
    joined = re.sub(r"[ \t\n\x0b\f\r]*[\r\n]+[ \t\n\x0b\f\r]*", " ", text.removeprefix("﻿"))
    return [s.strip() for s in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+|(?<=[。！？])[ \t\n\x0b\f\r]*", joined) if s.strip()]


def running(rng, lines):
    words = ["one", "two.", "three!", "four?", "猫。", "犬！水", "a.b", "…", "“so.”", "　", "ends."]
    return "\n".join(rng.choice(["", "  ", " ".join(rng.choice(words) for _ in range(rng.randrange(9)))]) for _ in range(lines))


@pytest.mark.parametrize("size", [64, 700, 1 << 20])
def test_running_text(spark, tmp_path, size):
    rng = random.Random(size)
    texts = ["﻿" + running(rng, 120), "no end at all " * 200, running(rng, 60) + " last words", "", "\n\n"]
    for i, t in enumerate(texts):
        (tmp_path / f"{i}.txt").write_text(t, encoding="utf-8")
    with blocks_of(spark, size):
        df = R.read_plain(spark, str(tmp_path), "en")
        got = df.orderBy("ordinal").collect()
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > (20 if size == 64 else 0)
    assert [r.text for r in got] == [s for t in texts for s in plain_sentences(t)]
    assert len({r.ordinal for r in got}) == len(got)


def test_compressed_text_that_can_be_split(spark, tmp_path):
    text = "\n".join(f"Sentence {i} is here. This one, {random.Random(i).random()},\nruns on to {i}" for i in range(30_000))
    (tmp_path / "t.txt.bz2").write_bytes(bz2.compress(text.encode(), 1))
    with blocks_of(spark, 60_000):
        df = R.read_sentences(spark, str(tmp_path / "t.txt.bz2"))
        assert spark.read.text(str(tmp_path / "t.txt.bz2")).rdd.getNumPartitions() > 3
        got = [r.text for r in df.orderBy("ordinal").collect()]
    assert got == plain_sentences(text)


def test_subtitles(spark, tmp_path):
    rng = random.Random(4)
    said = [running(rng, 3) for _ in range(150)]
    film = "\n\n".join(f"{i}\n00:00:01,000 --> 00:00:02,000\n<i>{t}</i>" for i, t in enumerate(said))
    (tmp_path / "film.srt").write_text(film, encoding="utf-8")
    lines = [x.strip(" ") for x in film.split("\n")]
    want = plain_sentences("\n".join(re.sub("<[^>]*>", "", x) for x in lines if x and not x.isdigit() and "-->" not in x))
    for size in (200, 1 << 20):
        with blocks_of(spark, size):
            assert [r.text for r in R.read_sentences(spark, str(tmp_path / "film.srt")).orderBy("ordinal").collect()] == want


@pytest.mark.parametrize("size", [50, 333, 1 << 20])
@pytest.mark.parametrize("sep", [",", "\t"])
def test_quoted_fields_over_lines_and_blocks(spark, tmp_path, size, sep):
    rng = random.Random(size)
    cell = lambda i: rng.choice(["plain", 'said "so"', f"two\nlines {i}", 'a "quote\n\nand" more', "x" * 90 + "\n" + "y" * 90, f"with {sep} inside", 'odd " quote', "", "end"])
    rows = [["eng", f"{i}: {cell(i)}", cell(i) or "z"] for i in range(200)]
    out = io.StringIO()
    csv.writer(out, delimiter=sep, lineterminator="\n").writerows(rows)
    text = out.getvalue() + '\neng' + sep + 'five 5" pipes' + sep + "z\n"
    name = tmp_path / ("q.csv" if sep == "," else "q.tsv")
    name.write_text(text, encoding="utf-8")
    want = [(r[1].strip(), r[2].strip()) for r in csv.reader(io.StringIO(text), delimiter=sep) if r]
    with blocks_of(spark, size):
        got = R.read_sentences(spark, str(name)).orderBy("ordinal").collect()
    assert [(r.text, r.translation) for r in got] == want and [r.ordinal for r in got] == list(range(len(want)))
