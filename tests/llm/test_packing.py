import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from glosswork.llm.packing import Packer, pack
from glosswork.llm.subwords import SubwordIds

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN, OURS = Tokenizer.from_file(PATH), SubwordIds(PATH)


@given(st.text(alphabet=st.sampled_from("ab Zé漢\n\t\x85\xa0 .,'19_😀")))
def test_fast_ids_are_the_tokenizers(text):
    assert OURS.ids(text).tolist() == PLAIN.encode(text, add_special_tokens=False).ids


def test_other_ways():
    for t in ("foo <|endoftext|> bar<|endoftext|>", "x" * 5000, " " * 3000 + "a", "\n" * 3000, "it's we'll  's"):
        assert OURS.ids(t).tolist() == PLAIN.encode(t, add_special_tokens=False).ids


def test_tables_ids(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for t, e in zip(texts, PLAIN.encode_batch(texts, add_special_tokens=False)):
        assert OURS.ids(t).tolist() == e.ids


@given(st.lists(st.integers(1, 200), max_size=80))
def test_a_worker_loses_no_id_and_pads_one_sequence(lengths):
    packer, got = Packer(64, 16), []
    for i, n in enumerate(lengths):
        got += packer.add(i, np.arange(n) + 1000 * i)
    got += packer.end()
    assert sorted(x for _, _, ids, _, _ in got for x in ids.tolist()) == sorted(1000 * i + x for i, n in enumerate(lengths) for x in range(n))
    assert all((ids == 1000 * doc + start + np.arange(len(ids))).all() for doc, start, ids, _, _ in got)
    fill = defaultdict(int)
    for _, _, ids, number, offset in got:
        assert offset == fill[number]
        fill[number] += len(ids)
    assert sum(n < 64 for n in fill.values()) <= 1 and all(n <= 64 for n in fill.values())


def test_bins_hold_as_many_documents_as_their_class_says():
    packer = Packer(60, 16)
    assert [list(packer.add(i, np.zeros(15))) for i in range(3)] == [[], [], []]
    assert [(d, n) for d, _, _, n, _ in packer.add(3, np.zeros(15))] == [(0, 0), (1, 0), (2, 0), (3, 0)]  # four quarters
    assert list(packer.add(4, np.zeros(22))) == [] and list(packer.add(5, np.zeros(25))) == []  # two halves, with room for 13
    assert [(d, s, len(x), o) for d, s, x, _, o in packer.add(6, np.zeros(40))] == [(4, 0, 22, 0), (5, 0, 25, 22), (6, 0, 13, 47)]
    assert packer.open[2].held[0][:2] == (6, 13)  # what is left of 6 is of class 2


def verify(df, rows):
    texts = defaultdict(list)
    for r in df.select("doc_id", df["text"]).collect() if df.columns.count("TEXT") == 0 else [(x[0], x[1]) for x in df.collect()]:
        ids = np.array(PLAIN.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4")
        texts[r[0]].append(ids)
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == texts.keys()
    for k, docs in texts.items():
        assert sum(len(ids) for ids in docs) == sum(r.length for r in pieces[k])
        if len(docs) == 1:
            at = 0
            for r in sorted(pieces[k], key=lambda r: r.start):
                assert r.start == at and r.ids_crc32 == zlib.crc32(docs[0][at : at + r.length].tobytes()) and r.doc_tokens == len(docs[0])
                at += r.length
        else:
            of = {(r.start, r.length, r.ids_crc32) for r in pieces[k]}
            assert of <= {(a, n, zlib.crc32(ids[a : a + n].tobytes())) for ids in docs for a, n, _ in of if a + n <= len(ids)}
    padding = 0
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding, sum(r.length for r in rows)


def test_pack(small):
    padding, tokens = verify(small, pack(small).collect())
    assert padding < 0.01 * tokens


def test_odd_rows(weird, nothing):
    verify(weird, pack(weird).collect())
    assert pack(nothing).count() == 0
