import re
from collections import Counter, defaultdict

import corpus_pipeline
from glosswork.llm import toxicity
from glosswork.llm.common import documents
from tests.llm.test_jaccard import brute
from tests.llm.test_mixing import WORD, water
from tests.llm.test_packing import verify

SF = "/root/testdata/sf0.001"


def stages(spark, docs, sf=SF):
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(f(spark, out[-1], sf).cache())
    return out


def test_each_stage_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    raw, clean, unique, redacted, mixed, packed = stages(spark, docs)
    for df in (clean, unique, redacted, mixed):
        assert df.columns == docs.columns and df.dtypes == docs.dtypes
    said = {r.doc_id for r in toxicity.severity(documents(raw), spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.toxic}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in raw.collect()} - said
    of = {k: c for k, _, c in brute([(r.doc_id, r.text) for r in clean.collect()])}
    assert sorted(str(r.doc_id) for r in unique.collect()) == sorted(k for k, c in of.items() if k == c)
    before = {r.doc_id: r.text for r in unique.collect()}
    for r in redacted.collect():
        assert not re.search(r"[\w.]+@[\w-]+\.\w+", r.text)
        if not re.search(r"[0-9@]", before[r.doc_id]):
            assert r.text == before[r.doc_id]
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in redacted.collect():
        sizes[r.source] += len(WORD.findall(r.text))
    texts = {r.doc_id: r.text for r in redacted.collect()}
    for r in mixed.collect():
        taken[r.source] += len(WORD.findall(r.text))
        assert texts[r.doc_id].startswith(r.text)
    for s, t in water(sizes).items():
        assert abs(taken[s] - t) <= 0.5 + 1e-6
    assert max(Counter(r.doc_id for r in mixed.collect()).values()) <= 3
    assert verify(mixed, packed.collect())[0] < 0.02 * packed.agg({"length": "sum"}).first()[0]


def test_run_equals_the_stages(spark):
    got = corpus_pipeline.run(spark, SF).agg({"length": "sum"}).first()[0]
    assert got == stages(spark, spark.read.parquet(f"{SF}/documents.parquet"))[-1].agg({"length": "sum"}).first()[0]


def test_odd_rows(spark, weird, nothing):
    out = stages(spark, weird)
    assert all(df.columns == weird.columns for df in out[:-1]) and out[-1].count() > 0
    assert stages(spark, nothing)[-1].count() == 0
