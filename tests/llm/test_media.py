import hashlib
import zlib

from glosswork.llm.media import from_png, payload, query, store_media, to_png


def test_png_round_trip():
    for text in (None, "", "a", "é" * 99, "x" * 64, "y" * 70000):
        n, samples = payload(text)
        assert from_png(to_png(samples)) == samples
        assert samples[:n].decode() == (text or "") and not samples[n:].strip(b"\0")


def verify(pairs, rows):
    want = sorted((str(k), n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for k, t in pairs for n, p in [payload(t)])
    assert want == sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows)
    media = {}
    for r in rows:
        assert media.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256, r.feature, r.shard, r.offset)) == (r.media_bytes, r.media_sha256, r.feature, r.shard, r.offset)
        assert r.width * r.height == r.payload_bytes and r.bit_depth == 8


def test_columns(small, weird, nothing):
    verify([(r.doc_id, r.text) for r in small.collect()], store_media(small, shard_bytes=50_000).collect())
    verify([(r[0], r[1]) for r in weird.collect()], store_media(weird).collect())
    assert store_media(nothing).count() == 0


def test_query_and_a_hot_payload(spark):
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = query(spark, "/root/testdata/sf0.001")
    assert got.columns[:8] == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    verify(pairs, got.collect())
    many = [(i, "" if i % 3 else f"text {i}") for i in range(3000)]
    verify(many, store_media(spark.createDataFrame(many, "doc_id long, text string").repartition(6)).collect())
