import hashlib
import re
from collections import defaultdict

import duckdb

from glosswork.llm.lines import ORACLE_SQL, dedup_lines, query

WHITE = " \t\n\x0b\x0c\r"


def plain(pairs):
    """By the contract, line by line."""
    held = defaultdict(set)
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(WHITE))
    for doc_id, text in pairs:
        for x in (text or "").split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(doc_id)
    keeper = {k: max(i for i in ids if i is not None) for k, ids in held.items() if len(ids) >= 3}
    out = []
    for doc_id, text in pairs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), doc_id) == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect()), key=str)


def test_small_and_odd_rows(small, weird, nothing):
    for df in (small, weird):
        assert got(dedup_lines(df)) == plain([(r[0], r[1]) for r in df.collect()])
    assert dedup_lines(nothing).count() == 0


def test_keys_ids_and_order(spark):
    shared, other = "This Line Is Held By Many", "é" * 20
    rows = [
        (1, f"{shared}\nown 1\n\t{shared.upper()} \n"), (2, f"a\n{shared}"), (3, f"\n\n{other}\n{shared}\r\nz"), (3, f"{shared}\nagain"),
        (None, f"{shared}\n{other}"), (4, other), (5, "é" * 19), (6, "é" * 19), (7, "é" * 19), (8, "twice is not enough for a line\n" * 3), (9, "twice is not enough for a line"),
        (10, "É" * 20), (11, "É" * 20), (12, "\xa0" + "x" * 20), (13, "x" * 20 + "\x85"), (14, "x" * 20),
    ]
    want = plain(rows)
    assert got(dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == want
    assert [r for r in want if r[0] == 3] == [(3, 2, 0, f"{shared}\nagain"), (3, 5, 1, f"\n\n{shared}\r\nz")]


def test_a_hot_line_and_a_hot_document(spark):
    rows = [(i if i % 3 else 7, f"line number {i} of its own kind\n" + ("a license line that everyone has" if i % 2 else f"some pair {i // 20} of lines that few have")) for i in range(3000)]
    assert got(dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))) == plain(rows)


def test_query_equals_its_sql(spark):
    c = duckdb.connect()
    c.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    df = query(spark, "/root/testdata/sf0.01")
    assert df.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    rows = sorted(map(tuple, df.collect()))
    assert rows == sorted(c.sql(ORACLE_SQL).fetchall()) and sum(r[2] for r in rows) > 0
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert all(h == hashlib.sha256(texts[i].encode()).hexdigest() for i, _, n, h in rows if not n)
