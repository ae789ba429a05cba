import calendar
import hashlib
import os
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest

from glosswork.llm.layout import click_moment, query, rewritten_layout

CUT = datetime(2024, 5, 1)


def moment(ts, click_id):
    if ts is None or click_id is None:
        return ts
    k = zlib.crc32(str(click_id).encode()) % 128
    if k < 16:
        return ts - timedelta(days=(k + 6) ** 3)
    return datetime(ts.year, ts.month, ts.day) - timedelta(days=ts.weekday()) if k > 111 else ts


def plain_leaves(moments, most):
    """hour -> leaf name, by walking down the calendar."""
    hours = Counter((m.year, m.month, m.day, m.hour) for m in moments)
    names = {}

    def held(path):
        return sum(n for h, n in hours.items() if h[: len(path)] == path)

    def walk(path, members):
        runs, open_ = [], None
        for x in members:
            n = held((*path, x))
            if n > most and len(path) < 3:
                open_ = None
                walk((*path, x), range(1, 13) if not path else range(1, calendar.monthrange(path[0], x)[1] + 1) if len(path) == 1 else range(24))
            elif open_ and open_[2] + n <= most:
                open_[1], open_[2] = x, open_[2] + n
            else:
                open_ = [x, x, n]
                runs.append(open_)
        form = "%04d" if not path else "%02d"
        top = "".join(("%04d/" if i == 0 else "%02d/") % p for i, p in enumerate(path))
        for a, b, _ in runs:
            for h in hours:
                if h[: len(path)] == path and a <= h[len(path)] <= b:
                    names[h] = f"{top}{form % a}-{form % b}"

    if hours:
        walk((), range(min(hours)[0], max(hours)[0] + 1))
    return names


def plain_layout(rows, names, most):
    at = {n: names.index(n) for n in ("ts", "arrived_at", "click_id")}
    where = [(moment(r[at["ts"]], r[at["click_id"]]), r) for r in rows]
    leaf = plain_leaves([m for m, _ in where if m], most)
    groups = defaultdict(list)
    for m, r in where:
        groups[leaf[m.year, m.month, m.day, m.hour] if m else "null"].append((m, r))
    key = lambda x: (x is not None, x or 0) if not isinstance(x, datetime) else (True, x.timestamp())
    files = {}
    for name, own in groups.items():
        own.sort(key=lambda x: (key(x[0]), key(x[1][at["arrived_at"]]), key(x[1][at["click_id"]])))
        for i in range(0, len(own), most):
            files[name, i // most + 1] = [r for _, r in own[i : i + most]]
    return files


def verify(df, got, folder, share=500):
    names, rows = df.columns, [tuple(r) for r in df.collect()]
    most = 1 + len(rows) // share
    arrived, id_ = names.index("arrived_at"), names.index("click_id")
    is_old = lambda r: r[arrived] is not None and r[arrived] < CUT
    text = lambda r: repr(tuple(x.asDict() if hasattr(x, "asDict") else x for x in r))
    before, after = plain_layout([r for r in rows if is_old(r)], names, most), plain_layout(rows, names, most)
    assert {(r.leaf, r.part) for r in got} == set(after)
    for r in got:
        want = after[r.leaf, r.part]
        ids = ",".join("" if x[id_] is None else str(x[id_]) for x in want)
        assert r.ids_sha256 == hashlib.sha256(ids.encode()).hexdigest() and r.columns == ",".join(names)
        assert (r.n_rows, r.n_new) == (len(want), sum(not is_old(x) for x in want))
        assert r.rewritten == (sorted(map(text, before.get((r.leaf, r.part), []))) != sorted(map(text, want)))
        held = pq.ParquetFile(r.path.replace("file://", "")).read()
        assert held.column_names == names
        assert sorted(map(text, zip(*(c.to_pylist() for c in held.columns)))) == sorted(map(text, want))
    assert sorted(os.path.basename(r.path) for r in got) == sorted(os.listdir(folder))
    return got


def folder_of(got):
    return os.path.dirname(got[0].path.replace("file://", ""))


def test_query_by_the_contract(spark):
    sf = "/root/testdata/sf0.001"
    df = query(spark, sf)
    assert dict(df.dtypes) == {"leaf": "string", "columns": "string", "ids_sha256": "string", "path": "string", "part": "bigint", "n_rows": "bigint", "n_new": "bigint", "rewritten": "boolean"}
    got = df.collect()
    verify(spark.read.parquet(f"{sf}/clicks.parquet"), got, folder_of(got))
    assert max(r.part for r in got) > 1 and len({r.leaf.count("/") for r in got}) == 4


def layout(df, **how):
    return rewritten_layout(df, "ts", "arrived_at", "click_id", click_moment, lambda a: a < CUT, **how)


SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, kind string, leaf string, moment int, c0 double, props struct<a:int,b:array<string>>"


def rows(n):
    for i in range(n):
        ts = datetime(2023, 12, 30) + timedelta(minutes=37 * i % 300_000) if i % 9 else datetime(2024, 2, 29, 23, 59, 59, 999999)
        late = datetime(2024, 5, 1) + timedelta(seconds=i) if i % 11 == 0 and i < 400 else ts + timedelta(hours=1)
        yield (i // 2 if i % 50 else None, ts if i % 4 or i % 8 else None, late if i % 13 or i >= 400 else None, "k" * (i % 3), f"{i}", None if i % 2 else i, i / 7, ((i, ["x", None]) if i % 5 else None))


@pytest.mark.parametrize("share", [7, 60])
def test_late_rows_nulls_and_clashing_names(spark, share):
    listed = list(rows(2000))
    df = spark.createDataFrame(listed + listed[:300], SCHEMA).repartition(5)
    got = layout(df, share=share).collect()
    verify(df, got, folder_of(got), share)
    if share == 60:
        assert {r.rewritten for r in got} == {True, False} and any(r.leaf == "null" and r.part > 1 for r in got)


def test_one_hour_one_row_and_none(spark, tmp_path):
    same = [(5, datetime(2024, 1, 1, 3), datetime(2024, 1, 1, 4), "a" * 100_000, None, None, None, None)] * 50
    df = spark.createDataFrame(same, SCHEMA).repartition(3)
    verify(df, layout(df, folder=f"file://{tmp_path}/same", share=7).collect(), tmp_path / "same", 7)
    one = spark.createDataFrame([(None, None, None, None, None, None, None, None)], SCHEMA)
    verify(one, layout(one, folder=f"file://{tmp_path}/one").collect(), tmp_path / "one")
    (tmp_path / "none").mkdir()
    assert layout(one.limit(0), folder=f"file://{tmp_path}/none").collect() == [] and not os.listdir(tmp_path / "none")
