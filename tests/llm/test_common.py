import types

import pytest
from pyspark.sql import functions as F

from glosswork.llm import common
from glosswork.llm.common import Kept, shared_folder, spread_join, stored


def test_hot_keys_meet_their_row_in_several_tasks(spark):
    rows = stored(spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 5000).alias("k")).repartition(6), shared_folder(spark), "rows")
    side = spark.range(-1, 4000).select(F.col("id").alias("k"), (F.col("id") * 7).alias("v"))
    met = spread_join(rows, side, "k", F.col("id"))
    assert sorted(map(tuple, met.select("id", "k", "v").collect())) == sorted(map(tuple, rows.join(side, "k").select("id", "k", "v").collect()))
    assert met.columns == ["k", "id", "v"]
    given = spread_join(rows, side, "k", F.col("id"), rows.select("k"))
    assert given.count() == met.count()


def test_side_rows_of_one_key_each_meet(spark):
    rows = stored(spark.range(100).select("id", (F.col("id") % 2).alias("k")), shared_folder(spark), "rows")
    side = spark.createDataFrame([(0, "a"), (0, "b"), (None, "c")], "k long, v string")
    assert spread_join(rows, side, "k", F.col("id")).groupBy("v").count().orderBy("v").collect() == [("a", 50), ("b", 50)]
    assert spread_join(rows.limit(0), side, "k", F.col("id")).count() == 0


def test_a_folder_is_shared_or_refused(spark):
    elsewhere = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *a: None), sparkContext=types.SimpleNamespace(master="spark://x:7077", applicationId="other"))
    with pytest.raises(ValueError):
        common.shared_folder(elsewhere)


def test_kept_tables(spark):
    folder = shared_folder(spark)
    stored(spark.range(5).select(F.col("id").alias("key")), folder, "five")
    stored(spark.range(0).select(F.col("id").alias("key")), folder, "none")
    assert sorted(Kept(f"{folder}/five").value["key"]) == [0, 1, 2, 3, 4] and Kept(f"{folder}/none").value == {}


def test_workers_give_freed_memory_back(spark):
    import pyarrow as pa

    def held(batches):
        import os

        import numpy as np

        def mb():
            with open("/proc/self/statm") as f:
                return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20

        for _ in batches:
            pa.array(np.ones(9)).take(pa.array(np.arange(9)))  # loads code that stays
            before = mb()
            arrays = [np.ones(1 << 20) for _ in range(20)] + [pa.array(np.ones(1 << 20)).take(pa.array(np.arange(1 << 20))) for _ in range(5)]
            full = mb()
            del arrays
            yield pa.RecordBatch.from_pydict({"pool": [pa.default_memory_pool().backend_name], "grew": [full - before], "stayed": [mb() - before]})

    common.share_code(spark)
    got = spark.range(1).mapInArrow(held, "pool string, grew long, stayed long").first()
    assert got.pool == "system" and got.grew > 150 and got.stayed < 50
