"""Adaptive time partitions: a folder of Parquet files of at most L rows each, years where rows are few, hours where
they are many, and its rewriting when rows arrive late.

Rows are counted by hour, ROLLUP adds days, months and years; a self-join keeps the children of nodes above L; calendar
sequences add the children without rows, and ``aggregate`` folds each parent's sorted children into runs of at most L
rows. Two runs side by side hold over L rows together, so there are at most some 6,000 leaves however many rows there
are: that table alone is broadcast. A row names the parents that it could have (all years, its year, month and day) and
meets its leaf by these and the leaf's range of hours.

Only leaves above L (an hour, or rows without a moment) have several parts: their rows are sorted over ranges of all
sort columns, and a prefix sum over the ranges' counts gives each row its place. A file of the contract is written by
one task, which streams it; the tasks that write hold one block of rows. Content is compared by counts and sums of two
hashes of whole rows, which combine before their shuffle. What tasks report are file names: each attempt has its own,
and a last job deletes all files of the folder that no report names, those of lost attempts and of the first layout
that don't recur.

Defined results: rows without a moment are the leaf ``null``; null arrival or id sorts first, a null id leaves the
moment as it is and is an empty text among the ids; rows without arrival come with the second layout; ties are ordered
by hashes of the whole row, so only equal rows can swap places; repeated rows are rows; very long texts in any column
are carried along; further columns, whatever their names, are part of the table and of its files; an empty table leaves
an empty folder and gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glosswork.llm.common import share_code, shared_folder, stored, table

SHARE = 500
#: Rows of a file that are held before they are written.
GROUP = 1 << 17
ORDER = ["moment", "arrived", "id", "h1", "h2"]


def lasting_folder(spark: SparkSession) -> str:
    """The name of a new folder beside those of ``shared_folder``, which stays when the application ends."""
    return shared_folder(spark).rsplit("/", 1)[0] + f"/layout-{uuid.uuid4().hex}"


def _made(spark: SparkSession, folder: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return folder


def rows_of(df: DataFrame, ts: str, arrived: str, id_: str, moment: Callable[[Column, Column], Column], first: Callable[[Column], Column]) -> DataFrame:
    """The columns of ``df`` as c0, c1 ..., found by exact case, and what places a row."""
    share_code(df.sparkSession)
    held = df.columns
    cols = [f"c{i}" for i in range(len(held))]
    at = {n: F.col(f"c{held.index(n)}") for n in (ts, arrived, id_)}
    flags = F.concat(*[F.isnull(c).cast("int").cast("string") for c in cols])
    plain = [F.to_json(c) if f.dataType.typeName() == "map" else F.col(c) for c, f in zip(cols, df.schema.fields)]
    named = df.toDF(*cols).select(
        *cols, at[arrived].alias("arrived"), at[id_].alias("id"), moment(at[ts].cast("timestamp_ntz"), at[id_]).alias("moment"), F.coalesce(first(at[arrived]), F.lit(False)).alias("old"),
        F.xxhash64(flags, *plain).alias("h1"), F.xxhash64(*plain, flags, F.lit(2)).alias("h2"), F.monotonically_increasing_id().alias("turn"),
    )
    day = F.col("moment").cast("date")
    return named.select("*", (F.unix_date(day).cast("long") * 24 + F.hour("moment")).alias("hour"), F.year(day).alias("y"), F.month(day).alias("m"), F.dayofmonth(day).alias("d"), F.hour("moment").alias("h"))


def counted(rows: DataFrame) -> DataFrame:
    """(y, m, d, h, n_old, n): rows of each hour; those without a moment have null."""
    return rows.groupBy("y", "m", "d", "h").agg(F.sum(F.col("old").cast("long")).alias("n_old"), F.count(F.lit(1)).alias("n"))


def leaves(counts: DataFrame, most: int) -> DataFrame:
    """(side, level, parent, lo, hi, leaf, held) of both layouts: side 0 of the old rows, side 1 of all.

    ``parent``: its first hour, from 1970 on; null above years. [lo, hi) are the hours of the leaf's members.
    """
    spark = counts.sparkSession
    sides = counts.select("y", "m", "d", "h", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("n_old").alias("n")), F.struct(F.lit(1).alias("side"), F.col("n").alias("n")))).alias("s")).select("y", "m", "d", "h", "s.*").filter("n > 0")
    nodes = spark.sql(
        """SELECT side, y, m, d, h, sum(n) AS n,
             CASE WHEN y IS NULL THEN 0 WHEN m IS NULL THEN 1 WHEN d IS NULL THEN 2 WHEN h IS NULL THEN 3 ELSE 4 END AS level
           FROM {sides} WHERE y IS NOT NULL GROUP BY side, ROLLUP(y, m, d, h)""",
        sides=sides,
    )
    families = spark.sql(
        f"""WITH c AS (SELECT *, coalesce(h, d, m, y) AS member, if(level > 1, y, null) AS py, if(level > 2, m, null) AS pm, if(level > 3, d, null) AS pd FROM {{nodes}})
            SELECT p.side, p.level + 1 AS level, p.y, p.m, p.d, min(member) AS least, max(member) AS greatest, map_from_entries(collect_list(struct(member, c.n))) AS held
            FROM {{nodes}} p JOIN c ON c.side = p.side AND c.level = p.level + 1 AND c.py <=> p.y AND c.pm <=> p.m AND c.pd <=> p.d
            WHERE p.level < 4 AND (p.level = 0 OR p.n > {most}) GROUP BY p.side, p.level, p.y, p.m, p.d""",
        nodes=nodes,
    )
    members = F.expr("""CASE level WHEN 1 THEN sequence(least, greatest) WHEN 2 THEN sequence(1, 12)
                        WHEN 3 THEN sequence(1, day(last_day(make_date(y, m, 1)))) ELSE sequence(0, 23) END""")
    siblings = F.transform(members, lambda x: F.struct(x.alias("member"), F.coalesce(F.try_element_at(F.col("held"), x), F.lit(0)).cast("long").alias("n")))
    run = "struct<first:int,last:int,n:bigint>"
    one = lambda x: F.struct(x["member"].alias("first"), x["member"].alias("last"), x["n"].alias("n"))
    closed = lambda a: F.when(a["open"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["open"])))
    none = F.lit(None).cast(run)

    def fold(a: Column, x: Column) -> Column:
        splits = (x["n"] > most) & (F.col("level") < 4)
        joins = a["open"].isNotNull() & (a["open"]["n"] + x["n"] <= most)
        longer = F.struct(a["open"]["first"].alias("first"), x["member"].alias("last"), (a["open"]["n"] + x["n"]).alias("n"))
        done = F.when(joins & ~splits, a["done"]).otherwise(closed(a))
        return F.struct(F.when(splits, none).when(joins, longer).otherwise(one(x)).alias("open"), done.alias("done"))

    start = F.struct(none.alias("open"), F.array().cast(f"array<{run}>").alias("done"))
    runs = families.withColumn("run", F.explode(F.aggregate(siblings, start, fold, closed))).select("side", "level", "y", "m", "d", "run.*").filter("n > 0")
    hours = lambda date: f"unix_date({date}) * 24L"
    lo = f"CASE level WHEN 1 THEN {hours('make_date(first, 1, 1)')} WHEN 2 THEN {hours('make_date(y, first, 1)')} WHEN 3 THEN {hours('make_date(y, m, first)')} ELSE {hours('make_date(y, m, d)')} + first END"
    hi = f"CASE level WHEN 1 THEN {hours('make_date(last + 1, 1, 1)')} WHEN 2 THEN {hours('add_months(make_date(y, last, 1), 1)')} WHEN 3 THEN {hours('(make_date(y, m, last) + 1)')} ELSE {hours('make_date(y, m, d)')} + last + 1 END"
    parent = f"CASE level WHEN 1 THEN null WHEN 2 THEN {hours('make_date(y, 1, 1)')} WHEN 3 THEN {hours('make_date(y, m, 1)')} ELSE {hours('make_date(y, m, d)')} END"
    name = """concat(if(level > 1, format_string('%04d/', y), ''), if(level > 2, format_string('%02d/', m), ''), if(level > 3, format_string('%02d/', d), ''),
              if(level = 1, format_string('%04d-%04d', first, last), format_string('%02d-%02d', first, last)))"""
    timed = runs.selectExpr("side", "level", f"coalesce({parent}, {_NO_PARENT}) AS parent", f"{lo} AS lo", f"{hi} AS hi", f"{name} AS leaf", "n AS held")
    timeless = sides.filter("y is null").selectExpr("side", "0 AS level", f"{_NO_PARENT} AS parent", "0L AS lo", "1L AS hi", "'null' AS leaf", "n AS held")
    return timed.unionByName(timeless)


#: No hour of any year.
_NO_PARENT = "-9000000000000000L"


def placed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with side, leaf and held, once for each layout that they are in: by the leaf's parent and range of hours."""
    when = F.expr(f"""if(moment is null, array(struct(0 AS level, {_NO_PARENT} AS parent)), array(
        struct(1 AS level, {_NO_PARENT} AS parent), struct(2 AS level, unix_date(make_date(y, 1, 1)) * 24L AS parent),
        struct(3 AS level, unix_date(make_date(y, m, 1)) * 24L AS parent), struct(4 AS level, hour - h AS parent)))""")
    sides = rows.withColumn("side", F.explode(F.expr("if(old, array(0, 1), array(1))"))).withColumn("w", F.explode(when)).withColumn("hour", F.coalesce("hour", F.lit(0).cast("long")))
    by = found.toDF("l_side", "l_level", "l_parent", "lo", "hi", "leaf", "held")
    met = sides.join(F.broadcast(by), F.expr("side = l_side AND w.level = l_level AND w.parent = l_parent AND hour >= lo AND hour < hi"))  # leaves: see the module's bound
    return met.drop("w", "l_side", "l_level", "l_parent", "lo", "hi", "y", "m", "d", "h", "hour")


def parted(rows: DataFrame, most: int, folder: str) -> DataFrame:
    """``placed`` rows with part: 1 where the leaf fits, by place in the leaf's order where it doesn't."""
    keys = ["side", "leaf", *ORDER, "turn"]
    heavy = rows.filter(F.col("held") > most).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    heavy = stored(heavy, folder, "heavy").withColumn("range", F.shiftright("at", 33))
    ranges = heavy.groupBy("side", "leaf", "range").agg(F.min("at").alias("from"), F.count(F.lit(1)).alias("rows"))
    ahead = F.coalesce(F.sum("rows").over(Window.partitionBy("side", "leaf").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("side", "leaf", "range", (ahead - F.col("from")).alias("shift"))
    # as many rows as there are shuffle partitions, and one more for each such leaf
    ranked = heavy.join(F.broadcast(ranges), ["side", "leaf", "range"]).withColumn("part", F.expr(f"(at + shift) div {most} + 1")).drop("at", "range", "shift")
    return rows.filter(F.col("held") <= most).withColumn("part", F.lit(1).cast("long")).unionByName(ranked)


def contents(rows: DataFrame) -> DataFrame:
    """(side, leaf, part, n_rows, n_new, and three sums over hashes of whole rows) of each file to be."""
    half = lambda c: F.sum(c).alias
    return rows.groupBy("side", "leaf", "part").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum((~F.col("old")).cast("long")).alias("n_new"),
        half(F.col("h1").bitwiseAND(0xFFFFFFFF))("s1"), half(F.shiftrightunsigned("h1", 32))("s2"), F.bit_xor("h2").alias("s3"),
    )


def _writer(folder: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSystem

        fs, top = FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        state: dict = {}

        def flush() -> None:
            whole = pa.Table.from_batches(state["held"]).rename_columns(names)
            if state["out"] is None:
                state["sink"] = fs.open_output_stream(f"{top}/{state['name']}")
                state["out"] = pq.ParquetWriter(state["sink"], whole.schema)
            state["out"].write_table(whole)
            state["held"], state["size"] = [], 0

        def close() -> pa.RecordBatch:
            flush()
            state["out"].close()
            state["sink"].close()
            return pa.RecordBatch.from_pydict({"leaf": [state["leaf"]], "part": [state["part"]], "ids_sha256": [state["sha"].hexdigest()], "path": [f"{folder}/{state['name']}"]})

        for batch in batches:
            if not batch.num_rows:
                continue
            leaf, part, ids = batch.column(0), batch.column(1), batch.column(2)
            new = pc.or_(pc.not_equal(leaf[1:], leaf[:-1]), pc.not_equal(part[1:], part[:-1])).to_numpy(zero_copy_only=False).nonzero()[0] + 1
            for a, b in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows]):
                key = (leaf[a].as_py(), part[a].as_py())
                if key != (state.get("leaf"), state.get("part")):
                    if state:
                        yield close()
                    state.update(leaf=key[0], part=key[1], name=f"{uuid.uuid4().hex}.parquet", sha=hashlib.sha256(), held=[], size=0, out=None, before="")
                state["sha"].update((state["before"] + ",".join(x or "" for x in ids.slice(a, b - a).to_pylist())).encode())
                state["before"] = ","
                rows = batch.slice(a, b - a)
                state["held"].append(rows.select(range(3, batch.num_columns)))
                state["size"] += b - a
                if state["size"] >= GROUP:
                    flush()
        if state:
            yield close()

    return run


def written(rows: DataFrame, folder: str, names: list[str]) -> DataFrame:
    """One Parquet file for each (leaf, part) of ``rows``, in order: leaf, part, ids_sha256, path."""
    cols = [f"c{i}" for i in range(len(names))]
    dealt = rows.repartition("leaf", "part").sortWithinPartitions("leaf", "part", *ORDER)
    return dealt.select("leaf", "part", F.col("id").cast("string").alias("id_text"), *cols).mapInArrow(_writer(folder, names), "leaf string, part long, ids_sha256 string, path string")


def _deleter(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem, FileType

        fs, top = FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        for batch in batches:
            for name in batch.column(0).to_pylist():
                if fs.get_file_info(f"{top}/{name}").type != FileType.NotFound:  # another attempt may have been here
                    fs.delete_file(f"{top}/{name}")
            yield batch

    return run


def swept(folder: str, files: DataFrame) -> int:
    """Deletes the folder's files that ``files`` (path) doesn't name; their number."""
    name = F.substring_index("path", "/", -1).alias("name")
    there = files.sparkSession.read.format("binaryFile").load(folder).select(name)  # names alone: nothing is read
    return there.join(files.select(name), "name", "left_anti").mapInArrow(_deleter(folder), "name string").count()


def rewritten_layout(df: DataFrame, ts: str, arrived: str, id_: str, moment: Callable[[Column, Column], Column], first: Callable[[Column], Column], folder: str | None = None, share: int = SHARE) -> DataFrame:
    """Writes the rows of ``df`` that ``first`` takes by arrival, then all of them, and returns the files that are left:
    leaf, columns, ids_sha256, path, part, n_rows, n_new, rewritten."""
    spark, names = df.sparkSession, df.columns
    work, folder = shared_folder(spark), _made(spark, folder or lasting_folder(spark))
    rows = rows_of(df, ts, arrived, id_, moment, first)
    counts = stored(counted(rows), work, "counts")
    most = 1 + (counts.agg(F.sum("n")).first()[0] or 0) // share
    found = stored(leaves(counts, most), work, "leaves")
    dealt = parted(placed(rows, found), most, work)
    files = stored(contents(dealt), work, "contents")
    sums = ["leaf", "part", "n_rows", "s1", "s2", "s3"]
    old = files.filter("side = 0").select(*sums, F.lit(True).alias("stays"))
    final = stored(files.filter("side = 1").join(old, sums, "left").select("leaf", "part", "n_rows", "n_new", F.coalesce("stays", F.lit(False)).alias("stays")), work, "final")
    before = stored(written(dealt.filter("side = 0"), folder, names), work, "before")
    changed = final.filter("not stays").select("leaf", "part")
    after = stored(written(dealt.filter("side = 1").join(F.broadcast(changed), ["leaf", "part"], "left_semi"), folder, names), work, "after")  # files: two for each L rows at most, and leaves
    left = before.join(final.filter("stays"), ["leaf", "part"]).unionByName(after.join(final, ["leaf", "part"]))
    left = stored(left.select("leaf", F.lit(",".join(names)).alias("columns"), "ids_sha256", "path", "part", "n_rows", "n_new", (~F.col("stays")).alias("rewritten")), work, "left")
    swept(folder, left)
    return left


def click_moment(ts: Column, click_id: Column) -> Column:
    """``ts``; for some ids moved back by days, or to the beginning of its week."""
    k = F.crc32(click_id.cast("string").cast("binary")) % 128
    days = (k + 6) * (k + 6) * (k + 6)
    return F.when(k < 16, ts - F.make_dt_interval(days.cast("int"))).when(k > 111, F.trunc(ts, "week").cast("timestamp_ntz")).otherwise(ts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    in_time = lambda arrived: arrived.cast("timestamp_ntz") < F.lit("2024-05-01 00:00:00").cast("timestamp_ntz")
    return rewritten_layout(table(spark, sf_dir, "clicks"), "ts", "arrived_at", "click_id", click_moment, in_time)


NAME = "op13_adaptive_partitions"
