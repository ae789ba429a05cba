"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Generators propose spans in every whole text: assignments to secret-like names, access keys, long hex in either case, key
blocks, mixed long strings, bearer tokens and passwords in addresses. The candidates' hashes are then counted over the
corpus by distinct repositories (documents) and distinct owners (sources). A value seen under few owners and in few
repositories looks like a live credential of theirs; one under many owners, or in many repositories of whichever owner,
is a copied example. Base kinds are reported whatever their class; the further kinds only where the corpus counts say
owner-specific, as an unowned look-alike is no finding.

Counting goes (value, owner, repository) -> (value, owner) -> (value), each step combined before its shuffle, so a
value in a third of all rows is a few partial rows for each task; where spans meet their counts, such a value is dealt
over several tasks. Text never leaves the first stage.

Defined results: null text is empty and has no spans; very long texts are read whole, their pieces between matches held
in memory; a null source is an owner of its own, a null doc_id a repository of its own; repeated rows are each reported
and count once as repository; spans that begin at one place are in order of kind; further columns are left out, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.llm.common import documents, shared_folder, spread_join, stored, table
from glosswork.llm.spans import listed, matched, placed

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ASSIGN_GUARD = r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=])"""
# a run that is too short has no long enough run inside, so asking for the length is dropping short runs
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BLOCK = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
MIXED = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+"
UPPER = r"(?<![A-Za-z0-9])[0-9A-F]{24,}+(?![A-Za-z0-9])"
BEARER = r"(?i:bearer)\x20+([A-Za-z0-9._~+/=-]{16,}+)"
ADDRESS = r"[A-Za-z][A-Za-z0-9+.-]{0,30}://[^\x20\x09-\x0D/:@]{1,100}:([^\x20\x09-\x0D/:@]{6,200})@"
KINDS = ("assign", "access", "hex", "block", "mixed", "upper", "bearer", "address")
GROUPED = ("assign", "bearer", "address")
BASE = 3
#: A value under at least so many owners, or in at least so many repositories, is an example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 25


def _span(ord_: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(ord_).alias("ord"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.sha2(s["value"], 256).alias("hash"))


def candidates(docs: DataFrame) -> DataFrame:
    """row, doc_id, source, spans: every generator's spans (start, ord, end, kind, hash) in order."""
    t = documents(docs, "source").select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    cols = matched("text", "assign", ASSIGN, text.rlike(ASSIGN_GUARD), 2)
    cols += matched("text", "access", ACCESS, text.contains("AKIA"))
    cols += matched("text", "hex", HEX, text.rlike(HEX))
    cols += matched("text", "block", BLOCK, text.contains("PRIVATE KEY-----"))
    cols += matched("text", "mixed", MIXED, text.rlike(MIXED))
    cols += matched("text", "upper", UPPER, text.rlike(UPPER))
    cols += matched("text", "bearer", BEARER, text.rlike("(?i:bearer) "), 1)
    cols += matched("text", "address", ADDRESS, text.contains("://") & text.contains("@"), 1)
    found = t.select("row", "doc_id", "source", *cols)
    spans = []
    for i, kind in enumerate(KINDS):
        got = placed(kind, kind in GROUPED)
        if kind == "assign":
            got = F.filter(got, lambda s: F.length(s["value"]) >= 6)
        if kind == "upper":
            got = F.filter(got, lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-F]"))
        if kind == "mixed":
            got = F.filter(got, lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]"))
        spans.append(F.transform(got, _span(i, kind)))
    return found.select("row", "doc_id", "source", F.array_sort(F.concat(*spans)).alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """hash, repositories, owners: distinct ones over all candidates."""
    owner = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("owner")
    repo = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("repo")
    seen = found.select(owner, repo, F.explode(F.array_distinct(F.col("spans.hash"))).alias("hash")).groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = seen.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    return by_owner.groupBy("hash").agg(F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners"))


def scan_secrets(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """doc_id and its spans (start, ord, end, kind, hash, repositories, owners, live) in order, for every row."""
    folder = shared_folder(docs.sparkSession)
    found = stored(candidates(docs), folder, "candidates")
    held = found.filter(F.size("spans") > 0).select("row", "doc_id", F.explode("spans").alias("s")).select("row", "doc_id", "s.*")
    live = (F.col("owners") < example_owners) & (F.col("repositories") < example_repositories)
    joined = spread_join(held, stored(ownership(found), folder, "owned"), "hash", F.xxhash64("row", "start", "ord")).withColumn("live", live)
    span = F.struct("start", "ord", "end", "kind", "hash", "repositories", "owners", "live")
    with_spans = joined.filter((F.col("ord") < BASE) | F.col("live")).groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    none = F.expr("cast(array() as array<struct<start:int,ord:int,end:int,kind:string,hash:string,repositories:bigint,owners:bigint,live:boolean>>)")
    some = found.filter(F.size("spans") > 0).select("row", "doc_id").join(with_spans, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))
    # documents that had no spans need no join
    return some.unionByName(found.filter(F.size("spans") == 0).select("doc_id", none.alias("spans")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return got.select(
        "doc_id", *[count(k) for k in KINDS[:BASE]],
        F.sha2(listed(F.filter("spans", lambda s: s["ord"] < BASE)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["owners"])), F.lit(0)).alias("most_owners"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["repositories"])), F.lit(0)).alias("most_repositories"),
    )


NAME = "op5_secret_scan"
