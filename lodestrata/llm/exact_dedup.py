"""Exact dedup with a heavy-hitter split; DataFrame functions only.

A Misra-Gries summary (`approx_top_k_accumulate`: counters that are all lowered when they run out) names the digests
that may hold more than one in `counters` of all rows. Summaries are merged in `_MERGES` groups and then as one. One exact
count verifies what they name; the verified winners, at most `counters` rows, are broadcast and their rows are decided where they
are read. All other digests are counted in a shuffle of partial counts; only rows that may be in a group of two or more are dealt
by digest, to meet their group's first row. A heavy digest that the summary missed is one of those.

Texts are equal if they are the same after every run of `[\\x20\\x09-\\x0D]` became one space. Of equal
texts the row with the smallest id stays. Null and empty texts are equal to each other. A null id comes
after all others. Of rows that repeat an id and have equal texts one stays, that with the least hash of the text as it is. Empty tables
give empty results; extra columns are carried by `drop_duplicates`, whatever their names, and ignored by `decisions`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm._shared import drop_rows, hash_filter, table, text_or_empty, with_filter, written

COUNTERS = 1000
#: Groups in which the tasks' summaries are merged before they meet; a summary has 8 * COUNTERS entries at most.
_MERGES = 256


def digest(text: str = "text"):
    """SHA-256, in hex, of the normalised text in UTF-8."""
    return F.sha2(F.regexp_replace(text_or_empty(text), r"[\x20\x09-\x0D]+", " "), 256)


def _fingerprints(docs: DataFrame, key: str, text: str) -> DataFrame:
    slim = docs.select(F.col(key).alias("id"), digest(text).alias("d"), F.xxhash64(text_or_empty(text)).alias("th"), F.monotonically_increasing_id().alias("row"))
    return written(slim, "digests")


def _self():
    return F.struct(F.col("id").isNull().alias("none"), "id", "th", "row")


def heavy_digests(slim: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Verified heavy digests with their first row and size: (d, first, size), at most `counters` rows."""
    total = slim.count()
    if not total:  # summaries of no rows cannot be merged
        return slim.groupBy("d").agg(F.min(_self()).alias("first"), F.count("*").alias("size"))
    parts = slim.groupBy(F.pmod(F.spark_partition_id(), F.lit(_MERGES)).alias("g")).agg(F.expr(f"approx_top_k_accumulate(d, {8 * counters})").alias("s"))
    parts = parts.repartition(1)  # the groups' summaries, so that no task has none to merge, which Spark's function does not allow
    found = parts.agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(s, {8 * counters}), {counters})").alias("top")).select(F.explode("top.item").alias("d"))
    sizes = slim.join(F.broadcast(found), "d", "left_semi").groupBy("d").agg(F.min(_self()).alias("first"), F.count("*").alias("size"))
    return written(sizes.where(F.col("size") * counters >= total).where("size > 1"), "heavy")


def _decided(slim: DataFrame, counters: int) -> DataFrame:
    """slim with `first` (the row that stays) and `size`."""
    columns = ("id", "d", "th", "row", "first", "size")
    heavy = F.broadcast(heavy_digests(slim, counters))
    hot = slim.join(heavy, "d").select(*columns)
    rest = slim.join(heavy, "d", "left_anti")
    groups = rest.groupBy("d").agg(F.min(_self()).alias("first"), F.count("*").alias("size")).where("size > 1")
    groups = written(groups.withColumn("h", F.xxhash64("d")), "groups")
    rest = with_filter(rest.withColumn("h", F.xxhash64("d")), "h", hash_filter(groups, "h"), "maybe")
    alone = rest.where("not maybe").select("id", "d", "th", "row", _self().alias("first"), F.lit(1).cast("long").alias("size"))
    some = rest.where("maybe").select("id", "d", "th", "row").join(groups.select("d", "first", "size").hint("merge"), "d", "left")
    some = some.select("id", "d", "th", "row", F.coalesce("first", _self()).alias("first"), F.coalesce("size", F.lit(1)).alias("size"))
    return hot.unionByName(alone).unionByName(some)


def decisions(docs: DataFrame, *, key: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per row of docs: key, keep_id, group_size, kept, text_sha256."""
    found = _decided(_fingerprints(docs, key, text), counters)
    return found.select(F.col("id").alias(key), F.col("first.id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("first.row")).alias("kept"), F.col("d").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    The rows that go are found on ids and digests alone, and named by id and hash of the text as it is.
    """
    found = _decided(_fingerprints(docs, key, text), counters).where("row <> first.row")
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th"))
    return drop_rows(docs, written(found.select("id", "th", same.alias("one")).distinct(), "listed"), F.col(key), text)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of `documents`: doc_id, keep_id, group_size, kept, text_sha256."""
    return decisions(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
WINDOW w AS (PARTITION BY text_sha256)
"""
