"""Shared places and small helpers for the corpus operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that the driver and all executors see (spark.checkpoint.dir).

    A session with a local master that names none, as in tests, gets a temporary folder; on a cluster this raises.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        where = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where if "://" in where or where.startswith("file:") else "file://" + where


class _Made(threading.local):
    """Folders that each thread has made, so that runs in several threads of one driver leave each other's tables alone."""

    def __init__(self):
        self.folders: list[str] = []


_MADE = _Made()


def made_so_far() -> int:
    """How many folders this thread has made; a mark for `remove_written`."""
    return len(_MADE.folders)


def remove_written(spark: SparkSession, since: int = 0, leave: int = 0) -> None:
    """Deletes the folders that this thread has made below the shared folder since a mark, but the last `leave` of them.

    Frames that read them end with them.
    """
    gone = _MADE.folders[since : len(_MADE.folders) - leave]
    for uri in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _MADE.folders.remove(uri)


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    _MADE.folders.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _MADE.folders[-1]


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, for code in Python workers."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame, written once to the shared folder and read again: lineage ends there, and lost executors cost no rerun."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(columns: list[str], name: str) -> str:
    """A column name that no input column has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def skew_join(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """Inner join of rows with `side`, an aggregate by the key, that Spark can split at hot keys.

    An aggregate by the key is dealt by it already, and a join with it as it stands cannot be split. The second
    key, which says nothing new, makes both sides be dealt anew for the join.
    """
    again = unused([*rows.columns, *side.columns], "again")
    return rows.withColumn(again, F.xxhash64(key)).join(side.withColumn(again, F.xxhash64(key)), [key, again]).drop(again)


#: Rows of a hash filter; each has 512 masks of 64 bits, so a filter has 8 MB, whatever went into it.
FILTER_BUCKETS, _MASKS = 2048, 512


def hash_filter(keys: DataFrame, column: str) -> DataFrame:
    """(bucket, masks): a bit for each 64-bit hash in `column`; a Bloom filter of one probe, written, of 8 MB whatever goes into it."""
    bucket, mask, bit = _place(F.col(column))
    words = keys.select(bucket.alias("bucket"), mask.alias("mask"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bits"))
    every = keys.sparkSession.range(FILTER_BUCKETS).select(F.col("id").cast("int").alias("bucket"), F.lit(0).alias("mask"), F.lit(0).cast("long").alias("bits"))
    words = words.unionByName(every).groupBy("bucket", "mask").agg(F.bit_or("bits").alias("bits"))
    found = words.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("mask", "bits"))).alias("found"))
    all_masks = F.transform(F.sequence(F.lit(0), F.lit(_MASKS - 1)), lambda i: F.coalesce(F.element_at("found", i), F.lit(0).cast("long")))
    return written(found.select("bucket", all_masks.alias("masks")), "filter")


def _place(value: Column) -> tuple[Column, Column, Column]:
    """Row, mask and bit of a hash."""
    return F.shiftright(value, 53).cast("int") + FILTER_BUCKETS // 2, F.shiftright(value, 6).bitwiseAND(F.lit(_MASKS - 1)).cast("int"), value.bitwiseAND(F.lit(63)).cast("int")


def with_filter(df: DataFrame, column: str, bits: DataFrame, name: str) -> DataFrame:
    """df and a column that is false only if the hash in `column` went into no part of the filter."""
    bucket, masks = unused([*df.columns, name], "bucket"), unused([*df.columns, name], "masks")
    row, mask, bit = _place(F.col(column))
    joined = df.withColumn(bucket, row).join(F.broadcast(bits.select(F.col("bucket").alias(bucket), F.col("masks").alias(masks))), bucket, "left")
    return joined.withColumn(name, F.coalesce(F.getbit(F.col(masks)[mask], bit) == 1, F.lit(False))).drop(bucket, masks)


def drop_rows(docs: DataFrame, listed: DataFrame, key: Column, text: str) -> DataFrame:
    """docs without the rows of the pairs (id, th) in the written frame `listed`, but for one row of each pair whose `one` is true.

    `th` is xxhash64 of the text (null: empty), `key` gives a row's id. Rows that pass a filter of `listed` meet it in a shuffle; the
    others stay where they are, so of a large table only the texts of listed rows are moved.
    """
    th, id_, maybe = (unused(docs.columns, n) for n in ("text_hash", "row_id", "maybe"))
    rows = with_filter(docs.withColumn(th, F.xxhash64(text_or_empty(text))), th, hash_filter(listed, "th"), maybe)
    side = listed.select(F.col("id").alias(id_), F.col("th").alias(th), F.col("one").alias("one_")).hint("merge")
    some = rows.where(maybe).withColumn(id_, key)
    on = some[id_].eqNullSafe(side[id_]) & (some[th] == side[th])
    kept = rows.where(~F.col(maybe)).select(*docs.columns).unionByName(some.join(side, on, "left_anti").select(*docs.columns))
    one = side.where("one_")
    if listed.where("one").limit(1).count():  # rows that repeat both id and text
        again = some.join(one, on, "left_semi").dropDuplicates([id_, th])
        kept = kept.unionByName(again.select(*docs.columns))
    return kept


#: Bytes of an Arrow batch that goes to a Python worker at once.
BATCH_BYTES = 8 << 20


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow in batches of bounded bytes; a worker gives memory it no longer needs back after each partition."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = df.sparkSession.conf.get(limit)
    if not held.rstrip("b").isdigit() or not 0 < int(held.rstrip("b")) <= BATCH_BYTES:
        df.sparkSession.conf.set(limit, f"{BATCH_BYTES}b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            return

    return df.mapInArrow(run, schema)
