"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

1. Rows are numbered inside their input partition (a slim table of ids, sizes and checksums is
   written to the shared folder, with partition and number; texts are not moved).
2. How many rows of each partition go to each shard is drawn exactly, partition by partition, from the
   multivariate hypergeometric law given the shard sizes: the law that a uniform permutation of all rows
   induces. The matrix has one row per partition.
3. Each partition permutes the multiset of its labels; its n-th row takes the n-th label.
4. Rows are exchanged by (shard, random bucket) and permuted again inside; the slot is the bucket's
   offset plus the rank in the bucket, so no task holds a shard.

Law `rows`: shard sizes differ by one at most. Slots are gapless from 0. Everything follows from the seed
and the row numbers in the written table. Null texts have size 1 and checksum 0; null and repeated ids are
rows as others; empty tables give no row. Extra columns are carried by `shard_rows` under their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm._shared import map_batches, table, text_or_empty, written

#: Mean rows of a bucket of the second permutation.
BUCKET_ROWS = 1024


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes that differ by one at most; the first shards take the odd rows."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """Rows of partition p that go to shard s; row sums are `counts`, column sums are `sizes`."""
    left, rng = np.array(sizes, np.int64), np.random.default_rng([seed, 1])
    out = np.zeros((len(counts), len(sizes)), np.int64)
    for p, n in enumerate(counts):
        total = int(left.sum())
        for s in range(len(sizes)):  # one draw a shard: exact for any size
            rest = total - int(left[s])
            if n:
                out[p, s] = n if rest == 0 else _draw(rng, int(left[s]), rest, n)
            n -= int(out[p, s])
            total = rest
        left -= out[p]
    return out


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Hypergeometric draw; halves the draw where the library's limit of 1e9 would be passed."""
    if good == 0 or n == 0:
        return 0
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    # a sample of n is a sample of n // 2, then one of the rest from what is left; small samples are drawn one by one
    if n <= 64:
        hits = 0
        for i in range(n):
            hits += int(rng.integers(good + bad - i)) < good - hits
        return hits
    first = _draw(rng, good, bad, n // 2)
    return first + _draw(rng, good - first, bad - (n // 2 - first), n - n // 2)


def assign(numbered: DataFrame, *, shards: int = 16, seed: int = 17, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds shard and slot to a written table that numbers its rows by `part` and `n` (from 0 in each part)."""
    spark = numbered.sparkSession
    found = sorted((r["part"], r["rows"]) for r in numbered.groupBy("part").agg(F.count("*").alias("rows")).collect())  # one row per input partition
    total = sum(n for _, n in found)
    matrix = communication_matrix([n for _, n in found], shard_sizes(total, shards), seed)
    plan = spark.createDataFrame(pa.table({"part": pa.array([p for p, _ in found], pa.int32()), "takes": pa.array(list(matrix), pa.list_(pa.int64()))}))
    columns = numbered.columns

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt: dict[int, np.ndarray] = {}
        for batch in batches:
            at = np.zeros(batch.num_rows, np.int32)
            part, n = batch.column("part").to_numpy(), batch.column("n").to_numpy()
            for p in np.unique(part):
                mine = np.flatnonzero(part == p)
                if p not in dealt:
                    if len(dealt) >= 4:
                        dealt.pop(next(iter(dealt)))
                    takes = batch.column("takes")[int(mine[0])].as_py()
                    dealt[p] = np.random.default_rng([seed, 2, int(p)]).permutation(np.repeat(np.arange(len(takes), dtype=np.int16), takes))
                at[mine] = dealt[p][n[mine]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(at)], names=[*columns, "shard"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema) + ", shard int"
    rows = map_batches(numbered.join(plan, "part").select(*columns, "takes"), deal, schema)
    buckets = max(1, -(-total // (shards * bucket_rows)))
    rnd = F.xxhash64(F.lit(seed), "part", "n")
    rows = written(rows.withColumn("rnd", rnd).withColumn("bucket", F.pmod("rnd", F.lit(buckets)).cast("int")), "dealt")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "bucket").agg(F.count("*").alias("rows")).withColumn("offset", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows")
    inside = Window.partitionBy("shard", "bucket").orderBy(F.xxhash64("rnd"), "part", "n")
    ranked = rows.withColumn("rank", F.row_number().over(inside))
    return ranked.join(offsets, ["shard", "bucket"]).withColumn("slot", F.col("offset") + F.col("rank") - 1).select(*columns, "shard", "slot")


def number_rows(slim: DataFrame) -> DataFrame:
    """The frame, written with `part` and `n` (from 0 in each part)."""
    at = F.monotonically_increasing_id()
    return written(slim.withColumn("part", F.shiftright(at, 33).cast("int")).withColumn("n", at.bitwiseAND(F.lit((1 << 33) - 1))), "numbered")


def shard_rows(df: DataFrame, *, shards: int = 16, seed: int = 17) -> DataFrame:
    """All rows and columns of df in shards, as a struct `row`, with shard and slot."""
    return assign(number_rows(df.select(F.struct("*").alias("row"))), shards=shards, seed=seed).select("row", "shard", "slot")


def write_shards(df: DataFrame, out: str, *, shards: int = 16, seed: int = 17) -> None:
    """Write df as Parquet, a folder per shard, rows in slot order within each file; files ascend by slot."""
    dealt = shard_rows(df, shards=shards, seed=seed)
    dealt.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").select("row.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot")).write.partitionBy("_shard").parquet(out)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15: doc_id, size, text_crc32, law (`rows`), shard, slot, grown_shard (null)."""
    text = text_or_empty()
    slim = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return assign(number_rows(slim)).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
