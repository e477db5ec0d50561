"""Variable-capacity best-fit packing of documents into training sequences.

A document takes as many tokens as its whole text has, plus one end id. Longer ones than the largest length
are cut into pieces of that length and a rest; nothing is dropped. Pieces are dealt into groups of about
`GROUP_ROWS` at random, by row numbers of the written table of lengths, and each group is packed by itself: pieces in
descending order go to the open bin with the least room that still holds them. If none does, a bin is opened: each permitted
length that holds the piece is tried against the sizes not placed yet (the piece, then always the largest that still
goes in), and the one with the least cost per token it would hold, after downsizing, is taken. So the lengths are chosen together,
for the sizes at hand. At last each bin takes the least costly length that holds its contents.

Null and empty texts take one token. Null and repeated ids are rows as others. Equal lengths are taken in the order of
row numbers. Empty tables give no row. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm._shared import map_batches, table, text_or_empty
from lodestrata.llm.sharding import number_rows
from lodestrata.llm.tokens import PackedEncoder

LENGTHS = (512, 1024, 2048, 4096, 8192)
GROUP_ROWS = 4096


def cost(length: int) -> float:
    """Cost of a sequence: a fixed part, its tokens, and attention over them."""
    return 64 + length + length * length / 65536


def fill(size: int, length: int, counts: list[int], present: int) -> int:
    """Tokens of a bin of that length that takes a piece of that size, and then always the largest size that still goes in.

    counts: pieces of each size that are not placed (the first piece not among them); present: bit s is set if there is one of size s.
    """
    room = length - size
    while room and (fits := present & ((2 << room) - 1)):
        s = fits.bit_length() - 1
        room -= s * min(counts[s], room // s)
        present = fits & ~(1 << s)
    return length - room


def best_length(size: int, counts: list[int], present: int, lengths: tuple[int, ...], price) -> int:
    """The permitted length with the least cost per token it would hold; the smaller of equal ones."""
    best = None
    for length in lengths:
        if length < size:
            continue
        held = fill(size, length, counts, present)
        found = min(price(x) for x in lengths if x >= held) / held
        if best is None or found < best[0]:
            best = (found, length)
    return best[1]


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, price=cost) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, its offset there, length of each bin); no size is over the largest length, none below 1."""
    lengths = tuple(sorted(lengths))
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    counts, present = [0] * (lengths[-1] + 1), 0  # of the pieces not placed
    for n in sizes:
        counts[n] += 1
        present |= 1 << n
    where, offset = [0] * len(sizes), [0] * len(sizes)
    room: dict[int, list[int]] = {}  # bins by their room
    rooms = 0  # bit r is set if a bin has room r
    capacity, filled = [], []
    for i in order:
        n = sizes[i]
        counts[n] -= 1
        if not counts[n]:
            present &= ~(1 << n)
        fits = rooms >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                rooms &= ~(1 << r)
        else:
            b = len(capacity)
            capacity.append(best_length(n, counts, present, lengths, price))
            filled.append(0)
        where[i], offset[i] = b, filled[b]
        filled[b] += n
        r = capacity[b] - filled[b]
        room.setdefault(r, []).append(b)
        rooms |= 1 << r
    return where, offset, [min((x for x in lengths if x >= f), key=price) for f in filled]


def token_counts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """(id, n): tokens of each row's whole text and one end id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PackedEncoder.shared(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            n = np.fromiter((encoder.count(texts[i].as_py()) + 1 for i in range(len(texts))), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], names=["id", "size"])

    kind = dict(docs.dtypes)[key]
    return map_batches(docs.select(F.col(key).alias("id"), text_or_empty(text).alias("t")), count, f"id {kind}, size long")


def pack_rows(sizes: DataFrame, *, lengths: tuple[int, ...] = LENGTHS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Packs rows (id, size): id, piece, piece_start, n_tokens, bin, capacity, bin_offset."""
    most = max(lengths)
    rows = number_rows(sizes)
    pieces = F.sequence(F.lit(0), ((F.greatest("size", F.lit(1)) - 1) / most).cast("int"))
    cut = rows.select("id", "size", "part", "n", F.explode(pieces).alias("piece"))
    cut = cut.select("id", "part", "n", "piece", (F.col("piece").cast("long") * most).alias("piece_start"), F.least(F.lit(most), F.col("size") - F.col("piece").cast("long") * most).alias("n_tokens"))
    full = cut.where(F.col("n_tokens") == most)
    whole = full.select("id", "piece", "piece_start", "n_tokens", F.concat_ws("-", F.lit("w"), "part", "n", "piece").alias("bin"), F.lit(most).alias("capacity"), F.lit(0).alias("bin_offset"))
    rest = cut.where(F.col("n_tokens") < most)
    groups = max(1, -(-rows.count() // group_rows))
    kind = dict(sizes.dtypes)["id"]

    def group(block: pa.Table) -> pa.Table:
        block = block.sort_by([("part", "ascending"), ("n", "ascending"), ("piece", "ascending")])
        where, offset, capacity = pack(block.column("n_tokens").to_pylist(), lengths)
        name = str(block.column("group")[0].as_py()) if block.num_rows else ""
        return pa.table(
            {
                **{c: block.column(c) for c in ("id", "piece", "piece_start", "n_tokens")},
                "bin": pa.array([f"g-{name}-{b}" for b in where], pa.string()),
                "capacity": pa.array([capacity[b] for b in where], pa.int32()),
                "bin_offset": pa.array(offset, pa.int32()),
            }
        )

    dealt = rest.withColumn("group", F.pmod(F.xxhash64("part", "n", "piece"), F.lit(groups)).cast("int"))
    packed = dealt.groupBy("group").applyInArrow(group, f"id {kind}, piece int, piece_start long, n_tokens long, bin string, capacity int, bin_offset int")
    return whole.unionByName(packed)


def pack_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lengths: tuple[int, ...] = LENGTHS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Packs the documents: key, piece, piece_start, n_tokens, bin, capacity, bin_offset."""
    return pack_rows(token_counts(docs, key=key, text=text), lengths=lengths, group_rows=group_rows).withColumnRenamed("id", key)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 512 to 8192 tokens: one row per piece."""
    return pack_documents(table(spark, sf_dir, "documents"))
