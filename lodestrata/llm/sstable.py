"""Token shards as sorted string tables.

A shard holds documents in key order. File layout, all numbers little-endian:

    block*            zstd of entries: varint shared, varint unshared, varint value size, key suffix, value
    index             zstd of, for each block: u32 key size, first key, u64 offset, u32 size, u32 crc, u32 entries
    bloom             bit array, 10 bits a key, 7 probes
    footer (80 bytes) u64 index offset, index size, bloom offset, bloom size, documents, tokens, blocks;
                      u32 id width, probes, format; crc32 of these; magic

Keys of a block share prefixes with the key before; the first key of a block is whole. A lookup
reads the footer, asks the filter, finds the block by binary search of the sparse index and reads
that block alone. Keys may repeat (repeated rows); `get` returns all of them, also across blocks.

Nulls: a null text is an empty text (the end id alone), a null key sorts first. Empty tables give
no shard. Rows with one key are ordered by the text's hash and text, so a rerun gives the same bytes.
Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm._shared import filesystem, map_batches, new_dir, table
from lodestrata.llm.tokens import PackedEncoder

MAGIC, FORMAT, PROBES, BITS_A_KEY = b"LSST0001", 1, 7, 10
_FOOTER = struct.Struct("<7Q4I8s")


def key_bytes(key: int | str | None) -> bytes:
    """Bytes that sort as the keys do: null, then numbers, then strings."""
    if key is None:
        return b"\0"
    if isinstance(key, str):
        return b"\2" + key.encode()
    return b"\1" + ((int(key) + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def key_value(raw: bytes) -> int | str | None:
    if raw[:1] == b"\0":
        return None
    return raw[1:].decode() if raw[:1] == b"\2" else int.from_bytes(raw[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _unvarint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    """Double hashing from two checksums of the key."""
    a, b = zlib.crc32(key), zlib.adler32(key[::-1]) * 0x9E3779B1 & 0xFFFFFFFF | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class ShardWriter:
    """Streams entries in key order to one file; what it holds is a block, the index and the keys' filter hashes."""

    def __init__(self, out, width: int, block: int = 64 << 10):
        self.out, self.width, self.limit = out, width, block
        self.at = self.docs = self.tokens = 0
        self.block, self.first, self.last, self.held, self.entries = [], b"", b"", 0, 0
        self.index: list[tuple[bytes, int, int, int, int]] = []
        self.keys: list[bytes] = []
        self.zstd = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, value: bytes) -> None:
        if self.last and key < self.last:
            raise ValueError("keys must ascend")
        if self.held and self.held + len(value) > self.limit:
            self._flush()
        shared = 0
        if self.entries:
            for x, y in zip(key, self.last):
                if x != y:
                    break
                shared += 1
        else:
            self.first = key
        suffix = key[shared:]
        self.block += [_varint(shared), _varint(len(suffix)), _varint(len(value)), suffix, value]
        self.held += len(value) + len(suffix) + 6
        self.entries += 1
        if key != self.last or not self.keys:
            self.keys.append(key)
        self.last = key
        self.docs += 1
        self.tokens += len(value) // self.width

    def _put(self, raw: bytes) -> tuple[int, int, int]:
        self.out.write(raw)
        at, self.at = self.at, self.at + len(raw)
        return at, len(raw), zlib.crc32(raw)

    def _flush(self) -> None:
        if self.entries:
            self.index.append((self.first, *self._put(self.zstd.compress(b"".join(self.block))), self.entries))
            self.block, self.held, self.entries = [], 0, 0

    def close(self) -> None:
        self._flush()
        index = self._put(self.zstd.compress(b"".join(struct.pack("<I", len(k)) + k + struct.pack("<QIII", at, n, crc, m) for k, at, n, crc, m in self.index)))
        bits = max(64, -(-len(self.keys) * BITS_A_KEY // 8) * 8)
        bloom = np.zeros(bits, np.uint8)
        if self.keys:
            bloom[np.array([_probes(k, bits) for k in self.keys]).ravel()] = 1
        bloom = self._put(np.packbits(bloom, bitorder="little").tobytes())
        head = struct.pack("<7Q3I", index[0], index[1], bloom[0], bloom[1], self.docs, self.tokens, len(self.index), self.width, PROBES, FORMAT)
        self._put(head + struct.pack("<I", zlib.crc32(head)) + MAGIC)


class ShardReader:
    """Reads a shard from a random-access file; blocks come one at a time."""

    def __init__(self, file, size: int):
        self.file, self.unzstd = file, zstandard.ZstdDecompressor()
        raw = self._read(size - _FOOTER.size, _FOOTER.size)
        *head, crc, magic = _FOOTER.unpack(raw)
        if magic != MAGIC or crc != zlib.crc32(raw[:-12]):
            raise ValueError("not a whole shard")
        at, n, self.bloom_at, self.bloom_size, self.docs, self.tokens, _, self.width, _, _ = head
        raw, self.index, i = self.unzstd.decompress(self._read(at, n)), [], 0
        while i < len(raw):
            (k,) = struct.unpack_from("<I", raw, i)
            self.index.append((raw[i + 4 : i + 4 + k], *struct.unpack_from("<QIII", raw, i + 4 + k)))
            i += 24 + k
        self.firsts = [x[0] for x in self.index]
        self.bloom: bytes | None = None

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, n, crc, count = self.index[block]
        raw = self._read(at, n)
        if zlib.crc32(raw) != crc:
            raise ValueError(f"block {block} is damaged")
        raw, i, key = self.unzstd.decompress(raw), 0, b""
        for _ in range(count):
            shared, i = _unvarint(raw, i)
            unshared, i = _unvarint(raw, i)
            size, i = _unvarint(raw, i)
            key = key[:shared] + raw[i : i + unshared]
            i += unshared
            yield key, raw[i : i + size]
            i += size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for b in range(len(self.index)):
            yield from self.entries(b)

    def may_have(self, key: bytes) -> bool:
        if self.bloom is None:
            self.bloom = self._read(self.bloom_at, self.bloom_size)
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bloom_size * 8))

    def get(self, key: int | str | None) -> list[np.ndarray]:
        """The ids of every document with this key, in file order."""
        raw, found = key_bytes(key), []
        if not self.may_have(raw):
            return found
        b = max(0, bisect_right(self.firsts, raw) - 1)
        while b > 0 and self.firsts[b] == raw:  # repeated keys may begin in the block before
            b -= 1
        for b in range(b, len(self.index)):
            if self.firsts[b] > raw:
                break
            found += [np.frombuffer(v, f"<u{self.width}") for k, v in self.entries(b) if k == raw]
        return found


def open_shard(uri: str) -> ShardReader:
    fs, path = filesystem(uri)
    return ShardReader(fs.open_input_file(path), fs.get_file_info(path).size)


MANIFEST = "part int, seq int, path string, docs long, tokens long, bytes long"


def write_token_shards(docs: DataFrame, out: str, *, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, shard_bytes: int = 64 << 20) -> None:
    """Write `docs` as token shards below `out`, keys ascending over all shards, and a manifest table.

    One range exchange orders the documents by (key, hash of text), so a key that holds many rows is
    spread over shards too. A task streams its rows to files of about `shard_bytes`; it holds a batch
    and a block. A file's name has the task attempt in it and nothing is moved or replaced: a shard counts
    once the manifest names it, and of a task that ran twice the manifest has the attempt that Spark committed. Files of
    attempts that fail are deleted by them; those of attempts that are killed stay, named by nothing.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    kind = "string" if dict(docs.dtypes)[key] == "string" else "long"
    rows = docs.select(F.col(key).cast(kind).alias("k"), t.alias("t"), F.xxhash64(t).alias("h"))
    rows = rows.repartitionByRange(F.col("k").asc_nulls_first(), F.col("h").asc()).sortWithinPartitions(F.col("k").asc_nulls_first(), "h", "t").select("k", "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, context = PackedEncoder.shared(tokenizer), TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        fs, base = filesystem(out)
        end = np.asarray([end_id], encoder.dtype).tobytes()
        fs.create_dir(base)
        writer = file = None
        seq, done = 0, []

        def name() -> str:
            return f"part-{part:06d}-{seq:05d}-{attempt}.sst"

        def close():
            nonlocal writer, seq
            writer.close()
            file.close()
            done.append({"part": part, "seq": seq, "path": f"{out}/{name()}", "docs": writer.docs, "tokens": writer.tokens, "bytes": writer.at})
            writer, seq = None, seq + 1

        try:
            for batch in batches:
                for k, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1))):
                    if writer is None:
                        file = fs.open_output_stream(f"{base}/{name()}")
                        writer = ShardWriter(file, encoder.width)
                    writer.add(key_bytes(k), ids + end)
                    if writer.at >= shard_bytes:
                        close()
            if writer is not None:
                close()
        except BaseException:
            for path in [f"{base}/{name()}"] * (writer is not None) + [base + d["path"].removeprefix(out) for d in done]:
                if fs.get_file_info(path).type != pafs.FileType.NotFound:
                    fs.delete_file(path)
            raise
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())]))

    # file names have the partition's number, so partitions are not joined before this shuffle of a row a shard
    map_batches(rows, write, MANIFEST).repartition(16).write.parquet(f"{out}/_manifest")


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """The shards in key order, each with the ids and documents before it (a prefix sum over shards, not documents)."""
    w = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.schema(MANIFEST).parquet(f"{out}/_manifest").withColumns({"base": F.coalesce(F.sum("tokens").over(w), F.lit(0)), "docs_before": F.coalesce(F.sum("docs").over(w), F.lit(0))})


def read_token_shards(spark: SparkSession, out: str, *, string_keys: bool = False, ids: bool = True, name: str = "doc_id") -> DataFrame:
    """Documents read back from the shards: key, start, n_tokens, ids_crc32 and (unless ids=False) the ids.

    `start` counts the ids of all documents before; `ids_crc32` is the checksum of the ids as unsigned
    32-bit little-endian integers.
    """
    files = manifest(spark, out)
    n = max(1, spark.read.schema(MANIFEST).parquet(f"{out}/_manifest").count())
    kind = "string" if string_keys else "long"
    schema = f"{name} {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    arrow = pa.schema([(name, pa.string() if string_keys else pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * ids)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = open_shard(path)
                for b in range(len(shard.index)):
                    rows = []
                    for key, value in shard.entries(b):
                        wide = np.frombuffer(value, f"<u{shard.width}").astype("<u4")
                        rows.append({name: key_value(key), "start": at, "n_tokens": len(wide), "ids_crc32": zlib.crc32(wide.tobytes())} | ({"ids": wide.astype(np.int32)} if ids else {}))
                        at += len(wide)
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return map_batches(files.select("path", "base").repartition(n), read, schema)


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token shards in the shared folder, read back: doc_id, start, n_tokens, ids_crc32."""
    out = new_dir(spark, "token-shards")
    write_token_shards(table(spark, sf_dir, "documents"), out)
    return read_token_shards(spark, out, ids=False)
