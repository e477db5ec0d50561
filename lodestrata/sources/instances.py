"""Instance files from frame rows: each is streamed frame by frame, with both offset tables reserved first and patched at the end.

Frames never meet in a row. They come sorted by (instance, frame) after one header row, so a task holds an Arrow batch and one file's
offsets (16 bytes a frame). Files are staged below the target folder, each attempt's under a name of its own; what was staged is written as a table, so that only
attempts that Spark took count, and `write_instances` installs them in one transaction (`journal`).
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.sources import attributes, journal
from lodestrata.sources.dicom import PIXELS, file_meta

NATIVE = "1.2.840.10008.1.2.1"
#: Bytes of an Arrow batch of frames.
BATCH_BYTES = 8 << 20
STAGED = "instance string, name string, staged string, frames long, bytes long, file_bytes long, sha256 string"


class InstanceFile:
    """One file, written from the front; `finish` patches the tables."""

    def __init__(self, path: str, header: bytes, transfer_syntax: str, sop_class: str, sop_instance: str, frames: int):
        self.path, self.native, self.expected = path, transfer_syntax == NATIVE, frames
        self.offsets, self.lengths, self.at, self.written = array("Q"), array("Q"), 0, 0
        self.digest = hashlib.sha256()
        self.file = open(path, "xb", buffering=1 << 20)
        self.file.write(file_meta(sop_class, sop_instance, transfer_syntax) + header)
        if self.native:
            self.pixels = self.file.tell()
            self.file.write(struct.pack("<HH2sHI", *PIXELS, b"OB", 0, 0))
        else:
            self.tables = []
            for tag in (1, 2):
                if 8 * frames > 0xFFFFFFFF - 1:
                    raise ValueError(f"{frames} frames are too many for an offset table")
                self.file.write(struct.pack("<HH2sHI", 0x7FE0, tag, b"OV", 0, 8 * frames))
                self.tables.append(self.file.tell())
                left = 8 * frames
                while left:  # reserved, in pieces
                    left -= self.file.write(bytes(min(left, 1 << 20)))
            self.file.write(struct.pack("<HH2sHI", *PIXELS, b"OB", 0, 0xFFFFFFFF) + struct.pack("<HHI", 0xFFFE, 0xE000, 0))

    def push(self, frame: pa.Buffer | bytes) -> None:
        """Appends a frame: as it is, or as a fragment of even length."""
        size = len(frame)
        if self.native:
            self.file.write(frame)
        else:
            if size > 0xFFFFFFFE:
                raise ValueError(f"a frame of {size} bytes does not fit in a fragment")
            self.offsets.append(self.at), self.lengths.append(size)
            self.file.write(struct.pack("<HHI", 0xFFFE, 0xE000, size + size % 2))
            self.file.write(frame)
            self.file.write(b"\0" * (size % 2))
            self.at += 8 + size + size % 2
        self.digest.update(frame)
        self.written += size

    def finish(self) -> int:
        """Ends the pixel data, patches lengths or tables, syncs, and returns the file's size."""
        if not self.native and len(self.lengths) != self.expected:
            raise ValueError(f"{self.path}: {len(self.lengths)} frames instead of {self.expected}")
        if self.native:
            size = self.written + self.written % 2
            if size > 0xFFFFFFFE:
                raise ValueError(f"{size} bytes are too many for native pixel data")
            self.file.write(b"\0" * (self.written % 2))
            end = self.file.tell()
            self.file.seek(self.pixels + 8)
            self.file.write(struct.pack("<I", size))
        else:
            self.file.write(struct.pack("<HHI", 0xFFFE, 0xE0DD, 0))
            end = self.file.tell()
            for at, values in zip(self.tables, (self.offsets, self.lengths)):
                self.file.seek(at)
                self.file.write(values.tobytes())
        self.file.flush()
        os.fsync(self.file.fileno())
        self.file.close()
        return end

    def drop(self) -> None:
        self.file.close()
        os.remove(self.path)


def _stage(stage: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(stage, exist_ok=True)
        held: tuple | None = None

        def done() -> pa.RecordBatch:
            out, instance, name, staged, frames = held
            row = [instance, name, staged, frames, out.written, out.finish(), out.digest.hexdigest()]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=[f.split()[0] for f in STAGED.split(", ")])

        try:
            for batch in batches:
                raw = batch.column("bytes")
                for i, (instance, head) in enumerate(zip(batch.column("instance").to_pylist(), batch.column("head").to_pylist())):
                    if head is not None:
                        if held:
                            yield done()
                            held = None
                        staged = f"{uuid.uuid4().hex}.part"
                        out = InstanceFile(os.path.join(stage, staged), head["header"], head["transfer_syntax"], head["sop_class"], head["sop_instance"], head["frames"])
                        held = (out, instance, head["name"], staged, head["frames"])
                    elif held is None or held[1] != instance:
                        raise ValueError(f"frames of {instance!r} without its instance")
                    else:
                        held[0].push(raw[i].as_buffer() if raw[i].is_valid else b"")
            if held:
                yield done()
                held = None
        finally:
            if held:
                held[0].drop()

    return run


def staged_instances(instances: DataFrame, frames: DataFrame, stage: str) -> DataFrame:
    """A row per instance of what was staged in the folder `stage`: STAGED.

    instances: (instance, name, transfer_syntax, attributes struct); frames: (instance, frame, bytes). The number of an instance's frames goes to NumberOfFrames,
    if the attributes have it. Instances without frames are written with none; frames of no instance are an error.
    """
    counts = frames.groupBy("instance").agg(F.count("*").alias("frames"))
    known = instances.join(counts, "instance", "left").withColumn("frames", F.coalesce("frames", F.lit(0)))
    fields = instances.schema["attributes"].dataType.fieldNames()
    if "NumberOfFrames" in fields:
        known = known.withColumn("attributes", F.col("attributes").withField("NumberOfFrames", F.col("frames").cast("string")))
    sop = [F.coalesce(F.col(f"attributes.{k}") if k in fields else F.lit(None), F.lit(v)) for k, v in (("SOPClassUID", "1.2.840.10008.5.1.4.1.1.77.1.6"), ("SOPInstanceUID", "2.25.1"))]
    known = known.select(F.col("instance").cast("string").alias("instance"), "name", "transfer_syntax", "frames", sop[0].alias("sop_class"), sop[1].alias("sop_instance"), "attributes")
    heads = attributes.encoded(known, "attributes", "header")
    heads = heads.select("instance", F.lit(None).cast("long").alias("frame"), F.struct("name", "transfer_syntax", "frames", "sop_class", "sop_instance", "header").alias("head"), F.lit(None).cast("binary").alias("bytes"))
    rows = frames.select(F.col("instance").cast("string").alias("instance"), F.col("frame").cast("long").alias("frame"), F.lit(None).cast(heads.schema["head"].dataType).alias("head"), "bytes")
    ordered = heads.unionByName(rows).repartition("instance").sortWithinPartitions("instance", F.col("head").isNull(), "frame")
    return ordered.mapInArrow(_stage(stage), STAGED)


def write_instances(instances: DataFrame, frames: DataFrame, folder: str, *, overwrite: bool = False) -> DataFrame:
    """Writes a file per instance below a folder that the driver and all executors see, in one transaction; returns STAGED with each file's path.

    The folder is locked from the start; a second writer is refused, and what a writer before left half installed is taken back first. The driver reads
    two names an instance, one after the other.
    """
    spark, root = instances.sparkSession, folder.removeprefix("file://")
    os.makedirs(root, exist_ok=True)
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit)
    with journal.FolderLock(root):
        journal.recover(root)
        transaction = journal.Transaction(root)
        listed = f"file://{root.rstrip('/')}/.written/{uuid.uuid4().hex}"
        try:
            spark.conf.set(limit, f"{BATCH_BYTES}b")
            staged_instances(instances, frames, transaction.stage).write.parquet(listed)
            found = spark.read.parquet(listed)
            transaction.commit(((r["name"], r["staged"]) for r in found.select("name", "staged").toLocalIterator()), overwrite)
        except BaseException:
            transaction.abort()
            raise
        finally:
            spark.conf.set(limit, before)
    return found.drop("staged").withColumn("path", F.concat(F.lit(root.rstrip("/") + "/"), "name"))


def offsets_of(path: str) -> tuple[list[int], list[int]]:
    """Both extended offset tables of a file; its pixel data are not read."""
    with open(path, "rb") as f:
        if f.read(132)[128:] != b"DICM":
            raise ValueError("no DICOM preamble")
        found = attributes.decode(f, until=0x7FE00010)
    table = lambda name: found.get(name, [])
    values = [[v] if isinstance(v := table(n), int) else v for n in ("7FE00001", "7FE00002")]
    return values[0], values[1]


def pixels_at(path: str) -> int:
    """Where the first fragment's item begins in a file; offsets count from there."""
    with open(path, "rb") as f:
        f.seek(132)
        attributes.decode(f, until=0x7FE00010)
        if f.read(8) != struct.pack("<HH2sH", *PIXELS, b"OB", 0) or f.read(4) != b"\xff\xff\xff\xff":
            raise ValueError("pixel data are not encapsulated")
        group, low, size = struct.unpack("<HHI", f.read(8))
        if (group, low) != (0xFFFE, 0xE000):
            raise ValueError("pixel data do not begin with an item")
        return f.tell() + size  # after the basic offset table


def stored_offsets(files: DataFrame) -> DataFrame:
    """(instance, frame, offset, length) as the files (instance, path) have them; frames count from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for instance, path in zip(batch.column("instance").to_pylist(), batch.column("path").to_pylist()):
                offsets, lengths = offsets_of(path)
                for i in range(0, len(offsets), 1 << 16):
                    part = range(i, min(i + (1 << 16), len(offsets)))
                    columns = [pa.array([instance] * len(part), pa.string()), pa.array(part, pa.int64()), pa.array(offsets[i : part.stop], pa.int64()), pa.array(lengths[i : part.stop], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["instance", "frame", "offset", "length"])

    return files.select("instance", "path").mapInArrow(run, "instance string, frame long, offset long, length long")
