"""DICOM files: a header reader that never touches pixels, and a writer of encapsulated frames with staged commit.

Only what the engine needs of the public standard: explicit VR little endian, file meta group, the whole-slide image module's
key elements, encapsulated pixel data with an extended offset table.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from lodestrata.sources import journal

_LONG = frozenset([b"OB", b"OW", b"OF", b"OD", b"OL", b"OV", b"SQ", b"UC", b"UR", b"UT", b"UN", b"SV", b"UV"])
IMPLICIT_LE = "1.2.840.10008.1.2"
#: Tags of the columns that the reader returns.
TAGS = {
    "sop_class_uid": (0x0008, 0x0016), "sop_instance_uid": (0x0008, 0x0018), "modality": (0x0008, 0x0060), "patient_name": (0x0010, 0x0010), "patient_id": (0x0010, 0x0020),
    "study_uid": (0x0020, 0x000D), "series_uid": (0x0020, 0x000E), "photometric": (0x0028, 0x0004), "number_of_frames": (0x0028, 0x0008), "rows": (0x0028, 0x0010),
    "columns": (0x0028, 0x0011), "bits_allocated": (0x0028, 0x0100), "samples": (0x0028, 0x0002), "total_columns": (0x0048, 0x0006), "total_rows": (0x0048, 0x0007),
}
_NUMBERS = frozenset(["number_of_frames", "rows", "columns", "bits_allocated", "samples", "total_columns", "total_rows"])
PIXELS = (0x7FE0, 0x0010)


def element(group: int, tag: int, vr: str, value: bytes | str | int | list) -> bytes:
    """One explicit-VR element; text is padded with a space (UI with a zero), numbers are packed by VR."""
    if isinstance(value, (int, list)) and vr in ("US", "UL", "FL", "FD", "OV"):
        many = value if isinstance(value, list) else [value]
        raw = struct.pack(f"<{len(many)}{ {'US': 'H', 'UL': 'I', 'FL': 'f', 'FD': 'd', 'OV': 'Q'}[vr] }", *many)
    else:
        raw = str(value).encode() if not isinstance(value, bytes) else value
        raw += (b"\0" if vr in ("UI", "OB") else b" ") * (len(raw) % 2)
    if vr.encode() in _LONG:
        return struct.pack("<HH2sHI", group, tag, vr.encode(), 0, len(raw)) + raw
    return struct.pack("<HH2sH", group, tag, vr.encode(), len(raw)) + raw


def file_meta(sop_class: str, sop_instance: str, transfer_syntax: str) -> bytes:
    body = element(2, 1, "OB", b"\0\1") + element(2, 2, "UI", sop_class) + element(2, 3, "UI", sop_instance) + element(2, 0x10, "UI", transfer_syntax) + element(2, 0x12, "UI", "2.25.1")
    return b"\0" * 128 + b"DICM" + element(2, 0, "UL", len(body)) + body


def item(raw: bytes) -> bytes:
    """A fragment: header, bytes, and one zero if their number is odd."""
    return struct.pack("<HHI", 0xFFFE, 0xE000, len(raw) + len(raw) % 2) + raw + b"\0" * (len(raw) % 2)


def encapsulated(frames: list[bytes]) -> bytes:
    """Extended offset tables and pixel data of one fragment a frame."""
    offsets, lengths, at = [], [], 0
    for f in frames:
        offsets.append(at)
        lengths.append(len(f))
        at += 8 + len(f) + len(f) % 2
    head = element(0x7FE0, 1, "OV", offsets) + element(0x7FE0, 2, "OV", lengths)
    return head + struct.pack("<HH2sHI", *PIXELS, b"OB", 0, 0xFFFFFFFF) + item(b"") + b"".join(map(item, frames)) + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)


def instance_bytes(header: dict, frames: list[bytes], transfer_syntax: str) -> bytes:
    """A whole file; elements are written in tag order."""
    sop_class = "1.2.840.10008.5.1.4.1.1.77.1.6"
    known = {"sop_class_uid": sop_class, "modality": "SM", "number_of_frames": str(len(frames)), **header}
    kinds = dict.fromkeys(("rows", "columns", "bits_allocated", "samples"), "US") | dict.fromkeys(("total_columns", "total_rows"), "UL") | {"number_of_frames": "IS", "patient_name": "PN", "patient_id": "LO", "modality": "CS", "photometric": "CS"}
    body = b"".join(element(*TAGS[k], kinds.get(k, "UI"), known[k]) for k in sorted((k for k in known if k in TAGS), key=TAGS.get))
    native = transfer_syntax == "1.2.840.10008.1.2.1"
    pixels = element(*PIXELS, "OB", b"".join(frames)) if native else encapsulated(frames)
    return file_meta(sop_class, known.get("sop_instance_uid", "2.25.1"), transfer_syntax) + body + pixels


def read_header(file) -> dict:
    """Columns of TAGS and the transfer syntax; reads up to the pixel data."""
    if file.read(132)[128:] != b"DICM":
        raise ValueError("no DICOM preamble")
    by_tag, out = {v: k for k, v in TAGS.items()}, {}
    implicit = False
    while len(head := file.read(8)) == 8:
        group, tag = struct.unpack("<HH", head[:4])
        if group != 2 and out.get("transfer_syntax") == IMPLICIT_LE:
            implicit = True
        if (group, tag) >= (0x7FE0, 0):
            break
        if implicit:
            vr, size = b"UN", struct.unpack("<I", head[4:])[0]
        elif head[4:6] in _LONG:
            vr, size = head[4:6], struct.unpack("<I", file.read(4))[0]
        else:
            vr, size = head[4:6], struct.unpack("<H", head[6:])[0]
        if size == 0xFFFFFFFF:
            _skip_sequence(file, implicit)
            continue
        name = "transfer_syntax" if (group, tag) == (2, 0x10) else by_tag.get((group, tag))
        if name is None:
            file.seek(size, 1)
            continue
        raw = file.read(size)
        if vr == b"US":
            out[name] = struct.unpack("<H", raw[:2])[0]
        elif vr == b"UL":
            out[name] = struct.unpack("<I", raw[:4])[0]
        else:
            text = raw.rstrip(b"\0 ").decode("utf-8", "replace")
            out[name] = (int(text) if text.strip().isdigit() else 0) if name in _NUMBERS else text
    return out


def _skip_sequence(file, implicit: bool) -> None:
    """Over the items of a sequence of undefined length."""
    while len(head := file.read(8)) == 8:
        group, tag, size = struct.unpack("<HHI", head)
        if (group, tag) == (0xFFFE, 0xE0DD):
            return
        if size != 0xFFFFFFFF:
            file.seek(size, 1)
            continue
        while len(inner := file.read(8)) == 8:
            group, tag = struct.unpack("<HH", inner[:4])
            if (group, tag) == (0xFFFE, 0xE00D):
                break
            if implicit:
                n = struct.unpack("<I", inner[4:])[0]
            elif inner[4:6] in _LONG:
                n = struct.unpack("<I", file.read(4))[0]
            else:
                n = struct.unpack("<H", inner[6:])[0]
            _skip_sequence(file, implicit) if n == 0xFFFFFFFF else file.seek(n, 1)


COLUMNS = ["path", "transfer_syntax", *TAGS, "error"]
SCHEMA = ", ".join(f"{c} {'long' if c in _NUMBERS else 'string'}" for c in COLUMNS)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class DicomHeaders(DataSource):
    """`spark.read.format("dicom_headers").load(folder)`: a row per `.dcm` file; a file that cannot be read has its `error`."""

    @classmethod
    def name(cls) -> str:
        return "dicom_headers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _HeaderReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return InstanceWriter(self.options, schema, overwrite)


class _HeaderReader(DataSourceReader):
    def __init__(self, options):
        from lodestrata.sources.listing import _Listing

        self.listing = _Listing({**options, "suffixes": "dcm"})

    def partitions(self) -> list[InputPartition]:
        paths = self.listing.found()
        return [_Files(paths[i : i + 200]) for i in range(0, len(paths), 200)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                with open(path, "rb") as f:
                    found = read_header(f)
                error = None
            except (OSError, ValueError, struct.error) as e:
                found, error = {}, str(e)
            yield tuple(path if c == "path" else error if c == "error" else found.get(c, 0 if c in _NUMBERS else None) for c in COLUMNS)


class _Staged(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class InstanceWriter(DataSourceWriter):
    """Writes rows (name, header json, transfer_syntax, frames array<binary>), a file each, below a folder that all tasks see.

    For small instances that fit in a row; `instances.write_instances` streams large ones. Files are staged in a folder of the write. The commit takes the
    folder's lock, takes back what a commit before left half done, and installs all files in one transaction (`journal`). Other writers' staging
    folders are left alone; a write that ends without a commit takes its own away.
    """

    def __init__(self, options, schema, overwrite: bool):
        self.root = options["path"].removeprefix("file://")
        self.overwrite, self.fields = overwrite, [f.name for f in schema.fields]
        self.stage = os.path.join(self.root, f"{journal.STAGING}{uuid.uuid4().hex}")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        os.makedirs(self.stage, exist_ok=True)
        files = []
        for row in rows:
            r = dict(zip(self.fields, row))
            name, staged = journal.safe_name(r["name"]), f"{uuid.uuid4().hex}.part"
            with open(os.path.join(self.stage, staged), "xb") as f:
                f.write(instance_bytes(json.loads(r["header"] or "{}"), [bytes(x) for x in r["frames"]], r["transfer_syntax"]))
                f.flush()
                os.fsync(f.fileno())
            files.append((name, staged))
        return _Staged(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        os.makedirs(self.stage, exist_ok=True)
        transaction = journal.Transaction(self.root, self.stage)
        try:
            with journal.FolderLock(self.root):
                journal.recover(self.root)
                transaction.commit([f for m in messages if m for f in m.files], self.overwrite)
        except (OSError, ValueError):
            transaction.abort()
            raise

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        journal.Transaction(self.root, self.stage).abort()
