"""Nested attribute sets: a recursive encoder to explicit VR little endian, and a reader that returns what was encoded.

A set is a mapping from keyword to value; a sequence's value is a list of sets. In Spark a set is a struct whose fields are keywords, a
sequence an array of structs, so `encoded` and `decoded` are columns to columns.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Tag and value representation of the keywords of the public dictionary that whole-slide images use.
DICTIONARY: dict[str, tuple[int, str]] = {
    "ImageType": (0x00080008, "CS"), "SOPClassUID": (0x00080016, "UI"), "SOPInstanceUID": (0x00080018, "UI"), "StudyDate": (0x00080020, "DA"), "ContentDate": (0x00080023, "DA"),
    "AcquisitionDateTime": (0x0008002A, "DT"), "AcquisitionDate": (0x00080022, "DA"), "StudyTime": (0x00080030, "TM"), "AcquisitionTime": (0x00080032, "TM"), "ContentTime": (0x00080033, "TM"),
    "AccessionNumber": (0x00080050, "SH"), "Modality": (0x00080060, "CS"), "Manufacturer": (0x00080070, "LO"), "ReferringPhysicianName": (0x00080090, "PN"),
    "CodeValue": (0x00080100, "SH"), "CodingSchemeDesignator": (0x00080102, "SH"), "CodeMeaning": (0x00080104, "LO"), "StudyDescription": (0x00081030, "LO"),
    "ManufacturerModelName": (0x00081090, "LO"), "VolumetricProperties": (0x00089206, "CS"), "PyramidUID": (0x00080019, "UI"), "FrameType": (0x00089007, "CS"),
    "PatientName": (0x00100010, "PN"), "PatientID": (0x00100020, "LO"), "PatientBirthDate": (0x00100030, "DA"), "PatientSex": (0x00100040, "CS"),
    "SliceThickness": (0x00180050, "DS"), "DeviceSerialNumber": (0x00181000, "LO"), "SoftwareVersions": (0x00181020, "LO"), "FocusMethod": (0x00480011, "CS"), "ExtendedDepthOfField": (0x00480012, "CS"),
    "StudyInstanceUID": (0x0020000D, "UI"), "SeriesInstanceUID": (0x0020000E, "UI"), "StudyID": (0x00200010, "SH"), "SeriesNumber": (0x00200011, "IS"), "InstanceNumber": (0x00200013, "IS"),
    "FrameOfReferenceUID": (0x00200052, "UI"), "Laterality": (0x00200060, "CS"), "PositionReferenceIndicator": (0x00201040, "LO"), "DimensionOrganizationUID": (0x00209164, "UI"),
    "DimensionIndexPointer": (0x00209165, "AT"), "FunctionalGroupPointer": (0x00209167, "AT"), "DimensionIndexValues": (0x00209157, "UL"), "FrameContentSequence": (0x00209111, "SQ"),
    "DimensionOrganizationSequence": (0x00209221, "SQ"), "DimensionIndexSequence": (0x00209222, "SQ"), "DimensionOrganizationType": (0x00209311, "CS"), "PyramidLabel": (0x00200027, "LO"),
    "SamplesPerPixel": (0x00280002, "US"), "PhotometricInterpretation": (0x00280004, "CS"), "PlanarConfiguration": (0x00280006, "US"), "NumberOfFrames": (0x00280008, "IS"),
    "Rows": (0x00280010, "US"), "Columns": (0x00280011, "US"), "PixelSpacing": (0x00280030, "DS"), "BitsAllocated": (0x00280100, "US"), "BitsStored": (0x00280101, "US"), "HighBit": (0x00280102, "US"),
    "PixelRepresentation": (0x00280103, "US"), "BurnedInAnnotation": (0x00280301, "CS"), "ICCProfile": (0x00282000, "OB"), "LossyImageCompression": (0x00282110, "CS"),
    "LossyImageCompressionRatio": (0x00282112, "DS"), "LossyImageCompressionMethod": (0x00282114, "CS"), "RepresentativeFrameNumber": (0x00286010, "US"), "PixelMeasuresSequence": (0x00289110, "SQ"),
    "ContainerIdentifier": (0x00400512, "LO"), "IssuerOfTheContainerIdentifierSequence": (0x00400513, "SQ"), "ContainerTypeCodeSequence": (0x00400518, "SQ"), "AcquisitionContextSequence": (0x00400555, "SQ"),
    "SpecimenIdentifier": (0x00400551, "LO"), "SpecimenUID": (0x00400554, "UI"), "SpecimenDescriptionSequence": (0x00400560, "SQ"), "IssuerOfTheSpecimenIdentifierSequence": (0x00400562, "SQ"),
    "SpecimenShortDescription": (0x00400600, "LO"), "SpecimenDetailedDescription": (0x00400602, "UT"), "SpecimenPreparationSequence": (0x00400610, "SQ"), "XOffsetInSlideCoordinateSystem": (0x0040072A, "DS"),
    "YOffsetInSlideCoordinateSystem": (0x0040073A, "DS"), "ZOffsetInSlideCoordinateSystem": (0x0040074A, "DS"), "ImagedVolumeWidth": (0x00480001, "FL"), "ImagedVolumeHeight": (0x00480002, "FL"),
    "ImagedVolumeDepth": (0x00480003, "FL"), "TotalPixelMatrixColumns": (0x00480006, "UL"), "TotalPixelMatrixRows": (0x00480007, "UL"), "TotalPixelMatrixOriginSequence": (0x00480008, "SQ"),
    "SpecimenLabelInImage": (0x00480010, "CS"), "ImageOrientationSlide": (0x00480102, "DS"), "OpticalPathSequence": (0x00480105, "SQ"), "OpticalPathIdentifier": (0x00480106, "SH"),
    "OpticalPathDescription": (0x00480107, "ST"), "IlluminationColorCodeSequence": (0x00480108, "SQ"), "IlluminationTypeCodeSequence": (0x00220016, "SQ"), "IlluminationWaveLength": (0x00220055, "FL"),
    "OpticalPathIdentificationSequence": (0x00480207, "SQ"), "PlanePositionSlideSequence": (0x0048021A, "SQ"), "ColumnPositionInTotalImagePixelMatrix": (0x0048021E, "SL"),
    "RowPositionInTotalImagePixelMatrix": (0x0048021F, "SL"), "NumberOfOpticalPaths": (0x00480302, "UL"), "TotalPixelMatrixFocalPlanes": (0x00480303, "UL"),
    "WholeSlideMicroscopyImageFrameTypeSequence": (0x00400710, "SQ"), "SharedFunctionalGroupsSequence": (0x52009229, "SQ"), "PerFrameFunctionalGroupsSequence": (0x52009230, "SQ"),
}
_BY_TAG = {tag: (keyword, vr) for keyword, (tag, vr) in DICTIONARY.items()}
_PACKED = {"US": "H", "SS": "h", "UL": "I", "SL": "i", "FL": "f", "FD": "d", "OV": "Q", "UV": "Q", "SV": "q"}
_WIDE = frozenset("OB OD OF OL OV OW SQ SV UC UN UR UT UV".split())
_ITEM, _ITEM_END, _END, _OPEN = 0xFFFEE000, 0xFFFEE00D, 0xFFFEE0DD, 0xFFFFFFFF


def tag_bytes(tag: int) -> bytes:
    return struct.pack("<HH", tag >> 16, tag & 0xFFFF)


def encode(values: dict[str, Any]) -> bytes:
    """The elements of a set in order of their tags; None is left out, an empty list is an empty sequence or value."""
    known = sorted((DICTIONARY[k], v) for k, v in values.items() if v is not None) if values.keys() <= DICTIONARY.keys() else None
    if known is None:
        raise ValueError(f"no such attributes: {sorted(values.keys() - DICTIONARY.keys())}")
    return b"".join(element(tag, vr, v) for (tag, vr), v in known)


def element(tag: int, vr: str, value: Any) -> bytes:
    return _framed(tag, vr, b"".join(map(_item, map(encode, value))) if vr == "SQ" else _value(vr, value))


def _item(body: bytes) -> bytes:
    return tag_bytes(_ITEM) + struct.pack("<I", len(body)) + body


def _framed(tag: int, vr: str, raw: bytes) -> bytes:
    if vr in _WIDE:
        return tag_bytes(tag) + vr.encode() + b"\0\0" + struct.pack("<I", len(raw)) + raw
    if len(raw) > 0xFFFF:
        raise ValueError(f"{len(raw)} bytes are too many for {vr}")
    return tag_bytes(tag) + vr.encode() + struct.pack("<H", len(raw)) + raw


def _value(vr: str, value: Any) -> bytes:
    if isinstance(value, (bytes, bytearray)):
        return bytes(value) + b"\0" * (len(value) % 2)
    many = value if isinstance(value, (list, tuple)) else [value]
    if vr == "AT":
        return b"".join(tag_bytes(DICTIONARY[v][0] if isinstance(v, str) else v) for v in many)
    if vr in _PACKED:
        return struct.pack(f"<{len(many)}{_PACKED[vr]}", *many)
    raw = "\\".join(map(str, many)).encode()
    return raw + (b"\0" if vr == "UI" else b" ") * (len(raw) % 2)


def decode(raw: bytes | BinaryIO, *, implicit: bool = False, until: int = 0x7FE00000, only: frozenset[str] | None = None) -> dict[str, Any]:
    """The set that `raw` encodes, up to the tag `until`; sequences of defined and of undefined length, explicit and implicit representation.

    Text of several values is a list, numbers are numbers (lists of them if there are several), tags are keywords; tags that the
    dictionary lacks are named by eight hexadecimal digits and are bytes. `only`: keywords of the outer set to keep; of others the bytes are passed over.
    """
    if only is not None and isinstance(raw, bytes) and not implicit and only <= DICTIONARY.keys():
        kept = _elements(raw, until, {DICTIONARY[n][0] for n in only})
        raw = raw if kept is None else b"".join(kept)
    file = io.BytesIO(raw) if isinstance(raw, (bytes, bytearray)) else raw
    return _set(file, implicit, until, None, only)


_WIDE_BYTES = frozenset(vr.encode() for vr in _WIDE)
_HEAD, _LENGTH = struct.Struct("<HH2sH"), struct.Struct("<I")


def _elements(raw: bytes, until: int, tags: set[int]) -> list[bytes] | None:
    """The elements of these tags in an explicit set; None if it has a length that is open or too long, or ends within a head."""
    out, at = [], 0
    while at < len(raw):
        if at + 8 > len(raw):
            return None
        group, low, vr, length = _HEAD.unpack_from(raw, at)
        tag, head = group << 16 | low, 8
        if group == 0xFFFE:
            return None
        if until and tag >= until:
            break
        if vr in _WIDE_BYTES:
            if at + 12 > len(raw):
                return None
            (length,), head = _LENGTH.unpack_from(raw, at + 8), 12
        end = at + head + length
        if end > len(raw) or (head == 12 and length == _OPEN):
            return None
        if tag in tags:
            out.append(raw[at:end])
        at = end
    return out


def _set(file: BinaryIO, implicit: bool, until: int, size: int | None, only: frozenset[str] | None = None) -> dict[str, Any]:
    end, out = None if size is None else file.tell() + size, {}
    while end is None or file.tell() < end:
        head = file.read(4)
        if len(head) < 4:
            break
        group, low = struct.unpack("<HH", head)
        tag = group << 16 | low
        if tag == _ITEM_END:
            file.read(4)
            break
        if until and tag >= until and group != 0xFFFE:
            file.seek(-4, 1)
            break
        name, vr = _BY_TAG.get(tag, (f"{tag:08X}", "UN"))
        if implicit:
            (length,) = struct.unpack("<I", file.read(4))
        else:
            vr = file.read(2).decode("ascii")
            length = struct.unpack("<I", file.read(6)[2:])[0] if vr in _WIDE else struct.unpack("<H", file.read(2))[0]
        if only is not None and name not in only and length != _OPEN:
            if len(file.read(length)) < length:
                raise ValueError(f"{name} ends early")
        elif vr == "SQ" or length == _OPEN:
            out[name] = list(_items(file, implicit, None if length == _OPEN else length))
        else:
            raw = file.read(length)
            if len(raw) < length:
                raise ValueError(f"{name} ends early")
            out[name] = _read(vr, raw)
    return out


def _items(file: BinaryIO, implicit: bool, size: int | None) -> Iterator[dict[str, Any]]:
    end = None if size is None else file.tell() + size
    while end is None or file.tell() < end:
        head = file.read(8)
        if len(head) < 8:
            raise ValueError("a sequence ends early")
        group, low, length = struct.unpack("<HHI", head)
        tag = group << 16 | low
        if tag == _END:
            return
        if tag != _ITEM:
            raise ValueError(f"{tag:08X} is no item")
        yield _set(file, implicit, 0, None if length == _OPEN else length)


def _read(vr: str, raw: bytes) -> Any:
    if vr in _PACKED:
        many = list(struct.unpack(f"<{len(raw) // struct.calcsize(_PACKED[vr])}{_PACKED[vr]}", raw))
    elif vr == "AT":
        many = [_BY_TAG.get(t := a << 16 | b, (t, ""))[0] for a, b in struct.iter_unpack("<HH", raw)]
    elif vr in ("OB", "OD", "OF", "OL", "OW", "UN"):
        return raw
    else:
        text = raw.decode("utf-8", "replace").rstrip("\0 ")
        many = [text] if vr in ("LT", "ST", "UR", "UT") else text.split("\\")
    return many[0] if len(many) == 1 else many


def encoded_sets(sets: pa.StructArray) -> list[bytes]:
    """`encode` of each set of an array (null: as an empty one), field by field: a value that was met before is looked up."""
    fields = sets.type
    if unknown := {f.name for f in fields} - DICTIONARY.keys():
        raise ValueError(f"no such attributes: {sorted(unknown)}")
    columns = [_encoded_field(DICTIONARY[name], sets.field(name)) for name in sorted((f.name for f in fields), key=DICTIONARY.__getitem__)]
    return list(map(b"".join, zip(*columns))) if columns else [b""] * len(sets)


def _encoded_field(known: tuple[int, str], values: pa.Array) -> list[bytes]:
    tag, vr = known
    kind, lists = values.type, pa.types.is_list(values.type)
    if not lists and not pa.types.is_floating(kind):
        coded = values.dictionary_encode()
        made = [*(element(tag, vr, v) for v in coded.dictionary.to_pylist()), b""]
        return list(map(made.__getitem__, coded.indices.fill_null(len(made) - 1).to_pylist() if coded.indices.null_count else coded.indices.to_numpy().tolist()))
    if not lists or pa.types.is_floating(kind.value_type):  # 0.0 and -0.0 are equal, but not their bytes
        return [b"" if v is None else element(tag, vr, v) for v in values.to_pylist()]
    if sets := vr == "SQ" and pa.types.is_struct(kind.value_type):
        items = encoded_sets(values.values)
    else:
        items = values.values.to_pylist()
    bounds, out, seen = values.offsets.to_pylist(), [], {}
    for i, j, there in zip(bounds, bounds[1:], values.is_valid().to_pylist()):
        if not there:
            out.append(b"")
            continue
        key = tuple(items[i:j])
        if key not in seen:
            seen[key] = _framed(tag, vr, b"".join(map(_item, key))) if sets else element(tag, vr, key)
        out.append(seen[key])
    return out


def plain(value: Any) -> Any:
    """A Spark value as sets and lists: nulls of a struct are left out."""
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items() if v is not None}
    return [plain(v) for v in value] if isinstance(value, list) else value


def encoded(rows: DataFrame, column: str, to: str) -> DataFrame:
    """rows with the struct `column` encoded in the binary column `to` (in its place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = batch.column(column)
            raw = pa.array([raw if there else None for raw, there in zip(encoded_sets(sets), sets.is_valid().to_pylist())], pa.binary())
            names = [to if n == column else n for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays([raw if n == column else c for n, c in zip(batch.schema.names, batch.columns)], names=names)

    schema = T.StructType([T.StructField(to, T.BinaryType()) if f.name == column else f for f in rows.schema])
    return rows.mapInArrow(run, schema)


def decoded(rows: DataFrame, column: str, to: str, kind: T.StructType) -> DataFrame:
    """rows with the binary `column` read into a struct of type `kind`, whose fields are keywords (in its place); others are left out."""
    from pyspark.sql.pandas.types import to_arrow_type

    arrow, names_ = to_arrow_type(kind), frozenset(kind.names)
    tags = {DICTIONARY[n][0] for n in names_} if names_ <= DICTIONARY.keys() else None
    nothing = dict.fromkeys(kind.names)
    met: dict[bytes, dict[str, Any]] = {}

    def shaped(value: Any, type_: T.DataType) -> Any:
        if isinstance(type_, T.StructType):
            return {f.name: shaped(value[f.name], f.dataType) if f.name in value else None for f in type_}
        if isinstance(type_, T.ArrayType):
            return [shaped(v, type_.elementType) for v in (value if isinstance(value, list) else [value])]
        return type_.fromInternal(str(value) if isinstance(type_, T.StringType) else value)

    def row(raw: bytes) -> dict[str, Any]:
        parts = None if tags is None else _elements(raw, 0x7FE00000, tags)
        if parts is None:
            return shaped(decode(raw, only=names_), kind)
        out = dict(nothing)
        for part in parts:
            if part not in met:
                if len(met) > 10_000:
                    met.clear()
                met[part] = {n: shaped(v, kind[n].dataType) for n, v in decode(part).items()}
            out.update(met[part])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([None if v is None else row(v) for v in batch.column(column).to_pylist()], arrow)
            names = [to if n == column else n for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays([found if n == column else c for n, c in zip(batch.schema.names, batch.columns)], names=names)

    schema = T.StructType([T.StructField(to, kind) if f.name == column else f for f in rows.schema])
    return rows.mapInArrow(run, schema)
