"""Headers of codestreams and pictures, read from binary columns by Arrow UDFs.

Each function has a plain form on bytes and a column form; damaged input gives null, never an error.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def codestream_is_rpcl(raw: bytes | None) -> bool | None:
    """Whether a JPEG 2000 codestream's coding style names the progression RPCL (2); None for what is no codestream or ends before it."""
    if not raw or raw[:2] != b"\xff\x4f":
        return None
    at = 2
    while at + 4 <= len(raw):
        marker, size = struct.unpack_from(">HH", raw, at)
        if marker in (0xFF90, 0xFF93, 0xFFD9) or marker < 0xFF00 or size < 2:
            return None
        if marker == 0xFF52:
            return raw[at + 5] == 2 if at + 6 <= len(raw) and size >= 4 else None
        at += 2 + size
    return None


def jpeg_icc_chunks(raw: bytes | None) -> list[tuple[int, int, bytes]]:
    """(number, count, data) of the colour profile's segments before the scan."""
    out, at = [], 2
    while raw and raw[:2] == b"\xff\xd8" and at + 4 <= len(raw):
        marker, size = struct.unpack_from(">HH", raw, at)
        if marker == 0xFFDA or marker < 0xFF00 or size < 2:
            break
        body = raw[at + 4 : at + 2 + size]
        if marker == 0xFFE2 and body[:12] == b"ICC_PROFILE\0" and len(body) >= 14:
            out.append((body[12], body[13], body[14:]))
        at += 2 + size
    return out


def jpeg_icc_profile(raw: bytes | None) -> bytes | None:
    """The whole profile; None if there is none or its chunks are not 1 to n, each once, of one count."""
    chunks = sorted(jpeg_icc_chunks(raw))
    numbers, counts = [c[0] for c in chunks], {c[1] for c in chunks}
    if not chunks or len(counts) != 1 or numbers != list(range(1, counts.pop() + 1)):
        return None
    return b"".join(c[2] for c in chunks)


def stable_icc(profile: bytes) -> bytes:
    """The profile with its creation date (bytes 24 to 35) set to the first of January 2000."""
    return profile[:24] + struct.pack(">6H", 2000, 1, 1, 0, 0, 0) + profile[36:] if len(profile) >= 36 else profile


def pnm_header(raw: bytes | None) -> tuple[str, int, int, int, int] | None:
    """(kind, width, height, most, bytes of samples) of a binary PGM or PPM; None if the header or the size is wrong."""
    if not raw or raw[:2] not in (b"P5", b"P6"):
        return None
    numbers, at = [], 2
    while len(numbers) < 3:
        while at < len(raw) and (raw[at : at + 1].isspace() or raw[at : at + 1] == b"#"):
            at = raw.find(b"\n", at) if raw[at : at + 1] == b"#" else at + 1
            if at < 0:
                return None
        end = at
        while end < len(raw) and raw[end : end + 1].isdigit() and end - at < 64:
            end += 1
        if end == at:
            return None
        numbers.append(int(raw[at:end]))
        at = end
    w, h, most = numbers
    if not (0 < w < 1 << 32 and 0 < h < 1 << 32 and 0 < most < 65536) or not raw[at : at + 1].isspace():
        return None
    size = w * h * (3 if raw[1:2] == b"6" else 1) * (2 if most > 255 else 1)
    return (raw[:2].decode(), w, h, most, size) if len(raw) - at - 1 == size else None


def pad_samples(raw: bytes, w: int, h: int, out_w: int, out_h: int, sample: int) -> bytes:
    """Row-major samples copied to the upper left of a zero-filled picture; `sample` is bytes a pixel."""
    out = bytearray(out_w * out_h * sample)
    line = min(w, out_w) * sample
    for y in range(min(h, out_h)):
        out[y * out_w * sample : y * out_w * sample + line] = raw[y * w * sample : y * w * sample + line]
    return bytes(out)


def _column(function: Callable, kind: str) -> Callable[[Column], Column]:
    @F.pandas_udf(kind)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for raw in batches:
            yield raw.map(lambda b: function(None if b is None else bytes(b)), na_action=None).astype(object)

    return apply


def is_rpcl(raw: Column) -> Column:
    return _column(codestream_is_rpcl, "boolean")(raw)


def icc_profile(raw: Column) -> Column:
    return _column(jpeg_icc_profile, "binary")(raw)


def be_u16(raw: Column, at: int) -> Column:
    """Big-endian 16-bit number at a byte, in the JVM."""
    return F.conv(F.hex(F.substring(raw, at + 1, 2)), 16, 10).cast("int")


def u64_values(raw: Column) -> Column:
    """Little-endian unsigned 64-bit numbers of a binary value, as decimals, in the JVM; null for null, and for bytes that are no whole numbers."""
    byte = lambda at: F.hex(F.substring(raw, at, F.lit(1)))
    one = lambda i: F.conv(F.concat(*(byte((i * 8 + k).cast("int")) for k in range(8, 0, -1))), 16, 10).cast("decimal(20,0)")
    n = F.octet_length(raw)
    whole = F.when(n == 0, F.array().cast("array<decimal(20,0)>")).otherwise(F.transform(F.sequence(F.lit(0), F.call_function("div", n, F.lit(8)).cast("int") - 1), one))
    return F.when(n % 8 == 0, whole)


def deterministic_rgb(w: int, h: int) -> bytes:
    """Fixture picture: each channel a linear form of x and y, modulo 256."""
    #: Coefficients of x and y for red, green and blue.
    coefficients = ((37, 11), (17, 29), (7, 43))
    return bytes((a * x + b * y) & 255 for y in range(h) for x in range(w) for a, b in coefficients)


def prepare_samples(raw: bytes | None, w: int, h: int, channels: int, bits: int, out_w: int, out_h: int, limit: int = 1 << 30) -> tuple[bytes, int] | None:
    """(samples, channels) of an interleaved tile laid into out_w x out_h, zeros elsewhere; a fourth channel is dropped if it is opaque everywhere.

    None for a wrong size, other channel counts or bit depths, a tile larger than the output, an alpha that is not opaque, and results over the limit.
    """
    size = bits // 8
    if raw is None or channels not in (1, 3, 4) or bits not in (8, 16) or w > out_w or h > out_h or len(raw) != w * h * channels * size:
        return None
    if channels == 4:
        full = b"\xff" * size
        step = 4 * size
        if any(raw[i + 3 * size : i + step] != full for i in range(0, len(raw), step)):
            return None
        raw, channels = b"".join(raw[i : i + 3 * size] for i in range(0, len(raw), step)), 3
    if out_w * out_h * channels * size > limit:
        return None
    return (raw if (w, h) == (out_w, out_h) else pad_samples(raw, w, h, out_w, out_h, channels * size)), channels


def prepared(raw: Column, w: Column, h: Column, channels: Column, bits: Column, out_w: int, out_h: int) -> Column:
    """struct(samples, channels) of tiles, by Arrow batches."""

    @F.pandas_udf("samples binary, channels int")
    def apply(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            rows = [prepare_samples(None if b is None else bytes(b), int(x), int(y), int(c), int(n), out_w, out_h) or (None, None) for b, x, y, c, n in zip(*columns)]
            yield pd.DataFrame(rows, columns=["samples", "channels"]).astype({"channels": "Int32"})

    return apply(raw, w, h, channels, bits)
