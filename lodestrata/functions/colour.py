"""Colour profiles of RGB spaces, built from primaries: a header, a table of tags, and values in fixed point, as the public format has them."""

from __future__ import annotations

import struct

import numpy as np

#: Chromaticities of red, green and blue of two public colour spaces, and of their white (D65).
SRGB = ((0.64, 0.33), (0.30, 0.60), (0.15, 0.06))
DISPLAY_P3 = ((0.680, 0.320), (0.265, 0.690), (0.150, 0.060))
D65 = (0.3127, 0.3290)
#: The connection space's white, the cone responses for adaptation to it, and the transfer curve of both spaces.
PCS_WHITE = (0.9642, 1.0, 0.8249)
BRADFORD = ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296))
CURVE = (2.4, 1 / 1.055, 0.055 / 1.055, 1 / 12.92, 0.04045)
#: When the profiles were made, as they say: not when they were written, so equal profiles have equal bytes.
CREATED = (2000, 1, 1, 0, 0, 0)


def _xyz(chromaticity: tuple[float, float]) -> np.ndarray:
    x, y = chromaticity
    return np.array([x / y, 1.0, (1 - x - y) / y])


def adaptation(white: tuple[float, float]) -> np.ndarray:
    """The matrix that takes colours seen under `white` to the connection space's white."""
    cones = np.array(BRADFORD)
    source, target = cones @ _xyz(white), cones @ np.array(PCS_WHITE)
    return np.linalg.inv(cones) @ np.diag(target / source) @ cones


def colorants(primaries: tuple, white: tuple[float, float] = D65) -> np.ndarray:
    """Columns: red, green and blue in the connection space; they add up to its white."""
    columns = np.array([_xyz(p) for p in primaries]).T
    return adaptation(white) @ (columns * np.linalg.solve(columns, _xyz(white)))


def _fixed(values) -> bytes:
    return b"".join(struct.pack(">i", int(round(float(v) * 65536))) for v in values)


def _text(text: str) -> bytes:
    raw = text.encode("utf-16-be")
    return b"mluc" + struct.pack(">III2s2sII", 0, 1, 12, b"en", b"US", len(raw), 28) + raw


def profile(name: str, primaries: tuple, white: tuple[float, float] = D65) -> bytes:
    """A display profile of version 4.3 with three colorants and one parametric curve."""
    matrix = colorants(primaries, white)
    curve = b"para" + struct.pack(">IHH", 0, 3, 0) + _fixed(CURVE)
    xyz = lambda v: b"XYZ " + bytes(4) + _fixed(v)
    tags = {
        "desc": _text(name), "cprt": _text("No copyright, use freely"), "wtpt": xyz(PCS_WHITE), "chad": b"sf32" + bytes(4) + _fixed(adaptation(white).ravel()),
        "rXYZ": xyz(matrix[:, 0]), "gXYZ": xyz(matrix[:, 1]), "bXYZ": xyz(matrix[:, 2]), "rTRC": curve, "gTRC": curve, "bTRC": curve,
    }
    at, data, entries, placed = 128 + 4 + 12 * len(tags), b"", [], {}
    for signature, value in tags.items():
        if value not in placed:
            placed[value] = at + len(data)
            data += value + bytes(-len(value) % 4)
        entries.append(struct.pack(">4sII", signature.encode(), placed[value], len(value)))
    table = struct.pack(">I", len(tags)) + b"".join(entries)
    head = struct.pack(">I4sI4s4s4s6H4s4sI4s4sQI", at + len(data), bytes(4), 0x04300000, b"mntr", b"RGB ", b"XYZ ", *CREATED, b"acsp", bytes(4), 0, bytes(4), bytes(4), 0, 0) + _fixed(PCS_WHITE)
    return head.ljust(128, b"\0") + table + data


def srgb() -> bytes:
    return profile("sRGB", SRGB)


def display_p3() -> bytes:
    return profile("Display P3", DISPLAY_P3)
