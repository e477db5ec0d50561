import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import binary, colour
from lodestrata.operators.attributes import optical_path
from lodestrata.sources import attributes


def _parsed(raw):
    """Tags of a profile, by the format's rules: sizes, signature, alignment, ranges, reserved bytes."""
    size, version, kind, space, pcs = struct.unpack(">I4xI4s4s4s", raw[:24])
    assert size == len(raw) and size % 4 == 0 and version == 0x04300000 and (kind, space, pcs) == (b"mntr", b"RGB ", b"XYZ ") and raw[36:40] == b"acsp" and raw[84:128] == bytes(44)
    assert struct.unpack(">3i", raw[68:80]) == (63190, 65536, 54061)
    (n,) = struct.unpack(">I", raw[128:132])
    tags = {}
    for i in range(n):
        name, at, length = struct.unpack(">4sII", raw[132 + 12 * i : 144 + 12 * i])
        assert at % 4 == 0 and at >= 132 + 12 * n and at + length <= size and name not in tags and raw[at + 4 : at + 8] == bytes(4)
        tags[name.decode()] = raw[at : at + length]
    return tags


def _numbers(raw):
    return np.array(struct.unpack(f">{len(raw) // 4}i", raw)) / 65536


@pytest.mark.parametrize("raw, name, red", [(colour.srgb(), "sRGB", (0.4361, 0.2225, 0.0139)), (colour.display_p3(), "Display P3", (0.5151, 0.2412, -0.0011))])
def test_profiles_of_the_public_format(raw, name, red):
    tags = _parsed(raw)
    assert set(tags) == {"desc", "cprt", "wtpt", "chad", "rXYZ", "gXYZ", "bXYZ", "rTRC", "gTRC", "bTRC"}
    columns = [_numbers(tags[t][8:]) for t in ("rXYZ", "gXYZ", "bXYZ")]
    assert np.allclose(sum(columns), colour.PCS_WHITE, atol=1e-4) and np.allclose(columns[0], red, atol=3e-4)
    g, a, b, c, d = _numbers(tags["rTRC"][12:])
    assert tags["rTRC"][8:10] == b"\0\3" and abs((a + b) ** g - 1) < 1e-3 and abs((a * d + b) ** g - c * d) < 1e-3
    language, country, length, at = struct.unpack(">2s2sII", tags["desc"][16:28])
    assert tags["desc"][at : at + length].decode("utf-16-be") == name
    assert raw[24:36] == binary.stable_icc(raw)[24:36]


def test_a_profile_travels_with_its_optical_path(spark):
    rows = spark.range(1).select(F.array(optical_path(F.lit(colour.srgb()))).alias("OpticalPathSequence")).select(F.struct("OpticalPathSequence").alias("a"))
    found = attributes.decode(bytes(attributes.encoded(rows, "a", "raw").first()["raw"]))
    assert found["OpticalPathSequence"][0]["ICCProfile"].rstrip(b"\0") == colour.srgb().rstrip(b"\0")
