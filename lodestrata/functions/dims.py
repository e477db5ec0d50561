"""Transfer syntaxes, pixel profiles, metric columns, extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Name, UID, member of the JPEG 2000 family, lossless member, lossy compression method.
TRANSFER_SYNTAXES = [
    ("JpegBaseline8Bit", "1.2.840.10008.1.2.4.50", False, False, "ISO_10918_1"),
    ("Jpeg2000", "1.2.840.10008.1.2.4.91", True, False, "ISO_15444_1"),
    ("Jpeg2000Lossless", "1.2.840.10008.1.2.4.90", True, True, None),
    ("Htj2k", "1.2.840.10008.1.2.4.203", True, False, "ISO_15444_15"),
    ("Htj2kLossless", "1.2.840.10008.1.2.4.201", True, True, None),
    ("Htj2kLosslessRpcl", "1.2.840.10008.1.2.4.202", True, True, None),
    ("ExplicitVrLittleEndian", "1.2.840.10008.1.2.1", False, False, None),
]
#: Irreversible quantization scale by profile; none for the reversible one.
QUANTIZATION_SCALES = [
    ("Lossless53", None), ("Lossy97Near", 2.0), ("Lossy97", 5.0), ("Lossy97Balanced", 5.0),
    ("Lossy97Aggressive", 10.0), ("Lossy97Preview", 20.0), ("Lossy97Thumbnail", 50.0),
]
#: What a compressed frame must be to pass through to a target unchanged.
PASSTHROUGH = [
    ("Jpeg2000", "Jpeg2000Lossless", "Jpeg2000Lossless"),
    ("Jpeg2000", "Jpeg2000Lossy", "Jpeg2000Lossy"),
    *(("Jpeg2000Lossless", c, "Jpeg2000Lossless") for c in ("Jpeg2000Lossless", "Jpeg2000Lossy", "HtJpeg2000Lossless", "HtJpeg2000Lossy")),
    ("Htj2k", "HtJpeg2000Lossless", "HtJpeg2000Lossless"),
    ("Htj2k", "HtJpeg2000Lossy", "HtJpeg2000Lossy"),
    *((t, c, "HtJpeg2000Lossless") for t in ("Htj2kLossless", "Htj2kLosslessRpcl") for c in ("Jpeg2000Lossless", "Jpeg2000Lossy", "HtJpeg2000Lossless", "HtJpeg2000Lossy")),
]
#: Extensions of slide files.
SLIDE_EXTENSIONS = ("svs", "tif", "tiff", "ndpi", "scn", "dcm", "mrxs", "vms", "vmu")
#: Resource types that are taken as clinical metadata.
RESOURCE_TYPES = ("Bundle", "Patient", "Specimen", "ServiceRequest", "DiagnosticReport")


def transfer_syntaxes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRANSFER_SYNTAXES, "syntax string, uid string, is_j2k boolean, is_lossless_j2k boolean, lossy_method string")


def quantization_scales(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUANTIZATION_SCALES, "profile string, scale double")


def passthrough_matrix(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PASSTHROUGH, "target string, candidate string, required string")
