"""Pixel checks: a table function reads a file's frames and decodes them, a check row each; rows whose output has a wrong size are then failed.

The function runs beside the header rows by a lateral join, so files are spread as the headers are, and a task holds one frame at a time.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import binary
from lodestrata.operators import validation
from lodestrata.plans.options import decoder_command
from lodestrata.sources.instances import offsets_of, pixels_at

CHECKS = "path string, check string, status string, message string"
_DECODED = "frame long, status string, message string, width long, height long, samples long, bits long"


def frame_decoder(commands: Mapping[str, str | None], *, max_frames: int, max_bytes: int, timeout: float, strict: bool, runner: validation.Runner):
    """The table function: (path, transfer syntax) to rows of _DECODED."""

    class Decode:
        def eval(self, path: str, transfer_syntax: str) -> Iterator[tuple]:
            nothing = (None,) * 4
            syntax = (transfer_syntax or "").rstrip("\0 ")
            if syntax not in commands:
                yield None, "skipped", f"pixel decode is not needed for transfer syntax {syntax}", *nothing
                return
            if not commands[syntax]:
                yield None, "failed" if strict else "skipped", "no decoder is configured", *nothing
                return
            try:
                offsets, lengths = offsets_of(path)
                if not offsets:
                    yield None, "skipped", "pixel data have no offset table", *nothing
                    return
                start = pixels_at(path)
            except (OSError, ValueError) as e:
                yield None, "failed", str(e), *nothing
                return
            for frame, (at, size) in enumerate(zip(offsets[:max_frames], lengths)):
                if size > max_bytes:
                    yield frame, "failed", f"frame {frame} has more than {max_bytes} bytes", *nothing
                else:
                    yield frame, *self.one(path, start + at + 8, size, commands[syntax])

        def one(self, path: str, at: int, size: int, command: str) -> tuple:
            with tempfile.TemporaryDirectory(prefix="frame-") as folder:  # the decoder's own files, gone with the call
                source, target = os.path.join(folder, "in"), os.path.join(folder, "out.pnm")
                with open(path, "rb") as f:
                    f.seek(at)
                    raw = f.read(size)
                if len(raw) < size:
                    return "failed", "the file ends within the frame", None, None, None, None
                with open(source, "wb") as f:
                    f.write(raw)
                words = decoder_command(command, source, target)
                if not runner.find(words[0]):
                    return "failed" if strict else "skipped", f"{words[0]} is missing", None, None, None, None
                code, text = runner.run(words, timeout)
                if code != 0:
                    return "failed", text.strip() or f"exit code {code}", None, None, None, None
                if not os.path.exists(target) or os.path.getsize(target) > max_bytes:
                    return "failed", "no output, or too much of it", None, None, None, None
                with open(target, "rb") as f:
                    found = binary.pnm_header(f.read())
            if found is None:
                return "failed", "the output is no valid PNM", None, None, None, None
            kind, width, height, most, _ = found
            return "passed", None, width, height, 3 if kind == "P6" else 1, 8 if most < 256 else 16

    return F.udtf(Decode, returnType=_DECODED)


def pixel_checks(headers: DataFrame, commands: Mapping[str, str | None], *, max_frames: int = 1, max_bytes: int = 64 << 20, timeout: float = 60, strict: bool = False, runner: validation.Runner | None = None) -> DataFrame:
    """CHECKS of rows of `dicom_headers`: one a decoded frame, or one a file that cannot or need not be decoded.

    commands: a template with {input} and {output} by transfer syntax, None where one is needed and not known; others need none. The first `max_frames` frames of a file are
    decoded. A decoder's success counts only if its output has the size that the header says.
    """
    spark, name = headers.sparkSession, f"decode_{uuid.uuid4().hex}"
    spark.udtf.register(name, frame_decoder(dict(commands), max_frames=max_frames, max_bytes=max_bytes, timeout=timeout, strict=strict, runner=runner or validation.Runner()))
    view = f"headers_{uuid.uuid4().hex}"
    expected = validation.frame_expectation(headers)
    expected.where("error is null").createOrReplaceTempView(view)
    found = spark.sql(f"SELECT h.path, h.expected, h.expectation_error, d.* FROM {view} h, LATERAL {name}(h.path, h.transfer_syntax) d")
    e, done = "expected", F.col("status") == "passed"
    wrong = (
        F.when(F.col("expectation_error").isNotNull(), F.col("expectation_error"))
        .when((F.col("width") != F.col(f"{e}.columns")) | (F.col("height") != F.col(f"{e}.rows")), F.format_string("decoded to %d x %d instead of %d x %d", "width", "height", f"{e}.columns", f"{e}.rows"))
        .when((F.col(f"{e}.samples") > 0) & (F.col("samples") != F.col(f"{e}.samples")), "decoded to another number of samples").when((F.col(f"{e}.bits") > 0) & (F.col("bits") != F.col(f"{e}.bits")), "decoded to other bits")
    )
    check = F.when(F.col("frame").isNull(), "pixel-decode").otherwise(F.concat(F.lit("pixel-decode-"), "frame"))
    return found.select("path", check.alias("check"), F.when(done & wrong.isNotNull(), "failed").otherwise(F.col("status")).alias("status"), F.when(done, wrong).otherwise(F.col("message")).alias("message"))


def set_checks(files: DataFrame, name: str, command: list[str], *, size: int = 512, timeout: float = 600, runner: validation.Runner | None = None) -> DataFrame:
    """CHECKS of a command that takes many files at once: a row per group of `size` paths, under its first path."""
    runner = runner or validation.Runner()

    def run(batches):
        import pandas as pd

        for rows in batches:
            found = [runner.run([*command, *paths], timeout) if runner.find(command[0]) else (None, "missing") for paths in rows["paths"]]
            yield pd.DataFrame({"path": [p[0] for p in rows["paths"]], "check": name, "status": ["skipped" if m == "missing" else "passed" if c == 0 else "failed" for c, m in found], "message": [None if c == 0 else m for c, m in found]})

    return validation.chunked(files, size).select("paths").mapInPandas(run, CHECKS)


def all_checks(headers: DataFrame, *, file_commands: Mapping[str, list[str]] | None = None, set_commands: Mapping[str, list[str]] | None = None, decoders: Mapping[str, str | None] | None = None, runner: validation.Runner | None = None, **limits) -> DataFrame:
    """CHECKS of all families in one table: headers, names of patients, commands a file, commands a set, and pixels."""
    fields = validation.field_errors(headers.where("error is null").select("path", "patient_id", "patient_name", "study_uid", "modality"), "path")
    names = fields.select("path", F.lit("fields").alias("check"), F.when(F.col("first").isNull(), "passed").otherwise("failed").alias("status"), F.concat(F.lit("not valid: "), F.array_join("errors", ", ")).alias("message"))
    parts = [validation.header_checks(headers), names.withColumn("message", F.when(F.col("status") == "failed", F.col("message")))]
    parts += [validation.command_checks(headers.select("path"), n, c, runner=runner) for n, c in (file_commands or {}).items()]
    parts += [set_checks(headers.select("path"), n, c, runner=runner) for n, c in (set_commands or {}).items()]
    if decoders is not None:
        parts.append(pixel_checks(headers, decoders, runner=runner, **limits))
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return every
