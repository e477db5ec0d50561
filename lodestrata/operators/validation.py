"""Checks as rows: metadata fields, headers, external tools. A failed check is a row, not an exception."""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import scalars as S

#: Metadata fields with the value representation that they must have.
FIELDS = {
    "patient_id": ("LO", 64), "patient_name": ("PN", 64), "birth_date": ("DA", 8), "sex": ("CS", 16), "study_id": ("SH", 16), "study_date": ("DA", 8), "study_time": ("TM", 14),
    "accession_number": ("SH", 16), "acquisition_datetime": ("DT", 26), "study_uid": ("UI", 64), "study_description": ("LO", 64), "specimen_id": ("LO", 64),
    "container_id": ("LO", 64), "manufacturer": ("LO", 64), "modality": ("CS", 16),
}


def field_errors(rows: DataFrame, key: str) -> DataFrame:
    """(key, errors, first): names of the fields whose value breaks its representation, in field order; nulls are valid."""
    def bad(name: str, vr: str, most: int):
        c = F.col(name)
        ok = {"DA": S.valid_da, "TM": S.valid_tm, "DT": S.valid_dt, "CS": S.valid_cs, "UI": S.valid_ui}.get(vr, lambda x: S.valid_text(x, most))(c)
        return F.when(c.isNotNull() & ~ok, F.lit(name))

    there = [bad(n, *v) for n, v in FIELDS.items() if n in rows.columns]
    errors = F.array_compact(F.array(*there))
    return rows.select(key, errors.alias("errors"), F.get(errors, F.lit(0)).alias("first"))


def strict_errors(rows: DataFrame, key: str) -> DataFrame:
    """(key, error): patient id and name must be there."""
    missing = lambda c: S.non_empty(F.trim(c)).isNull()
    return rows.select(key, F.when(missing(F.col("patient_id")), "patient id is missing").when(missing(F.col("patient_name")), "patient name is missing").alias("error"))


def header_checks(headers: DataFrame) -> DataFrame:
    """(path, check, status, message): readable, geometry and frame count of header rows."""
    across = F.call_function("div", F.col("total_columns") + F.col("columns") - 1, F.greatest("columns", F.lit(1)))
    down = F.call_function("div", F.col("total_rows") + F.col("rows") - 1, F.greatest("rows", F.lit(1)))
    checks = {
        "readable": (F.col("error").isNull(), F.col("error")),
        "geometry": (F.col("error").isNotNull() | ((F.col("rows") > 0) & (F.col("columns") > 0)), F.lit("rows or columns are 0")),
        "frames": (F.col("error").isNotNull() | (F.col("total_columns") == 0) | (F.col("number_of_frames") == across * down), F.lit("frames do not tile the matrix")),
    }
    each = F.array(*(F.struct(F.lit(n).alias("check"), F.when(F.col("error").isNotNull() & F.lit(n != "readable"), "skipped").when(ok, "passed").otherwise("failed").alias("status"), F.when(~ok, m).alias("message")) for n, (ok, m) in checks.items()))
    return headers.select("path", F.explode(each).alias("c")).select("path", "c.*")


def frame_expectation(headers: DataFrame) -> DataFrame:
    """Adds `expected` (columns, rows, samples, bits) of a decoded frame and `expectation_error`; samples and bits may be missing, rows and columns not."""
    c = F.col
    error = (
        F.when(c("columns").isNull(), "columns are missing").when(c("rows").isNull(), "rows are missing").when((c("columns") == 0) | (c("rows") == 0), "rows and columns must be greater than zero")
        .when(~c("samples").between(0, (1 << 16) - 1), "samples are no 16-bit number").when(~c("bits_allocated").between(0, (1 << 16) - 1), "bits are no 16-bit number")
    )
    return headers.withColumn("expectation_error", error).withColumn("expected", F.when(c("expectation_error").isNull(), F.struct("columns", "rows", "samples", c("bits_allocated").alias("bits"))))


class Runner:
    """How commands are found and run; tests hand in another."""

    def find(self, name: str) -> str | None:
        return shutil.which(name)

    def run(self, command: list[str], timeout: float) -> tuple[int | None, str]:
        """(return code, output of at most 64 KiB); None for a timeout."""
        try:
            done = subprocess.run(command, capture_output=True, timeout=timeout, check=False)
        except subprocess.TimeoutExpired:
            return None, "timed out"
        except OSError as e:
            return 127, str(e)
        return done.returncode, (done.stdout + done.stderr)[: 64 << 10].decode(errors="replace")


def command_checks(files: DataFrame, name: str, command: list[str], *, timeout: float = 60, runner: Runner | None = None) -> DataFrame:
    """(path, check, status, message): one external command a file, its path last."""
    runner = runner or Runner()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [runner.run([*command, p], timeout) if runner.find(command[0]) else (None, "missing") for p in rows["path"]]
            yield pd.DataFrame({"path": rows["path"], "check": name, "status": ["skipped" if m == "missing" else "passed" if c == 0 else "failed" for c, m in found], "message": [None if c == 0 else m for c, m in found]})

    return files.select("path").mapInPandas(run, "path string, check string, status string, message string")


def chunked(files: DataFrame, size: int = 512) -> DataFrame:
    """(chunk, paths): sorted paths in groups of `size`. Numbers come from ranges of paths and their counts, so no task sorts all."""
    from pyspark.sql import Window

    ordered = files.select("path").repartitionByRange("path").sortWithinPartitions("path").withColumn("p", F.spark_partition_id())
    at = ordered.withColumn("n", F.row_number().over(Window.partitionBy("p").orderBy("path")) - 1)
    before = ordered.groupBy("p").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return at.join(before, "p").withColumn("chunk", F.call_function("div", F.col("n") + F.col("before"), F.lit(size))).groupBy("chunk").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def doctor(spark: SparkSession, tools: dict[str, list[str]], *, runner: Runner | None = None, timeout: float = 10) -> DataFrame:
    """(tool, status, message) of the driver's host: passed, failed or missing."""
    runner, rows = runner or Runner(), []
    for tool, command in tools.items():
        if not runner.find(command[0]):
            rows.append((tool, "missing", None))
            continue
        code, text = runner.run(command, timeout)
        rows.append((tool, "passed" if code == 0 or (code is not None and tool in text) else "failed", text.strip().split("\n")[0]))
    return spark.createDataFrame(rows, "tool string, status string, message string")
