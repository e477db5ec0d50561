"""Lines of text for people: metrics, iterations, checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.operators.metrics import ROUTES, percent


def _one(value: Column) -> Column:
    return F.format_string("%.1f", value)


def milliseconds(micros: Column) -> Column:
    return F.format_string("%.3f", micros / 1000)


def resident_text(b: Column) -> Column:
    return F.coalesce(F.format_string("%.1f", b / (1 << 20)), F.lit("unknown"))


def frames_asked(n: Column) -> Column:
    """`all` for the largest number, else the number."""
    return F.when(n >= (1 << 63) - 1, "all").otherwise(n.cast("string"))


def route_line(fields: tuple[str, ...] = ROUTES) -> Column:
    """name=count name_pct=share of each route, then the encode time; over aggregated metrics."""
    total = F.col("total_frames")
    parts = [F.concat(F.lit(f"{f}="), F.col(f"{f}_frames").cast("string"), F.lit(f" {f}_pct="), _one(percent(F.col(f"{f}_frames"), total))) for f in fields]
    return F.concat_ws(" ", F.concat(F.lit("frames="), total.cast("string")), *parts, F.concat(F.lit("encode_ms="), milliseconds(F.col("encode_micros"))))


def iteration_line() -> Column:
    return F.concat(F.lit("iteration="), F.col("iteration").cast("string"), F.lit(" frames="), F.col("frames").cast("string"), F.lit(" frames_per_second="), F.format_string("%.3f", "frames_per_second"))


def check_line() -> Column:
    return F.concat(F.lit("passed="), F.col("passed").cast("string"), F.lit(" failed="), F.col("failed").cast("string"), F.lit(" skipped="), F.col("skipped").cast("string"))
