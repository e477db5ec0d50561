"""Mergeable counters of frames: measure columns, saturating sums, maxima, roll-ups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import metric_names

U64 = (1 << 64) - 1
ROUTES = ("passthrough", "retile", "fallback")


def saturating_sum(column: str) -> Column:
    """Sum of counters of 0 or more, at most the largest unsigned 64-bit number."""
    return F.least(F.sum(F.col(column).cast("decimal(38,0)")), F.lit(str(U64)).cast("decimal(38,0)"))


def reported_micros(nanos: Column) -> Column:
    """Whole microseconds; a positive time below one counts as one."""
    return F.when((nanos > 0) & (nanos < 1000), F.lit(1).cast("bigint")).otherwise(F.call_function("div", nanos, F.lit(1000)))


def measures(routed: DataFrame) -> DataFrame:
    """0/1 columns of JPEG-routed frames, to be summed once at any grain. The profile of a fallback frame is unknown."""
    one = lambda c: F.when(c, 1).otherwise(0).cast("bigint")
    known = F.col("route") != "fallback"
    return routed.withColumns({
        "total_frames": F.lit(1).cast("bigint"),
        **{f"{r}_frames": one(F.col("route") == r) for r in ROUTES}, "unknown_profile_frames": one(~known),
        "gray_frames": one(known & (F.col("components") == 1)), "rgb_like_frames": one(known & (F.col("components") == 3)), "other_component_frames": one(known & ~F.col("components").isin(1, 3)),
        "bits8_frames": one(known & (F.col("bits") == 8)), "bits16_frames": one(known & (F.col("bits") == 16)), "other_bit_depth_frames": one(known & ~F.col("bits").isin(8, 16)),
        **{f"rejected_{r}": one(F.coalesce(F.col("rejection") == r, F.lit(False))) for r in REJECTIONS},
        "encode_micros": F.when(F.col("route") == "fallback", F.col("micros")).otherwise(0).cast("bigint"),
    })


REJECTIONS = ("source_unsupported", "geometry_mismatch", "profile_unsupported", "mcu_invalid")
SUMS = (
    "total_frames", *(f"{r}_frames" for r in ROUTES), "unknown_profile_frames", "gray_frames", "rgb_like_frames", "other_component_frames",
    "bits8_frames", "bits16_frames", "other_bit_depth_frames", *(f"rejected_{r}" for r in REJECTIONS), "encode_micros",
)


def aggregate(measured: DataFrame, keys: list[str]) -> DataFrame:
    """All sums and the longest frame, by keys; partial sums are made before the shuffle."""
    return measured.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in SUMS), F.max("micros").alias("max_micros"))


def merge(parts: DataFrame, keys: list[str], sums: list[str], maxima: list[str]) -> DataFrame:
    """Merges partial metrics: saturating sums and maxima."""
    return parts.groupBy(*keys).agg(*(saturating_sum(c).alias(c) for c in sums), *(F.max(c).alias(c) for c in maxima))


def coverage(measured: DataFrame) -> DataFrame:
    """Sums at three grains (corpus, source, level); `grain` is 0 for level, 1 for source, 3 for the corpus. Frames are summed by level, and levels rolled up."""
    by_level = measured.groupBy("source", "level").agg(*(F.sum(c).alias(c) for c in SUMS))
    return by_level.rollup("source", "level").agg(F.grouping_id().alias("grain"), *(F.sum(c).alias(c) for c in SUMS))


def unclassified(total: Column, counters: list[Column]) -> Column:
    """Total less the counters, not below 0 at any step."""
    for c in counters:
        total = F.greatest(total - c, F.lit(0))
    return total


def retile_baseline_frames() -> Column:
    """Of serialised metrics: frames that were retiled and stayed baseline JPEG."""
    return F.greatest(F.col("jpeg_retile_frames") - F.col("jpeg_retile_to_htj2k_53_frames"), F.lit(0))


def unclassified_frames() -> Column:
    """Of serialised metrics: frames that no route counter accounts for."""
    counters = [retile_baseline_frames() if c == metric_names.RETILE_BASELINE else F.col(c) for c in metric_names.DECIDED]
    return unclassified(F.col("total_frames"), [F.col("jpeg_passthrough_frames") + F.col("j2k_passthrough_frames"), *counters])


def percent(part: Column, total: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(100.0 * part / total)


def effective_parallelism(hardware: Column, wall: Column) -> Column:
    return F.when(wall == 0, 0.0).otherwise(hardware / wall)


def corpus_report(routed: DataFrame, measured: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row per source and one, with a null source, for the corpus: considered, reports and failures, `error`, and sums over the sources without one.

    A source fails if frames of one instance that are copied or retiled have different pixel profiles, or with the `failure` that the rows may carry (a source that
    could not be read is a row with nothing else). Failed sources count nothing in the corpus. `measured` adds the counters (see `measures`).
    """
    failure = F.col("failure") if "failure" in routed.columns else F.lit(None).cast("string")
    profile = F.when(F.col("route") != "fallback", F.struct("components", "bits", "photometric"))
    by_instance = measured(routed).withColumns({"profile": profile, "failed": failure}).groupBy("source", "instance").agg(
        *(F.sum(c).alias(c) for c in SUMS), F.min("profile").alias("least"), F.max("profile").alias("most"), F.min("failed").alias("failed")
    )
    by_source = by_instance.groupBy("source").agg(*(F.sum(c).alias(c) for c in SUMS), F.min("failed").alias("failed"), F.bool_or(F.coalesce(F.col("least") != F.col("most"), F.lit(False))).alias("mixed"))
    by_source = by_source.withColumn("error", F.coalesce("failed", F.when(F.col("mixed"), "pixel profile changes")))
    sums = [F.sum(F.when(F.col("error").isNull(), F.col(c))).alias(c) for c in SUMS]
    one = F.count("*").alias("considered"), F.count_if(F.col("error").isNull()).alias("reports"), F.count_if(F.col("error").isNotNull()).alias("failures")
    return by_source.rollup("source").agg(F.when(F.grouping("source") == 0, F.min("error")).alias("error"), *one, *sums)


def common_value(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, all_values, common): sorted distinct values, and the value if there is just one."""
    found = df.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("all_values"))
    return found.withColumn("common", F.when(F.size("all_values") == 1, F.col("all_values")[0]))


def check_counts(checks: DataFrame, keys: list[str]) -> DataFrame:
    """passed, failed, skipped and missing checks, and whether any failed."""
    return checks.groupBy(*keys).agg(
        *(F.count_if(F.col("status") == s).alias(s) for s in ("passed", "failed", "skipped", "missing")), F.bool_or(F.col("status") == "failed").alias("has_failures")
    )


def complete(rows: DataFrame) -> DataFrame:
    """Adds serialised metrics that are not there as 0."""
    missing = [n for n in (*metric_names.SUM_NAMES, *metric_names.MAXIMUM_NAMES) if n not in rows.columns]
    return rows.withColumns({n: F.lit(0).cast("bigint") for n in missing}) if missing else rows


def serialised(parts: DataFrame, keys: list[str]) -> DataFrame:
    """All serialised metrics by keys: sums that stop at the largest unsigned number, maxima, and the derived parallelism."""
    merged = merge(complete(parts), keys, list(metric_names.SUM_NAMES), list(metric_names.MAXIMUM_NAMES))
    return merged.withColumn(metric_names.DERIVED, effective_parallelism(F.col("gpu_encode_hardware_micros").cast("double"), F.col("gpu_encode_wall_micros").cast("double")))


def as_serialised(routed: DataFrame) -> DataFrame:
    """One row of serialised counters per JPEG-routed frame, as a classification counts them: a fallback frame was not read, so its profile is unknown."""
    one = lambda c: F.when(c, 1).otherwise(0).cast("bigint")
    route, why = F.col("route"), F.coalesce("rejection", F.lit(""))
    known = route != "fallback"
    return routed.withColumns({
        "total_frames": F.lit(1).cast("bigint"), "jpeg_passthrough_frames": one(route == "passthrough"), "jpeg_retile_frames": one(route == "retile"),
        "cpu_fallback_frames": one(~known), "jpeg_decode_fallback_frames": one(~known), "unknown_pixel_profile_frames": one(~known),
        "gray_frames": one(known & (F.col("components") == 1)), "rgb_like_frames": one(known & (F.col("components") == 3)), "other_component_frames": one(known & ~F.col("components").isin(1, 3)),
        "bits8_frames": one(known & (F.col("bits") == 8)), "bits16_frames": one(known & (F.col("bits") == 16)), "other_bit_depth_frames": one(known & ~F.col("bits").isin(8, 16)),
        "jpeg_retile_rejected_frames": one(why != ""), **{f"jpeg_retile_{r}_frames": one(why == r) for r in REJECTIONS},
    })


#: Routes of written frames, and the counters that each adds one to, besides total_frames.
WRITTEN = {
    "jpeg_passthrough": ("jpeg_passthrough_frames",),
    "j2k_passthrough": ("j2k_passthrough_frames",),
    "j2k_direct": ("j2k_direct_htj2k_frames",),
    "jpeg_direct_53": ("jpeg_direct_htj2k_53_frames",),
    "jpeg_direct_97": ("jpeg_direct_htj2k_97_frames",),
    "retile": ("jpeg_retile_frames",),
    "retile_53": ("jpeg_retile_frames", "jpeg_retile_to_htj2k_53_frames", "jpeg_direct_htj2k_53_frames"),
    "encoded": (),
}


def written_frames(frames: DataFrame) -> DataFrame:
    """One row of serialised counters per frame that was written; `serialised` merges them.

    frames: route (a key of WRITTEN), components, bits, gpu_input, gpu_encode, gpu_validation (booleans), and times in nanoseconds, null where
    nothing was done: input_nanos, compose_nanos, encode_nanos, validation_nanos, device_nanos (the device's own), wall_nanos.
    An encoded frame is a device frame if input or encoder were on the device, resident if both were, else a fallback of the CPU.
    Times on the device also count as dispatched; what a dispatch took beyond the device's own time is its overhead.
    """
    one = lambda c: F.when(c, 1).otherwise(0).cast("bigint")
    micros = lambda n, c=None: F.when(F.lit(True) if c is None else c, F.coalesce(reported_micros(n), F.lit(0))).otherwise(0).cast("bigint")
    c = F.col
    encoded = c("route") == "encoded"
    device, both = encoded & (c("gpu_input") | c("gpu_encode")), encoded & c("gpu_input") & c("gpu_encode")
    timed = c("gpu_encode") & c("device_nanos").isNotNull()
    counters: dict[str, Column] = {}
    for route, names in WRITTEN.items():
        for n in names:
            counters[n] = counters.get(n, F.lit(False)) | (c("route") == route)
    return frames.withColumns({
        "total_frames": F.lit(1).cast("bigint"), **{n: one(x) for n, x in counters.items()},
        "gpu_transcode_frames": one(device), "resident_gpu_transcode_frames": one(both), "partial_gpu_transcode_frames": one(device & ~both), "cpu_fallback_frames": one(encoded & ~device),
        "cpu_input_frames": one(encoded & ~c("gpu_input")), "gpu_input_decode_frames": one(encoded & c("gpu_input")), "gpu_encode_frames": one(c("gpu_encode")), "gpu_validation_frames": one(c("gpu_validation")),
        "gray_frames": one(c("components") == 1), "rgb_like_frames": one(c("components") == 3), "other_component_frames": one(~c("components").isin(1, 3)),
        "bits8_frames": one(c("bits") == 8), "bits16_frames": one(c("bits") == 16), "other_bit_depth_frames": one(~c("bits").isin(8, 16)),
        "input_decode_micros": micros(c("input_nanos")), "compose_micros": micros(c("compose_nanos")), "encode_micros": micros(c("encode_nanos")), "validation_micros": micros(c("validation_nanos")),
        "gpu_dispatch_micros": micros(c("input_nanos"), c("gpu_input")) + micros(c("compose_nanos"), c("gpu_input")) + micros(c("encode_nanos"), c("gpu_encode")) + micros(c("validation_nanos"), c("gpu_validation")),
        "gpu_encode_wall_micros": micros(c("wall_nanos"), c("gpu_encode")), "gpu_encode_hardware_micros": micros(c("device_nanos"), timed),
        "gpu_encode_dispatch_overhead_micros": micros(F.greatest(F.coalesce("encode_nanos", F.lit(0)) - c("device_nanos"), F.lit(0)), timed),
    })


def metric(body: Column, name: str) -> Column:
    """A counter of a JSON report, 0 if it is missing or no whole number."""
    return F.coalesce(F.get_json_object(body, f"$.metrics.{name}").try_cast("bigint"), F.lit(0))
