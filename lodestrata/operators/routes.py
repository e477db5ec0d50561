"""Route rules: how each frame of an instance is produced. Rules are columns, so Catalyst folds and pushes them.

Probes have compression (`jpeg`, `jp2k`, `none`), photometric, components, bits, fits (the source tile is the output frame),
edge (the frame is cut by the border), error (text, or null). They may have rgb_grid (RGB tiles may be copied, see
`geometry.rgb_grid`) and synthetic (the level is made by downsampling); where these are missing they are false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

J2K_FAMILY = ("Jpeg2000", "Jpeg2000Lossless", "Htj2k", "Htj2kLossless", "Htj2kLosslessRpcl")
HTJ2K_FAMILY = ("Htj2k", "Htj2kLossless", "Htj2kLosslessRpcl")
LOSSLESS_FAMILY = ("Jpeg2000Lossless", "Htj2kLossless", "Htj2kLosslessRpcl")


def is_empty_tile(error: Column) -> Column:
    return F.coalesce(F.contains(error, F.lit("empty TIFF tiles")), F.lit(False))


def retile_error_class(error: Column) -> Column:
    """`mcu_invalid` if the message speaks of MCUs, restart markers or DCT; else `source_unsupported`; null without a message."""
    return F.when(error.isNotNull(), F.when(F.lower(error).rlike("mcu|restart|dct"), "mcu_invalid").otherwise("source_unsupported"))


def jpeg_profile_ok(photometric: Column, allow_rgb: Column | bool = False) -> Column:
    return (photometric != "RGB") | (allow_rgb if isinstance(allow_rgb, Column) else F.lit(allow_rgb))


def _flag(probes: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False)) if name in probes.columns else F.lit(False)


def jpeg_route(probes: DataFrame) -> DataFrame:
    """Adds `route`: passthrough, retile or fallback, first rule that holds; `rejection` of a retile that failed; and `blank`.

    A frame that cannot be read or whose tile is empty is a fallback frame as others; `blank` says that it is written without samples.
    """
    jpeg = (F.col("compression") == "jpeg") & (F.col("bits") == 8) & F.col("error").isNull() & jpeg_profile_ok(F.col("photometric"), _flag(probes, "rgb_grid"))
    route = F.when(jpeg & F.col("fits"), "passthrough").when(jpeg & ~F.col("fits") & ~F.col("edge"), "retile").otherwise("fallback")
    tried = (F.col("compression") == "jpeg") & ~F.col("fits")
    rejection = F.when(tried & (route == "fallback"), F.when(F.col("error").isNotNull(), retile_error_class(F.col("error"))).when(F.col("edge"), "geometry_mismatch").otherwise("profile_unsupported"))
    return probes.withColumns({"route": route, "rejection": rejection, "blank": is_empty_tile(F.col("error"))})


def probe_allowed(path: Column, target: Column) -> Column:
    """JPEG 2000 targets are always probed for passthrough, HTJ2K ones only for `.dcm` sources."""
    dcm = F.lower(path).rlike(r"[^/]\.dcm$")
    return target.isin("Jpeg2000", "Jpeg2000Lossless") | (target.isin(*HTJ2K_FAMILY) & dcm)


def j2k_passes(target: str) -> Column:
    base = (F.col("compression") == "jp2k") & F.col("fits") & F.col("error").isNull()
    if target == "Jpeg2000":
        return base
    return base & (F.col("bits") == 8) & F.col("components").isin(1, 3) if target in J2K_FAMILY else F.lit(False)


def j2k_route(probes: DataFrame, target: str) -> DataFrame:
    """Adds `route` for a target of the JPEG 2000 family, by priority: passthrough, J2K recode, JPEG transcode, fallback, unsupported."""
    recode = F.lit(target in ("Htj2kLossless", "Htj2kLosslessRpcl")) & (F.col("compression") == "jp2k") & F.col("error").isNull() & F.col("fits")
    transcode = F.lit(target in HTJ2K_FAMILY) & (F.col("compression") == "jpeg") & F.col("error").isNull() & F.col("fits") & (F.col("photometric") != "YBR_FULL_422")
    may_encode = F.lit(target not in ("Htj2k", "Jpeg2000")) | (F.lit(target == "Jpeg2000") & F.col("edge") & (F.col("compression") == "jp2k"))
    route = F.when(j2k_passes(target), "passthrough").when(recode, "j2k_direct").when(transcode, "jpeg_direct").when(may_encode, "fallback").otherwise("unsupported")
    rejected = F.lit(target in HTJ2K_FAMILY) & (F.col("compression") == "jpeg") & ~transcode
    return probes.withColumns({"route": route, "jpeg_direct_rejected": rejected})


def encoded_photometric(target: Column, components: Column, photometric: Column) -> Column:
    """Lossless J2K of three components is YBR_RCT; anything else stays."""
    return F.when(target.isin("Jpeg2000", *LOSSLESS_FAMILY) & (components == 3), "YBR_RCT").otherwise(photometric)


def encode_syntax(target: Column) -> Column:
    return F.when(target == "Jpeg2000", "Jpeg2000Lossless").otherwise(target)


def default_syntax(probes: DataFrame, *, max_levels: int | None = None, level: int | None = None) -> DataFrame:
    """(source, syntax): from frame 0 of each instance: any JPEG passthrough, else J2K if some is eligible and none blocked, else HTJ2K RPCL.

    Synthetic levels, those from max_levels on and those that are not `level` have no say; a source without others is HTJ2K RPCL.
    """
    if max_levels is not None and max_levels <= 0:
        raise ValueError("max_levels must be greater than zero")
    says = (F.col("frame") == 0) & ~_flag(probes, "synthetic") & (F.lit(True) if max_levels is None else F.col("level") < max_levels) & (F.lit(True) if level is None else F.col("level") == level)
    first = jpeg_route(probes.where("frame = 0").withColumn("says", says)).withColumn("j2k", F.when(j2k_passes("Jpeg2000"), "eligible").when(F.col("compression") == "jp2k", "blocked").otherwise("no source"))
    any_ = lambda c: F.bool_or(F.col("says") & c)
    found = first.groupBy("source").agg(any_(F.col("route") == "passthrough").alias("jpeg"), any_(F.col("j2k") == "eligible").alias("eligible"), any_(F.col("j2k") == "blocked").alias("blocked"))
    return found.select("source", F.when(F.col("jpeg"), "JpegBaseline8Bit").when(F.col("eligible") & ~F.col("blocked"), "Jpeg2000").otherwise("Htj2kLosslessRpcl").alias("syntax"))


def all_or_nothing(probes: DataFrame) -> DataFrame:
    """(instance, frames, all_pass): whether every frame of the instance passes through, so all can be copied directly."""
    return jpeg_route(probes).groupBy("instance").agg(F.count("*").alias("frames"), F.bool_and(F.col("route") == "passthrough").alias("all_pass"))


def profile_consistency(probes: DataFrame) -> DataFrame:
    """(instance, profiles, consistent): distinct pixel profiles; an instance may have one."""
    return probes.groupBy("instance").agg(F.countDistinct("components", "bits", "photometric").alias("profiles")).withColumn("consistent", F.col("profiles") == 1)


def required_passthrough(probes: DataFrame, matrix: DataFrame) -> DataFrame:
    """Left lookup of what a candidate must be; the matrix has a fixed handful of rows."""
    return probes.join(F.broadcast(matrix), ["target", "candidate"], "left")


def fallback_runs(routed: DataFrame) -> DataFrame:
    """(instance, first, last, frames): maximal runs of consecutive fallback frames (gaps and islands)."""
    w = Window.partitionBy("instance").orderBy("frame")
    by_class = Window.partitionBy("instance", "route").orderBy("frame")
    island = routed.withColumn("island", F.row_number().over(w) - F.row_number().over(by_class)).where("route = 'fallback'")
    return island.groupBy("instance", "island").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("frames")).drop("island")


def run_count(routed: DataFrame, flag: str) -> DataFrame:
    """(instance, runs): number of maximal runs of equal flag."""
    w = Window.partitionBy("instance").orderBy("frame")
    change = F.coalesce((F.col(flag) != F.lag(flag).over(w)).cast("int"), F.lit(1))
    return routed.withColumn("change", change).groupBy("instance").agg(F.sum("change").alias("runs"))


def budgeted(rows: DataFrame, group: list[str], order: list[str], budget: int) -> DataFrame:
    """The first `budget` rows of each group in order; Spark cuts groups before the shuffle (WindowGroupLimit)."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_rank") <= budget).drop("_rank")


def best_route(durations: DataFrame, *, margin: int = 92) -> DataFrame:
    """(probe, route) from (probe, route, ord, micros): the fastest device route if it takes under `margin` per cent of the CPU's time, else `cpu`.

    A probe without a CPU time takes its fastest route; ties keep the earlier `ord`; without any time it is `cpu`.
    """
    timed = durations.where(F.col("micros").isNotNull())
    cpu = F.min(F.when(F.col("route") == "cpu", F.col("micros")))
    device = F.min(F.when(F.col("route") != "cpu", F.struct("micros", "ord", "route")))
    found = durations.select("probe").distinct().join(timed.groupBy("probe").agg(cpu.alias("cpu"), device.alias("device")), "probe", "left")
    beats = F.col("device").isNotNull() & (F.col("cpu").isNull() | (F.col("device.micros") * 100 < F.col("cpu") * margin))
    return found.select("probe", F.when(beats, F.col("device.route")).otherwise("cpu").alias("route"))


def past_deadline(rows: DataFrame, group: list[str], order: list[str], micros: int) -> DataFrame:
    """(group, done, elapsed, exceeded): frames of each group that begin within the time budget, in order, and whether it ran out.

    Checked before each frame, so the frame that passes the limit is still done. A budget of 0 or less is an error.
    """
    if micros <= 0:
        raise ValueError("the time budget of a level must be greater than zero")
    before = F.coalesce(F.sum("micros").over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    timed = rows.withColumn("_before", before)
    begun = F.col("_before") <= micros
    return timed.groupBy(*group).agg(F.count_if(begun).alias("done"), F.coalesce(F.sum(F.when(begun, F.col("micros"))), F.lit(0)).alias("elapsed"), F.bool_or(~begun).alias("exceeded"))
