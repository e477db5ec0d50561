"""Rules that pick the encoder's backend, lane and budget; as columns, so they can be held against a whole corpus of instances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.routes import HTJ2K_FAMILY, LOSSLESS_FAMILY

#: Instances of at most so many frames stay on the CPU; least frames for a device; share of the CPU's time to beat.
SMALL_FRAMES, LEAST_FRAMES = 128, 16


def effective_backend(backend: Column, syntax: Column, frames: Column) -> Column:
    small = (backend == "prefer_device") & ((syntax == "Jpeg2000Lossless") | ((syntax == "Htj2kLosslessRpcl") & (frames <= SMALL_FRAMES)))
    return F.when(small | (syntax == "Jpeg2000"), "cpu").otherwise(backend)


def hybrid_lane(backend: Column, syntax: Column, frames: Column) -> Column:
    """gpu, cpu, or null where lanes do not apply."""
    asked = (backend == "prefer_device") & (syntax == "Htj2kLosslessRpcl")
    return F.when(asked, F.when(effective_backend(backend, syntax, frames) == "cpu", "cpu").otherwise("gpu"))


def lanes_on(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, hybrid): both lanes are used and no job is without one."""
    return jobs.groupBy(*keys).agg((F.bool_or(F.col("lane") == "gpu") & F.bool_or(F.col("lane") == "cpu") & F.bool_and(F.col("lane").isNotNull())).alias("hybrid"))


def jpeg_direct_supported(syntax: Column, backend: Column) -> Column:
    return syntax.isin(*HTJ2K_FAMILY) & (backend != "require_device")


def cpu_input_ok(tiles: DataFrame, keys: list[str], *, least: int = 32) -> DataFrame:
    """(keys, allowed): at least so many frames, all of 1 or 3 components and 8 or 16 bits."""
    return tiles.groupBy(*keys).agg((F.bool_and(F.col("components").isin(1, 3) & F.col("bits").isin(8, 16)) & (F.count("*") >= least)).alias("allowed"))


def direct_pixels(frames: Column, tile: Column, threads: Column) -> Column:
    """Whether an instance's estimated bytes fit the in-memory budget of the threads, with more than one thread."""
    from lodestrata.functions.scalars import buffer_bytes

    return (threads > 1) & (frames * tile * tile * 6 <= buffer_bytes(threads))


def workers(jobs: Column, threads: Column, cpu_safe: Column) -> Column:
    return F.when(cpu_safe, F.least(jobs, F.greatest(threads - 1, F.lit(1)))).otherwise(1)


def jpeg_device_batch(backend: Column, frame_w: Column, frame_h: Column, frames: Column, device_decode: Column) -> Column:
    """Whether JPEG frames may be encoded on the device: never for `cpu`; any if it is preferred or required; for `auto` four square ones or more with a device decoder."""
    asked = backend.isin("prefer_device", "require_device") & (frames > 0)
    return asked | ((backend == "auto") & device_decode & (frame_w == frame_h) & (frames >= 4))


def lossless_device_input(backend: Column, syntax: Column, frames: Column) -> Column:
    """Whether a lossless instance may be read on the device; `auto` asks for HTJ2K and LEAST_FRAMES."""
    auto = (backend == "auto") & (frames >= LEAST_FRAMES) & syntax.isin("Htj2kLossless", "Htj2kLosslessRpcl")
    return syntax.isin(*LOSSLESS_FAMILY) & (backend.isin("prefer_device", "require_device") | auto)


def device_input_preference(backend: Column, device_decode: Column) -> Column:
    """A device that is required but cannot decode the source gets its input from the CPU."""
    return F.when((backend == "require_device") & ~device_decode, "cpu").otherwise(backend)


def starts_on_cpu(backend: Column, syntax: Column, frames: Column) -> Column:
    return (backend == "auto") & syntax.isin(*LOSSLESS_FAMILY) & ~lossless_device_input(backend, syntax, frames)
