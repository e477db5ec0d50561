"""Offsets of encapsulated frames: running sums and their inverse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def padded(length: Column) -> Column:
    """Even length of a fragment."""
    return length + length % 2


def offset_table(frames: DataFrame, length: str = "bytes") -> DataFrame:
    """Adds `padded` and `offset`: the bytes of all earlier items (8 of header, even payload) of the instance."""
    w = Window.partitionBy("instance").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    sized = frames.withColumn("padded", padded(F.col(length)))
    return sized.withColumn("offset", F.coalesce(F.sum(F.col("padded") + 8).over(w), F.lit(0)))


def fragment_ranges(fragments: DataFrame, starts: DataFrame) -> DataFrame:
    """(instance, frame, first, last): fragments of each frame, from fragments (instance, fragment, bytes) and frame starts (instance, frame, offset).

    A start must be a fragment's offset, the first must be 0 and they must ascend: `valid` tells.
    """
    w = Window.partitionBy("instance").orderBy("fragment")
    at = fragments.withColumn("offset", F.coalesce(F.sum(padded(F.col("bytes")) + 8).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counts = fragments.groupBy("instance").agg(F.count("*").alias("n"))
    by_frame = Window.partitionBy("instance").orderBy("frame")
    found = starts.join(at.select("instance", "fragment", "offset"), ["instance", "offset"], "left").join(counts, "instance")
    return found.select(
        "instance", "frame", F.col("fragment").alias("first"), (F.coalesce(F.lead("fragment").over(by_frame), F.col("n")) - 1).alias("last"),
        (F.col("fragment").isNotNull() & (F.coalesce(F.lag("fragment").over(by_frame), F.lit(-1)) < F.col("fragment")) & ((F.col("frame") > 0) | (F.col("offset") == 0))).alias("valid"),
    )


def lossy_ratio(frames: DataFrame, tile: int) -> DataFrame:
    """(instance, ratio): raw bytes of the frames over their compressed bytes; null if there are none."""
    raw = F.sum(F.lit(tile * tile).cast("bigint") * F.col("components") * F.call_function("div", F.col("bits") + 7, F.lit(8)))
    return frames.groupBy("instance").agg(F.when(F.sum("bytes") > 0, raw / F.sum("bytes")).alias("ratio"))


def assemble_frames(fragments: DataFrame, starts: DataFrame) -> DataFrame:
    """(instance, frame, raw, error): the bytes of each frame, its fragments in order, cut to the recorded length.

    fragments: (instance, fragment, data); starts: (instance, frame, offset, length), length null where none is recorded. Instances without any start have a frame a
    fragment. `error`, then without bytes: a start that is no fragment's offset, starts that do not ascend from 0, or a length beyond the bytes there are.
    A row holds the fragments of one frame, never those of an instance. Fragments and starts meet by instance, sorted by offset; inputs dealt by instance stay as they are dealt.
    """
    w = Window.partitionBy("instance").orderBy("fragment")
    size = F.octet_length("data").cast("bigint")
    at = F.coalesce(F.sum(padded(size) + 8).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lag = F.lag("offset").over(Window.partitionBy("instance").orderBy("frame"))
    ascends = F.when(lag.isNull(), F.col("offset") == 0).otherwise(F.col("offset") > lag)
    known = starts.select("instance", F.col("offset").cast("bigint").alias("offset"), F.lit(True).alias("is_start"), "frame", F.struct("length", ascends.alias("ascends")).alias("known"))
    pieces = fragments.select("instance", at.cast("bigint").alias("offset"), F.lit(False).alias("is_start"), "fragment", "data")
    order = [F.col("is_start").desc(), "frame", "fragment"]
    rows = pieces.unionByName(known, allowMissingColumns=True)
    # a fragment comes after the starts at its offset; instances that are null meet no start
    own = F.when(~F.col("is_start") & F.col("instance").isNotNull(), F.min(F.when(F.col("is_start"), F.col("frame"))).over(Window.partitionBy("instance", "offset").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("own", own).withColumn("begun", F.last("own", ignorenulls=True).over(Window.partitionBy("instance").orderBy("offset", *order).rowsBetween(Window.unboundedPreceding, 0)))
    has_starts = F.max("is_start").over(Window.partitionBy("instance")) & F.col("instance").isNotNull()
    rows = rows.withColumn("alone", ~F.col("is_start") & ~has_starts).withColumn("frame", F.when(F.col("is_start"), F.col("frame")).when(F.col("alone"), F.col("fragment")).otherwise(F.col("begun")))
    parts = rows.where("is_start or frame is not null").groupBy("instance", "frame", "alone").agg(
        F.collect_list("known").alias("known"), F.sort_array(F.collect_list(F.when(~F.col("is_start"), F.struct("fragment", "data")))).alias("parts"), F.sum(size).alias("there")
    )
    raw = F.when(F.size("parts") > 0, F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["data"])))
    each = parts.select("instance", "frame", "alone", "there", raw.alias("raw"), F.explode_outer("known").alias("known")).select("instance", "frame", "alone", "there", "raw", "known.*")
    error = F.when(F.col("alone"), F.lit(None)).when(~F.col("ascends"), "offsets do not ascend from zero").when(F.col("raw").isNull(), "offset is no fragment's").when(F.col("length") > F.col("there"), "length is beyond the fragments")
    cut = F.when(F.col("alone"), F.col("raw")).otherwise(F.substring("raw", F.lit(1), F.coalesce(F.col("length"), F.col("there")).cast("int")))
    return each.select("instance", "frame", F.when(error.isNull(), cut).alias("raw"), error.alias("error"))
