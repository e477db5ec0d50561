"""Output tiles composed from source tiles: requests, address bounds, and the pixels by an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def requests(frames: DataFrame) -> DataFrame:
    """(.., tile_col, tile_row, src_x, src_y, dst_x, dst_y, w, h): for each frame rect the part of every source tile it needs."""
    r = F.col("rect")
    touched = lambda at, n, size: F.when((r["w"] > 0) & (r["h"] > 0), F.sequence(F.call_function("div", at, size), F.call_function("div", at + n - 1, size)))
    each = frames.withColumn("tile_row", F.explode(touched(r["y"], r["h"], F.col("tile_h")))).withColumn("tile_col", F.explode(touched(r["x"], r["w"], F.col("tile_w"))))
    col, row = F.col("tile_col"), F.col("tile_row")
    left, top = F.greatest(r["x"], col * F.col("tile_w")), F.greatest(r["y"], row * F.col("tile_h"))
    right, low = F.least(r["x"] + r["w"], (col + 1) * F.col("tile_w")), F.least(r["y"] + r["h"], (row + 1) * F.col("tile_h"))
    return each.withColumns({
        "src_x": left - col * F.col("tile_w"), "src_y": top - row * F.col("tile_h"), "dst_x": left - r["x"], "dst_y": top - r["y"], "w": right - left, "h": low - top,
    })


def last_byte(x: Column, y: Column, w: Column, h: Column, stride: Column, sample: int) -> Column:
    """Index of the last byte of a rectangle in rows of `stride` pixels; null if it is empty."""
    return F.when((w > 0) & (h > 0), ((y + h - 1) * stride + x + w) * sample - 1)


def in_bounds(x: Column, y: Column, w: Column, h: Column, all_w: Column, all_h: Column) -> Column:
    return (x >= 0) & (y >= 0) & (w >= 0) & (h >= 0) & (x + w <= all_w) & (y + h <= all_h)


def is_aligned(frame_w: Column, frame_h: Column, tile_w: Column, tile_h: Column, kind: Column) -> Column:
    """Whether output frames are source tiles, one by one."""
    return (kind == "regular") & (frame_w == tile_w) & (frame_h == tile_h)


def gather(asked: DataFrame, tiles: DataFrame, keys: list[str], out_w: int, out_h: int) -> DataFrame:
    """(keys, frame, pixels): requests joined with tiles (keys, tile_col, tile_row, pixels array<int>) and laid out row by row, 0 where nothing is."""
    both = asked.join(tiles, [*keys, "tile_col", "tile_row"])
    dx = lambda i, r: i % out_w - r["dst_x"]
    dy = lambda i, r: F.call_function("div", i, F.lit(out_w)) - r["dst_y"]
    part = F.struct("dst_x", "dst_y", "src_x", "src_y", "w", "h", "tile_w", "pixels")
    parts = both.groupBy(*keys, "frame").agg(F.collect_list(part).alias("parts"))

    def pixel(i: Column) -> Column:
        hits = F.transform(F.col("parts"), lambda r: F.when(dx(i, r).between(0, r["w"] - 1) & dy(i, r).between(0, r["h"] - 1), F.get(r["pixels"], ((r["src_y"] + dy(i, r)) * r["tile_w"] + r["src_x"] + dx(i, r)).cast("int"))))
        return F.coalesce(F.array_max(hits), F.lit(0))

    return parts.select(*keys, "frame", F.transform(F.sequence(F.lit(0), F.lit(out_w * out_h - 1)), pixel).alias("pixels"))


def scatter(results: DataFrame, size: DataFrame, key: str) -> DataFrame:
    """(key, index, value): results (key, index, value) put back in order, null where one is missing; sizes are (key, n)."""
    from lodestrata.operators.geometry import counted

    places = size.select(key, F.explode(counted(F.col("n"))).alias("index"))
    return places.join(results, [key, "index"], "left")
