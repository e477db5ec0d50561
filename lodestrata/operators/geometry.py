"""Grids, jobs, frames and coordinates of image pyramids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("source", "scene", "series", "level", "z", "c", "t")


def ceil_div(a, b) -> Column:
    """Exact ceiling of a / b for whole numbers of 0 or more."""
    a, b = (x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x) for x in (a, b))
    return F.call_function("div", a + b - 1, b)


def counted(n: Column) -> Column:
    """0 to n - 1 as an array; empty for n = 0, where `sequence` would count down."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>"))


def square_grid(levels: DataFrame, tile: int) -> DataFrame:
    """Adds tiles_across, tiles_down and frames for square tiles. A tile size of 0 is an error."""
    if tile <= 0:
        raise ValueError("tile size must be greater than zero")
    grid = levels.withColumns({"tiles_across": ceil_div("cols", tile), "tiles_down": ceil_div("rows", tile)})
    return grid.withColumn("frames", F.col("tiles_across") * F.col("tiles_down"))


def row_tile_count(row: Column, across: Column, frames: Column) -> Column:
    return F.greatest(F.least(across, frames - row * across), F.lit(0))


def checked_u32(value: Column, name: str) -> Column:
    """The value, or an error if it is no unsigned 32-bit number."""
    return F.when(value.between(0, (1 << 32) - 1), value).otherwise(F.raise_error(F.lit(f"{name} exceeds 32 bits")))


def clamped_rect(col: Column, row: Column, frame_w: Column, frame_h: Column, cols: Column, rows: Column) -> Column:
    """struct(x, y, w, h) of a frame, cut at the right and lower border."""
    side = lambda n, size, all_: F.least(size, F.greatest(all_ - n * size, F.lit(0)))
    return F.struct((col * frame_w).alias("x"), (row * frame_h).alias("y"), side(col, frame_w, cols).alias("w"), side(row, frame_h, rows).alias("h"))


def j2k_tile_size(levels: DataFrame, tile: int, passthrough_only: bool) -> DataFrame:
    """Adds `tile`: the requested size, or for passthrough-only targets the smaller of it and a square native tile."""
    native = F.when(F.col("kind").isin("regular", "whole") & (F.col("tile_w") == F.col("tile_h")) & (F.col("tile_w") > 0), F.least("tile_w", F.lit(tile)))
    return levels.withColumn("tile", F.coalesce(native, F.lit(tile)) if passthrough_only else F.lit(tile))


def viewer_friendly(w: Column, h: Column, tile: int) -> Column:
    return (w > 0) & (h > 0) & F.lit(tile > 0) & (F.greatest(w, h) <= tile) & (F.least(w, h) >= -(-tile // 2))


def jpeg_frame_geometry(levels: DataFrame, tile: int) -> DataFrame:
    """Adds frame_w, frame_h: native for whole levels with friendly tiles and regular levels whose tile is the requested one; else square."""
    own = ((F.col("kind") == "whole") & viewer_friendly(F.col("tile_w"), F.col("tile_h"), tile)) | ((F.col("kind") == "regular") & (F.col("tile_w") == tile) & (F.col("tile_h") == tile))
    sized = levels.withColumns({"frame_w": F.when(own, F.col("tile_w")).otherwise(tile), "frame_h": F.when(own, F.col("tile_h")).otherwise(tile)})
    sized = sized.withColumns({"tiles_across": ceil_div("cols", "frame_w"), "tiles_down": ceil_div("rows", "frame_h")})
    return sized.withColumn("frames", F.col("tiles_across") * F.col("tiles_down"))


def rgb_grid(sized: DataFrame) -> DataFrame:
    """Adds `rgb_grid` to levels with frame_w and frame_h: all frames are whole native tiles, so RGB tiles may be copied without a frame that has to be encoded."""
    native = (F.col("tile_w") == F.col("frame_w")) & (F.col("tile_h") == F.col("frame_h"))
    whole = (F.col("cols") % F.col("frame_w") == 0) & (F.col("rows") % F.col("frame_h") == 0)
    return sized.withColumn("rgb_grid", native & ((F.col("kind") == "whole") | ((F.col("kind") == "regular") & whole)))


def jobs(levels: DataFrame, *, max_levels: int | None = None, level: int | None = None) -> DataFrame:
    """One job per scene, series, level, z, t and channel, in that order, with ordinal and instance_number by source."""
    rows = levels.where(F.col("level") == level) if level is not None else levels
    rows = rows.where(F.col("level") < max_levels) if max_levels is not None else rows
    rows = rows.withColumn("z", F.explode(counted(F.col("n_z")))).withColumn("t", F.explode(counted(F.col("n_t")))).withColumn("c", F.explode(counted(F.col("n_c"))))
    w = Window.partitionBy("source").orderBy("scene", "series", "level", "z", "t", "c")
    return rows.withColumn("ordinal", F.row_number().over(w).cast("bigint") - 1).withColumn("instance_number", F.col("ordinal") + 1)


def frames(levels: DataFrame, *, start_row: int = 0, row_count: int | None = None) -> DataFrame:
    """One row per frame of levels with tiles_across, tiles_down, frame_w and frame_h; a task's frames are those of its levels, row by row."""
    last = F.col("tiles_down") if row_count is None else F.least("tiles_down", F.lit(start_row + row_count))
    down = F.when(last > start_row, F.sequence(F.lit(start_row).cast("bigint"), last.cast("bigint") - 1))
    each = levels.withColumn("row", F.explode(down)).withColumn("col", F.explode(counted(F.col("tiles_across"))))
    rect = clamped_rect(F.col("col"), F.col("row"), F.col("frame_w"), F.col("frame_h"), F.col("cols"), F.col("rows"))
    return each.withColumn("frame", F.col("row") * F.col("tiles_across") + F.col("col")).withColumn("rect", rect)


def dimension_values(frame: DataFrame, spacing: float) -> DataFrame:
    """Adds the dimension index, the position in the matrix from 1, and the offset in millimetres of each frame."""
    return frame.withColumns({
        "dimension_col": F.col("col") + 1, "dimension_row": F.col("row") + 1,
        "matrix_col": (F.col("col") * F.col("frame_w") + 1).cast("int"), "matrix_row": (F.col("row") * F.col("frame_h") + 1).cast("int"),
        "offset_x": F.col("col") * F.col("frame_w") * F.lit(spacing), "offset_y": F.col("row") * F.col("frame_h") * F.lit(spacing),
    })


def _pair(col, row) -> Column:
    as_long = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("bigint")
    return F.struct(as_long(col).alias("col"), as_long(row).alias("row"))


def probe_places(across: Column, down: Column, *, first: int = 4096) -> Column:
    """Ordered distinct places (row * across + col) of tiles to probe: nine anchors, an 8 by 8 lattice, then the first tiles row by row."""
    across, down = across.cast("bigint"), down.cast("bigint")
    last_c, last_r, mid_c, mid_r = across - 1, down - 1, F.call_function("div", across, F.lit(2)), F.call_function("div", down, F.lit(2))
    zero = F.lit(0).cast("bigint")
    anchors = F.array(*(r * across + c for c, r in ((zero, zero), (mid_c, mid_r), (last_c, last_r), (zero, mid_r), (mid_c, zero), (last_c, mid_r), (mid_c, last_r), (last_c, zero), (zero, last_r))))
    step = lambda last, k: F.call_function("div", last * k, F.lit(7))
    lattice = F.transform(F.sequence(zero, F.lit(63).cast("bigint")), lambda i: step(last_r, F.call_function("div", i, F.lit(8))) * across + step(last_c, i % 8))
    return F.when((across > 0) & (down > 0), F.array_distinct(F.concat(anchors, lattice, counted(F.least(across * down, F.lit(first))))))


def probe_coordinates(across: Column, down: Column, *, first: int = 4096) -> Column:
    """Ordered distinct tiles (col, row) to probe, as `probe_places` has them; numbers are made distinct by a hash set, structs pair by pair."""
    return F.transform(probe_places(across, down, first=first), lambda i: _pair(i % across, F.call_function("div", i, across)))


def sampled_coordinates(across: Column, down: Column, most: int = 16) -> Column:
    """Ordered distinct tiles whose colour profiles are sampled: first, last, middle, then row by row."""
    three = F.array(_pair(0, 0), _pair(F.greatest(across - 1, F.lit(0)), F.greatest(down - 1, F.lit(0))), _pair(F.call_function("div", across, F.lit(2)), F.call_function("div", down, F.lit(2))))
    rest = F.transform(counted(F.least(across * down, F.lit(most + 3))), lambda i: _pair(i % across, F.call_function("div", i, across)))
    return F.slice(F.array_distinct(F.concat(three, rest)), 1, most)


def source_window(x: Column, y: Column, w: Column, h: Column, tile_w: Column, tile_h: Column) -> Column:
    """Source tiles (col, row) that a window of the level touches, row by row: interval arithmetic instead of an overlap join."""
    first = lambda a, t: F.call_function("div", a, t)
    cols = F.sequence(first(x, tile_w), first(x + w - 1, tile_w))
    rows = F.sequence(first(y, tile_h), first(y + h - 1, tile_h))
    return F.when((w > 0) & (h > 0), F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: _pair(c, r)))))


def pixel_spacing(mpp_x: Column, mpp_y: Column, downsample: Column) -> Column:
    """struct(row, col) spacing in millimetres; null unless both are finite and positive."""
    y, x = mpp_y * downsample / 1000, mpp_x * downsample / 1000
    good = lambda v: v.isNotNull() & ~F.isnan(v) & (v > 0) & (v < F.lit(float("inf")))
    return F.when(good(x) & good(y), F.struct(y.alias("row"), x.alias("col")))


def output_path() -> Column:
    return F.format_string("scene-%d-series-%d-level-%d-z%d-c%d-t%d.dcm", "scene", "series", "level", "z", "c", "t")


def output_paths(levels: DataFrame) -> DataFrame:
    """(source, path, is_unique) of all jobs, a row each: whether another job of the source has the path.

    Jobs meet by level, before they are many: levels of one source, scene, series and level are counted for each z, t and channel that they have.
    """
    same = levels.groupBy("source", "scene", "series", "level").agg(F.collect_list(F.struct("n_z", "n_t", "n_c")).alias("same"))
    each = same.select("*", F.explode("same").alias("own"))
    for axis in ("z", "t", "c"):
        each = each.withColumn(axis, F.explode(counted(F.col(f"own.n_{axis}"))))
    others = F.filter("same", lambda n: (n["n_z"] > F.col("z")) & (n["n_t"] > F.col("t")) & (n["n_c"] > F.col("c")))
    return each.select("source", output_path().alias("path"), ((F.size("same") == 1) | (F.size(others) == 1)).alias("is_unique"))


def batch_rows(across: Column, rows_left: Column, *, configured: int | None = None, target: int = 256) -> Column:
    """Rows of tiles handled together: as configured, or enough for `target` tiles; at least one, at most what is left."""
    want = F.lit(configured) if configured else ceil_div(F.lit(target), across)
    return F.least(F.greatest(want, F.lit(1)), rows_left)


def address_width(max_source: Column, max_destination: Column) -> Column:
    return F.when((max_source < (1 << 32)) & (max_destination < (1 << 32)), 32).otherwise(64)
