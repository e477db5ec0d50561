"""Queries of the engine's own operators over the driver's tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import dims, metric_names
from lodestrata.functions import scalars as S
from lodestrata.operators import clinical as C
from lodestrata.operators import compose as K
from lodestrata.operators import device as D
from lodestrata.operators import geometry as G
from lodestrata.operators import lines
from lodestrata.operators import lookups as L
from lodestrata.operators import metrics as M
from lodestrata.operators import offsets as O
from lodestrata.operators import reports as R
from lodestrata.operators import routes as T
from lodestrata.operators import validation as V
from lodestrata.plans import adapters as A
from lodestrata.plans import harness as H

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from lodestrata.plans import extras, writing

    return _QUERIES | extras.QUERIES | writing.QUERIES


def oracle_sql() -> dict[str, str]:
    from lodestrata.plans import extras, writing

    return _SQL | extras.sql(_JOBS, _ROUTED, _SQL["default_syntax"], _SUM_SQL) | writing.sql(_JOBS, _ROUTED, _SUM_SQL)


TILE = 512
_GRID = f"(cols + {TILE - 1}) // {TILE} AS tiles_across, (rows + {TILE - 1}) // {TILE} AS tiles_down"


@query(f"WITH {A.LEVELS_SQL} SELECT source, level, cols, rows, tiles_across, tiles_down, tiles_across * tiles_down AS frames FROM (SELECT *, {_GRID} FROM levels)")
def level_grid(spark, d):
    return G.square_grid(A.levels(spark, d), TILE).select("source", "level", "cols", "rows", "tiles_across", "tiles_down", "frames")


_JOBS = f"""{A.LEVELS_SQL}, jobs AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY scene, series, level, z, t, c) - 1 AS ordinal
  FROM (SELECT *, unnest(range(n_c)) AS c FROM (SELECT *, unnest(range(n_t)) AS t FROM (SELECT *, unnest(range(n_z)) AS z FROM levels))))"""


@query(f"WITH {_JOBS} SELECT source, level, z, t, c, ordinal, ordinal + 1 AS instance_number FROM jobs")
def job_expansion(spark, d):
    return G.jobs(A.levels(spark, d)).select("source", "level", "z", "t", "c", "ordinal", "instance_number")


@query(f"WITH {_JOBS} SELECT source, level, count(*) AS jobs, CAST(sum(tiles_across * tiles_down) AS BIGINT) AS available_frames FROM (SELECT *, {_GRID} FROM jobs) GROUP BY source, level")
def available_frames(spark, d):
    found = G.square_grid(G.jobs(A.levels(spark, d)), TILE)
    return found.groupBy("source", "level").agg(F.count("*").alias("jobs"), F.sum("frames").alias("available_frames"))


@query(f"""WITH {A.LEVELS_SQL}, sized AS (
  SELECT *, CASE WHEN own THEN tile_w ELSE {TILE} END AS frame_w, CASE WHEN own THEN tile_h ELSE {TILE} END AS frame_h FROM (
    SELECT *, (kind = 'whole' AND greatest(tile_w, tile_h) <= {TILE} AND least(tile_w, tile_h) >= {TILE // 2}) OR (kind = 'regular' AND tile_w = {TILE} AND tile_h = {TILE}) AS own FROM levels)),
grid AS (SELECT *, (cols + frame_w - 1) // frame_w AS tiles_across, (rows + frame_h - 1) // frame_h AS tiles_down FROM sized),
f AS (SELECT *, unnest(range(tiles_across)) AS col FROM (SELECT *, unnest(range(tiles_down)) AS row FROM grid))
SELECT source, level, row * tiles_across + col AS frame, col * frame_w AS x, row * frame_h AS y, least(frame_w, greatest(cols - col * frame_w, 0)) AS w, least(frame_h, greatest(rows - row * frame_h, 0)) AS h FROM f""")
def frame_explode(spark, d):
    found = G.frames(G.jpeg_frame_geometry(A.levels(spark, d), TILE))
    return found.select("source", "level", "frame", "rect.x", "rect.y", "rect.w", "rect.h")


@query(f"WITH {A.LEVELS_SQL}, n AS (SELECT *, CASE WHEN kind <> 'irregular' AND tile_w = tile_h THEN least(tile_w, {TILE}) ELSE {TILE} END AS tile FROM levels) SELECT source, level, tile, (cols + tile - 1) // tile * ((rows + tile - 1) // tile) AS frames FROM n")
def passthrough_grid(spark, d):
    n = G.j2k_tile_size(A.levels(spark, d), TILE, True).withColumn("tile", F.col("tile").cast("bigint"))
    return n.select("source", "level", "tile", (G.ceil_div("cols", "tile") * G.ceil_div("rows", "tile")).alias("frames"))


@query(f"""WITH {A.LEVELS_SQL}, g AS (SELECT *, {_GRID} FROM levels), f AS (SELECT *, unnest(range(tiles_across)) AS col FROM (SELECT *, unnest(range(tiles_down)) AS row FROM g))
SELECT source, level, col + 1 AS dimension_col, row + 1 AS dimension_row, CAST(col * {TILE} + 1 AS INTEGER) AS matrix_col, CAST(row * {TILE} + 1 AS INTEGER) AS matrix_row, round(col * {TILE} * CAST(0.0005 AS DOUBLE), 6) AS offset_x, round(row * {TILE} * CAST(0.0005 AS DOUBLE), 6) AS offset_y FROM f""")
def frame_positions(spark, d):
    grid = G.square_grid(A.levels(spark, d), TILE).withColumns({"frame_w": F.lit(TILE), "frame_h": F.lit(TILE)})
    found = G.dimension_values(G.frames(grid), 0.0005)
    return found.select("source", "level", "dimension_col", "dimension_row", "matrix_col", "matrix_row", F.round("offset_x", 6).alias("offset_x"), F.round("offset_y", 6).alias("offset_y"))


@query(f"""WITH {A.LEVELS_SQL}, g AS (SELECT *, {_GRID} FROM levels),
w AS (SELECT *, unnest(range(100 // tile_w, (100 + 700 - 1) // tile_w + 1)) AS col FROM (SELECT *, unnest(range(50 // tile_h, (50 + 300 - 1) // tile_h + 1)) AS row FROM g))
SELECT source, level, col, row FROM w""")
def source_windows(spark, d):
    lv = A.levels(spark, d)
    tiles = G.source_window(F.lit(100).cast("bigint"), F.lit(50).cast("bigint"), F.lit(700).cast("bigint"), F.lit(300).cast("bigint"), F.col("tile_w"), F.col("tile_h"))
    return lv.select("source", "level", F.explode(tiles).alias("t")).select("source", "level", "t.col", "t.row")


@query(f"""WITH {A.LEVELS_SQL}, g AS (SELECT *, {_GRID} FROM levels),
c AS (SELECT source, level, [{{'c': 0, 'r': 0}}, {{'c': tiles_across // 2, 'r': tiles_down // 2}}, {{'c': tiles_across - 1, 'r': tiles_down - 1}}, {{'c': 0, 'r': tiles_down // 2}},
        {{'c': tiles_across // 2, 'r': 0}}, {{'c': tiles_across - 1, 'r': tiles_down // 2}}, {{'c': tiles_across // 2, 'r': tiles_down - 1}}, {{'c': tiles_across - 1, 'r': 0}}, {{'c': 0, 'r': tiles_down - 1}}]
      || [{{'c': (tiles_across - 1) * (i % 8) // 7, 'r': (tiles_down - 1) * (i // 8) // 7}} FOR i IN range(64)]
      || [{{'c': i % tiles_across, 'r': i // tiles_across}} FOR i IN range(least(tiles_across * tiles_down, 4096))] AS p FROM g),
u AS (SELECT source, level, unnest(p) AS x, unnest(range(len(p))) AS i FROM c),
f AS (SELECT source, level, x.c AS col, x.r AS row, min(i) AS i FROM u GROUP BY source, level, x.c, x.r)
SELECT source, level, row_number() OVER (PARTITION BY source, level ORDER BY i) - 1 AS probe, CAST(col AS BIGINT) AS col, CAST(row AS BIGINT) AS row FROM f""")
def probe_coordinates(spark, d):
    g = G.square_grid(A.levels(spark, d), TILE)
    g = g.select("source", "level", "tiles_across", "tiles_down").distinct()
    found = g.select("source", "level", "tiles_across", F.posexplode(G.probe_places(F.col("tiles_across"), F.col("tiles_down"))).alias("probe", "at"))
    return found.select("source", "level", F.col("probe").cast("bigint").alias("probe"), F.expr("at % tiles_across").alias("col"), F.expr("at div tiles_across").alias("row"))


@query(f"""WITH {_JOBS} SELECT source, 'scene-' || scene || '-series-' || series || '-level-' || level || '-z' || z || '-c' || c || '-t' || t || '.dcm' AS path,
count(*) OVER (PARTITION BY source, scene, series, level, z, c, t) = 1 AS is_unique FROM jobs""")
def output_paths(spark, d):
    return G.output_paths(A.levels(spark, d))


_JPEG = "(compression = 'jpeg' AND bits = 8 AND error IS NULL AND (photometric <> 'RGB' OR rgb_grid))"
_ROUTED = f"""{A.PROBES_SQL}, r0 AS (SELECT *, CASE WHEN {_JPEG} AND fits THEN 'passthrough' WHEN {_JPEG} AND NOT fits AND NOT edge THEN 'retile' ELSE 'fallback' END AS route FROM probes),
routed AS (SELECT *, CASE WHEN compression = 'jpeg' AND NOT fits AND route = 'fallback' THEN CASE WHEN error IS NOT NULL THEN CASE WHEN regexp_matches(lower(error), 'mcu|restart|dct') THEN 'mcu_invalid' ELSE 'source_unsupported' END
    WHEN edge THEN 'geometry_mismatch' ELSE 'profile_unsupported' END END AS rejection, coalesce(contains(error, 'empty TIFF tiles'), false) AS blank FROM r0)"""


def _routed(spark, d):
    return T.jpeg_route(A.frame_probes(spark, d))


@query(f"WITH {_ROUTED} SELECT instance, frame, route, rejection, blank FROM routed")
def jpeg_route_class(spark, d):
    return _routed(spark, d).select("instance", "frame", "route", "rejection", "blank")


@query(f"""WITH {A.LEVELS_SQL}, g AS (SELECT *, (kind = 'whole' AND greatest(tile_w, tile_h) <= {TILE} AND least(tile_w, tile_h) >= {TILE // 2}) OR (kind = 'regular' AND tile_w = {TILE} AND tile_h = {TILE}) AS own FROM levels)
SELECT source, level, own AND (kind = 'whole' OR (cols % tile_w = 0 AND rows % tile_h = 0)) OR (NOT own AND kind = 'whole' AND tile_w = {TILE} AND tile_h = {TILE}) AS rgb_grid FROM g""")
def rgb_grids(spark, d):
    return G.rgb_grid(G.jpeg_frame_geometry(A.levels(spark, d), TILE)).select("source", "level", "rgb_grid")


_J2K_PASS = "(compression = 'jp2k' AND fits AND error IS NULL)"
_J2K = f"""{A.PROBES_SQL}, j AS (SELECT *, coalesce(compression = 'jpeg' AND error IS NULL AND fits AND photometric <> 'YBR_FULL_422', false) AS transcode FROM probes)"""


@query(f"""WITH {_J2K} SELECT instance, frame, CASE WHEN {_J2K_PASS} AND bits = 8 AND components IN (1, 3) THEN 'passthrough' WHEN {_J2K_PASS} THEN 'j2k_direct' WHEN transcode THEN 'jpeg_direct' ELSE 'fallback' END AS route,
compression = 'jpeg' AND NOT transcode AS jpeg_direct_rejected FROM j""")
def j2k_route_class(spark, d):
    return T.j2k_route(A.frame_probes(spark, d), "Htj2kLosslessRpcl").select("instance", "frame", "route", "jpeg_direct_rejected")


@query(f"WITH {_J2K} SELECT instance, frame, CASE WHEN {_J2K_PASS} THEN 'passthrough' WHEN edge AND compression = 'jp2k' THEN 'fallback' ELSE 'unsupported' END AS route FROM j")
def j2k_passthrough_only_route(spark, d):
    return T.j2k_route(A.frame_probes(spark, d), "Jpeg2000").select("instance", "frame", "route")


def _default_sql(where: str) -> str:
    says = f"frame = 0 AND NOT synthetic{where}"
    return f"""WITH {_ROUTED}, s AS (SELECT source, coalesce(bool_or(route = 'passthrough') FILTER ({says}), false) AS jpeg, coalesce(bool_or({_J2K_PASS}) FILTER ({says}), false) AS ok,
 coalesce(bool_or(compression = 'jp2k' AND NOT {_J2K_PASS}) FILTER ({says}), false) AS blocked FROM routed WHERE frame = 0 GROUP BY source)
SELECT source, CASE WHEN jpeg THEN 'JpegBaseline8Bit' WHEN ok AND NOT blocked THEN 'Jpeg2000' ELSE 'Htj2kLosslessRpcl' END AS syntax FROM s"""


@query(_default_sql(""))
def default_syntax(spark, d):
    return T.default_syntax(A.frame_probes(spark, d))


@query(_default_sql(" AND level < 2 AND level = 1"))
def default_syntax_of_a_level(spark, d):
    return T.default_syntax(A.frame_probes(spark, d), max_levels=2, level=1)


@query(f"WITH {_ROUTED} SELECT instance, count(*) AS frames, bool_and(route = 'passthrough') AS all_pass FROM routed GROUP BY instance")
def all_or_nothing_passthrough(spark, d):
    return T.all_or_nothing(A.frame_probes(spark, d))


@query(f"WITH {A.PROBES_SQL} SELECT instance, count(DISTINCT (components, bits, photometric)) AS profiles, count(DISTINCT (components, bits, photometric)) = 1 AS consistent FROM probes GROUP BY instance")
def profile_consistency(spark, d):
    return T.profile_consistency(A.frame_probes(spark, d))


_KNOWN = "route <> 'fallback'"


@query(f"""WITH {_ROUTED} SELECT source, level, count(*) FILTER ({_KNOWN} AND components = 1) AS gray, count(*) FILTER ({_KNOWN} AND components = 3) AS rgb_like, count(*) FILTER ({_KNOWN} AND bits = 8) AS bits8,
 count(*) FILTER ({_KNOWN} AND bits = 16) AS bits16, count(*) FILTER (route = 'fallback') AS unknown FROM routed GROUP BY source, level""")
def pixel_histogram(spark, d):
    m = M.aggregate(M.measures(_routed(spark, d)), ["source", "level"])
    return m.select("source", "level", F.col("gray_frames").alias("gray"), F.col("rgb_like_frames").alias("rgb_like"), F.col("bits8_frames").alias("bits8"), F.col("bits16_frames").alias("bits16"), F.col("unknown_profile_frames").alias("unknown"))


_SUM_SQL = f"""count(*) AS total_frames, count(*) FILTER (route = 'passthrough') AS passthrough_frames, count(*) FILTER (route = 'retile') AS retile_frames, count(*) FILTER (route = 'fallback') AS fallback_frames,
 count(*) FILTER (route = 'fallback') AS unknown_profile_frames, count(*) FILTER ({_KNOWN} AND components = 1) AS gray_frames, count(*) FILTER ({_KNOWN} AND components = 3) AS rgb_like_frames,
 count(*) FILTER ({_KNOWN} AND components NOT IN (1, 3)) AS other_component_frames, count(*) FILTER ({_KNOWN} AND bits = 8) AS bits8_frames, count(*) FILTER ({_KNOWN} AND bits = 16) AS bits16_frames,
 count(*) FILTER ({_KNOWN} AND bits NOT IN (8, 16)) AS other_bit_depth_frames,
 count(*) FILTER (rejection = 'source_unsupported') AS rejected_source_unsupported, count(*) FILTER (rejection = 'geometry_mismatch') AS rejected_geometry_mismatch,
 count(*) FILTER (rejection = 'profile_unsupported') AS rejected_profile_unsupported, count(*) FILTER (rejection = 'mcu_invalid') AS rejected_mcu_invalid,
 CAST(sum(CASE WHEN route = 'fallback' THEN micros ELSE 0 END) AS BIGINT) AS encode_micros"""


@query(f"WITH {_ROUTED} SELECT source, level, {_SUM_SQL}, max(micros) AS max_micros FROM routed GROUP BY source, level")
def metrics_by_level(spark, d):
    return M.aggregate(M.measures(_routed(spark, d)), ["source", "level"])


@query(f"WITH {_ROUTED} SELECT source, level, CAST(grouping(source, level) AS BIGINT) AS grain, {_SUM_SQL} FROM routed GROUP BY ROLLUP (source, level)")
def coverage_rollup(spark, d):
    return M.coverage(M.measures(_routed(spark, d)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route coverage at level, source and corpus grain, with shares and whether every frame is decided."""
    found = coverage_rollup(spark, sf_dir)
    left = M.unclassified(F.col("total_frames"), [F.col(f"{r}_frames") for r in M.ROUTES])
    return found.withColumns({"passthrough_percent": F.round(M.percent(F.col("passthrough_frames"), F.col("total_frames")), 6), "complete": left == 0})


_COUNTERS = {n: 3 + 2 * i for i, n in enumerate(("jpeg_passthrough_frames", "j2k_passthrough_frames", "jpeg_retile_frames", "jpeg_retile_to_htj2k_53_frames", *(c for c in metric_names.DECIDED if c != metric_names.RETILE_BASELINE)))}


@query(f"""WITH c AS (SELECT l_orderkey % 500 AS source, sum(l_partkey % 97) AS total_frames, {", ".join(f"sum(l_partkey % {m}) AS {n}" for n, m in _COUNTERS.items())} FROM lineitem GROUP BY source),
b AS (SELECT *, greatest(jpeg_retile_frames - jpeg_retile_to_htj2k_53_frames, 0) AS baseline FROM c)
SELECT source, CAST(baseline AS DECIMAL(38, 0)) AS retile_baseline, CAST(greatest(total_frames - jpeg_passthrough_frames - j2k_passthrough_frames - j2k_direct_htj2k_frames - jpeg_direct_htj2k_53_frames
 - jpeg_direct_htj2k_97_frames - baseline - gpu_transcode_frames - cpu_fallback_frames, 0) AS DECIMAL(38, 0)) AS unclassified FROM b""")
def unclassified_frames(spark, d):
    rows = A.table(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("source"), (F.col("l_partkey") % 97).alias("total_frames"), *((F.col("l_partkey") % m).alias(n) for n, m in _COUNTERS.items()))
    as_decimal = lambda c: c.cast("decimal(38,0)")
    return M.serialised(rows, ["source"]).select("source", as_decimal(M.retile_baseline_frames()).alias("retile_baseline"), as_decimal(M.unclassified_frames()).alias("unclassified"))


@query(f"""WITH {A.PROBES_SQL}, t AS (SELECT *, coalesce(sum(micros) OVER (PARTITION BY source, level ORDER BY instance, frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= 200000 AS begun FROM probes)
SELECT source, level, count(*) FILTER (begun) AS done, CAST(coalesce(sum(micros) FILTER (begun), 0) AS BIGINT) AS elapsed, bool_or(NOT begun) AS exceeded FROM t GROUP BY source, level""")
def level_deadlines(spark, d):
    return T.past_deadline(A.frame_probes(spark, d), ["source", "level"], ["instance", "frame"], 200_000)


@query(f"""WITH {A.PROBES_SQL} SELECT source, array_to_string(list_sort(list(DISTINCT compression)), ',') AS all_values, CASE WHEN count(DISTINCT compression) = 1 THEN min(compression) END AS common FROM probes WHERE frame = 0 GROUP BY source""")
def common_syntax(spark, d):
    found = M.common_value(A.frame_probes(spark, d).where("frame = 0"), ["source"], "compression")
    return found.select("source", F.array_join("all_values", ",").alias("all_values"), "common")


@query(f"WITH {A.PROBES_SQL} SELECT instance, frame, bytes + bytes % 2 AS padded, CAST(coalesce(sum(bytes + bytes % 2 + 8) OVER (PARTITION BY instance ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM probes")
def offset_table(spark, d):
    return O.offset_table(A.frame_probes(spark, d)).select("instance", "frame", "padded", "offset")


@query(f"""WITH {A.PROBES_SQL}, starts AS (SELECT instance, frame AS fragment, row_number() OVER (PARTITION BY instance ORDER BY frame) - 1 AS frame FROM probes WHERE frame % 2 = 0)
SELECT s.instance, s.frame, s.fragment AS first, coalesce(lead(s.fragment) OVER (PARTITION BY s.instance ORDER BY s.frame), n) - 1 AS last, true AS valid
FROM starts s JOIN (SELECT instance, count(*) AS n FROM probes GROUP BY instance) c ON s.instance = c.instance""")
def fragment_assembly(spark, d):
    fragments = A.frame_probes(spark, d).select("instance", F.col("frame").alias("fragment"), "bytes")
    at = O.offset_table(A.frame_probes(spark, d)).where("frame % 2 = 0")  # every frame has two fragments
    starts = at.select("instance", F.call_function("div", F.col("frame"), F.lit(2)).alias("frame"), "offset")
    return O.fragment_ranges(fragments, starts)


@query(f"""WITH {_ROUTED}, i AS (SELECT *, row_number() OVER (PARTITION BY instance ORDER BY frame) - row_number() OVER (PARTITION BY instance, route ORDER BY frame) AS g FROM routed)
SELECT instance, min(frame) AS first, max(frame) AS last, count(*) AS frames FROM i WHERE route = 'fallback' GROUP BY instance, g""")
def fallback_runs(spark, d):
    return T.fallback_runs(_routed(spark, d))


@query(f"""WITH {A.PROBES_SQL}, c AS (SELECT instance, CASE WHEN fits IS DISTINCT FROM lag(fits) OVER (PARTITION BY instance ORDER BY frame) THEN 1 ELSE 0 END AS x FROM probes) SELECT instance, CAST(sum(x) AS BIGINT) AS runs FROM c GROUP BY instance""")
def padded_runs(spark, d):
    return T.run_count(A.frame_probes(spark, d), "fits").withColumn("runs", F.col("runs").cast("bigint"))


@query(f"WITH {A.PROBES_SQL} SELECT instance, CASE WHEN sum(bytes) > 0 THEN round(sum({TILE * TILE} * components * ((bits + 7) // 8)) / sum(bytes), 6) END AS ratio FROM probes GROUP BY instance")
def lossy_ratio(spark, d):
    return O.lossy_ratio(A.frame_probes(spark, d), TILE).withColumn("ratio", F.round("ratio", 6))


@query(f"WITH {_ROUTED} SELECT source, level, instance, frame, route FROM (SELECT *, row_number() OVER (PARTITION BY source, level ORDER BY instance, frame) AS n FROM routed) WHERE n <= 64")
def budgeted_sample(spark, d):
    return T.budgeted(_routed(spark, d), ["source", "level"], ["instance", "frame"], 64).select("source", "level", "instance", "frame", "route")


@query("""WITH r AS (SELECT l_orderkey AS probe, l_shipmode AS route, ord, CAST(floor(l_extendedprice) AS BIGINT) AS micros FROM (SELECT l_orderkey, l_extendedprice, CAST(l_linenumber % 3 AS INTEGER) AS ord, CASE l_linenumber % 3 WHEN 0 THEN 'cpu' WHEN 1 THEN 'metal' ELSE 'cuda' END AS l_shipmode FROM lineitem)),
a AS (SELECT probe, min(micros) FILTER (route = 'cpu') AS cpu, min({'m': micros, 'o': ord, 'r': route}) FILTER (route <> 'cpu') AS dev FROM r GROUP BY probe)
SELECT probe, CASE WHEN dev IS NOT NULL AND (cpu IS NULL OR dev.m * 100 < cpu * 92) THEN dev.r ELSE 'cpu' END AS route FROM a""")
def argmin_route(spark, d):
    rows = A.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("probe"), F.expr("case l_linenumber % 3 when 0 then 'cpu' when 1 then 'metal' else 'cuda' end").alias("route"),
        F.expr("l_linenumber % 3").alias("ord"), F.expr("cast(floor(l_extendedprice) as bigint)").alias("micros"),
    )
    return T.best_route(rows)


@query("""WITH s AS (SELECT doc_id AS slide, source || '/' || doc_id || '/' || CASE doc_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'File' ELSE 'x' END || (doc_id % 40) || '.SVS' AS path FROM documents),
m AS (SELECT p_partkey AS position, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE 'id' || p_partkey END AS file_id, CASE WHEN p_partkey % 5 = 0 THEN 'src' || (p_partkey % 20) || '/' || p_partkey || '/x' || (p_partkey % 40) || '.SVS' ELSE 'file' || p_partkey || '.svs' END AS filename FROM part),
j AS (SELECT slide, 1 AS tier, position, file_id FROM s JOIN m ON path = filename
 UNION ALL SELECT slide, 2, position, file_id FROM s JOIN m ON split_part(path, '/', -2) = file_id
 UNION ALL SELECT slide, 3, position, file_id FROM s JOIN m ON lower(split_part(path, '/', -1)) = lower(split_part(filename, '/', -1))),
b AS (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY tier, position) AS n FROM j)
SELECT s.slide, b.tier, b.file_id FROM s LEFT JOIN b ON s.slide = b.slide AND n = 1""")
def manifest_match(spark, d):
    slides = A.table(spark, d, "documents").select(F.col("doc_id").alias("slide"), F.expr("concat(source, '/', doc_id, '/', case doc_id % 4 when 0 then 'A' when 1 then 'File' else 'x' end, doc_id % 40, '.SVS')").alias("path"))
    manifest = A.table(spark, d, "part").select(
        F.col("p_partkey").alias("position"), F.expr("case when p_partkey % 3 = 0 then string(p_partkey) else concat('id', p_partkey) end").alias("file_id"),
        F.expr("case when p_partkey % 5 = 0 then concat('src', p_partkey % 20, '/', p_partkey, '/x', p_partkey % 40, '.SVS') else concat('file', p_partkey, '.svs') end").alias("filename"),
    )
    return L.manifest_match(slides, manifest)


_REFS = f"""{A.RESOURCES_SQL}, every AS (SELECT bundle FROM report UNION SELECT bundle FROM request),
ps AS (SELECT bundle, count(*) AS patients, count(*) AS patients_hit FROM patient GROUP BY bundle),
ss AS (SELECT s.bundle, count(*) AS specimens, count(*) FILTER (s.id = r.specimen) AS specimens_hit FROM specimen s LEFT JOIN report r ON r.bundle = s.bundle GROUP BY s.bundle),
qs AS (SELECT q.bundle, count(*) AS requests, count(*) FILTER (q.id = r.request) AS requests_hit FROM request q LEFT JOIN report r ON r.bundle = q.bundle GROUP BY q.bundle),
h AS MATERIALIZED (SELECT e.bundle, {", ".join(f"coalesce({w}s{t}, 0) AS {w}s{t}" for w in ("patient", "specimen", "request") for t in ("_hit", ""))}, r.bundle IS NOT NULL AS reported
  FROM every e LEFT JOIN report r ON r.bundle = e.bundle LEFT JOIN ps ON ps.bundle = e.bundle LEFT JOIN ss ON ss.bundle = e.bundle LEFT JOIN qs ON qs.bundle = e.bundle),
resolved AS MATERIALIZED (SELECT * EXCLUDE (reported), CASE WHEN NOT reported THEN 'needs one report'
  {" ".join(f"WHEN {w}s > {w}s_hit THEN 'unreferenced {w}' WHEN {w}s_hit <> 1 THEN '{n} not found once'" for _, n, w in L.REFERENCED)} END AS error FROM h)"""


@query(f"WITH {_REFS} SELECT * FROM resolved")
def fhir_resolution(spark, d):
    return L.resolve_references(A.resources(spark, d))


@query(f"""WITH {_REFS} {" UNION ALL ".join(f"SELECT o.bundle, '{t}' AS type, o.id FROM {w} o LEFT JOIN report r ON r.bundle = o.bundle WHERE r.{n} IS DISTINCT FROM o.id" for t, n, w in L.REFERENCED)}""")
def unreferenced_resources(spark, d):
    return L.unreferenced(A.resources(spark, d))


@query(f"WITH {A.RESOURCES_SQL} SELECT bundle, patient_id, patient_name, birth_date, sex FROM patient")
def fhir_patients(spark, d):
    return L.patient_fields(A.resources(spark, d))


_SETTINGS = {"tools": {"cpu": ["run", "{path}"], "device": ["run", "--device", "{path}"]}, "profiles": ["1-URGENT", "3-MEDIUM", "none"], "scopes": ["base", "full"], "runs": 3}


@query(f"""WITH {A.TRIALS_SQL}, planned AS (SELECT * FROM (SELECT DISTINCT 'slide-' || p_partkey % 60 AS slide FROM part), (SELECT unnest({list(_SETTINGS["tools"])}) AS tool), (SELECT unnest({_SETTINGS["profiles"]}) AS profile),
 (SELECT unnest({_SETTINGS["scopes"]}) AS scope), (SELECT CAST(unnest(range(1, {_SETTINGS["runs"] + 1})) AS INTEGER) AS run_index))
SELECT * FROM planned p WHERE NOT EXISTS (SELECT 1 FROM trials t WHERE t.slide = p.slide AND t.tool = p.tool AND t.profile = p.profile AND t.scope = p.scope AND t.run_index = p.run_index)""")
def resume_plan(spark, d):
    slides = A.table(spark, d, "part").select(F.concat(F.lit("slide-"), F.col("p_partkey") % 60).alias("slide")).distinct().withColumn("path", F.concat("slide", F.lit(".svs")))
    return H.resumed(H.planned(slides, **_SETTINGS), A.trials(spark, d)).select("slide", "tool", "profile", "scope", "run_index")


_LABELED = f"""{A.TRIALS_SQL}, labeled AS (SELECT *, coalesce(nullif(label, ''), CASE tool WHEN 'cpu' THEN 'CPU' WHEN 'baseline' THEN 'Baseline' ELSE CASE
  WHEN hint LIKE '%cuda%' OR hint LIKE '%nvidia%' THEN 'CUDA' WHEN hint LIKE '%metal%' OR hint LIKE '%darwin%' THEN 'Metal' WHEN system_label IS NOT NULL THEN 'Device (' || system_label || ')' ELSE 'Device' END END) AS result_label
  FROM (SELECT *, lower(concat_ws(' ', system_label, output_dir, stdout_path, source_path)) AS hint FROM trials))"""


@query(f"WITH {_LABELED} SELECT seq, result_label FROM labeled")
def label_inference(spark, d):
    return R.with_label(A.trials(spark, d)).select("seq", "result_label")


@query(f"""WITH {_LABELED}, g AS (SELECT slide, profile, scope, result_label, count(*) AS n, count(*) FILTER (status = 'passed') AS passed, avg(seconds) FILTER (status = 'passed') AS seconds, arg_max(status, seq) AS last FROM labeled GROUP BY ALL)
SELECT slide, profile, scope, result_label, CASE result_label WHEN 'CPU' THEN 0 WHEN 'Metal' THEN 1 WHEN 'CUDA' THEN 2 WHEN 'Device' THEN 3 WHEN 'Baseline' THEN 4 ELSE 50 END AS rank, n, passed, round(seconds, 6) AS seconds,
CASE WHEN passed = n THEN 'passed' WHEN passed > 0 THEN 'partial ' || passed || '/' || n ELSE last END AS status FROM g""")
def trial_summary(spark, d):
    return R.summary(R.with_label(A.trials(spark, d))).withColumn("seconds", F.round("seconds", 6))


@query(f"""WITH {_LABELED}, w AS (SELECT slide, profile, scope, {', '.join(f"avg(seconds) FILTER (status = 'passed' AND result_label = '{x}') AS {x.lower()}_seconds" for x in ('CPU', 'CUDA', 'Metal', 'Baseline'))} FROM labeled GROUP BY ALL)
SELECT slide, profile, scope, {', '.join(f'round({x}_seconds, 6) AS {x}_seconds' for x in ('cpu', 'cuda', 'metal', 'baseline'))}, round(cpu_seconds / coalesce(cuda_seconds, metal_seconds), 6) AS cpu_ratio, round(baseline_seconds / coalesce(cuda_seconds, metal_seconds), 6) AS baseline_ratio FROM w""")
def trial_pivot(spark, d):
    found = R.pivot(R.with_label(A.trials(spark, d)))
    return found.select("slide", "profile", "scope", *(F.round(c, 6).alias(c) for c in found.columns[3:]))


@query(f"WITH {A.TRIALS_SQL} SELECT seq, status, 'first' AS result_set, tool FROM trials WHERE seq % 2 = 0 UNION ALL SELECT seq, status, 'second', NULL FROM trials WHERE seq % 2 = 1")
def merge_results(spark, d):
    t = A.trials(spark, d)
    return R.merge_results([("first", t.where("seq % 2 = 0").select("seq", "status", "tool")), ("second", t.where("seq % 2 = 1").select("seq", "status"))]).select("seq", "status", "result_set", "tool")


@query(f"""WITH {A.TRIALS_SQL}, t AS (SELECT slide AS cell, tool, seconds, seq % 7 AS device_frames, 7 AS total_frames FROM trials),
g AS (SELECT coalesce(c.cell, v.cell) AS cell, cpu, device, on_device, frames FROM (SELECT cell, min(seconds) AS cpu FROM t WHERE tool = 'cpu' GROUP BY cell) c
 FULL JOIN (SELECT cell, min(seconds) AS device, sum(device_frames) AS on_device, sum(total_frames) AS frames FROM t WHERE tool = 'device' GROUP BY cell) v ON c.cell = v.cell),
p AS (SELECT *, CASE WHEN frames > 0 THEN 100.0 * on_device / frames ELSE 0 END AS pct, CASE WHEN device > 0 THEN cpu / device END AS s FROM g)
SELECT cell, round(pct, 6) AS percent, round(s, 6) AS speedup, CASE WHEN device IS NULL THEN 'no device run' WHEN cpu IS NULL THEN 'no CPU run' WHEN pct < 40 THEN 'frames off device' WHEN coalesce(s, 0) < 1 THEN 'too slow' END AS reason FROM p""")
def preflight_gate(spark, d):
    runs = A.trials(spark, d).select(F.col("slide").alias("cell"), "tool", "seconds", (F.col("seq") % 7).alias("device_frames"), F.lit(7).alias("total_frames"))
    return R.gate(runs, min_percent=40.0).select("cell", F.round("percent", 6).alias("percent"), F.round("speedup", 6).alias("speedup"), "reason")


_DATES = """d AS (SELECT o_orderkey AS k, lpad(CAST(1990 + o_orderkey % 20 AS VARCHAR), 4, '0') || lpad(CAST(o_custkey % 14 AS VARCHAR), 2, '0') || lpad(CAST(o_orderkey % 33 AS VARCHAR), 2, '0') AS da,
 lpad(CAST(o_orderkey % 26 AS VARCHAR), 2, '0') || lpad(CAST(o_custkey % 63 AS VARCHAR), 2, '0') || lpad(CAST(o_orderkey % 61 AS VARCHAR), 2, '0') || CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '.' || (o_custkey % 1000) WHEN 2 THEN '.1234567' ELSE '.5' END AS tm FROM orders)"""
_P = lambda c, a, n: f"coalesce(TRY_CAST(substr({c}, {a}, {n}) AS INTEGER), 0)"
_DIM = lambda y, m: f"CASE WHEN {m} = 2 THEN CASE WHEN ({y} % 4 = 0 AND {y} % 100 <> 0) OR {y} % 400 = 0 THEN 29 ELSE 28 END WHEN {m} IN (4, 6, 9, 11) THEN 30 WHEN {m} BETWEEN 1 AND 12 THEN 31 ELSE 0 END"
_DA = lambda c: f"({_P(c, 1, 4)} > 0 AND {_P(c, 5, 2)} BETWEEN 1 AND 12 AND {_P(c, 7, 2)} BETWEEN 1 AND {_DIM(_P(c, 1, 4), _P(c, 5, 2))})"
_TM = lambda c: f"(regexp_matches({c}, '^[0-9]{{6}}(\\.[0-9]{{1,6}})?$') AND {_P(c, 1, 2)} <= 23 AND {_P(c, 3, 2)} <= 59 AND {_P(c, 5, 2)} <= 59)"


@query(f"WITH {_DATES} SELECT k, da, tm, {_DA('da')} AS da_ok, {_TM('tm')} AS tm_ok, {_DA('da')} AND {_TM('tm')} AS dt_ok FROM d")
def date_validation(spark, d):
    pad = lambda e: F.lpad(F.expr(e).cast("string"), 2, "0")
    da = F.concat(F.expr("string(1990 + o_orderkey % 20)"), pad("o_custkey % 14"), pad("o_orderkey % 33"))
    tail = F.expr("case o_orderkey % 4 when 0 then '' when 1 then concat('.', o_custkey % 1000) when 2 then '.1234567' else '.5' end")
    tm = F.concat(pad("o_orderkey % 26"), pad("o_custkey % 63"), pad("o_orderkey % 61"), tail)
    rows = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), da.alias("da"), tm.alias("tm"))
    return rows.select("k", "da", "tm", S.valid_da(F.col("da")).alias("da_ok"), S.valid_tm(F.col("tm")).alias("tm_ok"), S.valid_dt(F.concat("da", "tm")).alias("dt_ok"))


@query("""SELECT doc_id, length(text) <= 1024 AND NOT regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}]') AS text_ok, regexp_matches(upper(source), '^[A-Z0-9_ ]{0,16}$') AS cs_ok,
regexp_matches('1.2.' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.' ELSE '' END, '^[0-9]+(\\.[0-9]+)*$') AS ui_ok FROM documents""")
def text_validation(spark, d):
    rows = A.table(spark, d, "documents")
    ui = F.concat(F.lit("1.2."), "doc_id", F.when(F.col("doc_id") % 3 == 0, ".").otherwise(""))
    return rows.select("doc_id", S.valid_text(F.col("text"), 1024).alias("text_ok"), S.valid_cs(F.upper("source")).alias("cs_ok"), S.valid_ui(ui).alias("ui_ok"))


@query(r"""SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(lower(regexp_replace(text, '[^\p{L}\p{N}._-]', '-', 'g')), '^-+|-+$', '', 'g'), '-{2,}', '-', 'g'), ''), 'slide') AS slug FROM documents""")
def slug(spark, d):
    return A.table(spark, d, "documents").select("doc_id", S.slug(F.col("text")).alias("slug"))


@query("SELECT p_partkey, '2.25.' || CAST(CAST('0x' || substr(sha256(p_name || ':' || p_partkey), 1, 32) AS UHUGEINT) AS VARCHAR) AS uid FROM part")
def instance_uid(spark, d):
    return A.table(spark, d, "part").select("p_partkey", S.uid(F.concat_ws(":", "p_name", "p_partkey")).alias("uid"))


@query("SELECT page_id, url, lower(regexp_extract(split_part(split_part(url, '?', 1), '#', 1) || CASE page_id % 4 WHEN 0 THEN '.SVS' WHEN 1 THEN '.ndpi' WHEN 2 THEN '.txt' ELSE '' END, '[^/]\\.([^./]+)$', 1)) IN ('svs', 'tif', 'tiff', 'ndpi', 'scn', 'dcm', 'mrxs', 'vms', 'vmu') AS candidate FROM pages")
def wsi_candidates(spark, d):
    path = F.concat(F.regexp_extract("url", "^[^?#]*", 0), F.expr("case page_id % 4 when 0 then '.SVS' when 1 then '.ndpi' when 2 then '.txt' else '' end"))
    return A.table(spark, d, "pages").select("page_id", "url", S.is_slide_path(path).alias("candidate"))


@query("""WITH p AS (SELECT path, (row_number() OVER (ORDER BY path) - 1) // 512 AS chunk FROM (SELECT lpad(CAST(page_id AS VARCHAR), 9, '0') AS path FROM pages))
SELECT chunk, count(*) AS files, min(path) AS first, max(path) AS last FROM p GROUP BY chunk""")
def chunked_checks(spark, d):
    found = V.chunked(A.table(spark, d, "pages").select(F.lpad(F.col("page_id").cast("string"), 9, "0").alias("path")))
    return found.select("chunk", F.size("paths").cast("bigint").alias("files"), F.get("paths", F.lit(0)).alias("first"), F.element_at("paths", -1).alias("last"))


@query("""SELECT event_id, CASE WHEN json_type(b, '$.name') = 'VARCHAR' THEN nullif(json_extract_string(b, '$.name'), '') END AS name, CASE WHEN json_type(b, '$.k') = 'VARCHAR' THEN nullif(json_extract_string(b, '$.k'), '') END AS k_text, json_extract_string(props, '$.k') AS k
FROM (SELECT event_id, props, '{"name":"' || CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END || '","k":' || user_id || '}' AS b FROM events)""")
def json_fields(spark, d):
    b = F.expr("""concat('{"name":"', if(event_id % 5 = 0, '', event_type), '","k":', user_id, '}')""")
    return A.table(spark, d, "events").select("event_id", S.json_text(b, "$.name").alias("name"), S.json_text(b, "$.k").alias("k_text"), F.get_json_object("props", "$.k").alias("k"))


@query("""SELECT vec_id, array_to_string([CASE WHEN i % 10 < 8 AND i // 10 < 8 THEN CAST(round(embedding[(i // 10) * 8 + i % 10 + 1] * 1000) AS INTEGER) ELSE 0 END FOR i IN range(100)], ',') AS padded FROM embeddings""")
def tile_padding(spark, d):
    padded = S.pad_tile(F.col("embedding"), 8, 8, 10, 10)
    return A.table(spark, d, "embeddings").select("vec_id", F.array_join(F.transform(padded, lambda x: F.round(x * F.lit(1000).cast("float")).cast("int")), ",").alias("padded"))  # in floats, as SQL


@query("""SELECT event_type AS iteration, count(*) AS frames, round(sum(CAST(floor(value * 1000) AS BIGINT)) / 1000000.0, 6) AS seconds, round(count(*) / (sum(CAST(floor(value * 1000) AS BIGINT)) / 1000000.0), 4) AS frames_per_second FROM events GROUP BY event_type""")
def iteration_rate(spark, d):
    rows = A.table(spark, d, "events").select(F.col("event_type").alias("iteration"), F.lit(1).cast("bigint").alias("frames"), F.floor(F.col("value") * 1000).cast("bigint").alias("micros"))
    return R.iteration_rates(rows).select("iteration", "frames", F.round("seconds", 6).alias("seconds"), F.round("frames_per_second", 4).alias("frames_per_second"))


@query(f"WITH {A.PROBES_SQL} SELECT instance, frame, CASE WHEN micros > 0 AND micros < 1000 THEN 1 ELSE micros // 1000 END AS reported, CASE WHEN bytes = 0 THEN 0.0 ELSE round(micros / bytes, 6) END AS parallelism FROM probes")
def reported_times(spark, d):
    return A.frame_probes(spark, d).select("instance", "frame", M.reported_micros(F.col("micros")).alias("reported"), F.round(M.effective_parallelism(F.col("micros"), F.col("bytes")), 6).alias("parallelism"))


@query("""SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_type <> 'error') WHERE n = 1""")
def decision_cache(spark, d):
    rows = A.table(spark, d, "events").withColumn("decision", F.when(F.col("event_type") == "error", "undecided").otherwise(F.col("event_type")))
    return L.upsert_latest(rows, ["user_id"], "event_id").select("user_id", "event_type", "value")


@query("SELECT l_suppkey, count(*) FILTER (l_linestatus = 'O') AS passed, count(*) FILTER (l_returnflag = 'R' AND l_linestatus <> 'O') AS failed, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus <> 'O') AS skipped, bool_or(l_returnflag = 'R' AND l_linestatus <> 'O') AS has_failures FROM lineitem GROUP BY l_suppkey")
def check_counts(spark, d):
    rows = A.table(spark, d, "lineitem").withColumn("status", F.expr("case when l_linestatus = 'O' then 'passed' when l_returnflag = 'R' then 'failed' else 'skipped' end"))
    return M.check_counts(rows, ["l_suppkey"]).drop("missing")


@query(f"""WITH {A.PROBES_SQL}, t AS (SELECT instance, frame, CASE instance % 5 WHEN 0 THEN 'Jpeg2000' WHEN 1 THEN 'Jpeg2000Lossless' WHEN 2 THEN 'Htj2k' WHEN 3 THEN 'Htj2kLossless' ELSE 'JpegBaseline8Bit' END AS target,
 CASE frame % 4 WHEN 0 THEN 'Jpeg2000Lossless' WHEN 1 THEN 'Jpeg2000Lossy' WHEN 2 THEN 'HtJpeg2000Lossless' ELSE 'HtJpeg2000Lossy' END AS candidate FROM probes)
SELECT *, CASE target WHEN 'Jpeg2000' THEN CASE WHEN candidate LIKE 'Jpeg%' THEN candidate END WHEN 'Jpeg2000Lossless' THEN 'Jpeg2000Lossless' WHEN 'Htj2k' THEN CASE WHEN candidate LIKE 'Ht%' THEN candidate END WHEN 'Htj2kLossless' THEN 'HtJpeg2000Lossless' END AS required FROM t""")
def required_syntax(spark, d):
    rows = A.frame_probes(spark, d).select(
        "instance", "frame", F.expr("case instance % 5 when 0 then 'Jpeg2000' when 1 then 'Jpeg2000Lossless' when 2 then 'Htj2k' when 3 then 'Htj2kLossless' else 'JpegBaseline8Bit' end").alias("target"),
        F.expr("case frame % 4 when 0 then 'Jpeg2000Lossless' when 1 then 'Jpeg2000Lossy' when 2 then 'HtJpeg2000Lossless' else 'HtJpeg2000Lossy' end").alias("candidate"),
    )
    return T.required_passthrough(rows, dims.passthrough_matrix(spark)).select("instance", "frame", "target", "candidate", "required")


@query("""SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE (contains(lower(p_name), 'a') OR contains(lower(p_brand), 'a') OR contains(lower(p_type), 'a') OR contains(CAST(p_size AS VARCHAR), 'a'))
AND (contains(lower(p_name), '1') OR contains(lower(p_brand), '1') OR contains(lower(p_type), '1') OR contains(CAST(p_size AS VARCHAR), '1'))""")
def select_slides(spark, d):
    found = L.select_slides(A.table(spark, d, "part"), ["A", "1"], ["p_name", "p_brand", "p_type", "p_size"], order="p_partkey")
    return found.select("p_partkey", "p_name", "p_brand", "p_type")


@query("""WITH b AS (SELECT o_orderkey AS bundle, CASE o_orderkey % 3 WHEN 0 THEN '{"resourceType":"Patient","id":"p' || o_custkey || '"}'
  ELSE '{"resourceType":"Bundle","entry":[{"resource":{"resourceType":"Specimen","id":"s' || o_orderkey || '","accessionIdentifier":{"value":"' || CASE o_orderkey % 2 WHEN 0 THEN '' ELSE 'a' END || '"}}},{"note":1},{"resource":{"resourceType":"ServiceRequest","id":"q"}}]}' END AS body FROM orders)
SELECT bundle, 0 AS pos, 'Patient' AS type, json_extract_string(body, '$.id') AS id FROM b WHERE bundle % 3 = 0
UNION ALL SELECT bundle, 0, 'Specimen', json_extract_string(body, '$.entry[0].resource.id') FROM b WHERE bundle % 3 <> 0
UNION ALL SELECT bundle, 2, 'ServiceRequest', 'q' FROM b WHERE bundle % 3 <> 0""")
def bundle_resources(spark, d):
    body = F.expr("""case o_orderkey % 3 when 0 then concat('{"resourceType":"Patient","id":"p', o_custkey, '"}')
      else concat('{"resourceType":"Bundle","entry":[{"resource":{"resourceType":"Specimen","id":"s', o_orderkey, '","accessionIdentifier":{"value":"', if(o_orderkey % 2 = 0, '', 'a'), '"}}},{"note":1},{"resource":{"resourceType":"ServiceRequest","id":"q"}}]}') end""")
    rows = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("bundle"), body.alias("body"))
    return C.bundle_resources(rows).select("bundle", "pos", "type", "id")


@query(f"""WITH {_REFS} SELECT h.bundle, p.patient_id, p.patient_name, p.birth_date, p.sex, s.specimen_id, s.specimen_id AS container_id, s.kind AS specimen_description, 'q' AS accession_number, r.id AS study_id, r.code AS study_description
FROM resolved h JOIN patient p ON p.bundle = h.bundle JOIN specimen s ON s.bundle = h.bundle JOIN report r ON r.bundle = h.bundle WHERE h.error IS NULL""")
def clinical_metadata(spark, d):
    return C.metadata(A.resources(spark, d))


@query("""WITH s AS (SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 'x' ELSE '' END AS own, CASE WHEN vec_id % 3 <> 0 THEN 'y' END AS sampled, 1 + vec_id % 2 AS n, CASE label % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'srgb' WHEN 2 THEN 'p3' ELSE 'omit' END AS policy FROM embeddings)
SELECT vec_id, CASE WHEN own <> '' THEN 'source' WHEN sampled IS NOT NULL AND n = 1 THEN 'source_jpeg' WHEN sampled IS NULL THEN CASE policy WHEN 'srgb' THEN 'synthesized_srgb' WHEN 'p3' THEN 'synthesized_display_p3' WHEN 'omit' THEN 'omitted' END END AS source,
CASE WHEN own <> '' OR (sampled IS NOT NULL AND n = 1) THEN NULL WHEN sampled IS NOT NULL THEN 'samples differ' WHEN policy = 'error' THEN 'profile is missing' END AS error FROM s""")
def colour_profiles(spark, d):
    rows = A.table(spark, d, "embeddings").select("vec_id", F.expr("if(vec_id % 4 = 0, 'x', '')").alias("own"), F.expr("case when vec_id % 3 <> 0 then 'y' end").alias("sampled"), F.expr("1 + vec_id % 2").alias("n"), F.expr("case label % 4 when 0 then 'error' when 1 then 'srgb' when 2 then 'p3' else 'omit' end").alias("policy"))
    found = C.colour_profile(F.col("own"), F.col("sampled"), F.col("n"), F.col("policy"))
    return rows.select("vec_id", found.alias("f")).select("vec_id", "f.source", "f.error")


@query(f"""WITH {A.PROBES_SQL}, i AS (SELECT instance, count(*) * 40 AS frames, CASE instance % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'prefer_device' ELSE 'require_device' END AS backend,
  CASE instance % 4 WHEN 0 THEN 'Jpeg2000' WHEN 1 THEN 'Jpeg2000Lossless' ELSE 'Htj2kLosslessRpcl' END AS syntax FROM probes GROUP BY instance),
e AS (SELECT *, CASE WHEN (backend = 'prefer_device' AND (syntax = 'Jpeg2000Lossless' OR (syntax = 'Htj2kLosslessRpcl' AND frames <= 128))) OR syntax = 'Jpeg2000' THEN 'cpu' ELSE backend END AS effective FROM i)
SELECT instance, effective, CASE WHEN backend = 'prefer_device' AND syntax = 'Htj2kLosslessRpcl' THEN CASE WHEN effective = 'cpu' THEN 'cpu' ELSE 'gpu' END END AS lane, syntax LIKE 'Htj2k%' AND backend <> 'require_device' AS jpeg_direct,
  frames * 262144 * 6 <= 134217728 AS in_memory, (backend = 'auto' AND instance % 2 = 0 AND frames >= 4) OR (backend <> 'auto' AND frames > 0) AS jpeg_batch,
  syntax <> 'Jpeg2000' AND (backend <> 'auto' OR (frames >= 16 AND syntax LIKE 'Htj2k%')) AS device_input, CASE WHEN backend = 'require_device' AND instance % 2 <> 0 THEN 'cpu' ELSE backend END AS input_from,
  backend = 'auto' AND syntax <> 'Jpeg2000' AND NOT (frames >= 16 AND syntax LIKE 'Htj2k%') AS cpu_start FROM e""")
def device_policy(spark, d):
    rows = A.frame_probes(spark, d).groupBy("instance").agg((F.count("*") * 40).alias("frames"))
    rows = rows.select("instance", "frames", F.expr("case instance % 3 when 0 then 'auto' when 1 then 'prefer_device' else 'require_device' end").alias("backend"), F.expr("case instance % 4 when 0 then 'Jpeg2000' when 1 then 'Jpeg2000Lossless' else 'Htj2kLosslessRpcl' end").alias("syntax"), F.expr("instance % 2 = 0").alias("decodes"))
    c = F.col
    return rows.select("instance", D.effective_backend(c("backend"), c("syntax"), c("frames")).alias("effective"), D.hybrid_lane(c("backend"), c("syntax"), c("frames")).alias("lane"),
        D.jpeg_direct_supported(c("syntax"), c("backend")).alias("jpeg_direct"), D.direct_pixels(c("frames"), F.lit(512), F.lit(4)).alias("in_memory"),
        D.jpeg_device_batch(c("backend"), F.lit(512), F.lit(512), c("frames"), c("decodes")).alias("jpeg_batch"), D.lossless_device_input(c("backend"), c("syntax"), c("frames")).alias("device_input"),
        D.device_input_preference(c("backend"), c("decodes")).alias("input_from"), D.starts_on_cpu(c("backend"), c("syntax"), c("frames")).alias("cpu_start"))


@query(f"""WITH {A.LEVELS_SQL}, g AS (SELECT *, {_GRID} FROM levels), f AS (SELECT *, unnest(range(tiles_across)) AS c FROM (SELECT *, unnest(range(tiles_down)) AS r FROM g)),
x AS (SELECT source, level, r * tiles_across + c AS frame, tile_w, tile_h, c * {TILE} AS x, r * {TILE} AS y, least({TILE}, cols - c * {TILE}) AS w, least({TILE}, rows - r * {TILE}) AS h FROM f),
t AS (SELECT *, unnest(range(x // tile_w, (x + w - 1) // tile_w + 1)) AS tile_col FROM (SELECT *, unnest(range(y // tile_h, (y + h - 1) // tile_h + 1)) AS tile_row FROM x))
SELECT source, level, frame, tile_col, tile_row, greatest(x, tile_col * tile_w) - tile_col * tile_w AS src_x, greatest(y, tile_row * tile_h) - tile_row * tile_h AS src_y, greatest(x, tile_col * tile_w) - x AS dst_x, greatest(y, tile_row * tile_h) - y AS dst_y,
least(x + w, (tile_col + 1) * tile_w) - greatest(x, tile_col * tile_w) AS w, least(y + h, (tile_row + 1) * tile_h) - greatest(y, tile_row * tile_h) AS h FROM t""")
def compose_requests(spark, d):
    grid = G.square_grid(A.levels(spark, d), TILE).withColumns({"frame_w": F.lit(TILE), "frame_h": F.lit(TILE)})
    return K.requests(G.frames(grid)).select("source", "level", "frame", "tile_col", "tile_row", "src_x", "src_y", "dst_x", "dst_y", "w", "h")


@query()
def metric_lines(spark, d):
    """Lines of text with shares and times; other engines round them differently, so a test holds them against plain Python."""
    m = M.aggregate(M.measures(_routed(spark, d)), ["source", "level"])
    return m.select("source", "level", lines.route_line().alias("line"))


@query(f"WITH {A.TRIALS_SQL}, cells AS (SELECT DISTINCT slide, profile, scope FROM trials WHERE status = 'passed') SELECT seq FROM trials t WHERE EXISTS (SELECT 1 FROM cells c WHERE c.slide = t.slide AND c.profile = t.profile AND c.scope = t.scope)")
def trials_of_passed_cells(spark, d):
    t = A.trials(spark, d)
    return L.trials_of_cells(t, t.where("status = 'passed'")).select("seq")


@query(f"WITH {A.PROBES_SQL}, n AS (SELECT instance, max(frame) + 2 AS n FROM probes GROUP BY instance), p AS (SELECT instance, unnest(range(n)) AS index FROM n) SELECT p.instance, p.index, bytes AS value FROM p LEFT JOIN probes ON p.instance = probes.instance AND p.index = frame")
def scattered_results(spark, d):
    probes = A.frame_probes(spark, d)
    size = probes.groupBy("instance").agg((F.max("frame") + 2).alias("n"))
    return K.scatter(probes.select("instance", F.col("frame").alias("index"), F.col("bytes").alias("value")), size, "instance")


_SERIAL = {n: (i * 7 + 3) % 101 for i, n in enumerate((*metric_names.SUM_NAMES, *metric_names.MAXIMUM_NAMES))}
_NUMBERS = ", ".join([f"CAST(sum(k % {m + 1}) AS DECIMAL(38, 0)) AS {n}" for n, m in list(_SERIAL.items())[: len(metric_names.SUM_NAMES)]] + [f"max(k % {m + 1}) AS {n}" for n, m in list(_SERIAL.items())[len(metric_names.SUM_NAMES) :]])


@query(f"""WITH m AS (SELECT l_orderkey % 20 AS source, {_NUMBERS} FROM (SELECT l_orderkey, l_partkey AS k FROM lineitem) GROUP BY source)
SELECT *, CASE WHEN {metric_names.DEVICE_NAMES[0]} = 0 THEN 0.0 ELSE round(CAST({metric_names.DEVICE_NAMES[1]} AS DOUBLE) / CAST({metric_names.DEVICE_NAMES[0]} AS DOUBLE), 6) END AS {metric_names.DERIVED} FROM m""")
def serialised_metrics(spark, d):
    rows = A.table(spark, d, "lineitem").select((F.col("l_orderkey") % 20).alias("source"), *((F.col("l_partkey") % (m + 1)).alias(n) for n, m in _SERIAL.items()))
    return M.serialised(rows, ["source"]).withColumn(metric_names.DERIVED, F.round(metric_names.DERIVED, 6))


def _filtered(**counters: str) -> str:
    return ", ".join(f"CAST(count(*) FILTER ({c}) AS DECIMAL(38, 0)) AS {n}" for n, c in counters.items())


_CLASSIFIED = {
    "total_frames": "true", "jpeg_passthrough_frames": "route = 'passthrough'", "jpeg_retile_frames": "route = 'retile'", "cpu_fallback_frames": "route = 'fallback'", "jpeg_decode_fallback_frames": "route = 'fallback'",
    "unknown_pixel_profile_frames": "route = 'fallback'", "gray_frames": f"{_KNOWN} AND components = 1", "bits8_frames": f"{_KNOWN} AND bits = 8", "jpeg_retile_rejected_frames": "rejection IS NOT NULL",
    "jpeg_retile_mcu_invalid_frames": "rejection = 'mcu_invalid'", "cpu_input_frames": "false", "gpu_encode_frames": "false",
}


@query(f"WITH {_ROUTED} SELECT source, {_filtered(**_CLASSIFIED)} FROM routed GROUP BY source")
def source_metrics(spark, d):
    return M.serialised(M.as_serialised(_routed(spark, d)), ["source"]).select("source", *_CLASSIFIED)


_WRITTEN_SQL = f"""{A.PROBES_SQL}, w AS (SELECT source, components, bits, {list(M.WRITTEN)}[instance % {len(M.WRITTEN)} + 1] AS route, frame % 2 = 0 AS gin, instance % 4 = 0 AS genc, instance % 8 = 0 AS gval, micros * 37 AS inp,
 CASE WHEN frame % 3 = 0 THEN micros * 5 END AS com, micros * 211 AS enc, CASE WHEN frame % 2 = 1 THEN micros END AS val, CASE WHEN frame % 5 <> 0 THEN micros * 190 + 7000 END AS dev, micros * 230 AS wall FROM probes)"""
_N = lambda c: f"coalesce(CASE WHEN {c} > 0 AND {c} < 1000 THEN 1 ELSE {c} // 1000 END, 0)"
_TIMES = {
    "input_decode_micros": _N("inp"), "compose_micros": _N("com"), "encode_micros": _N("enc"), "validation_micros": _N("val"),
    "gpu_dispatch_micros": f"CASE WHEN gin THEN {_N('inp')} + {_N('com')} ELSE 0 END + CASE WHEN genc THEN {_N('enc')} ELSE 0 END + CASE WHEN gval THEN {_N('val')} ELSE 0 END",
    "gpu_encode_wall_micros": f"CASE WHEN genc THEN {_N('wall')} ELSE 0 END", "gpu_encode_hardware_micros": f"CASE WHEN genc AND dev IS NOT NULL THEN {_N('dev')} ELSE 0 END",
    "gpu_encode_dispatch_overhead_micros": f"CASE WHEN genc AND dev IS NOT NULL THEN {_N('greatest(enc - dev, 0)')} ELSE 0 END",
}
_WRITTEN = {
    "total_frames": "true", "jpeg_passthrough_frames": "route = 'jpeg_passthrough'", "j2k_direct_htj2k_frames": "route = 'j2k_direct'", "jpeg_direct_htj2k_53_frames": "route IN ('jpeg_direct_53', 'retile_53')",
    "jpeg_retile_frames": "route IN ('retile', 'retile_53')", "jpeg_retile_to_htj2k_53_frames": "route = 'retile_53'", "gpu_transcode_frames": "route = 'encoded' AND (gin OR genc)", "resident_gpu_transcode_frames": "route = 'encoded' AND gin AND genc",
    "partial_gpu_transcode_frames": "route = 'encoded' AND gin <> genc", "cpu_fallback_frames": "route = 'encoded' AND NOT gin AND NOT genc", "cpu_input_frames": "route = 'encoded' AND NOT gin", "gpu_encode_frames": "genc", "gpu_validation_frames": "gval",
    "gray_frames": "components = 1", "bits16_frames": "bits = 16",
}


@query(f"WITH {_WRITTEN_SQL} SELECT source, {_filtered(**_WRITTEN)}, {', '.join(f'CAST(sum({c}) AS DECIMAL(38, 0)) AS {n}' for n, c in _TIMES.items())} FROM w GROUP BY source")
def written_frame_metrics(spark, d):
    rows = A.frame_probes(spark, d).select(
        "source", "components", "bits", F.get(F.array(*map(F.lit, M.WRITTEN)), (F.col("instance") % len(M.WRITTEN)).cast("int")).alias("route"), F.expr("frame % 2 = 0").alias("gpu_input"), F.expr("instance % 4 = 0").alias("gpu_encode"),
        F.expr("instance % 8 = 0").alias("gpu_validation"), F.expr("micros * 37").alias("input_nanos"), F.expr("case when frame % 3 = 0 then micros * 5 end").alias("compose_nanos"), F.expr("micros * 211").alias("encode_nanos"),
        F.expr("case when frame % 2 = 1 then micros end").alias("validation_nanos"), F.expr("case when frame % 5 <> 0 then micros * 190 + 7000 end").alias("device_nanos"), F.expr("micros * 230").alias("wall_nanos"),
    )
    return M.serialised(M.written_frames(rows), ["source"]).select("source", *_WRITTEN, *_TIMES)


@query("""SELECT event_id, coalesce(TRY_CAST(json_extract_string(b, '$.metrics.total_frames') AS BIGINT), 0) AS total, coalesce(TRY_CAST(json_extract_string(b, '$.metrics.absent') AS BIGINT), 0) AS absent FROM (
 SELECT event_id, '{"metrics":{"total_frames":' || CASE event_id % 3 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN '"many"' ELSE 'null' END || '}}' AS b FROM events)""")
def profile_metrics(spark, d):
    b = F.expr("""concat('{"metrics":{"total_frames":', case event_id % 3 when 0 then string(user_id) when 1 then '"many"' else 'null' end, '}}')""")
    return A.table(spark, d, "events").select("event_id", M.metric(b, "total_frames").alias("total"), M.metric(b, "absent").alias("absent"))


@query("""WITH h AS (SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_size % 5 END AS columns, CASE WHEN p_partkey % 11 <> 0 THEN p_size % 6 END AS rows, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey * 40 END AS samples FROM part),
e AS (SELECT *, CASE WHEN columns IS NULL THEN 'columns are missing' WHEN rows IS NULL THEN 'rows are missing' WHEN columns = 0 OR rows = 0 THEN 'rows and columns must be greater than zero' WHEN samples > 65535 THEN 'samples are no 16-bit number' END AS error FROM h)
SELECT p_partkey, error, CASE WHEN error IS NULL THEN columns || 'x' || rows || 'x' || coalesce(samples, -1) END AS expected FROM e""")
def frame_expectations(spark, d):
    h = A.table(spark, d, "part").select("p_partkey", F.expr("case when p_partkey % 7 <> 0 then p_size % 5 end").alias("columns"), F.expr("case when p_partkey % 11 <> 0 then p_size % 6 end").alias("rows"),
        F.expr("case when p_partkey % 3 <> 0 then p_partkey * 40 end").alias("samples"), F.lit(8).alias("bits_allocated"))
    e = F.col("expected")
    text = F.when(e.isNotNull(), F.concat_ws("x", e["columns"].cast("string"), e["rows"].cast("string"), F.coalesce(e["samples"], F.lit(-1)).cast("string")))
    return V.frame_expectation(h).select("p_partkey", F.col("expectation_error").alias("error"), text.alias("expected"))


_CHECKED = """f AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 <> 0 THEN 'P' || o_custkey || CASE WHEN o_orderkey % 5 = 0 THEN chr(1) ELSE '' END END AS patient_id, CASE WHEN o_orderkey % 4 = 0 THEN '  ' ELSE 'A^B' END AS patient_name,
 CASE WHEN o_orderkey % 3 = 0 THEN '20230229' ELSE '20240229' END AS birth_date, CASE o_orderkey % 5 WHEN 0 THEN 'm' WHEN 1 THEN 'F' END AS sex, '1.2' || CASE WHEN o_orderkey % 8 = 0 THEN '..3' ELSE '' END AS study_uid, repeat('x', CAST(o_custkey % 20 AS INTEGER)) AS accession_number FROM orders)"""


@query(f"""WITH {_CHECKED}, b AS (SELECT k, list_filter([CASE WHEN contains(patient_id, chr(1)) THEN 'patient_id' END, CASE WHEN birth_date = '20230229' THEN 'birth_date' END, CASE WHEN sex = 'm' THEN 'sex' END,
 CASE WHEN length(accession_number) > 16 THEN 'accession_number' END, CASE WHEN contains(study_uid, '..') THEN 'study_uid' END], lambda x: x IS NOT NULL) AS e FROM f)
SELECT f.k, array_to_string(e, ',') AS errors, e[1] AS first, CASE WHEN coalesce(trim(patient_id), '') = '' THEN 'patient id is missing' WHEN trim(patient_name) = '' THEN 'patient name is missing' END AS strict FROM f JOIN b ON f.k = b.k""")
def metadata_checks(spark, d):
    rows = A.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("k"), F.expr("case when o_orderkey % 6 <> 0 then concat('P', o_custkey, if(o_orderkey % 5 = 0, char(1), '')) end").alias("patient_id"), F.expr("if(o_orderkey % 4 = 0, '  ', 'A^B')").alias("patient_name"),
        F.expr("if(o_orderkey % 3 = 0, '20230229', '20240229')").alias("birth_date"), F.expr("case o_orderkey % 5 when 0 then 'm' when 1 then 'F' end").alias("sex"), F.expr("concat('1.2', if(o_orderkey % 8 = 0, '..3', ''))").alias("study_uid"),
        F.expr("repeat('x', cast(o_custkey % 20 as int))").alias("accession_number"),
    )
    strict = V.strict_errors(rows, "k").withColumnRenamed("error", "strict")
    return V.field_errors(rows, "k").join(strict, "k").select("k", F.array_join("errors", ",").alias("errors"), "first", "strict")
