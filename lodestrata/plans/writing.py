"""Queries of what is written: instance files, attribute sets, frames from fragments, attempts, counters of batches; with DuckDB SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.operators import attempts, batches, metrics, offsets, routes
from lodestrata.operators.attributes import instance_attributes
from lodestrata.plans import adapters
from lodestrata.plans.export import Export
from lodestrata.plans.extras import _shared_folder, _uid_sql
from lodestrata.sources import attributes, instances

_ORDER = "l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax"
_LINES = f"""SELECT l_suppkey AS instance, row_number() OVER (PARTITION BY l_suppkey ORDER BY {_ORDER}) - 1 AS frame, repeat('x', CAST(l_linenumber AS INTEGER)) || l_orderkey || 'é' AS said FROM lineitem"""


#: Line items that a task sorts, whatever the size of the table.
LINES_A_TASK = 250_000


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instance, frame, bytes): the line items of a supplier as its frames."""
    w = Window.partitionBy("l_suppkey").orderBy(*_ORDER.split(", "))
    said = F.concat(F.expr("repeat('x', l_linenumber)"), F.col("l_orderkey").cast("string"), F.lit("é"))
    lines = adapters.spread(adapters.table(spark, sf_dir, "lineitem").select(*_ORDER.split(", "), "l_suppkey"), "l_suppkey", LINES_A_TASK)
    return lines.select(F.col("l_suppkey").alias("instance"), (F.row_number().over(w).cast("bigint") - 1).alias("frame"), F.encode(said, "UTF-8").alias("bytes"))


def written_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets and lengths as written instance files have them in their extended offset tables: a file a supplier, a frame a line item."""
    folder = f"{_shared_folder(spark)}/instances-{uuid.uuid4().hex}"
    known = adapters.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("instance"), F.concat(F.lit("supplier-"), "s_suppkey", F.lit(".dcm")).alias("name"), F.lit("1.2.840.10008.1.2.4.50").alias("transfer_syntax"),
        F.struct(F.concat(F.lit("2.25."), "s_suppkey").alias("SOPInstanceUID"), F.col("s_name").alias("PatientName"), F.lit("0").alias("NumberOfFrames")).alias("attributes"),
    )
    files = instances.write_instances(known, _frames(spark, sf_dir), folder)
    return instances.stored_offsets(files).select(F.col("instance").cast("bigint").alias("instance"), "frame", "offset", "length")


_SIZED = f"sized AS (SELECT *, CAST(strlen(said) AS BIGINT) AS length FROM ({_LINES}))"
WRITTEN_OFFSETS_SQL = f"""WITH {_SIZED}
SELECT instance, frame, CAST(coalesce(sum(length + length % 2 + 8) OVER (PARTITION BY instance ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", length FROM sized"""


def frame_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of three fragments each, put together by offsets and cut to their lengths; some lengths are too long."""
    fragments = _frames(spark, sf_dir).select("instance", F.col("frame").alias("fragment"), F.col("bytes").alias("data"))
    sized = offsets.offset_table(fragments.select("instance", F.col("fragment").alias("frame"), F.octet_length("data").cast("bigint").alias("bytes")))
    third = F.call_function("div", F.col("frame"), F.lit(3))
    whole = sized.groupBy("instance", third.alias("frame")).agg(F.min("offset").alias("offset"), F.sum("bytes").alias("bytes"))
    length = F.when(F.col("frame") % 5 == 4, F.lit(None)).when(F.col("frame") % 7 == 6, F.col("bytes") + 1).otherwise(F.col("bytes") - F.col("frame") % 2)
    found = offsets.assemble_frames(fragments, whole.select("instance", "frame", "offset", length.cast("bigint").alias("length")))
    return found.select("instance", "frame", F.octet_length("raw").alias("size"), F.sha2("raw", 256).alias("sha256"), "error")


FRAME_BYTES_SQL = f"""WITH {_SIZED}, three AS (SELECT instance, frame // 3 AS frame, string_agg(said, '' ORDER BY frame) AS said, sum(length) AS bytes FROM sized GROUP BY instance, frame // 3),
cut AS (SELECT instance, frame, CASE WHEN frame % 5 <> 4 AND frame % 7 = 6 THEN 'length is beyond the fragments' END AS error,
  CASE WHEN frame % 5 = 4 OR frame % 2 = 0 THEN hex(encode(said)) ELSE left(hex(encode(said)), 2 * CAST(bytes - 1 AS INTEGER)) END AS raw FROM three)
SELECT instance, frame, CASE WHEN error IS NULL THEN CAST(length(raw) // 2 AS INTEGER) END AS size, CASE WHEN error IS NULL THEN sha256(unhex(raw)) END AS sha256, error FROM cut"""

_CODE = "CodeValue: string, CodeMeaning: string"
#: What is read back of an attribute set.
READ = (
    "ImageType array<string>, SOPInstanceUID string, Rows int, TotalPixelMatrixColumns bigint, ImagedVolumeWidth float, NumberOfFrames string, PlanarConfiguration int, "
    f"OpticalPathSequence array<struct<OpticalPathIdentifier: string, IlluminationTypeCodeSequence: array<struct<{_CODE}>>, IlluminationWaveLength: float>>, "
    "SpecimenDescriptionSequence array<struct<SpecimenIdentifier: string, SpecimenUID: string, SpecimenPreparationSequence: array<struct<CodeValue: string>>>>, "
    "SharedFunctionalGroupsSequence array<struct<PixelMeasuresSequence: array<struct<PixelSpacing: array<string>>>>>, "
    "DimensionIndexSequence array<struct<DimensionOrganizationUID: string, DimensionIndexPointer: string, FunctionalGroupPointer: string>>"
)


def attribute_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute sets of all planned instances, encoded to bytes and read back."""
    plan = Export(adapters.levels(spark, sf_dir)).to_directory("out").with_placeholder_metadata().plan("seed")
    rows = plan.withColumns({
        "tile": F.lit(512), "components": F.expr("1 + 2 * (source % 2)"), "bits": F.lit(8), "photometric": F.lit("RGB"), "series_number": F.lit(1),
        "row_mm": F.expr("(1 + source % 7) * 0.00025D * shiftleft(1, level)"), "column_mm": F.expr("(1 + source % 5) * 0.0005D * shiftleft(1, level)"),
    })
    sets = rows.select("path", "source", instance_attributes({"SpecimenIdentifier": "S-1"}).alias("attributes"))
    found = attributes.decoded(attributes.encoded(sets, "attributes", "raw"), "raw", "a", T.StructType.fromDDL(READ))
    group = F.col("a.SharedFunctionalGroupsSequence")[0]["PixelMeasuresSequence"][0]
    path, specimen = F.col("a.OpticalPathSequence")[0], F.col("a.SpecimenDescriptionSequence")[0]
    pointers = F.array_join(F.transform("a.DimensionIndexSequence", lambda x: F.concat_ws(">", x["FunctionalGroupPointer"], x["DimensionIndexPointer"])), ",")
    return found.select(
        "source", F.col("a.SOPInstanceUID").alias("sop_uid"), F.array_join("a.ImageType", "/").alias("image_type"), F.col("a.TotalPixelMatrixColumns").alias("cols"), F.col("a.NumberOfFrames").alias("frames"),
        F.col("a.Rows").alias("tile"), F.col("a.PlanarConfiguration").alias("planar"), F.array_join(group["PixelSpacing"], "/").alias("spacing"), path["IlluminationTypeCodeSequence"][0]["CodeMeaning"].alias("light"),
        path["IlluminationWaveLength"].cast("int").alias("wave"), specimen["SpecimenUID"].alias("specimen_uid"), F.size(specimen["SpecimenPreparationSequence"]).alias("preparations"), pointers.alias("pointers"),
    )


def _attribute_sets_sql(jobs: str) -> str:
    spacing = lambda factor, step: f"regexp_replace(printf('%.10f', (1 + j.source % {factor}) * {step} * (1 << level)), '\\.?0+$', '')"
    uid = "'2.25.' || CAST(CAST('0x' || substr(sha256('specimen:S-1'), 1, 32) AS UHUGEINT) AS VARCHAR)"
    return f"""WITH {jobs}
SELECT j.source, {_uid_sql("instance", "scene", "series", "level", "z", "c", "t").replace("source", "j.source")} AS sop_uid,
 CASE WHEN level = 0 THEN 'ORIGINAL/PRIMARY/VOLUME/NONE' ELSE 'DERIVED/PRIMARY/VOLUME/RESAMPLED' END AS image_type, CAST(cols AS BIGINT) AS cols, CAST((cols + 511) // 512 * ((rows + 511) // 512) AS VARCHAR) AS frames, 512 AS tile,
 CASE WHEN j.source % 2 = 1 THEN 0 END AS planar, {spacing(7, "0.00025")} || '/' || {spacing(5, "0.0005")} AS spacing, 'Brightfield illumination' AS light, 550 AS wave, {uid} AS specimen_uid, 0 AS preparations,
 'PlanePositionSlideSequence>ColumnPositionInTotalImagePixelMatrix,PlanePositionSlideSequence>RowPositionInTotalImagePixelMatrix' AS pointers FROM jobs j"""


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of three routes: transcoding JPEG, recoding J2K, and the encoder, which some errors stop."""
    probes = adapters.frame_probes(spark, sf_dir)
    kept = ("instance", "frame", "components", "bits")
    jpeg = probes.where("compression = 'jpeg'").select(*kept, "photometric", F.lit(0).alias("priority"), F.lit("jpeg_direct").alias("route"), F.expr("fits and error is null").alias("ok"), F.coalesce("error", F.lit("does not fit")).alias("error"))
    j2k = probes.where("compression = 'jp2k'").select(*kept, "photometric", F.lit(1).alias("priority"), F.lit("j2k_direct").alias("route"), F.expr("error is null").alias("ok"), "error")
    cpu = probes.select(*kept, F.lit("RGB").alias("photometric"), F.lit(2).alias("priority"), F.lit("cpu").alias("route"), F.expr("error is null or error <> 'codec not supported'").alias("ok"), "error")
    return jpeg.unionByName(j2k).unionByName(cpu)


def first_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The route and profile of each frame after three routes tried it, the failures before, and why none succeeded."""
    return attempts.first_success(adapters.frame_probes(spark, sf_dir), _attempts(spark, sf_dir))


def profile_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances with their misses and conflicts of pixel profiles, after all routes."""
    return attempts.conflicts(first_success(spark, sf_dir))


_RESOLVED = f"""WITH {adapters.PROBES_SQL}, resolved AS (SELECT instance, frame,
  CASE WHEN compression = 'jpeg' AND fits AND error IS NULL THEN 'jpeg_direct' WHEN compression = 'jp2k' AND error IS NULL THEN 'j2k_direct' WHEN error IS NULL OR error <> 'codec not supported' THEN 'cpu' END AS route,
  components, bits, CASE WHEN (compression = 'jpeg' AND fits OR compression = 'jp2k') AND error IS NULL THEN photometric ELSE 'RGB' END AS photometric,
  CAST(compression = 'jpeg' AND NOT (fits AND error IS NULL) AS BIGINT) + CAST(compression = 'jp2k' AND error IS NOT NULL AS BIGINT) + CAST(coalesce(error = 'codec not supported', false) AS BIGINT) AS failures, error FROM probes)"""
FIRST_SUCCESS_SQL = f"""{_RESOLVED} SELECT instance, frame, route, CASE WHEN route IS NOT NULL THEN components END AS components, CASE WHEN route IS NOT NULL THEN bits END AS bits,
  CASE WHEN route IS NOT NULL THEN photometric END AS photometric, failures, CASE WHEN route IS NULL THEN error END AS error FROM resolved"""
PROFILE_CONFLICTS_SQL = f"""{_RESOLVED} SELECT instance, count(*) AS frames, count(route) AS done, count(*) - count(route) AS misses,
  CASE WHEN count(route) < count(*) THEN min(error) FILTER (route IS NULL) WHEN count(DISTINCT (components, bits, photometric)) FILTER (route IS NOT NULL) > 1 THEN 'pixel profile changes' END AS error FROM resolved GROUP BY instance"""

#: Facts of a batch, an order's frames, as expressions over its key.
_FACTS = {
    "gpu_input_decode_batches": "1", "gpu_compose_batches": "instance % 2", "gpu_encode_batches": "1 + instance % 3", "gpu_encode_plan_nanos": "instance * 17 % 900", "gpu_encode_prepare_submit_nanos": "instance * 7919 % 5000000",
    "gpu_encode_codestream_wait_nanos": "instance * 104729 % 9000000", "gpu_encode_tile_count": "instance % 64", "gpu_encode_code_block_count": "instance % 4096", "jpeg_direct_htj2k_extract_micros": "instance % 1013",
    "jpeg_direct_htj2k_batch_count": "1", "jpeg_direct_htj2k_batch_jobs": "instance % 32", "streaming_write_nanos": "instance * 31 % 70000", "pixel_data_patch_nanos": "instance % 1500", "write_nanos": "instance * 97 % 800000",
    "gpu_encode_configured_inflight_tiles": "instance % 128", "gpu_pipeline_depth": "1 + instance % 4",
}
_PROBED = {"probe_frames": "instance % 6", "probe_gpu_batches": "instance % 2", "probe_cpu_nanos": "instance * 53 % 400000", "probe_gpu_nanos": "instance * 59 % 300000"}
_SHOWN = (*(n.replace("_nanos", "_micros") for n in _FACTS), "auto_route_probe_frames", "auto_route_probe_gpu_batches", "auto_route_probe_cpu_micros", "auto_route_probe_gpu_micros", "auto_route_probe_selected_gpu_input_frames", "total_frames", "encode_micros")


def two_grain_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of sources from frames and from batches; every frame carries its batch's report."""
    probes = adapters.frame_probes(spark, sf_dir)
    one = F.lit(1).cast("bigint")
    frames = probes.select("source", one.alias("total_frames"), metrics.reported_micros(F.expr("micros * 211")).alias("encode_micros"))
    facts = {n: F.expr(e) for n, e in (_FACTS | _PROBED).items()} | {"probe_selected": F.expr("instance % 3 = 0")}
    reports = probes.select("source", F.col("instance").alias("batch"), *(c.alias(n) for n, c in facts.items()))
    return batches.two_grains(frames, reports, ["source"], "batch").select("source", *_SHOWN)


def _two_grain_sql() -> str:
    nanos = lambda e: f"CASE WHEN {e} > 0 AND {e} < 1000 THEN 1 ELSE {e} // 1000 END"
    sums = {n.replace("_nanos", "_micros"): nanos(f"({e})") if n.endswith("_nanos") else f"({e})" for n, e in (_FACTS | _PROBED).items()}
    sums |= {"probe_selected": "(CASE WHEN instance % 3 = 0 THEN instance % 6 ELSE 0 END)"}
    names = {"probe_frames": "auto_route_probe_frames", "probe_gpu_batches": "auto_route_probe_gpu_batches", "probe_cpu_micros": "auto_route_probe_cpu_micros", "probe_gpu_micros": "auto_route_probe_gpu_micros", "probe_selected": "auto_route_probe_selected_gpu_input_frames"}
    of_batch = ", ".join(f"CAST(max({e}) AS BIGINT) AS {n}" if n in ("gpu_encode_configured_inflight_tiles", "gpu_pipeline_depth") else f"CAST(sum({e}) AS DECIMAL(38, 0)) AS {names.get(n, n)}" for n, e in sums.items())
    return f"""WITH {adapters.PROBES_SQL}, b AS (SELECT source, {of_batch} FROM (SELECT DISTINCT source, instance FROM probes) GROUP BY source),
f AS (SELECT source, CAST(count(*) AS DECIMAL(38, 0)) AS total_frames, CAST(sum({nanos("(micros * 211)")}) AS DECIMAL(38, 0)) AS encode_micros FROM probes GROUP BY source)
SELECT source, {", ".join(_SHOWN)} FROM b JOIN f USING (source)"""


_PLAIN = {"components": 3, "bits": 8, "photometric": "YBR_FULL_422"}


def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of each source and of the corpus: one source in ten cannot be read, and of one in three the instances have mixed profiles."""
    probes = adapters.frame_probes(spark, sf_dir)
    probes = probes.withColumns({c: F.when(F.col("source") % 3 == 0, F.col(c)).otherwise(F.lit(v)) for c, v in _PLAIN.items()})
    routed = routes.jpeg_route(probes).withColumn("failure", F.when(F.col("source") % 10 == 9, "cannot be read"))
    return metrics.corpus_report(routed, metrics.measures)


def _corpus_sql(routed: str, sums: str) -> str:
    plain = ", ".join(f"CASE WHEN source % 3 = 0 THEN {c} ELSE {v!r} END AS {c}" for c, v in _PLAIN.items())
    routed = routed.replace("probes AS (", "raw AS (", 1).replace("routed AS (", f"probes AS (SELECT * REPLACE ({plain}) FROM raw), routed AS (", 1)
    totals = ", ".join(f"CAST(sum({c}) FILTER (error IS NULL) AS BIGINT) AS {c}" for c in metrics.SUMS)
    return f"""WITH {routed}, i AS (SELECT source, instance, count(DISTINCT (components, bits, photometric)) FILTER (route <> 'fallback') > 1 AS mixed, {sums} FROM routed GROUP BY source, instance),
s AS (SELECT source, CASE WHEN source % 10 = 9 THEN 'cannot be read' WHEN bool_or(mixed) THEN 'pixel profile changes' END AS error, {", ".join(f"sum({c}) AS {c}" for c in metrics.SUMS)} FROM i GROUP BY source)
SELECT source, CASE WHEN grouping(source) = 0 THEN min(error) END AS error, count(*) AS considered, count(*) FILTER (error IS NULL) AS reports, count(error) AS failures, {totals} FROM s GROUP BY ROLLUP (source)"""


def sql(jobs: str, routed: str, sums: str) -> dict[str, str]:
    return {
        "corpus_report": _corpus_sql(routed, sums),
        "written_offsets": WRITTEN_OFFSETS_SQL, "frame_bytes": FRAME_BYTES_SQL, "attribute_sets": _attribute_sets_sql(jobs), "first_success": FIRST_SUCCESS_SQL,
        "profile_conflicts": PROFILE_CONFLICTS_SQL, "two_grain_counters": _two_grain_sql(),
    }


QUERIES = {f.__name__: f for f in (written_offsets, frame_bytes, attribute_sets, first_success, profile_conflicts, two_grain_counters, corpus_report)}
