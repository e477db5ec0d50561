"""Entry points: conversion plans, route profiles, coverage, validation. Each returns DataFrames; actions are the caller's.

Sources come as two tables: levels (see geometry) and probes (see routes). Codecs are not part of the engine: frames that have
to be encoded are named in the plan, and a codec is handed in as a function on batches.
"""

from __future__ import annotations

import json
import secrets
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import dims, scalars
from lodestrata.operators import geometry, metrics, offsets, routes
from lodestrata.plans.options import ExportOptions
from lodestrata.sources.attributes import DICTIONARY

PLACEHOLDER = {"patient_id": "RESEARCH", "patient_name": "RESEARCH^SLIDE", "modality": "SM"}


@dataclass(frozen=True)
class Export:
    """Builder of a conversion: `Export(levels, probes).to_directory(p).with_placeholder_metadata().plan()`."""

    levels: DataFrame
    probes: DataFrame | None = None
    output: str | None = None
    options: ExportOptions = field(default_factory=ExportOptions)
    metadata: dict | None = None
    level_filter: int | None = None
    source_aware: bool = True

    def to_directory(self, path: str) -> Export:
        return replace(self, output=path)

    def with_options(self, options: ExportOptions) -> Export:
        return replace(self, options=options, source_aware=False)

    def with_metadata(self, metadata: dict) -> Export:
        return replace(self, metadata=metadata)

    def with_placeholder_metadata(self) -> Export:
        return replace(self, metadata=dict(PLACEHOLDER))

    def level(self, level: int) -> Export:
        return replace(self, level_filter=level)

    def transfer_syntax(self, syntax: str) -> Export:
        return replace(self, options=self.options.with_syntax(syntax), source_aware=False)

    def source_aware_transfer_syntax(self) -> Export:
        return replace(self, source_aware=True)

    def tile_size(self, size: int) -> Export:
        return replace(self, options=replace(self.options, tile_size=size))

    def jpeg_quality(self, quality: int) -> Export:
        return replace(self, options=replace(self.options, jpeg_quality=quality))

    def profile(self, name: str) -> Export:
        return replace(self, options=replace(self.options, profile=name))

    def device(self, **settings: int | bool | None) -> Export:
        """Sets source_device_decode and limits of the device's encoder (`ExportOptions.device_limits`) by name."""
        if unknown := set(settings) - {"source_device_decode", *self.options.device_limits()}:
            raise ValueError(f"no device option {sorted(unknown)}")
        return replace(self, options=replace(self.options, **settings))

    def checked(self) -> Export:
        self.options.validate()
        if not self.output:
            raise ValueError("an output folder is needed")
        if not self.metadata:
            raise ValueError("metadata are needed, or the placeholder")
        return self

    def plan(self, seed: str = "0") -> DataFrame:
        """One row per instance: coordinates, syntax, frames, path and UIDs. Two instances of a source with one path are an error."""
        self.checked()
        jobs = geometry.jobs(geometry.square_grid(self.levels, self.options.tile_size), level=self.level_filter)
        if self.source_aware and self.probes is not None:
            jobs = jobs.join(routes.default_syntax(self.probes), "source", "left").withColumn("syntax", F.coalesce("syntax", F.lit(self.options.transfer_syntax)))
        else:
            jobs = jobs.withColumn("syntax", F.lit(self.options.transfer_syntax))
        return with_uids(jobs.withColumn("path", geometry.output_path()), seed)

    def run(self, frames: DataFrame, *, seed: str | None = None, codec: Callable[[bytes, dict], bytes] | None = None, settings: dict | None = None, profile: Column | None = None) -> DataFrame:
        """Writes the planned instances below the output folder, in one transaction, and returns a row per file: path, frames, bytes, file_bytes, sha256.

        frames: (source, scene, series, level, z, c, t, frame, bytes), or `pixels` in place of `bytes`, which `codec` encodes. A frame of no planned instance, an instance
        without all its frames and a frame that the codec fails on are errors, and nothing is written. Files are named by source and coordinates.
        """
        from lodestrata.operators.attributes import instance_attributes
        from lodestrata.sources import instances

        plan = self.plan(seed or fresh_seed())
        where = ["source", "scene", "series", "level", "z", "c", "t"]
        name = F.concat(F.regexp_replace(F.col("source").cast("string"), r"[^A-Za-z0-9._-]", "_"), F.lit("-"), F.substring(F.sha2(F.col("source").cast("string"), 256), 1, 8), F.lit("-"), "path")
        default = lambda c, v: F.col(c) if c in plan.columns else F.lit(v)
        planned = plan.withColumns({
            "tile": F.lit(self.options.tile_size), "components": default("components", 3), "bits": default("bits", 8), "photometric": default("photometric", "YBR_FULL_422"),
            "row_mm": default("row_mm", 0.0005) * F.expr("shiftleft(1, level)"), "column_mm": default("column_mm", 0.0005) * F.expr("shiftleft(1, level)"), "series_number": F.lit(1),
        })
        keyed = F.concat_ws("|", *where)
        known = planned.select(keyed.alias("instance"), name.alias("name"), "syntax", "frames", instance_attributes(by_keyword(self.metadata), profile=profile).alias("attributes"))
        rows = frames.withColumn("instance", keyed)
        if codec is not None:
            rows = encode_frames(rows, codec, settings or {}).select("instance", "frame", F.col("encoded").alias("bytes"), "error")
            rows = rows.withColumn("bytes", F.when(F.col("error").isNull(), F.col("bytes")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("frame"), "frame", F.lit("of"), "instance", "error")).cast("binary")))
        counted = rows.groupBy("instance").agg(F.count("*").alias("there"), F.min("frame").alias("least"), F.max("frame").alias("most"), F.countDistinct("frame").alias("different"))
        wrong = known.join(counted, "instance", "full").where("name is null or there is null or there <> frames or different <> frames or least <> 0 or most <> frames - 1")
        if bad := wrong.select("instance").head():
            raise ValueError(f"the frames of {bad['instance']} are not those of the plan")
        syntaxes = F.create_map(*(F.lit(x) for name_, uid, *_ in dims.TRANSFER_SYNTAXES for x in (name_, uid)))
        files = known.select("instance", "name", syntaxes[F.col("syntax")].alias("transfer_syntax"), "attributes")
        return instances.write_instances(files, rows.select("instance", "frame", "bytes"), self.output, overwrite=self.options.overwrite)


def by_keyword(metadata: dict) -> dict[str, str]:
    """Metadata by keyword: `patient_id` and `PatientID` are one."""
    known = {k.lower(): k for k in DICTIONARY}
    return {known.get(k.replace("_", "").lower(), k): v for k, v in metadata.items()}


def fresh_seed() -> str:
    """A seed for one run, drawn on the driver."""
    return secrets.token_hex(16)


def deterministic_seed(content: Column, options: ExportOptions, metadata: dict) -> Column:
    """Seed of a source: SHA-256 of its bytes, a zero and the settings that shape the output, as JSON."""
    shaping = {k: v for k, v in asdict(options).items() if k not in ("overwrite", "uid_policy", "validate_codec")}
    settings = json.dumps({"options": shaping, "metadata": metadata}, sort_keys=True, separators=(",", ":"))
    return F.sha2(F.concat(content, F.lit(b"\0" + settings.encode())), 256)


def with_uids(jobs: DataFrame, seed: str) -> DataFrame:
    """Adds instance, series, pyramid, dimension and frame-of-reference UIDs; those of a series leave the level out, that of the frame also the plane."""
    def uid(role: str, *keys: str):
        return scalars.uid(F.concat_ws(":", F.lit(seed), "source", F.lit(role), *keys))

    plane = ("scene", "series", "z", "c", "t")
    return jobs.withColumns({
        "sop_uid": uid("instance", "scene", "series", "level", "z", "c", "t"), "series_uid": uid("series", *plane), "pyramid_uid": uid("pyramid", *plane),
        "dimension_uid": uid("dimension", *plane), "frame_of_reference_uid": uid("frame", "scene", "series"), "study_uid": uid("study"),
    })


def route_profile(probes: DataFrame, *, level: int = 0, max_frames: int = 64) -> DataFrame:
    """Counters of the first frames of one level of each source."""
    return metrics.aggregate(metrics.measures(routes.jpeg_route(routes.budgeted(probes.where(F.col("level") == level), ["source"], ["instance", "frame"], max_frames))), ["source"])


def route_coverage(probes: DataFrame, *, max_frames: int | None = 64) -> DataFrame:
    """Counters and completeness at level, source and corpus grain; all frames where max_frames is None."""
    available = probes.groupBy("source", "level").agg(F.count("*").alias("available"))
    rows = probes if max_frames is None else routes.budgeted(probes, ["source", "level"], ["instance", "frame"], max_frames)
    by_level = metrics.aggregate(metrics.measures(routes.jpeg_route(rows)), ["source", "level"]).join(available, ["source", "level"])
    found = by_level.rollup("source", "level").agg(F.grouping_id().alias("grain"), F.sum("available").alias("available"), *(F.sum(c).alias(c) for c in metrics.SUMS))
    return found.withColumn("complete", F.col("total_frames") >= F.col("available"))


def frame_table(frames: DataFrame) -> DataFrame:
    """Offsets and lengths of each instance's frames, in frame order, for the writer's extended offset tables."""
    w = Window.partitionBy("instance").orderBy("frame")
    return offsets.offset_table(frames).withColumn("item", F.row_number().over(w))


def encode_frames(frames: DataFrame, codec: Callable[[bytes, dict], bytes], settings: dict) -> DataFrame:
    """(instance, frame, encoded, error) of rows (instance, frame, pixels): the codec runs on Arrow batches; a frame it fails on has its error."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            done, errors = [], []
            for raw in b.column("pixels").to_pylist():
                try:
                    done.append(codec(raw, settings))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  an error is a row, whatever the codec raises
                    done.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column("instance"), b.column("frame"), pa.array(done, pa.binary()), pa.array(errors, pa.string())], names=["instance", "frame", "encoded", "error"])

    kinds = dict(frames.dtypes)
    return frames.select("instance", "frame", "pixels").mapInArrow(run, f"instance {kinds['instance']}, frame {kinds['frame']}, encoded binary, error string")
