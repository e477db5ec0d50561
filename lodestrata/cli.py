"""Command line: plans, route profiles, coverage, validation, checks of the host, a self-test, and benchmark trials.

    python -m lodestrata coverage --probes probes.parquet --out coverage.parquet

Tables are Parquet (see `geometry` and `routes` for their columns), read and written by Spark. The exit code is 1 if a check failed.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import binary
from lodestrata.operators import decoding, metrics, routes, validation
from lodestrata.plans import export, harness, options
from lodestrata.sources import dicom
from lodestrata.streaming import iterations


def _export(spark: SparkSession, a: argparse.Namespace) -> export.Export:
    plan = export.Export(spark.read.parquet(a.levels), spark.read.parquet(a.probes) if a.probes else None).to_directory(a.output)
    syntax = options.resolve_syntax(a.preset, a.syntax)
    plan = plan.with_options(options.preset(a.preset)) if a.preset else plan
    plan = plan.transfer_syntax(syntax) if syntax else plan
    plan = plan.tile_size(a.tile_size).with_metadata(json.loads(a.metadata)) if a.metadata else plan.tile_size(a.tile_size).with_placeholder_metadata()
    return replace(plan, options=replace(plan.options, overwrite=True)) if a.overwrite else plan


def convert(spark: SparkSession, a: argparse.Namespace) -> bool:
    """The plan of a conversion, one row an instance; with --frames, encoded frames by coordinates, also its files, and a row of each."""
    plan, seed = _export(spark, a), a.seed or export.fresh_seed()
    found = plan.run(spark.read.parquet(a.frames), seed=seed) if a.frames else plan.plan(seed)
    found.write.mode("overwrite").parquet(a.out)
    return True


def sustain(spark: SparkSession, a: argparse.Namespace) -> bool:
    """The same conversion again and again, each below a folder of its own, until one fails; a row an iteration."""
    plan, frames = _export(spark, a), spark.read.parquet(a.frames)

    def work(n: int) -> dict:
        files = plan.to_directory(f"{a.output}/iteration-{n:04d}").run(frames, seed=a.seed)
        return files.agg(F.count("*").alias("files"), F.sum("frames").alias("frames"), F.sum("file_bytes").alias("file_bytes")).first().asDict()

    try:
        iterations.sustained(spark, work, a.out, iterations=a.iterations, interval=f"{a.interval_ms} milliseconds").show(truncate=False)
    except iterations.Stopped as e:
        print(e)
        return False
    return True


def profile(spark: SparkSession, a: argparse.Namespace) -> bool:
    export.route_profile(spark.read.parquet(a.probes), level=a.level, max_frames=a.max_frames).write.mode("overwrite").parquet(a.out)
    return True


def coverage(spark: SparkSession, a: argparse.Namespace) -> bool:
    """Coverage by level, source and corpus; false if some frame was left out by --max-frames."""
    found = export.route_coverage(spark.read.parquet(a.probes), max_frames=a.max_frames)
    found.write.mode("overwrite").parquet(a.out)
    return not spark.read.parquet(a.out).where("not complete").limit(1).count()


def coverage_corpus(spark: SparkSession, a: argparse.Namespace) -> bool:
    """As coverage, the compressions of each source's first frames, and a report of the corpus with the sources that failed."""
    probes = spark.read.parquet(a.probes)
    metrics.corpus_report(routes.jpeg_route(probes), metrics.measures).write.mode("overwrite").parquet(f"{a.out}/corpus")
    metrics.common_value(probes.where("frame = 0"), ["source"], "compression").write.mode("overwrite").parquet(f"{a.out}/sources")
    return coverage(spark, argparse.Namespace(probes=a.probes, max_frames=a.max_frames, out=f"{a.out}/coverage"))


def _report(checks: DataFrame, out: str | None) -> bool:
    counts = checks.groupBy().agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("passed", "failed", "skipped", "missing"))).first()
    print(" ".join(f"{k}={v}" for k, v in counts.asDict().items()))
    if out:
        checks.write.mode("overwrite").json(out)
    return counts["failed"] == 0


def validate(spark: SparkSession, a: argparse.Namespace) -> bool:
    """All checks of a folder's files: headers, fields, a command a file and one a set if they are given, and pixels with a decoder (`uid=template`)."""
    spark.dataSource.register(dicom.DicomHeaders)
    headers = spark.read.format("dicom_headers").load(a.folder)
    named = lambda c, name: {name: c} if c else {}
    decoders = dict(d.split("=", 1) for d in a.decoder) if a.decoder else None
    return _report(decoding.all_checks(headers, file_commands=named(a.command, "command"), set_commands=named(a.set_command, "set-command"), decoders=decoders), a.out)


def doctor(spark: SparkSession, a: argparse.Namespace) -> bool:
    return _report(validation.doctor(spark, {t.split()[0]: t.split() for t in a.tool or ["java -version", "git --version"]}), a.out)


def self_test(spark: SparkSession, a: argparse.Namespace) -> bool:
    """Writes a small picture, reads its header back and checks it."""
    with tempfile.TemporaryDirectory() as folder:
        header = {"sop_instance_uid": "2.25.1", "rows": 16, "columns": 16, "total_rows": 16, "total_columns": 32, "samples": 3, "bits_allocated": 8, "photometric": "RGB"}
        with open(os.path.join(folder, "self-test.dcm"), "wb") as f:
            f.write(dicom.instance_bytes(header, [binary.deterministic_rgb(16, 16)] * 2, "1.2.840.10008.1.2.1"))
        spark.dataSource.register(dicom.DicomHeaders)
        return _report(validation.header_checks(spark.read.format("dicom_headers").load(folder)), a.out)


def bench(spark: SparkSession, a: argparse.Namespace) -> bool:
    """Runs the planned trials that have no recorded row, and writes the summary of all."""
    tools = {k: v.split() for k, v in (t.split("=", 1) for t in a.tool)}
    trials = harness.planned(spark.read.parquet(a.slides), tools=tools, profiles=a.profile, scopes=a.scope, runs=a.runs)
    results = f"{a.out}/results"
    recorded = spark.read.schema("slide string, tool string, profile string, scope string, run_index int").json(results) if os.path.isdir(results) else None
    trials = harness.resumed(trials, recorded) if recorded is not None else trials
    done = harness.run_trials(trials, timeout=a.timeout).withColumns({"label": F.lit(None).cast("string"), "system_label": F.lit(a.system).cast("string"), "seq": F.monotonically_increasing_id()})
    done.write.parquet(where := f"{a.out}/runs-{export.fresh_seed()}")
    harness.write_summary(spark.read.parquet(where), a.out)
    return not spark.read.parquet(where).where("status <> 'passed'").limit(1).count()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestrata", description=__doc__.split("\n")[0])
    commands = top.add_subparsers(dest="command_name", required=True)

    def command(f, **arguments: dict) -> None:
        c = commands.add_parser(f.__name__.replace("_", "-"), help=(f.__doc__ or "").split("\n")[0])
        c.set_defaults(run=f)
        for name, settings in arguments.items():
            c.add_argument("--" + name.replace("_", "-"), **settings)

    need, text, number, many = {"required": True}, {"default": None}, {"type": int, "default": None}, {"nargs": "+"}
    command(convert, levels=need, probes=text, output=need, out=need, preset=text, syntax=text, tile_size={"type": int, "default": 512}, metadata=text, seed=text, frames=text, overwrite={"action": "store_true"})
    command(sustain, levels=need, frames=need, probes=text, output=need, out=need, preset=text, syntax=text, tile_size={"type": int, "default": 512}, metadata=text, seed=text, overwrite={"action": "store_true"}, iterations={"type": int, "default": 1}, interval_ms={"type": int, "default": 0})
    command(profile, probes=need, out=need, level={"type": int, "default": 0}, max_frames={"type": int, "default": 64})
    command(coverage, probes=need, out=need, max_frames=number)
    command(coverage_corpus, probes=need, out=need, max_frames=number)
    command(validate, folder=need, command=many, set_command=many, decoder=many, out=text)
    command(doctor, tool={"action": "append"}, out=text)
    command(self_test, out=text)
    command(bench, slides=need, tool={"action": "append", "required": True}, profile=many | need, scope=many | need, runs={"type": int, "default": 1}, timeout={"type": float, "default": 7200}, system=text, out=need)
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    return 0 if a.run(spark or SparkSession.builder.getOrCreate(), a) else 1


if __name__ == "__main__":
    sys.exit(main())
