"""Attempts of routes, counters of two grains, frames from fragments, corpora with failures, labels by all hints."""

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import metric_names
from lodestrata.operators import attempts, batches, metrics, offsets, reports, routes


def _planned(spark, n=6):
    return spark.createDataFrame([("i", f) for f in range(n)], "instance string, frame long")


def test_each_route_gets_what_those_before_left(spark, tmp_path):
    seen = {}

    def route(name, does, photometric="RGB"):
        def run(left):
            seen[name] = sorted(r["frame"] for r in left.collect())
            return left.select("instance", "frame", F.col("frame").isin(does).alias("ok"), F.concat(F.lit(name), F.lit(" failed")).alias("error"), F.lit(3).alias("components"), F.lit(8).alias("bits"), F.lit(photometric).alias("photometric"))

        return name, run

    def save(df, name):
        df.write.mode("overwrite").parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    found = attempts.resolve(_planned(spark), [route("a", [0, 2]), route("b", [2, 3], "YBR"), route("c", [1])], save)
    got = {r["frame"]: (r["route"], r["failures"], r["error"]) for r in found.collect()}
    assert seen == {"a": [0, 1, 2, 3, 4, 5], "b": [1, 3, 4, 5], "c": [1, 4, 5]}
    assert got == {0: ("a", 0, None), 1: ("c", 2, None), 2: ("a", 0, None), 3: ("b", 1, None), 4: (None, 3, "a failed"), 5: (None, 3, "a failed")}
    (one,) = attempts.conflicts(found).collect()
    assert (one["frames"], one["done"], one["misses"], one["error"]) == (6, 4, 2, "a failed")
    (one,) = attempts.conflicts(found.where("route is not null")).collect()
    assert (one["misses"], one["error"]) == (0, "pixel profile changes")
    (one,) = attempts.conflicts(found.where("route = 'a'")).collect()
    assert one["error"] is None


def test_attempts_on_frames_that_are_not_planned_and_none_at_all(spark):
    rows = spark.createDataFrame([("i", 0, 1, "b", True, None, 1, 8, "M"), ("i", 0, 1, "a", True, None, 3, 8, "R"), ("i", 9, 0, "a", True, None, 1, 8, "M")], "instance string, frame long, priority int, route string, ok boolean, error string, components int, bits int, photometric string")
    got = {r["frame"]: (r["route"], r["components"], r["failures"]) for r in attempts.first_success(_planned(spark, 2).union(_planned(spark, 1)), rows).collect()}
    assert got == {0: ("a", 3, 0), 1: (None, None, 0)}


def test_batches_count_once(spark):
    frames = spark.createDataFrame([("s", 1, 5), ("s", 1, 7), ("t", 1, 1)], "source string, total_frames long, encode_micros long")
    rows = [("s", b, 1, 999, 4, 6, 1, 1500, 2500, True) for b in (1, 1, 1, 2)] + [("s", None, 9, 9, 9, 9, 9, 9, 9, True), ("u", 1, None, None, 8, 6, 1, 0, None, False)]
    facts = spark.createDataFrame(rows, "source string, batch long, gpu_encode_batches long, write_nanos long, gpu_pipeline_depth long, probe_frames long, probe_gpu_batches long, probe_cpu_nanos long, probe_gpu_nanos long, probe_selected boolean")
    got = {r["source"]: r for r in batches.two_grains(frames, facts, ["source"], "batch").collect()}
    assert set(got) == {"s", "t", "u"} and set(metric_names.SUM_NAMES) | set(metric_names.MAXIMUM_NAMES) | {metric_names.DERIVED} <= set(got["s"].asDict())
    s = got["s"]
    assert (s["total_frames"], s["encode_micros"], s["gpu_encode_batches"], s["write_micros"], s["gpu_pipeline_depth"]) == (2, 12, 2, 2, 4)
    assert (s["auto_route_probe_frames"], s["auto_route_probe_cpu_micros"], s["auto_route_probe_gpu_micros"], s["auto_route_probe_selected_gpu_input_frames"]) == (12, 2, 4, 12)
    assert (got["u"]["total_frames"], got["u"]["auto_route_probe_selected_gpu_input_frames"], got["u"]["gpu_pipeline_depth"]) == (0, 0, 8)
    with pytest.raises(ValueError, match="no_such"):
        batches.counters(facts.withColumn("no_such", F.lit(1)), ["source", "batch"])


def _assembled(spark, fragments, starts):
    f = spark.createDataFrame([("i", n, bytes(b)) for n, b in enumerate(fragments)], "instance string, fragment long, data binary")
    s = spark.createDataFrame([("i", n, o, size) for n, (o, size) in enumerate(starts)], "instance string, frame long, offset long, length long")
    return {r["frame"]: (None if r["raw"] is None else list(r["raw"]), r["error"]) for r in offsets.assemble_frames(f, s).collect()}


def test_frames_from_fragments(spark):
    parts = [[1, 2], [3, 0], [4, 5]]
    assert _assembled(spark, parts, [(0, 3), (20, 2)]) == {0: ([1, 2, 3], None), 1: ([4, 5], None)}
    assert _assembled(spark, parts, [(0, None), (20, None)]) == {0: ([1, 2, 3, 0], None), 1: ([4, 5], None)}
    assert _assembled(spark, parts, []) == {0: ([1, 2], None), 1: ([3, 0], None), 2: ([4, 5], None)}
    assert _assembled(spark, parts, [(0, 5), (20, 2)])[0] == (None, "length is beyond the fragments")
    assert _assembled(spark, parts, [(0, 1), (7, 1)])[1] == (None, "offset is no fragment's")
    assert _assembled(spark, parts, [(10, 1), (20, 1)])[0] == (None, "offsets do not ascend from zero")
    assert _assembled(spark, parts, [(0, 1), (20, 1), (20, 1)])[2][1] == "offsets do not ascend from zero"


def test_corpus_with_a_source_that_fails(spark):
    rows = [("a", 1, f, "YBR_FULL_422", 3, 8, None) for f in range(4)] + [("b", 1, 0, "YBR_FULL_422", 3, 8, None), ("b", 1, 1, "MONOCHROME2", 1, 8, None), ("c", None, None, None, None, None, "no such file")]
    df = spark.createDataFrame(rows, "source string, instance long, frame long, photometric string, components int, bits int, failure string")
    probes = df.withColumns({"compression": F.when(F.col("failure").isNull(), "jpeg"), "fits": F.lit(True), "edge": F.lit(False), "error": F.lit(None).cast("string"), "micros": F.lit(1).cast("long")})
    got = {r["source"]: r for r in metrics.corpus_report(routes.jpeg_route(probes), metrics.measures).collect()}
    assert {k: r["error"] for k, r in got.items()} == {"a": None, "b": "pixel profile changes", "c": "no such file", None: None}
    whole = got[None]
    assert (whole["considered"], whole["reports"], whole["failures"], whole["total_frames"], whole["passthrough_frames"]) == (3, 1, 2, 4, 4)


def test_all_hints_of_a_device(spark):
    rows = spark.createDataFrame([(1, None, None, "/x/NVidia.log", None), (2, "Darwin 23", None, None, None), (3, "Linux", None, None, None), (4, None, "metal-run", None, "/cuda/a.svs"), (5, None, None, None, None)], "n int, system_label string, output_dir string, stderr_path string, source_path string")
    trials = rows.withColumns({"tool": F.lit("device"), "label": F.lit(None).cast("string")})
    label = lambda **k: {r["n"]: r["result_label"] for r in reports.with_label(trials, **k).collect()}
    assert label() == {1: "CUDA", 2: "Metal", 3: "Device (Linux)", 4: "CUDA", 5: "Device"}
    assert label(result_set="night-cuda")[5] == "CUDA"
