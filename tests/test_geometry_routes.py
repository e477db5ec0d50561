import hashlib

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import dims
from lodestrata.functions import scalars as S
from lodestrata.operators import geometry as G
from lodestrata.operators import lookups as L
from lodestrata.operators import metrics as M
from lodestrata.operators import offsets as O
from lodestrata.operators import reports as R
from lodestrata.operators import routes as T


def _one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_empty_counts_make_no_rows(spark):
    rows = spark.createDataFrame([(1, 0, 0, 0, 100, 100, 0, 2, 1), (1, 0, 0, 1, 10, 10, 2, 1, 3)], "source long, scene int, series int, level int, cols long, rows long, n_z long, n_c long, n_t long")
    got = [(r["level"], r["z"], r["t"], r["c"], r["ordinal"]) for r in G.jobs(rows).orderBy("ordinal").collect()]
    assert got == [(1, z, t, 0, z * 3 + t) for z in range(2) for t in range(3)]


def test_grid_rejects_zero_and_large(spark):
    with pytest.raises(ValueError):
        G.square_grid(spark.range(1), 0)
    with pytest.raises(Exception, match="exceeds 32 bits"):
        spark.range(1).select(G.checked_u32(F.lit(1 << 32), "frames")).collect()


def test_probe_coordinates_are_distinct_and_ordered(spark):
    r = _one(spark, p=G.probe_coordinates(F.lit(3).cast("long"), F.lit(2).cast("long")), s=G.sampled_coordinates(F.lit(30).cast("long"), F.lit(20).cast("long")), n=G.probe_coordinates(F.lit(0).cast("long"), F.lit(2).cast("long")))
    p = [tuple(x) for x in r["p"]]
    assert p == [(0, 0), (1, 1), (2, 1), (0, 1), (1, 0), (2, 0)] and r["n"] is None
    assert [tuple(x) for x in r["s"]][:5] == [(0, 0), (29, 19), (15, 10), (1, 0), (2, 0)] and len(r["s"]) == 16


def test_source_window_equals_overlap(spark):
    lit = lambda x: F.lit(x).cast("long")
    r = _one(spark, w=G.source_window(lit(90), lit(10), lit(50), lit(100), lit(40), lit(64)), none=G.source_window(lit(0), lit(0), lit(0), lit(5), lit(4), lit(4)))
    want = [(c, row) for row in range(9) for c in range(9) if c * 40 < 140 and c * 40 + 40 > 90 and row * 64 < 110 and row * 64 + 64 > 10]
    assert [tuple(x) for x in r["w"]] == want and r["none"] is None


def test_spacing_needs_finite_positive(spark):
    f = lambda a: G.pixel_spacing(F.lit(a), F.lit(0.5), F.lit(2.0))
    r = _one(spark, ok=f(0.25), nan=f(float("nan")), inf=f(float("inf")), zero=f(0.0))
    assert (r["ok"]["row"], r["ok"]["col"]) == (0.001, 0.0005) and r["nan"] is None and r["inf"] is None and r["zero"] is None


PROBE = "source long, level long, instance long, frame long, compression string, photometric string, components int, bits int, fits boolean, edge boolean, bytes long, micros long, error string"


def _probes(spark, rows, **flags):
    return spark.createDataFrame(rows, PROBE).withColumns({k: F.expr(v) for k, v in flags.items()})


def test_jpeg_route_priority(spark):
    rows = [
        (0, "jpeg", "YBR_FULL_422", 8, True, False, None, "passthrough", None), (1, "jpeg", "RGB", 8, True, False, None, "fallback", None),
        (2, "jpeg", "YBR_FULL_422", 8, False, False, None, "retile", None), (3, "jpeg", "YBR_FULL_422", 8, False, True, None, "fallback", "geometry_mismatch"),
        (4, "jpeg", "RGB", 8, False, False, None, "fallback", "profile_unsupported"), (5, "jpeg", "RGB", 8, False, False, "bad MCU", "fallback", "mcu_invalid"),
        (6, "jpeg", "RGB", 8, False, False, "no", "fallback", "source_unsupported"), (7, "none", "RGB", 8, True, False, "has empty TIFF tiles", "fallback", None), (8, "jp2k", "RGB", 16, True, False, None, "fallback", None),
    ]
    probes = spark.createDataFrame([(1, 0, 1, n, c, p, 3, b, f, e, 10, 5, x) for n, c, p, b, f, e, x, *_ in rows], PROBE)
    got = {r["frame"]: (r["route"], r["rejection"]) for r in T.jpeg_route(probes).collect()}
    assert got == {r[0]: r[-2:] for r in rows}
    assert [r["frame"] for r in T.jpeg_route(probes).where("blank").collect()] == [7]
    copied = {r["frame"]: (r["route"], r["rejection"]) for r in T.jpeg_route(probes.withColumn("rgb_grid", F.lit(True))).collect()}
    assert {k: v for k, v in copied.items() if v != got[k]} == {1: ("passthrough", None), 4: ("retile", None)}


def test_fallback_frames_have_no_profile(spark):
    rows = [(1, 0, 1, n, "jpeg" if n < 3 else "none", "YBR_FULL_422", 3 if n % 2 else 1, 8, True, False, 1, 7, None) for n in range(6)]
    m = M.aggregate(M.measures(T.jpeg_route(_probes(spark, rows))), ["source"]).first()
    assert (m["total_frames"], m["passthrough_frames"], m["fallback_frames"], m["unknown_profile_frames"]) == (6, 3, 3, 3)
    assert (m["gray_frames"], m["rgb_like_frames"], m["bits8_frames"], m["encode_micros"]) == (2, 1, 3, 21)


def test_rgb_tiles_are_copied_on_whole_native_grids_only(spark):
    rows = [("regular", 512, 512, 1024, 512), ("regular", 512, 512, 1000, 512), ("regular", 256, 256, 1024, 512), ("whole", 300, 512, 1000, 700), ("irregular", 512, 512, 1024, 1024)]
    levels = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "level long, kind string, tile_w long, tile_h long, cols long, rows long")
    assert [r["rgb_grid"] for r in G.rgb_grid(G.jpeg_frame_geometry(levels, 512)).orderBy("level").collect()] == [True, False, False, True, False]


def test_deadlines(spark):
    rows = [(k, 0, 1, n, "jpeg", "RGB", 3, 8, True, False, 1, 10, None) for k, m in ((1, 5), (2, 2)) for n in range(m)]
    got = {r["source"]: (r["done"], r["elapsed"], r["exceeded"]) for r in T.past_deadline(_probes(spark, rows), ["source"], ["frame"], 25).collect()}
    assert got == {1: (3, 30, True), 2: (2, 20, False)}
    with pytest.raises(ValueError, match="greater than zero"):
        T.past_deadline(_probes(spark, rows), ["source"], ["frame"], 0)


def test_unclassified_takes_off_all_seven_counters(spark):
    from lodestrata.functions import metric_names as N

    names = ("jpeg_passthrough_frames", "j2k_passthrough_frames", "jpeg_retile_frames", "jpeg_retile_to_htj2k_53_frames", *(c for c in N.DECIDED if c != N.RETILE_BASELINE))
    row = spark.range(1).select(F.lit(100).alias("total_frames"), *(F.lit(i + 1).alias(n) for i, n in enumerate(names)))
    r = M.complete(row).select(M.retile_baseline_frames().alias("b"), M.unclassified_frames().alias("u")).first()
    assert (r["b"], r["u"]) == (0, 100 - 1 - 2 - 0 - sum(range(5, len(names) + 1)))
    assert len(N.SUM_NAMES) + len(N.MAXIMUM_NAMES) + 1 == 99 == len({*N.SUM_NAMES, *N.MAXIMUM_NAMES}) + 1


def test_written_frames(spark):
    kinds = "route string, components int, bits int, gpu_input boolean, gpu_encode boolean, gpu_validation boolean, input_nanos long, compose_nanos long, encode_nanos long, validation_nanos long, device_nanos long, wall_nanos long"
    rows = [("encoded", 3, 8, True, True, False, 5000, None, 9000, None, 7000, 12000), ("encoded", 3, 8, False, False, False, 1, 2000, 3000, 4000, None, None), ("retile_53", 1, 8, False, False, False, None, None, None, None, None, None)]
    m = M.serialised(M.written_frames(spark.createDataFrame(rows, kinds)).withColumn("k", F.lit(1)), ["k"]).first()
    want = {"total_frames": 3, "gpu_transcode_frames": 1, "resident_gpu_transcode_frames": 1, "partial_gpu_transcode_frames": 0, "cpu_fallback_frames": 1, "jpeg_retile_frames": 1, "jpeg_retile_to_htj2k_53_frames": 1, "jpeg_direct_htj2k_53_frames": 1,
            "input_decode_micros": 6, "encode_micros": 12, "gpu_dispatch_micros": 14, "gpu_encode_wall_micros": 12, "gpu_encode_hardware_micros": 7, "gpu_encode_dispatch_overhead_micros": 2, "gray_frames": 1, "rgb_like_frames": 2}
    assert {k: int(m[k]) for k in want} == want and m["gpu_encode_effective_parallelism"] == pytest.approx(7 / 12)


def test_default_syntax_rules(spark):
    def probe(source, compression, fits=True):
        return (source, 0, source * 10, 0, compression, "YBR_FULL_422", 3, 8, fits, False, 1, 1, None)

    rows = [probe(1, "jpeg"), probe(1, "jp2k", False), probe(2, "jp2k"), probe(3, "jp2k"), probe(3, "jp2k", False), probe(4, "none")]
    got = {r["source"]: r["syntax"] for r in T.default_syntax(spark.createDataFrame(rows, PROBE)).collect()}
    assert got == {1: "JpegBaseline8Bit", 2: "Jpeg2000", 3: "Htj2kLosslessRpcl", 4: "Htj2kLosslessRpcl"}
    levels = [(9, v, 90 + v, 0, c, "YBR_FULL_422", 3, 8, True, False, 1, 1, None) for v, c in enumerate(("none", "jp2k", "jpeg"))]
    of = lambda probes, **k: T.default_syntax(probes, **k).first()["syntax"]
    assert of(_probes(spark, levels)) == "JpegBaseline8Bit" and of(_probes(spark, levels), max_levels=2) == "Jpeg2000" and of(_probes(spark, levels), level=0) == "Htj2kLosslessRpcl"
    assert of(_probes(spark, levels, synthetic="level = 2")) == "Jpeg2000" and of(_probes(spark, levels, synthetic="true")) == "Htj2kLosslessRpcl"
    with pytest.raises(ValueError, match="max_levels"):
        T.default_syntax(_probes(spark, levels), max_levels=0)


def test_best_route_needs_a_margin(spark):
    rows = [(1, "cpu", 0, 100), (1, "metal", 1, 91), (2, "cpu", 0, 100), (2, "metal", 1, 92), (3, "cpu", 0, None), (3, "cuda", 2, 50), (3, "metal", 1, 50), (4, "cpu", 0, None)]
    got = {r["probe"]: r["route"] for r in T.best_route(spark.createDataFrame(rows, "probe long, route string, ord int, micros long")).collect()}
    assert got == {1: "metal", 2: "cpu", 3: "metal", 4: "cpu"}


def test_saturating_sum(spark):
    r = spark.createDataFrame([(str(2**63),)] * 3, "n string").select(F.col("n").cast("decimal(38,0)").alias("n")).agg(M.saturating_sum("n").alias("s")).first()
    assert int(r["s"]) == 2**64 - 1
    r = _one(spark, a=M.reported_micros(F.lit(5).cast("long")), b=M.reported_micros(F.lit(2999).cast("long")), c=M.reported_micros(F.lit(0).cast("long")))
    assert tuple(r) == (1, 2, 0)


def test_fragments_invert_offsets(spark):
    frames = spark.createDataFrame([(1, i, 3 + i) for i in range(6)], "instance long, fragment long, bytes long")
    table = O.offset_table(frames.withColumnRenamed("fragment", "frame"))
    at = {r["frame"]: r["offset"] for r in table.collect()}
    assert at[0] == 0 and at[1] == 12 and at[2] == 24 and at[3] == 38
    starts = spark.createDataFrame([(1, 0, at[0]), (1, 1, at[2]), (1, 2, at[3]), (2, 0, 5)], "instance long, frame long, offset long")
    got = sorted((r["frame"], r["first"], r["last"], r["valid"]) for r in O.fragment_ranges(frames, starts).collect())
    assert got == [(0, 0, 1, True), (1, 2, 2, True), (2, 3, 5, True)]


def test_uids(spark):
    rows = [("a",), ("",), ("x:1",), ("é",)]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "s string").select("s", S.uid(F.col("s"))).collect()}
    assert got == {s: "2.25." + str(int(hashlib.sha256(s.encode()).hexdigest()[:32], 16)) for (s,) in rows}


@pytest.mark.parametrize(("check", "good", "bad"), [
    (S.valid_da, ["", "20240229", "19991231"], ["20230229", "2024013", "00000101", "20241301", "20240431", "2024-1-1"]),
    (S.valid_tm, ["", "23", "2359", "235959", "235959.123456"], ["24", "2360", "235960", "2359.1", "235959.", "235959.1234567", "1"]),
    (S.valid_dt, ["", "2024", "202402", "20240229", "20240229235959.1", "2024+1400", "20240229-0330"], ["202413", "20230229", "2024022924", "20240229.1", "2024+1401", "2024+1500", "2024+0060", "+0100"]),
    (S.valid_cs, ["", "AB_1 2"], ["ab", "A" * 17, "A-B"]),
    (S.valid_ui, ["", "1.2.840", "0"], ["1..2", ".1", "1.", "1.a", "1." * 32 + "1"]),
    (lambda c: S.valid_text(c, 5), ["", "a\tb\nc", "ééééé"], ["123456", "a\x01", "\x7f"]),
])
def test_validators(spark, check, good, bad):
    rows = spark.createDataFrame([(x, True) for x in good] + [(x, False) for x in bad], "x string, ok boolean")
    assert [r["x"] for r in rows.where(check(F.col("x")) != F.col("ok")).collect()] == []


def test_names_and_numbers(spark):
    r = _one(spark, a=S.slug(F.lit("  Hello, World!! v1.2_x ")), b=S.slug(F.lit("***")), c=S.slug(F.lit("a - b")))
    assert tuple(r) == ("hello-world-v1.2_x", "slide", "a-b")
    assert [S.decimal_string(x) for x in (0.5, 1 / 3, 123456789.123456, 1e20, 2.0, -0.0, 1e-9)] == ["0.5", "0.333333333333", "123456789.123456", "1.00000000e+20", "2", "0", "0.000000001"]
    r = _one(spark, a=S.json_text(F.lit('{"a":"x","b":5,"c":""}'), "$.a"), b=S.json_text(F.lit('{"a":"x","b":5}'), "$.b"), c=S.json_text(F.lit('{"c":""}'), "$.c"), d=S.json_text(F.lit("no json"), "$.a"))
    assert tuple(r) == ("x", None, None, None)


def test_manifest_tiers(spark):
    slides = spark.createDataFrame([(1, "a/f1/x.svs"), (2, "b/f2/Y.SVS"), (3, "c/f9/z.svs"), (4, "d/f8/w.svs"), (5, None)], "slide long, path string")
    manifest = spark.createDataFrame([(0, "n0", "q/z.svs"), (1, "n1", "r/Z.svs"), (2, "f2", "other.svs"), (3, "n3", "a/f1/x.svs"), (4, "f1", "k.svs"), (5, "n5", "y.svs")], "position long, file_id string, filename string")
    got = {r["slide"]: (r["tier"], r["file_id"]) for r in L.manifest_match(slides, manifest).collect()}
    assert got == {1: (1, "n3"), 2: (2, "f2"), 3: (3, "n0"), 4: (None, None), 5: (None, None)}


def test_selected_slides_and_cells(spark):
    slides = spark.createDataFrame([(1, "Alpha", None, "x"), (2, "beta", "Alp", "Y"), (3, "gamma", "d", None)], "k long, a string, b string, c string")
    of = lambda *f, **o: [r["k"] for r in L.select_slides(slides, list(f), ["a", "b", "c"], order="k", **o).collect()]
    assert of() == [1, 2, 3] and of("ALP") == [1, 2] and of("alp", "y") == [2] and of("a", most=2) == [1, 2] and of("zz") == []
    trials = spark.createDataFrame([("s", "p", "f", 1), ("s", "p", "g", 2), ("t", "p", "f", 3)], "slide string, profile string, scope string, seq long")
    assert [r["seq"] for r in L.trials_of_cells(trials, trials.where("seq <> 2")).orderBy("seq").collect()] == [1, 3]


def test_references(spark):
    def res(bundle, kind, id_, body="{}"):
        return (bundle, kind, id_, body)

    report = '{"subject":{"reference":"Patient/p"},"specimen":[{"reference":"Specimen/k"}],"basedOn":[{"reference":"ServiceRequest/s"}]}'
    two = report.replace('[{"reference":"Specimen/k"}]', '[{"reference":"Specimen/k"},{"reference":"Specimen/l"}]')
    rest = lambda b: [res(b, "Specimen", "k"), res(b, "ServiceRequest", "s")]
    rows = [
        res(1, "DiagnosticReport", "r", report), res(1, "Patient", "p"), *rest(1),
        res(2, "DiagnosticReport", "r", report), res(2, "Patient", "q"), *rest(2),
        res(3, "DiagnosticReport", "r", report), res(3, "DiagnosticReport", "r2", report), res(3, "Patient", "p"),
        res(4, "DiagnosticReport", "r", report), res(4, "Patient", "p"), *rest(4), res(4, "ServiceRequest", "t"),
        res(5, "DiagnosticReport", "r", "{}"), res(5, "Patient", "p"),
        res(6, "DiagnosticReport", "r", two), res(6, "Patient", "p"), *rest(6), res(6, "Specimen", "l"),
        res(7, "DiagnosticReport", "r", report), res(7, "Patient", "p"), res(7, "ServiceRequest", "s"),
        res(8, "Patient", "p"), *rest(8), res(9, "DiagnosticReport", "r", report), res(9, "Patient", "p"), res(9, "Patient", "p"), *rest(9),
        res(10, "DiagnosticReport", "r", report.replace("Specimen/k", "Patient/p")), res(10, "Patient", "p"), *rest(10),
    ]
    df = spark.createDataFrame(rows, "bundle long, type string, id string, body string")
    got = {r["bundle"]: r["error"] for r in L.resolve_references(df).collect()}
    assert got == {
        1: None, 2: "unreferenced patient", 3: "needs one report", 4: "unreferenced request", 5: "bad subject", 6: "bad specimen", 7: "specimen not found once", 8: "needs one report",
        9: "subject not found once", 10: "bad specimen",
    }
    assert sorted(tuple(r) for r in L.unreferenced(df).where("bundle = 4").collect()) == [(4, "ServiceRequest", "t")]


def test_status_and_labels(spark):
    rows = [("s", "cpu", None, "p", "f", "passed", 2.0, 1), ("s", "cpu", None, "p", "f", "failed", None, 2), ("s", "device", None, "p", "f", "failed", None, 3), ("s", "device", None, "p", "f", "timeout", None, 4), ("s", "", None, "p", "f", "passed", 1.0, 5)]
    t = spark.createDataFrame(rows, "slide string, tool string, label string, profile string, scope string, status string, seconds double, seq long").withColumns({"system_label": F.lit("Nvidia box"), "output_dir": F.lit("/metal")})
    got = {r["result_label"]: (r["status"], r["seconds"]) for r in R.summary(R.with_label(t)).collect()}
    assert got == {"CPU": ("partial 1/2", 2.0), "CUDA": ("timeout", None), "unknown": ("passed", 1.0)}
    assert _one(spark, x=R.summary_line({"a": F.lit('q"'), "b": F.lit(None).cast("string")}))[0] == "a=q' b=none"


def test_dimension_tables(spark):
    assert dims.transfer_syntaxes(spark).select("uid").distinct().count() == 7
    assert dims.quantization_scales(spark).where("scale is null").count() == 1
