import os
import struct

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import binary
from lodestrata import cli
from lodestrata.operators import reports
from lodestrata.operators import validation as V
from lodestrata.plans import adapters
from lodestrata.plans import harness
from lodestrata.plans import options as P
from lodestrata.plans.export import Export, encode_frames, route_coverage, route_profile
from lodestrata.sources import dicom, listing
from lodestrata.streaming import iterations


@pytest.fixture
def registered(spark):
    spark.dataSource.register(listing.BoundedListing)
    spark.dataSource.register(dicom.DicomHeaders)
    return spark


def test_bounded_listing(registered, tmp_path):
    for name in ("a.SVS", "b.txt", "deep/er/c.dcm", ".dcm"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"xy")
    read = lambda **o: registered.read.format("bounded_listing").options(**o).load(str(tmp_path))
    got = read(suffixes="svs,dcm").collect()
    assert [os.path.basename(r["path"]) for r in got] == ["a.SVS", "c.dcm"] and {r["length"] for r in got} == {2}
    assert tuple(listing.file_totals(read()).first()) == (4, 8)
    for bad in ({"max_depth": "1"}, {"max_files": "2"}, {"suffixes": "none", "strict_empty": "true"}):
        with pytest.raises(Exception, match="deeper|more than|no file"):
            read(**bad).collect()
    (tmp_path / "link").symlink_to(tmp_path / "b.txt")
    with pytest.raises(Exception, match="symbolic link"):
        read().collect()


def test_text_tables(spark, tmp_path):
    (tmp_path / "m.tsv").write_text('id\tfilename\tsize\nx\t"q.svs\t12\n\ny\tz.svs\tmany\n')
    got = [tuple(r) for r in listing.read_manifest(spark, str(tmp_path / "m.tsv")).collect()]
    assert got == [("x", '"q.svs', "", 12, ""), ("y", "z.svs", "", None, "")]
    for k in ("one", "two"):
        (tmp_path / k).mkdir()
        (tmp_path / k / "results.jsonl").write_text('{"slide":"s","seconds":1.5}\n\nnot json\n')
    rows = listing.read_result_sets(spark, [str(tmp_path / "one"), str(tmp_path / "two")], "slide string, seconds double").collect()
    assert sorted((r["result_set"], r["slide"], r["_damaged"]) for r in rows if r["slide"]) == [("one", "s", None), ("two", "s", None)]
    assert sum(r["_damaged"] == "not json" for r in rows) == 2
    assert spark.range(1).select(listing.first_line(F.lit("\n  \n x \ny"))).first()[0] == "x"


def _instances(spark, names, frames=(b"abc", b"", b"defg")):
    rows = [(n, '{"sop_instance_uid":"2.25.7","patient_id":"P1","rows":4,"columns":4,"total_columns":8,"total_rows":7,"photometric":"RGB"}', "1.2.840.10008.1.2.4.50", list(frames)) for n in names]
    return spark.createDataFrame(rows, "name string, header string, transfer_syntax string, frames array<binary>")


def test_instances_round_trip(registered, tmp_path):
    out = str(tmp_path / "out")
    _instances(registered, ["a.dcm", "b.dcm"]).repartition(2).write.format("dicom_headers").mode("append").save(out)
    assert sorted(n for n in os.listdir(out) if not n.startswith(".")) == ["a.dcm", "b.dcm"]
    (tmp_path / "out" / "broken.dcm").write_bytes(b"nothing")
    got = {os.path.basename(r["path"]): r for r in registered.read.format("dicom_headers").load(out).collect()}
    a = got["a.dcm"]
    assert (a["transfer_syntax"], a["patient_id"], a["rows"], a["number_of_frames"], a["bits_allocated"], a["error"]) == ("1.2.840.10008.1.2.4.50", "P1", 4, 3, 0, None)
    assert got["broken.dcm"]["error"] and got["broken.dcm"]["rows"] == 0
    checks = {(os.path.basename(r["path"]), r["check"]): r["status"] for r in V.header_checks(registered.read.format("dicom_headers").load(out)).collect()}
    assert checks["a.dcm", "frames"] == "failed" and checks["a.dcm", "geometry"] == "passed" and checks["broken.dcm", "readable"] == "failed" and checks["broken.dcm", "frames"] == "skipped"


def test_writes_are_all_or_nothing(registered, tmp_path):
    out = str(tmp_path / "out")
    _instances(registered, ["a.dcm"]).write.format("dicom_headers").mode("append").save(out)
    before = (tmp_path / "out" / "a.dcm").read_bytes()
    for names in (["a.dcm", "c.dcm"], ["d.dcm", "d.dcm"], ["../x.dcm"]):
        with pytest.raises(Exception, match="there already|have the name|no file name"):
            _instances(registered, names).write.format("dicom_headers").mode("append").save(out)
        assert [n for n in os.listdir(out) if not n.startswith(".")] == ["a.dcm"]
    (tmp_path / "out" / ".staging-left").mkdir()
    _instances(registered, ["a.dcm"], [b"new"]).write.format("dicom_headers").mode("overwrite").save(out)
    assert (tmp_path / "out" / "a.dcm").read_bytes() != before
    assert sorted(os.listdir(out)) == [".lodestrata-lock", ".staging-left", "a.dcm"]  # another writer's staging folder is left alone


def test_encapsulated_layout():
    raw = dicom.encapsulated([b"abc", b"defg"])
    offsets, lengths = struct.unpack("<2Q", raw[12:28]), struct.unpack("<2Q", raw[40:56])
    data = raw[56 + 12 + 8 :]
    assert lengths == (3, 4) and offsets == (0, 12)
    assert [data[o + 8 : o + 8 + n] for o, n in zip(offsets, lengths)] == [b"abc", b"defg"] and raw.endswith(struct.pack("<HHI", 0xFFFE, 0xE0DD, 0))


def _jpeg(*chunks):
    body = b"".join(struct.pack(">HH", 0xFFE2, 16 + len(d)) + b"ICC_PROFILE\0" + bytes([n, m]) + d for n, m, d in chunks)
    return b"\xff\xd8" + struct.pack(">HH", 0xFFE0, 4) + b"xx" + body + b"\xff\xda\0\2"


def test_binary_headers(spark):
    head, cod = b"\xff\x4f\xff\x51\0\4aa", b"\xff\x52\0\4\0"
    cases = [(head + cod + b"\2", True), (head + cod + b"\1", False), (head + b"\xff\x90" + cod + b"\2", None), (b"", None), (None, None), (head + b"\xff\x52\0\4", None), (b"\xff\xd8" + cod, None)]
    assert [binary.codestream_is_rpcl(r) for r, _ in cases] == [w for _, w in cases]
    rows = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(cases)], "i int, raw binary")
    assert [r[0] for r in rows.orderBy("i").select(binary.is_rpcl(F.col("raw"))).collect()] == [w for _, w in cases]
    assert binary.jpeg_icc_profile(_jpeg((2, 2, b"b"), (1, 2, b"a"))) == b"ab"
    for wrong in ([(1, 2, b"a")], [(1, 2, b"a"), (1, 2, b"b")], [(1, 1, b"a"), (2, 2, b"b")], []):
        assert binary.jpeg_icc_profile(_jpeg(*wrong)) is None
    assert binary.stable_icc(b"x" * 40)[24:36] == struct.pack(">6H", 2000, 1, 1, 0, 0, 0) and binary.stable_icc(b"short") == b"short"
    assert binary.pnm_header(b"P6 # c\n2 1\n255\nabcdef") == ("P6", 2, 1, 255, 6)
    assert binary.pnm_header(b"P5\n2 2\n65535\n" + b"x" * 8) == ("P5", 2, 2, 65535, 8)
    for wrong in (b"P6 2 1 255\nabc", b"P4 1 1 1\n", b"P5 0 1 255\n", b"P5 a", b"P5 1 1 255x", None):
        assert binary.pnm_header(wrong) is None
    assert binary.pad_samples(b"abcd", 2, 2, 3, 3, 1) == b"ab\0cd\0\0\0\0"
    assert binary.deterministic_rgb(2, 2)[:6] == bytes([0, 0, 0, 37, 17, 7]) and len(binary.deterministic_rgb(3, 2)) == 18


def test_options():
    assert P.ExportOptions().validate().with_syntax("Htj2k").validate().profile == "Lossy97"
    for bad in ({"tile_size": 0}, {"jpeg_quality": 101}, {"transfer_syntax": "Htj2k"}, {"profile": "Lossy97"}, {"decomposition_levels": 0}, {"backend": "x"}):
        with pytest.raises(ValueError):
            P.ExportOptions(**bad).validate()
    assert P.resolve_syntax("fast_jpeg", None) == "JpegBaseline8Bit" and P.resolve_syntax(None, "Jpeg2000") == "Jpeg2000"
    with pytest.raises(ValueError):
        P.resolve_syntax("fast_jpeg", "Jpeg2000")
    assert P.decoder_command("/bin/d -i {input} -o '{output}'", "a b", "c") == ["/bin/d", "-i", "a b", "-o", "c"]
    assert P.decoder_command("/bin/d -q", "x", "y") == ["/bin/d", "-q", "x"]
    with pytest.raises(ValueError):
        P.decoder_command("d {input}", "x", "y")
    assert [P.timeout_text(x) for x in (0.5, 1.5, 3)] == ["500 ms", "1500 ms", "3 s"]


def test_export_plan(spark):
    from lodestrata.plans import adapters

    d = "/root/testdata/sf0.001"
    levels, probes = adapters.levels(spark, d), adapters.frame_probes(spark, d)
    with pytest.raises(ValueError, match="metadata"):
        Export(levels).to_directory("o").plan()
    with pytest.raises(ValueError, match="output"):
        Export(levels).with_placeholder_metadata().plan()
    plan = Export(levels, probes).to_directory("o").with_placeholder_metadata().level(1).plan().cache()
    assert plan.count() == plan.select("sop_uid").distinct().count() > 0 and plan.where("level <> 1").count() == 0
    fixed = Export(levels, probes).to_directory("o").with_placeholder_metadata().transfer_syntax("Jpeg2000").plan()
    assert {r[0] for r in fixed.select("syntax").distinct().collect()} == {"Jpeg2000"}
    series = fixed.groupBy("source", "scene", "series", "z", "c", "t").agg(F.countDistinct("series_uid").alias("n")).select(F.max("n")).first()[0]
    assert series == 1
    some, every = route_coverage(probes, max_frames=2), route_coverage(probes, max_frames=None)
    assert every.where("not complete").count() == 0 and some.where("grain = 3 and complete").count() == 0
    assert route_profile(probes, max_frames=3).select(F.max("total_frames")).first()[0] <= 3


def test_codec_errors_are_rows(spark):
    rows = spark.createDataFrame([(1, 0, b"ab"), (1, 1, b"")], "instance long, frame long, pixels binary")

    def codec(raw, settings):
        return raw[::-1] * settings["n"] if raw else 1 / 0

    got = sorted(tuple(r) for r in encode_frames(rows, codec, {"n": 2}).collect())
    assert got[0] == (1, 0, b"baba", None) and got[1][2] is None and "ZeroDivisionError" in got[1][3]


def _fake():
    class Fake(V.Runner):
        def find(self, name):
            return None if name == "absent" else name
    
        def run(self, command, timeout):
            return (None, "timed out") if "slow" in command[-1] else (0, "fine") if command[-1].endswith("ok") else (3, "bad file\nmore")

    return Fake()  # a class of this function travels to the workers whole


def test_checks(spark):
    files = spark.createDataFrame([("a.ok",), ("b",), ("slow",)], "path string")
    got = {r["path"]: (r["status"], r["message"]) for r in V.command_checks(files, "x", ["tool"], runner=_fake()).collect()}
    assert got == {"a.ok": ("passed", None), "b": ("failed", "bad file\nmore"), "slow": ("failed", "timed out")}
    assert {r["status"] for r in V.command_checks(files, "x", ["absent"], runner=_fake()).collect()} == {"skipped"}
    tools = {r["tool"]: r["status"] for r in V.doctor(spark, {"one": ["one", "ok"], "two": ["absent"], "three": ["three", "no"]}, runner=_fake()).collect()}
    assert tools == {"one": "passed", "two": "missing", "three": "failed"}
    assert V.Runner().run(["sleep", "5"], 0.1)[0] is None and V.Runner().run(["true"], 5)[0] == 0
    chunks = V.chunked(spark.range(1100).select(F.format_string("%05d", "id").alias("path"))).orderBy("chunk").collect()
    assert [len(c["paths"]) for c in chunks] == [512, 512, 76] and chunks[1]["paths"][0] == "00512"
    fields = spark.createDataFrame([(1, "P", "N", "20230229", "m"), (2, None, "N", None, "M")], "k int, patient_id string, patient_name string, birth_date string, sex string")
    assert [(r["k"], r["errors"]) for r in V.field_errors(fields, "k").orderBy("k").collect()] == [(1, ["birth_date", "sex"]), (2, [])]
    assert [r["error"] for r in V.strict_errors(fields, "k").orderBy("k").collect()] == [None, "patient id is missing"]


def test_streams(spark, tmp_path):
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=i), "ab"[i % 2], float(i)) for i in range(40)]
    events = spark.createDataFrame(rows, "ts timestamp, event_type string, value double")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = iterations.windowed_rates(stream).writeStream.outputMode("complete").format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("rates").collect())) == sorted(map(tuple, iterations.windowed_rates(events).collect()))
    keyed = stream.select(F.col("event_type").alias("key"), F.when(F.col("value") > 36, "undecided").otherwise("gpu").alias("decision"), "ts")
    seen = []
    q = iterations.cached_decisions(keyed).writeStream.outputMode("update").foreachBatch(lambda d, i: seen.extend(map(tuple, d.collect()))).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {k: (d, n) for k, d, n in seen} == {"a": ("gpu", 20), "b": ("gpu", 20)}


def test_decisions_follow_event_time_and_old_keys_go(spark, tmp_path):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    batches = [[("a", "gpu", at(5)), ("a", "cpu", at(3)), ("b", "cpu", at(1))], [("a", "undecided", at(9)), ("c", "gpu", at(200))], [("c", "cpu", at(201)), ("b", "gpu", at(202))]]
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    stream = spark.readStream.schema("key string, decision string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(folder))
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "key string, decision string, ts timestamp").coalesce(1).write.mode("append").parquet(str(folder))
        cached = iterations.cached_decisions(stream, keep="1 hour", late="10 minutes").writeStream.outputMode("update")
        q = cached.foreachBatch(lambda d, i, n=n: seen.extend((n, *r) for r in d.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert {x for x in seen if x[0] == 0} == {(0, "a", "gpu", 2), (0, "b", "cpu", 1)}
    assert (1, "a", "gpu", 3) in seen and (2, "c", "cpu", 2) in seen and (2, "b", "gpu", 1) in seen  # b began anew


def test_harness(spark, tmp_path):
    slides = spark.createDataFrame([("s1", "/d/a.ok"), ("s2", "/d/b")], "slide string, path string")
    trials = harness.planned(slides, tools={"cpu": ["tool", "-p", "{profile}", "{path}"], "device": ["tool", "-o", "{output}"]}, profiles=["p"], scopes=["base", "full"], runs=2)
    assert trials.count() == 16
    done = harness.run_trials(trials.where("tool = 'cpu'"), runner=_fake()).cache()
    assert {(r["slide"], r["status"], r["error"]) for r in done.collect()} == {("s1", "passed", None), ("s2", "failed", "bad file")}
    assert harness.resumed(trials, done).count() == 8
    rows = done.withColumns({"label": F.lit(None).cast("string"), "system_label": F.lit(None).cast("string"), "seq": F.monotonically_increasing_id()})
    (tmp_path / "out").mkdir()
    harness.write_summary(rows, str(tmp_path / "out"))
    text = (tmp_path / "out" / "summary.md").read_text()
    assert text.startswith("# Trials\n\n| Slide | Profile | Scope | CPU status | CPU seconds |\n") and text.count("| passed | ") == 2 and text.count("| failed |  |") == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "results.csv")).columns[:2] == ["slide", "display_name"]
    more = rows.where("slide = 's1' and scope = 'full'").withColumns({"tool": F.lit("device"), "system_label": F.lit("nvidia"), "seconds": F.lit(2.0)})
    rows = rows.withColumn("seconds", F.lit(5.0)).unionByName(more)
    lines = list(harness.markdown_lines(reports.with_label(rows), "T"))
    assert lines[2] == "| Slide | Profile | Scope | CPU status | CPU seconds | CUDA status | CUDA seconds | CUDA vs CPU |" and lines[3].count("---:") == 3
    assert lines[4:6] == ["| s1 | p | base | passed | 5.000 | missing |  |  |", "| s1 | p | full | passed | 5.000 | passed | 2.000 | 2.50x |"]
    (tmp_path / "r").mkdir()
    for n, t in (("a", '{"x":1}'), ("b", " "), ("c", "{")):
        (tmp_path / "r" / n).write_text(t)
    assert [(r["report"], r["error"]) for r in harness.report_rows(spark, str(tmp_path / "r")).orderBy("path").collect()] == [('{"x":1}', None), (None, "empty"), (None, "no JSON")]


def test_prepared_samples(spark):
    assert binary.prepare_samples(b"abcd", 2, 2, 1, 8, 3, 2) == (b"ab\0cd\0", 1)
    assert binary.prepare_samples(b"abc\xffdef\xff", 2, 1, 4, 8, 2, 1) == (b"abcdef", 3)
    assert binary.prepare_samples(b"abcdef", 1, 1, 3, 16, 1, 1) == (b"abcdef", 3)
    for wrong in ((b"abc\xfe", 1, 1, 4, 8, 1, 1), (b"ab", 1, 1, 2, 8, 1, 1), (b"abc", 2, 2, 1, 8, 2, 2), (b"ab", 2, 1, 1, 8, 1, 1), (None, 1, 1, 1, 8, 1, 1), (b"a", 1, 1, 1, 32, 1, 1)):
        assert binary.prepare_samples(*wrong) is None
    assert binary.prepare_samples(b"a", 1, 1, 1, 8, 9, 9, limit=80) is None
    rows = spark.createDataFrame([(b"abcd", 2, 2, 1, 8), (None, 1, 1, 1, 8)], "raw binary, w int, h int, c int, b int")
    got = rows.select(binary.prepared(F.col("raw"), F.col("w"), F.col("h"), F.col("c"), F.col("b"), 2, 2).alias("p")).collect()
    assert bytes(got[0]["p"]["samples"]) == b"abcd" and got[0]["p"]["channels"] == 1 and got[1]["p"]["samples"] is None


def test_u64_values(spark):
    values = [[], [0, 1, 2**64 - 1], [258]]
    rows = spark.createDataFrame([(i, struct.pack(f"<{len(v)}Q", *v)) for i, v in enumerate(values)] + [(3, b"abc"), (4, None)], "i int, raw binary")
    got = [r["v"] for r in rows.select("i", binary.u64_values(F.col("raw")).alias("v")).orderBy("i").collect()]
    assert [None if v is None else [int(x) for x in v] for v in got] == [*values, None, None]


def test_seeds(spark):
    import hashlib
    from dataclasses import replace

    from lodestrata.plans.export import deterministic_seed, fresh_seed

    o = P.ExportOptions()
    raw = spark.createDataFrame([(b"abc",), (b"abd",)], "c binary")
    seed = lambda x: [r[0] for r in raw.select(deterministic_seed(F.col("c"), x, {"patient_id": "P"})).collect()]
    assert seed(o) == seed(replace(o, overwrite=True)) != seed(replace(o, tile_size=256)) and len(set(seed(o))) == 2
    assert len(fresh_seed()) == 32 and fresh_seed() != fresh_seed()
    assert len(seed(o)[0]) == len(hashlib.sha256(b"").hexdigest())


def test_device_options():
    e = Export(None).device(source_device_decode=True, gpu_pipeline_depth=2, gpu_row_batch_rows=None)
    assert e.options.source_device_decode and e.options.gpu_pipeline_depth == 2 and e.options.validate()
    with pytest.raises(ValueError, match="gpu_encode_memory_mib must be greater than zero"):
        e.device(gpu_encode_memory_mib=0).options.validate()
    with pytest.raises(ValueError, match="no device option"):
        e.device(speed=1)


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_command_line(spark, tmp_path, capsys):
    where = {n: str(tmp_path / n) for n in ("levels", "probes", "plan", "profile", "coverage", "corpus", "slides", "bench", "checks")}
    adapters.levels(spark, SF).write.parquet(where["levels"])
    adapters.frame_probes(spark, SF).write.parquet(where["probes"])
    run = lambda *a: cli.main(list(a), spark)
    assert run("convert", "--levels", where["levels"], "--probes", where["probes"], "--output", "out", "--out", where["plan"], "--seed", "s") == 0
    assert spark.read.parquet(where["plan"]).select("sop_uid").distinct().count() == spark.read.parquet(where["plan"]).count() > 0
    assert run("profile", "--probes", where["probes"], "--out", where["profile"], "--max-frames", "5") == 0
    assert {r["total_frames"] for r in spark.read.parquet(where["profile"]).collect()} == {5}
    assert run("coverage", "--probes", where["probes"], "--out", where["coverage"]) == 0 and run("coverage", "--probes", where["probes"], "--out", where["coverage"], "--max-frames", "1") == 1
    assert run("coverage-corpus", "--probes", where["probes"], "--out", where["corpus"]) == 0
    assert spark.read.parquet(where["corpus"] + "/coverage").where("grain = 3").count() == 1 and spark.read.parquet(where["corpus"] + "/sources").count() > 1
    capsys.readouterr()
    assert run("self-test") == 0 and "passed=3 failed=0" in capsys.readouterr().out
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.dcm").write_bytes(b"no")
    assert run("validate", "--folder", str(tmp_path / "bad"), "--out", where["checks"]) == 1 and spark.read.json(where["checks"]).count() == 3
    assert run("doctor", "--tool", "sh -c true", "--tool", "no-such-tool") == 0 and "passed=1 failed=0 skipped=0 missing=1" in capsys.readouterr().out
    spark.createDataFrame([("s", "/x")], "slide string, path string").write.parquet(where["slides"])
    (tmp_path / "bench").mkdir()
    asked = ("bench", "--slides", where["slides"], "--tool", "cpu=echo {path}", "--profile", "p", "--scope", "full", "--out", where["bench"])
    assert run(*asked) == 0 and "| s | p | full | passed |" in (tmp_path / "bench" / "summary.md").read_text()
    assert run(*asked) == 0 and spark.read.json(where["bench"] + "/results").count() == 1  # nothing is left to run


def test_metric_lines_equal_plain_python(spark):
    from lodestrata.operators import routes
    from lodestrata.plans import catalogue

    sums = {}
    for r in routes.jpeg_route(adapters.frame_probes(spark, SF)).collect():
        n = sums.setdefault((r["source"], r["level"]), {"passthrough": 0, "retile": 0, "fallback": 0, "us": 0})
        n[r["route"]] += 1
        n["us"] += r["micros"] if r["route"] == "fallback" else 0
    for r in catalogue.queries()["metric_lines"](spark, SF).collect():
        n = sums.pop((r["source"], r["level"]))
        total = n["passthrough"] + n["retile"] + n["fallback"]
        found = dict(x.split("=") for x in r["line"].split(" "))
        assert list(found) == ["frames", *(x for k in ("passthrough", "retile", "fallback") for x in (k, f"{k}_pct")), "encode_ms"] and int(found["frames"]) == total
        for k in ("passthrough", "retile", "fallback"):
            assert int(found[k]) == n[k] and abs(float(found[f"{k}_pct"]) - 100 * n[k] / total) <= 0.0501
        assert abs(float(found["encode_ms"]) - n["us"] / 1000) <= 0.00051
    assert not sums
