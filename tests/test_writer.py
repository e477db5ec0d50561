"""Instance files, attribute sets, and the journal of what is installed."""

import io
import json
import os
import random
import struct
import tracemalloc

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.operators.attributes import instance_attributes, number
from lodestrata.sources import attributes, dicom, instances, journal

JPEG = "1.2.840.10008.1.2.4.50"


@pytest.mark.parametrize("syntax", [JPEG, instances.NATIVE])
@pytest.mark.parametrize("frames", [[], [b"abc"], [b"", b"ab", b"c" * 1001, b"d" * 70_000]])
def test_streamed_file_is_the_one_made_at_once(tmp_path, syntax, frames):
    header = {"sop_instance_uid": "2.25.7", "patient_id": "odd", "rows": 3}
    want = dicom.instance_bytes(header, frames, syntax)
    meta = dicom.file_meta("1.2.840.10008.5.1.4.1.1.77.1.6", "2.25.7", syntax)
    body = dicom.instance_bytes(header, frames, syntax)[len(meta) :]
    body = body[: body.index(struct.pack("<H", 0x7FE0))]
    out = instances.InstanceFile(str(tmp_path / "f"), body, syntax, "1.2.840.10008.5.1.4.1.1.77.1.6", "2.25.7", len(frames))
    for f in frames:
        out.push(f)
    assert out.finish() == os.path.getsize(tmp_path / "f")
    assert (tmp_path / "f").read_bytes() == want


def test_a_large_file_needs_little_memory(tmp_path):
    frame, n = random.Random(1).randbytes(1 << 20), 60
    tracemalloc.start()
    out = instances.InstanceFile(str(tmp_path / "f"), b"", JPEG, "1", "2", n)
    for _ in range(n):
        out.push(frame)
    out.finish()
    assert tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()
    offsets, lengths = instances.offsets_of(str(tmp_path / "f"))
    assert offsets == [i * (8 + (1 << 20)) for i in range(n)] and lengths == [1 << 20] * n
    os.remove(tmp_path / "f")


def test_frames_that_are_missing_or_too_large(tmp_path):
    out = instances.InstanceFile(str(tmp_path / "f"), b"", JPEG, "1", "2", 2)
    out.push(b"x")
    with pytest.raises(ValueError, match="1 frames instead of 2"):
        out.finish()
    with pytest.raises(ValueError, match="too many"):
        instances.InstanceFile(str(tmp_path / "g"), b"", JPEG, "1", "2", 1 << 29)


@pytest.fixture()
def tables(spark):
    r = random.Random(2)
    frames = [(i, n, r.randbytes(r.randint(0, 900))) for i in (1, 2, 3) for n in range(40 * i)]
    shuffled = r.sample(frames, len(frames))
    known = spark.createDataFrame([(i, f"i{i}.dcm", JPEG, f"2.25.{i}") for i in (1, 2, 3, 4)], "instance long, name string, transfer_syntax string, uid string")
    sets = F.struct(F.col("uid").alias("SOPInstanceUID"), F.lit("0").alias("NumberOfFrames"), F.array(F.struct(F.lit("a").alias("CodeValue"))).alias("ContainerTypeCodeSequence"))
    return known.select("instance", "name", "transfer_syntax", sets.alias("attributes")), spark.createDataFrame(shuffled, "instance long, frame long, bytes binary").repartition(3), frames


def test_write_and_read_back(spark, tables, tmp_path):
    known, frames, rows = tables
    folder = str(tmp_path / "out")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    files = instances.write_instances(known, frames, f"file://{folder}")
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
    for r in files.collect():
        own = [b for i, _, b in rows if str(i) == r["instance"]]
        raw = open(r["path"], "rb").read()
        assert len(raw) == r["file_bytes"] and r["frames"] == len(own) and r["bytes"] == sum(map(len, own))
        assert raw.endswith(dicom.encapsulated([bytes(b) for b in own]))
        found = attributes.decode(raw[132:])
        assert found["NumberOfFrames"] == str(len(own)) and found["SOPInstanceUID"] == f"2.25.{r['instance']}" and found["ContainerTypeCodeSequence"] == [{"CodeValue": "a"}]
    stored = {(r["instance"], r["frame"]): (r["offset"], r["length"]) for r in instances.stored_offsets(files).collect()}
    at = {}
    for i, n, b in rows:
        assert stored[str(i), n] == (at.get(i, 0), len(b))
        at[i] = at.get(i, 0) + 8 + len(b) + len(b) % 2
    assert len(stored) == len(rows)
    spark.dataSource.register(dicom.DicomHeaders)
    heads = {r["sop_instance_uid"]: r["number_of_frames"] for r in spark.read.format("dicom_headers").load(folder).collect()}
    assert heads == {"2.25.1": 40, "2.25.2": 80, "2.25.3": 120, "2.25.4": 0}
    with pytest.raises(FileExistsError):
        instances.write_instances(known, frames, folder)
    assert len(os.listdir(folder)) == 6  # four files, the lock and the lists of what was written
    instances.write_instances(known.where("instance = 1"), frames.where("instance = 1").withColumn("bytes", F.lit(b"new")), folder, overwrite=True)
    assert open(f"{folder}/i1.dcm", "rb").read().count(b"new") == 40


def test_a_write_that_fails_leaves_nothing(spark, tables, tmp_path):
    known, frames, _ = tables
    with pytest.raises(Exception, match="without its instance"):
        instances.write_instances(known.where("instance <> 2"), frames, str(tmp_path))
    assert [n for n in os.listdir(tmp_path) if not n.startswith((journal.LOCK, ".written"))] == []


def test_a_second_writer_is_refused(spark, tables, tmp_path):
    known, frames, _ = tables
    with journal.FolderLock(str(tmp_path)), pytest.raises(BlockingIOError, match="another writer"):
        instances.write_instances(known, frames, str(tmp_path))
    os.remove(tmp_path / journal.LOCK)
    os.symlink("/dev/null", tmp_path / journal.LOCK)
    with pytest.raises(OSError):
        journal.FolderLock(str(tmp_path))


OLD = {"a": b"old a", "b": b"old b"}
NEW = {"a": b"new a", "b": b"new b", "c": b"new c"}


def _staged(root):
    t = journal.Transaction(root, os.path.join(root, journal.STAGING + "test"))
    for n, raw in NEW.items():
        with open(os.path.join(t.stage, n + ".part"), "wb") as f:
            f.write(raw)
    return t


def _files(root):
    return {n: open(os.path.join(root, n), "rb").read() for n in os.listdir(root) if not n.startswith(".")}


def _in_child(work, stop_at):
    """Runs `work` in a process that dies before its step `stop_at` on the disk; returns whether it came to its end."""
    pid = os.fork()
    if pid:
        return os.waitpid(pid, 0)[1] == 0
    step = [0]

    def counted(f):
        def run(*a, **k):
            step[0] += 1
            if step[0] == stop_at:
                os._exit(9)
            return f(*a, **k)

        return run

    os.replace, os.remove, os.fsync, os.makedirs, os.rmdir, os.unlink = map(counted, (os.replace, os.remove, os.fsync, os.makedirs, os.rmdir, os.unlink))
    try:
        work()
        os._exit(0)
    except BaseException:
        os._exit(1)


def test_killed_at_any_step_all_files_are_old_or_all_new(tmp_path):
    seen, stop, done = set(), 0, False
    while not done:
        stop += 1
        root = str(tmp_path / str(stop))
        os.mkdir(root)
        for n, raw in OLD.items():
            with open(os.path.join(root, n), "wb") as f:
                f.write(raw)
        t = _staged(root)
        done = _in_child(lambda: t.commit([(n, n + ".part") for n in NEW], overwrite=True), stop)
        for again in range(1, 40):  # the one that recovers may be killed too
            if _in_child(lambda: journal.recover(root), again):
                break
        with journal.FolderLock(root):
            journal.recover(root)
            journal.clear(root, 0)
        found = _files(root)
        assert found in (OLD, NEW), (stop, found)
        assert not [n for n in os.listdir(root) if n.startswith(journal.STAGING)]
        seen.add(found == NEW)
    assert stop > 10 and seen == {True, False}


def test_an_error_in_the_commit_takes_all_back(tmp_path, monkeypatch):
    root = str(tmp_path)
    for n, raw in OLD.items():
        (tmp_path / n).write_bytes(raw)
    t, real, calls = _staged(root), os.replace, []

    def replace(a, b):
        calls.append(b)
        if len(calls) == 4:
            raise OSError("disk full")
        return real(a, b)

    monkeypatch.setattr(os, "replace", replace)
    with pytest.raises(OSError, match="disk full"):
        t.commit([(n, n + ".part") for n in NEW], overwrite=True)
    assert _files(root) == OLD and not os.path.exists(t.stage)


def test_journals_that_cannot_be_trusted(tmp_path):
    root = str(tmp_path)
    t = _staged(root)
    with pytest.raises(ValueError):
        t.commit([("../x", "a.part")])
    with pytest.raises(ValueError):
        t.commit([("a", "a.part"), ("a", "b.part")])
    with open(os.path.join(t.stage, journal.JOURNAL), "w") as f:
        f.write(json.dumps({"name": "../../etc", "staged": "a.part", "replaces": False}) + "\n" + json.dumps({"phase": "prepared"}) + "\n")
    with pytest.raises(ValueError):
        journal.recover(root)
    with open(os.path.join(t.stage, journal.JOURNAL), "w") as f:
        f.write(json.dumps({"name": "a", "staged": "a.part", "replaces": False}) + '\n{"pha')
    assert journal.recover(root) == [(journal.STAGING + "test", "cleared")]


def test_a_live_writers_staging_folder_is_left_alone(tmp_path):
    t = _staged(str(tmp_path))
    with journal.FolderLock(str(tmp_path)):
        assert journal.recover(str(tmp_path)) == [] and journal.clear(str(tmp_path), 3600) == []
    assert os.path.exists(os.path.join(t.stage, "a.part"))


NESTED = {
    "PatientName": "A^B", "Rows": 7, "TotalPixelMatrixRows": 70_000, "IlluminationWaveLength": 550.0, "ImageType": ["ORIGINAL", "PRIMARY"], "ICCProfile": b"\1\2\3\4", "StudyID": "",
    "DimensionIndexPointer": "ColumnPositionInTotalImagePixelMatrix", "ColumnPositionInTotalImagePixelMatrix": -5, "AcquisitionContextSequence": [], "SpecimenDetailedDescription": "x" * 70_000 + "\\y",
    "OpticalPathSequence": [{"OpticalPathIdentifier": "0", "IlluminationTypeCodeSequence": [{"CodeValue": "1"}, {"CodeValue": "22", "CodeMeaning": "é"}]}, {}],
}


def test_nested_sets_come_back():
    raw = attributes.encode(NESTED)
    assert attributes.decode(raw) == NESTED
    tags = [k for k in attributes.decode(raw)]
    assert tags == sorted(tags, key=lambda k: attributes.DICTIONARY[k][0])
    with pytest.raises(ValueError, match="NoSuch"):
        attributes.encode({"NoSuch": 1})
    with pytest.raises(ValueError, match="too many"):
        attributes.encode({"PatientName": "x" * 70_000})
    for cut in range(len(raw) - 1, 0, -997):
        try:
            attributes.decode(raw[:cut])
        except (ValueError, struct.error, UnicodeDecodeError):
            pass


def test_sequences_of_undefined_length_and_implicit_sets():
    tag = attributes.tag_bytes
    code = attributes.encode({"CodeValue": "ab"})
    item = tag(0xFFFEE000) + b"\xff\xff\xff\xff" + code + tag(0xFFFEE00D) + b"\0\0\0\0"
    raw = tag(0x00480105) + b"SQ\0\0\xff\xff\xff\xff" + item + item + tag(0xFFFEE0DD) + b"\0\0\0\0" + attributes.encode({"NumberOfOpticalPaths": 2})
    assert attributes.decode(raw) == {"OpticalPathSequence": [{"CodeValue": "ab"}] * 2, "NumberOfOpticalPaths": 2}
    implicit = tag(0x00080100) + struct.pack("<I", 2) + b"ab" + tag(0x00480105) + b"\xff\xff\xff\xff" + tag(0xFFFEE000) + struct.pack("<I", 10) + tag(0x00080104) + struct.pack("<I", 2) + b"cd" + tag(0xFFFEE0DD) + b"\0\0\0\0" + tag(0x00999999) + struct.pack("<I", 2) + b"zz"
    assert attributes.decode(implicit, implicit=True) == {"CodeValue": "ab", "OpticalPathSequence": [{"CodeMeaning": "cd"}], "00999999": b"zz"}
    # the header reader goes over them
    whole = dicom.file_meta("1", "2.25.1", JPEG) + raw + dicom.encapsulated([b"x"])
    assert dicom.read_header(io.BytesIO(whole))["transfer_syntax"] == JPEG


def test_all_parts_of_an_instance_come_back(spark):
    row = spark.range(1).selectExpr("1 as level", "12L as frames", "512 as tile", "2000L as cols", "1500L as rows", "3 as components", "8 as bits", "'RGB' as photometric", "0.0005D as row_mm", "0.00025D as column_mm",
                                    "3 as series_number", "4 as instance_number", "'1.1' as sop_uid", "'1.2' as series_uid", "'1.3' as study_uid", "'1.4' as pyramid_uid", "'1.5' as frame_of_reference_uid", "'1.6' as dimension_uid")
    sets = row.select(instance_attributes({"PatientName": "X^Y", "SpecimenIdentifier": "S", "Laterality": ""}, profile=F.lit(b"icc!")).alias("a"))
    raw = attributes.encoded(sets, "a", "raw").first()["raw"]
    found = attributes.decode(bytes(raw))
    given = attributes.plain(sets.first()["a"].asDict(recursive=True))
    text = lambda v: [text(x) for x in v] if isinstance(v, list) else {k: text(x) for k, x in v.items()} if isinstance(v, dict) else bytes(v) if isinstance(v, bytearray) else v
    near = lambda v: pytest.approx(v, rel=1e-6) if isinstance(v, float) else v
    assert found.keys() == given.keys() and all(found[k] == near(text(given[k])) for k in given)
    assert found["SpecimenDescriptionSequence"][0]["SpecimenPreparationSequence"] == [] and found["OpticalPathSequence"][0]["ICCProfile"] == b"icc!"
    assert found["SharedFunctionalGroupsSequence"][0]["PixelMeasuresSequence"][0] == {"PixelSpacing": ["0.0005", "0.00025"], "SliceThickness": "0.001"}
    assert [x["DimensionIndexPointer"] for x in found["DimensionIndexSequence"]] == ["ColumnPositionInTotalImagePixelMatrix", "RowPositionInTotalImagePixelMatrix"]
    assert found["ImageType"] == ["DERIVED", "PRIMARY", "VOLUME", "RESAMPLED"] and found["HighBit"] == 7 and "Laterality" not in found
    kind = T.StructType.fromDDL("PatientName string, Rows int, ContainerTypeCodeSequence array<struct<CodeValue: string>>, StudyDescription string, ICCProfile binary")
    again = attributes.decoded(attributes.encoded(sets, "a", "raw"), "raw", "b", kind).first()["b"]
    assert (again["PatientName"], again["Rows"], again["ContainerTypeCodeSequence"][0]["CodeValue"], again["ICCProfile"]) == ("X^Y", 512, "433466003", None)


def test_decimal_strings(spark):
    values = [0.0, 1.0, 0.5, 0.00025, 1234567.25, 1e-12, -0.25, 100.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(number(F.col("v"))).collect()]
    assert got == ["0", "1", "0.5", "0.00025", "1234567.25", "0", "-0.25", "100"]


LEVELS = "source string, scene int, series int, level int, cols long, rows long, kind string, tile_w int, tile_h int, n_z int, n_c int, n_t int"
WHERE = "source string, scene int, series int, level int, z int, c int, t int, frame long"


@pytest.fixture()
def slides(spark, tmp_path):
    levels = spark.createDataFrame([("/a/x.svs", 0, 0, 0, 1000, 600, "regular", 512, 512, 1, 1, 1), ("/a/x.svs", 0, 0, 1, 500, 300, "regular", 512, 512, 1, 1, 1), ("/b/x.svs", 0, 0, 0, 100, 100, "regular", 512, 512, 2, 1, 1)], LEVELS)
    frames = [("/a/x.svs", 0, 0, 0, 0, 0, 0, f) for f in range(4)] + [("/a/x.svs", 0, 0, 1, 0, 0, 0, 0), ("/b/x.svs", 0, 0, 0, 0, 0, 0, 0), ("/b/x.svs", 0, 0, 0, 1, 0, 0, 0)]
    rows = spark.createDataFrame(frames, WHERE).withColumn("bytes", F.encode(F.concat_ws("-", "source", "level", "z", "frame"), "UTF-8"))
    levels.write.parquet(str(tmp_path / "levels")), rows.write.parquet(str(tmp_path / "frames"))
    return levels, rows


def test_an_export_writes_its_files(spark, slides, tmp_path):
    from lodestrata.plans.export import Export

    levels, frames = slides
    job = Export(levels).to_directory(str(tmp_path / "out")).transfer_syntax("JpegBaseline8Bit").with_metadata({"patient_id": "P1", "PatientName": "A^B"})
    files = job.run(frames, seed="s").collect()
    assert len(files) == 4 and sum(r["frames"] for r in files) == 7
    uids = {r["sop_uid"]: r["frames"] for r in job.plan("s").collect()}
    for r in files:
        found = attributes.decode(open(r["path"], "rb").read()[132:])
        assert found["PatientID"] == "P1" and found["PatientName"] == "A^B" and uids[found["SOPInstanceUID"]] == int(found["NumberOfFrames"])
        raw = open(r["path"], "rb").read()
        assert raw.endswith(dicom.encapsulated([f"{s}-{lv}-{z}-{f}".encode() for s, _, _, lv, z, _, _, f, _ in sorted(map(tuple, frames.collect())) if "|".join(map(str, (s, 0, 0, lv, z, 0, 0))) == r["instance"]]))
    with pytest.raises(FileExistsError):
        job.run(frames, seed="s")
    before = sorted(os.listdir(tmp_path / "out"))
    for wrong in (frames.where("frame <> 1"), frames.union(frames.limit(1)), frames.withColumn("level", F.lit(7))):
        with pytest.raises(ValueError, match="not those of the plan"):
            job.run(wrong, seed="s")
    assert sorted(os.listdir(tmp_path / "out")) == before


def test_a_codec_makes_the_frames(slides, tmp_path):
    from lodestrata.plans.export import Export

    levels, frames = slides
    job = Export(levels).to_directory(str(tmp_path / "out")).transfer_syntax("JpegBaseline8Bit").with_placeholder_metadata()
    pixels = frames.withColumnRenamed("bytes", "pixels")
    files = job.run(pixels, codec=lambda raw, s: s["head"] + bytes(raw), settings={"head": b"!!"}).collect()
    assert sum(r["bytes"] for r in files) == sum(len(r["bytes"]) + 2 for r in frames.collect())

    def fails(raw, _):
        raise ValueError("no codec for this")

    with pytest.raises(Exception, match="no codec for this"):
        Export(levels).to_directory(str(tmp_path / "other")).transfer_syntax("JpegBaseline8Bit").with_placeholder_metadata().run(pixels, codec=fails)
    assert [n for n in os.listdir(tmp_path / "other") if not n.startswith(".")] == []


def test_convert_writes_files(spark, slides, tmp_path):
    from lodestrata import cli

    run = lambda *more: cli.main(["convert", "--levels", str(tmp_path / "levels"), "--output", str(tmp_path / "out"), "--out", str(tmp_path / "report"), "--syntax", "JpegBaseline8Bit", "--frames", str(tmp_path / "frames"), *more], spark)
    assert run() == 0 and spark.read.parquet(str(tmp_path / "report")).agg(F.sum("frames")).first()[0] == 7
    with pytest.raises(FileExistsError):
        run()
    assert run("--overwrite") == 0 and len([n for n in os.listdir(tmp_path / "out") if n.endswith(".dcm")]) == 4


def test_sustained_conversion(spark, slides, tmp_path):
    from lodestrata import cli

    run = lambda n, *more: cli.main(["sustain", "--levels", str(tmp_path / "levels"), "--output", str(tmp_path / "many"), "--out", f"file://{tmp_path}/runs{n}", "--syntax", "JpegBaseline8Bit", "--frames", str(tmp_path / "frames"), "--iterations", "2", *more], spark)
    assert run(1) == 0 and sorted(n for n in os.listdir(tmp_path / "many")) == ["iteration-0001", "iteration-0002"]
    assert len([n for n in os.listdir(tmp_path / "many" / "iteration-0002") if n.endswith(".dcm")]) == 4
    assert run(2) == 1  # the files are there already: the first iteration fails, and no other is begun
    assert run(3, "--overwrite") == 0
    assert cli.main(["validate", "--folder", str(tmp_path / "many" / "iteration-0001")], spark) == 0
