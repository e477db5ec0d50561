"""Pixel checks by a table function, all families of checks, sustained runs."""

import json
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lodestrata.operators import decoding, validation
from lodestrata.sources import dicom
from lodestrata.streaming import iterations

JPEG, HTJ2K, RPCL = "1.2.840.10008.1.2.4.50", "1.2.840.10008.1.2.4.201", "1.2.840.10008.1.2.4.202"

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # for Spark's Python workers


class Fake(validation.Runner):
    """A decoder whose frames say what comes out: width, height and samples; other commands look at names."""

    def find(self, name):
        return None if name.endswith("absent") else name

    def run(self, command, timeout):
        if command[0] != "/x/decode":
            return (1, "bad name") if any("wrong" in c for c in command[1:]) else (0, "")
        raw = open(command[1], "rb").read().decode()
        if raw.startswith("crash"):
            return 3, "cannot decode"
        if raw.startswith("none"):
            return 0, ""
        w, h, samples = map(int, raw.split())
        with open(command[2], "wb") as f:
            f.write(b"P%d %d %d 255\n" % (6 if samples == 3 else 5, w, h) + bytes(w * h * samples))
        return 0, "ok"


@pytest.fixture(scope="module")
def headers(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")

    def write(name, frames, syntax=JPEG, **header):
        known = {"rows": 2, "columns": 4, "samples": 3, "bits_allocated": 8, "patient_id": "P", "patient_name": "A^B", "study_uid": "1.2", "total_columns": 0, "total_rows": 0} | header
        (folder / name).write_bytes(dicom.instance_bytes(known, frames, syntax))

    write("a.dcm", [b"4 2 3", b"4 2 3 ", b"4 3 3", b"4 2 1"])
    write("b.dcm", [b"crash", b"none"])
    write("c.dcm", [b"4 2 3"], "1.2.840.10008.1.2.1")
    write("d.dcm", [b"4 2 3"], HTJ2K)
    write("e.dcm", [b"4 2 3"], RPCL)
    write("f.dcm", [b"4 2 3"], rows=0)
    write("wrong.dcm", [b"4 2 3"], patient_id="x" * 65)
    (folder / "g.dcm").write_bytes(b"nothing")
    spark.dataSource.register(dicom.DicomHeaders)
    return spark.read.format("dicom_headers").load(str(folder))


COMMANDS = {JPEG: "/x/decode {input} {output}", HTJ2K: None, RPCL: "/x/absent {input} {output}"}


def _rows(df):
    return {(os.path.basename(r["path"]), r["check"]): (r["status"], r["message"]) for r in df.collect()}


def test_a_row_for_each_frame(headers):
    got = _rows(decoding.pixel_checks(headers, COMMANDS, max_frames=9, runner=Fake()))
    assert [got["a.dcm", f"pixel-decode-{i}"][0] for i in range(4)] == ["passed", "passed", "failed", "failed"]
    assert got["a.dcm", "pixel-decode-2"][1] == "decoded to 4 x 3 instead of 4 x 2" and "samples" in got["a.dcm", "pixel-decode-3"][1]
    assert got["b.dcm", "pixel-decode-0"] == ("failed", "cannot decode") and got["b.dcm", "pixel-decode-1"][0] == "failed"
    assert got["c.dcm", "pixel-decode"][0] == "skipped" and got["d.dcm", "pixel-decode"] == ("skipped", "no decoder is configured") and got["e.dcm", "pixel-decode-0"][0] == "skipped"
    assert got["f.dcm", "pixel-decode-0"] == ("failed", "rows and columns must be greater than zero")
    assert not [k for k in got if k[0] == "g.dcm"]


def test_limits_and_strictness(headers):
    got = _rows(decoding.pixel_checks(headers, COMMANDS, max_frames=1, max_bytes=5, strict=True, runner=Fake()))
    assert got["a.dcm", "pixel-decode-0"] == ("failed", "no output, or too much of it") and ("a.dcm", "pixel-decode-1") not in got
    assert got["d.dcm", "pixel-decode"][0] == "failed" and got["e.dcm", "pixel-decode-0"] == ("failed", "/x/absent is missing")
    assert "more than 3 bytes" in _rows(decoding.pixel_checks(headers, COMMANDS, max_bytes=3, runner=Fake()))["a.dcm", "pixel-decode-0"][1]


def test_all_families_in_one_table(headers):
    checks = decoding.all_checks(headers, file_commands={"lint": ["lint"], "other": ["absent"]}, set_commands={"set": ["sets"]}, decoders=COMMANDS, max_frames=2, runner=Fake())
    assert checks.columns == ["path", "check", "status", "message"]
    got = _rows(checks)
    assert got["wrong.dcm", "fields"] == ("failed", "not valid: patient_id") and got["a.dcm", "fields"] == ("passed", None)
    assert got["wrong.dcm", "lint"] == ("failed", "bad name") and got["a.dcm", "lint"][0] == "passed" and got["a.dcm", "other"][0] == "skipped"
    assert [v[0] for k, v in got.items() if k[1] == "set"] == ["failed"]
    assert got["a.dcm", "pixel-decode-1"][0] == "passed" and got["g.dcm", "readable"][0] == "failed" and got["a.dcm", "geometry"][0] == "passed"


def test_sustained_runs_stop_at_the_first_failure_and_go_on(spark, tmp_path):
    seen, broken = [], [True]

    def work(n):
        seen.append(n)
        if n == 3 and broken[0]:
            raise OSError("disk full")
        return {"frames": n * 10}

    with pytest.raises(iterations.Stopped, match="OSError: disk full"):
        iterations.sustained(spark, work, f"file://{tmp_path}/a", iterations=5, timeout=120)
    assert seen == [1, 2, 3]
    broken[0] = False
    rows = iterations.sustained(spark, work, f"file://{tmp_path}/b", iterations=2, timeout=120).collect()
    assert [(r["iteration"], json.loads(r["report"])["frames"], r["error"]) for r in rows] == [(1, 10, None), (2, 20, None)] and all(r["elapsed_micros"] >= 0 for r in rows)
    seen.clear()
    assert iterations.sustained(spark, work, f"file://{tmp_path}/b", iterations=4, timeout=120).agg(F.max("iteration")).first()[0] == 4
    assert seen == [3, 4]
    with pytest.raises(ValueError):
        iterations.sustained(spark, work, f"file://{tmp_path}/c", iterations=0)
