"""Cases of a review: each failed before it was mended."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import scalars as S
from lodestrata.operators import clinical as C
from lodestrata.operators import offsets
from lodestrata.plans import adapters as A
from lodestrata.plans import catalogue
from lodestrata.sources import attributes


def against_sql(spark, name, folder, tmp_path):
    """(rows that only SQL has, rows that only the query has)."""
    out = str(tmp_path / f"{name}-got")
    catalogue.queries()[name](spark, folder).write.parquet(out)
    con = duckdb.connect()
    sql = catalogue.oracle_sql()[name]
    for table in ("part", "lineitem", "orders", "supplier", "embeddings"):
        if (tmp_path / f"{table}.parquet").exists():
            con.sql(f"create view {table} as from '{folder}/{table}.parquet/*.parquet'")
    con.sql(f"create table want as {sql}")
    con.sql(f"create table got as from '{out}/*.parquet'")
    columns = ", ".join(f'"{r[0]}"' for r in con.sql("describe want").fetchall())
    return [con.sql(f"select {columns} from {a} except all select {columns} from {b}").fetchall() for a, b in (("want", "got"), ("got", "want"))]


def test_tile_padding_rounds_floats(spark, tmp_path):
    half = float.fromhex("0x1.472b020000000p-2")  # times 1000 it is 319.5 in floats, less in doubles
    spark.createDataFrame([(1, [half, -half] + [0.25] * 62, 0)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert against_sql(spark, "tile_padding", str(tmp_path), tmp_path) == [[], []]
    assert catalogue.queries()["tile_padding"](spark, str(tmp_path)).first()["padded"].startswith("320,-320,250")


def test_paths_of_parts_that_are_there_twice(spark, tmp_path):
    rows = [(1, 7), (1, 7), (1, 5), (2, 3), (3, 6), (3, 3), (4, 1)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").repartition(2).write.parquet(str(tmp_path / "part.parquet"))
    for name in ("output_paths", "probe_coordinates", "compose_requests"):
        assert against_sql(spark, name, str(tmp_path), tmp_path) == [[], []]


def test_levels_are_dealt_by_source(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(A, "PARTS_A_TASK", 100)
    spark.range(1000).selectExpr("id p_partkey", "int(id % 50) p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    for name in ("compose_requests", "probe_coordinates", "output_paths"):
        found = catalogue.queries()[name](spark, str(tmp_path))
        each = [r[0] for r in found.groupBy(F.spark_partition_id().alias("p")).count().select("count").collect()]
        assert len(each) == 10 and max(each) < 3 * sum(each) / 10


def test_uid_of_digests(spark):
    texts = [None, "", *map(str, range(3000))]
    want = [None if t is None else f"2.25.{int(hashlib.sha256(t.encode()).hexdigest()[:32], 16)}" for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", S.uid(F.col("t")).alias("u")).orderBy("i").collect()
    assert [r["u"] for r in rows] == want
    small = ["0" * 32, "0" * 31 + "1", "0" * 24 + "3b9aca00", "0" * 16 + "f" * 16, "f" * 32, "8" + "0" * 31]  # digests that no text at hand has
    rows = spark.createDataFrame(list(enumerate(small)), "i int, d string").select("i", S.uid_of_digest(F.col("d")).alias("u")).orderBy("i").collect()
    assert [r["u"] for r in rows] == [f"2.25.{int(d, 16)}" for d in small]


def test_sets_of_an_array_are_encoded_as_sets(spark):
    import pyarrow as pa

    rows = [
        {"PatientName": "A", "FocusMethod": None, "Rows": 7, "ImagedVolumeWidth": 0.0, "ImageType": ["X", "Y"], "SharedFunctionalGroupsSequence": [{"PixelMeasuresSequence": [{"PixelSpacing": ["1", "2"]}]}, {"PixelMeasuresSequence": []}]},
        {"PatientName": "A", "FocusMethod": "AUTO", "Rows": None, "ImagedVolumeWidth": -0.0, "ImageType": [], "SharedFunctionalGroupsSequence": None},
        {"PatientName": "\u00e9", "FocusMethod": None, "Rows": 7, "ImagedVolumeWidth": None, "ImageType": None, "SharedFunctionalGroupsSequence": []},
    ]
    sets = pa.array(rows * 3)
    want = [attributes.encode(attributes.plain(r)) for r in rows * 3]
    assert attributes.encoded_sets(sets) == want and attributes.encoded_sets(sets.slice(1, 4)) == want[1:5]
    for raw in want:
        whole = attributes.decode(raw)
        for only in (frozenset({"Rows", "SharedFunctionalGroupsSequence"}), frozenset(), frozenset(whole)):
            assert attributes.decode(raw, only=only) == {k: v for k, v in whole.items() if k in only}
    with pytest.raises(ValueError):
        attributes.decode(want[0][:-1], only=frozenset({"Rows"}))


def test_metadata_meets_in_one_exchange_and_counts_names_of_other_types(spark):
    report = '{"subject":{"reference":"Patient/p"},"specimen":[{"reference":"Specimen/k"}],"basedOn":[{"reference":"ServiceRequest/s"}],"code":{"text":"t"}}'
    patient = '{"name":[{"family":"F","given":["A"]}]}'
    four = lambda b, p="p": [(b, "DiagnosticReport", "r", report), (b, "Patient", p, patient), (b, "Specimen", "k", "{}"), (b, "ServiceRequest", "s", "{}")]
    rows = [
        *four(1), *four(2), (2, "DiagnosticReport", "r2", report), *four(3), (3, None, "Patient/p", "{}"), *four(4, "q"), (4, None, "Patient/p", "{}"),
        *four(5)[:2], *four(6), (6, "Organization", "o", "{}"), (6, None, "Patient/x", "{}"), *four(7, "q"), *four(8), (8, "Specimen", "l", "{}"), *four(None), (9, "DiagnosticReport", "r", None), *four(9)[1:], *four(10)[:1], (10, "Patient", "p", "{}"), *four(10)[2:],
    ]
    found = C.metadata(spark.createDataFrame(rows, "bundle long, type string, id string, body string"))
    assert sorted(tuple(r) for r in found.collect()) == [(b, p, "F^A", None, None, "k", "k", None, "s", "r", "t") for b, p in ((1, "p"), (4, "q"), (6, "p"))]
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_fragments_and_starts_meet_in_one_exchange(spark):
    fragments = [(i, n, bytes([n] * size)) for i, sizes in (("a", [2, 3, 1, 2]), ("b", [1, 1]), ("c", [4, 2]), (None, [1])) for n, size in enumerate(sizes)]
    starts = [("a", 0, 0, None), ("a", 1, 22, 2), ("a", 1, 22, 2), ("c", 0, 12, None), ("c", 1, None, 1), ("d", 0, 0, None), (None, 0, 0, 1)]
    found = offsets.assemble_frames(
        spark.createDataFrame(fragments, "instance string, fragment long, data binary"), spark.createDataFrame(starts, "instance string, frame long, offset long, length long")
    )
    got = {(r["instance"], r["frame"], r["raw"] and r["raw"].hex(), r["error"]) for r in found.collect()}
    ascend, none = "offsets do not ascend from zero", "offset is no fragment's"
    assert got == {
        ("a", 0, "0000010101", None), ("a", 1, None, ascend), ("a", 1, "0203", None), ("b", 0, "00", None), ("b", 1, "01", None), ("c", 0, None, ascend), ("c", 1, None, none),
        ("d", 0, None, none), (None, 0, "00", None), (None, 0, None, none),
    }
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan
