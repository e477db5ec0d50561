"""Queries do the whole job: every row, level and text, held against plain Python."""

import os

from pyspark.sql import functions as F

from lodestrata.functions import scalars as S
from lodestrata.operators import geometry as G
from lodestrata.plans import adapters as A
from lodestrata.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _slug(value):
    text = "".join(c.lower() if c.isalnum() or c in "._-" else "-" for c in value).strip("-")
    while "--" in text:
        text = text.replace("--", "-")
    return text or "slide"


def test_slug_has_every_document_and_its_whole_text(spark):
    want = sorted((r["doc_id"], _slug(r["text"])) for r in A.table(spark, SF, "documents").collect())
    assert sorted((r["doc_id"], r["slug"]) for r in catalogue.queries()["slug"](spark, SF).collect()) == want
    assert max(len(s) for _, s in want) > 60


def test_slug_keeps_letters_and_digits_of_all_scripts(spark):
    texts = ["\u00c4pfel & \u00c9t\u00e9", "\u4e2d\u6587 \u0661\u0662", "\u00b2\u2167\u2460", "\u039f\u0394\u039f\u03a3 x", "\u0130stanbul", "e\u0301", "\U0001d400\U0001f600b", "-- ", "", "a--_.-", "\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", S.slug(F.col("t")).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in rows] == [_slug(t) for t in texts]


def _levels(spark):
    return A.levels(spark, SF).select("source", "level", "cols", "rows", "tile_w", "tile_h").collect()


def test_frame_positions_are_those_of_all_levels(spark):
    want = sorted((v["source"], v["level"], c + 1, r + 1, c * 512 + 1, r * 512 + 1, round(c * 512 * 0.0005, 6), round(r * 512 * 0.0005, 6)) for v in _levels(spark) for r in range(-(-v["rows"] // 512)) for c in range(-(-v["cols"] // 512)))
    found = catalogue.queries()["frame_positions"](spark, SF)
    assert found.columns == ["source", "level", "dimension_col", "dimension_row", "matrix_col", "matrix_row", "offset_x", "offset_y"]
    assert sorted(map(tuple, found.collect())) == want and {r[1] for r in want} == {0, 1, 2}


def test_compose_requests_cover_every_frame_of_all_levels(spark):
    want = []
    for v in _levels(spark):
        across, tw, th = -(-v["cols"] // 512), v["tile_w"], v["tile_h"]
        for r in range(-(-v["rows"] // 512)):
            for c in range(across):
                x, y, x2, y2 = c * 512, r * 512, min(c * 512 + 512, v["cols"]), min(r * 512 + 512, v["rows"])
                for tr in range(y // th, -(-y2 // th)):
                    for tc in range(x // tw, -(-x2 // tw)):
                        left, top, right, low = max(x, tc * tw), max(y, tr * th), min(x2, (tc + 1) * tw), min(y2, (tr + 1) * th)
                        want.append((v["source"], v["level"], r * across + c, tc, tr, left - tc * tw, top - tr * th, left - x, top - y, right - left, low - top))
    assert sorted(map(tuple, catalogue.queries()["compose_requests"](spark, SF).collect())) == sorted(want)


def test_source_windows_are_those_of_all_levels(spark):
    want = sorted((v["source"], v["level"], c, r) for v in _levels(spark) for r in range(50 // v["tile_h"], 349 // v["tile_h"] + 1) for c in range(100 // v["tile_w"], 799 // v["tile_w"] + 1))
    assert sorted(map(tuple, catalogue.queries()["source_windows"](spark, SF).collect())) == want and {r[1] for r in want} == {0, 1, 2}


def test_common_syntax_reads_the_first_frame_of_all_instances(spark):
    firsts = [r for r in A.frame_probes(spark, SF).collect() if r["frame"] == 0]
    want = {s: sorted({r["compression"] for r in firsts if r["source"] == s}) for s in {r["source"] for r in firsts}}
    got = catalogue.queries()["common_syntax"](spark, SF).collect()
    assert {r["source"]: (r["all_values"], r["common"]) for r in got} == {s: (",".join(v), v[0] if len(v) == 1 else None) for s, v in want.items()}
    assert {r["level"] for r in firsts} == {0, 1, 2}


def test_common_syntax_sees_what_only_other_levels_have(spark, tmp_path):
    line = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    firsts = [(0, "A"), (50, "A"), (100, "N"), (1, "A"), (51, "A"), (102, "R")]  # sources 0, 0, 0, 1, 1, 2 on levels 0, 1, 2, 0, 1, 2
    rows = [(k, n, 1, 1, 1.0, 1.0, 0.0, 0.0, flag if n == 1 else "R", "O") for k, flag in firsts for n in (1, 2)]
    spark.createDataFrame(rows, line).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = catalogue.queries()["common_syntax"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == [(0, "jp2k,jpeg", None), (1, "jpeg", "jpeg"), (2, "none", "none")]


def test_available_frames_counts_all_levels(spark):
    want = {}
    for v in A.levels(spark, SF).collect():
        if n := v["n_z"] * v["n_c"] * v["n_t"]:
            want[v["source"], v["level"]] = (n, n * -(-v["cols"] // 512) * -(-v["rows"] // 512))
    got = catalogue.queries()["available_frames"](spark, SF).collect()
    assert {(r["source"], r["level"]): (r["jobs"], r["available_frames"]) for r in got} == want and len(got) == len(want)


def test_jobs_of_the_first_levels_only(spark):
    rows = spark.createDataFrame([(1, 0, 0, v, 100, 100, 1, 2, 1) for v in range(3)], "source long, scene int, series int, level int, cols long, rows long, n_z long, n_c long, n_t long")
    of = lambda **limit: sorted((r["level"], r["c"], r["ordinal"]) for r in G.jobs(rows, **limit).collect())
    assert of() == [(v, c, 2 * v + c) for v in range(3) for c in range(2)]
    assert of(max_levels=2) == of()[:4] and of(max_levels=0) == []
