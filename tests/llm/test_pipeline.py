import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import SCHEMA, odd_rows, words
from tests.llm.test_decontaminate import _brute as leaks
from tests.llm.test_exact_dedup import _norm
from tests.llm.test_minmax_dedup import _brute as near


@pytest.fixture(scope="module")
def sf(spark, benchmark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    good = [(i, ". ".join(words(i, 40).split(" ")), "en", "s", 9) for i in range(100, 160)]
    junk = [(i, " ".join([words(i, 1)] * 60), "en", "s", 9) for i in range(200, 230)]
    spark.createDataFrame(odd_rows() + good + junk, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 200)) for r in good + junk], "doc_id long, quality int").withColumn("toxic", F.lit(0)).write.parquet(f"{d}/labels.parquet")
    benchmark.write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = [tuple(r) for r in docs.collect()], spark.read.parquet(str(tmp_path / str(k)))
        got = sorted(map(str, (tuple(r) for r in docs.collect()))) if k < 4 else None
        if k == 0:
            ids = {r["doc_id"] for r in docs.collect()}
            assert not ids & set(range(200, 230)) and set(range(100, 160)) <= ids
        elif k == 1:
            least = {}
            for r in before:
                key = (r[0] is None, r[0] or 0)
                least[_norm(r[1])] = min(least.get(_norm(r[1]), (True, 1 << 62)), key)
            assert len(got) == len(least)
            assert {(None if v[0] else v[1]) for v in least.values()} == {r["doc_id"] for r in docs.collect()}
        elif k == 2:
            want = [r for r, (n, c) in zip(before, near(before)) if r[0] == c]
            assert got == sorted(map(str, want))
        elif k == 3:
            hit = {}
            for r in before:
                hit[str(r)] = leaks([r], items)[0][2]
            assert got == sorted(r for r, n in hit.items() if n == 0) and any(hit.values())
    assert docs.count() >= len(got or [])
    pieces = lambda df: sorted(map(str, df.select("doc_id", "piece", "piece_start", "n_tokens").collect()))
    assert pieces(corpus_pipeline.run(spark, sf)) == pieces(docs)


def test_empty_documents(spark, sf, tmp_path):
    import shutil

    d = str(tmp_path / "sf")
    shutil.copytree(sf, d)
    shutil.rmtree(f"{d}/documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
