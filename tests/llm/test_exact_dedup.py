import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import exact_dedup as X
from tests.llm.conftest import CLASHING, odd_rows


def _norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def _brute(rows):
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(_norm(r[1]), []).append((r[0] is None, r[0] or 0, i))
    return {t: (None if min(g)[0] else min(g)[1], len(g)) for t, g in groups.items()}


@pytest.mark.parametrize("counters", [2, 5, 1000])
def test_decisions_equal_brute_force(spark, odd, counters):
    rows = odd_rows()
    want = _brute(rows)
    got = X.decisions(odd, counters=counters).collect()
    assert len(got) == len(rows)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
    assert all((r["keep_id"], r["group_size"]) == by_hash[r["text_sha256"]] for r in got)
    assert sum(r["kept"] for r in got) == len(want)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


@pytest.mark.parametrize("counters", [2, 1000])
def test_drop_keeps_one_row_of_each_text_with_all_columns(odd, counters):
    got = X.drop_duplicates(odd, counters=counters)
    assert got.columns == odd.columns
    kept = got.collect()
    want = _brute(odd_rows())
    assert sorted((_norm(r["text"]), str(r["doc_id"])) for r in kept) == sorted((t, str(v[0])) for t, v in want.items())
    assert all(r[c] == v for r in kept for c, v in CLASHING.items())


def test_heavy_digests_are_those_over_the_share(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    slim = X._fingerprints(docs, "doc_id", "text")
    heavy = X.heavy_digests(slim, 10).collect()
    assert [(r["first"]["id"], r["size"]) for r in heavy] == [(0, 334)]
    assert X.decisions(docs, counters=10).where("kept").count() == 1 + 666


def test_rows_of_one_id_with_equal_texts(spark):
    rows = [(1, "a  b"), (1, "a b"), (1, "a b"), (1, "a b"), (2, "a\nb"), (None, "c"), (None, "c"), (None, "c d"), (3, "e"), (3, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = X.drop_duplicates(docs).collect()
    assert sorted((str(r["doc_id"]), _norm(r["text"])) for r in kept) == [("1", "a b"), ("3", "e"), ("3", "f"), ("None", "c"), ("None", "c d")]
    assert X.decisions(docs).where("kept").count() == 5


def test_many_groups_below_the_share(spark):
    """Groups that the summary does not name meet in the shuffle; no group is lost."""
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('t', case when id < 1500 then id % 500 else id end) as text")
    got = X.decisions(docs, counters=3)
    assert {(r["group_size"], r["n"]) for r in got.groupBy("group_size").agg(F.count("*").alias("n")).collect()} == {(3, 1500), (1, 1500)}
    assert got.where("kept").count() == X.drop_duplicates(docs, counters=3).count() == 2000


def test_more_partitions_than_rows(spark, odd):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "97")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert X.decisions(odd.repartition(31)).where("kept").count() == len(_brute(odd_rows())) == X.drop_duplicates(odd).count()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_empty_table(empty):
    assert X.decisions(empty).count() == 0 and X.drop_duplicates(empty).count() == 0


def test_main_path_has_no_python(odd):
    plan = X.decisions(odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
