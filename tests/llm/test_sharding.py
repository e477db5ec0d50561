import zlib
from collections import Counter

import numpy as np

from lodestrata.llm import sharding as H
from tests.llm.conftest import odd_rows


def test_matrix_has_exact_margins():
    counts, sizes = [5, 0, 17, 100, 3], H.shard_sizes(125, 16)
    m = H.communication_matrix(counts, sizes, 1)
    assert m.sum(1).tolist() == counts and m.sum(0).tolist() == sizes and (m >= 0).all()
    assert max(sizes) - min(sizes) <= 1


def test_draws_follow_the_hypergeometric_law():
    draws = np.array([H.communication_matrix([3, 3], [2, 4], s)[0, 0] for s in range(6000)])
    share = [np.mean(draws == k) for k in range(3)]
    assert np.allclose(share, [4 / 20, 12 / 20, 4 / 20], atol=0.03)


def test_large_draws_are_split():
    rng = np.random.default_rng(1)
    got = [H._draw(rng, 2_000_000_000, 2_000_000_000, 1000) for _ in range(200)]
    assert abs(np.mean(got) - 500) < 10 and abs(np.std(got) - 15.8) < 4


def test_every_row_has_one_slot(spark, odd):
    got = H.shard_rows(odd, shards=4).collect()
    assert Counter(str(r["row"]["doc_id"]) for r in got) == Counter(str(r[0]) for r in odd_rows())
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert got[0]["row"].asDict().keys() == {*odd.columns}


def test_positions_are_uniform_over_seeds(spark):
    slim = H.number_rows(spark.range(12).repartition(3))
    seen = Counter()
    for seed in range(40):
        seen.update((r["id"], r["shard"]) for r in H.assign(slim, shards=2, seed=seed, bucket_rows=2).collect())
    assert all(8 <= seen[i, 0] <= 32 for i in range(12))
    again = [sorted(map(tuple, H.assign(slim, shards=2, seed=5).collect())) for _ in range(2)]
    assert again[0] == again[1]


def test_fewer_rows_than_shards_and_none(spark, empty):
    assert Counter(r["shard"] for r in H.shard_rows(spark.range(3), shards=16).collect()) == {0: 1, 1: 1, 2: 1}
    assert H.shard_rows(empty).count() == 0


def test_written_shards_hold_all_rows(spark, odd, tmp_path):
    H.write_shards(odd, str(tmp_path / "s"), shards=3)
    assert spark.read.parquet(str(tmp_path / "s")).count() == odd.count()


def test_query_columns(spark, tmp_path):
    rows = odd_rows()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = H.op5_sharding(spark, str(tmp_path)).collect()
    want = Counter((str(r[0]), len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
