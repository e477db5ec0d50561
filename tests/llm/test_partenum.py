import itertools
import random

import numpy as np
import pytest

from lodestrata.llm import partenum as P
from tests.llm.conftest import odd_rows, words
from tests.llm.test_minmax_dedup import _edited, _set

SCHEMA = "doc_id long, text string"


def _brute(rows, num=80):
    sets, parent = [_set(r[1]) for r in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= num * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        key = (r[0] is None, r[0] or 0)
        least[root(i)] = min(least.get(root(i), key), key)
    return sorted((str(r[0]), len(sets[i]), None if (k := least[root(i)])[0] else k[1]) for i, r in enumerate(rows))


def _short(seed):
    """Short texts with a word more, less or other at an end, where sets of 4 to 20 shingles are near the threshold."""
    r, out = random.Random(seed), []
    for g in range(60):
        base = words(3000 + g, r.randint(5, 24)).split(" ")
        out += [" ".join(base), " ".join([*base, "more"]), " ".join(base[1:]), " ".join(["other", *base[1:]]), " ".join([*base, "one", "two"])]
    return list(enumerate(out))


@pytest.mark.parametrize("rows", [[r[:2] for r in odd_rows()], [r[:2] for r in _edited(5)], _short(1)], ids=["odd", "edited", "short"])
def test_query_equals_brute_force(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in P.op13_jaccard_join(spark, str(tmp_path)).collect())
    assert got == _brute(rows)


def test_other_thresholds_and_many_batches(spark, monkeypatch):
    monkeypatch.setattr(P, "COMBINED", 500)
    rows = [r[:2] for r in _edited(6, 60)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    for num in (60,):
        got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in P.jaccard_components(docs, num=num).collect())
        assert got == _brute(rows, num)


def _pairs(r, size, num):
    """Random linked sets as unlike as the threshold lets them be: some elements only in one, some only in the other."""
    a = r.integers(1 << 63, size=size, dtype=np.uint64)
    most = (100 - num) * 2 * size // (100 + num)
    for gone in sorted({0, most, most // 2, int(r.integers(0, most + 1))}):
        for new in (most - gone, most - gone + 1, 0):
            b = np.concatenate([a[gone:], r.integers(1 << 63, size=new, dtype=np.uint64)])
            if 100 * (size - gone) >= num * (size + new) and (gone or new):
                yield np.unique(a), np.unique(b)


@pytest.mark.parametrize("num", [60, 75, 80, 90])
def test_linked_sets_share_a_signature(num):
    r, seen = np.random.default_rng(num), 0
    for size in [*range(1, 60), *range(60, 400, 17), 1000, 5000]:
        for _ in range(4 if size < 60 else 1):
            for a, b in _pairs(r, size, num):
                sig, of = P.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), num)
                assert set(sig[of == 0].tolist()) & set(sig[of == 1].tolist()), (size, len(a), len(b))
                seen += 1
    assert seen > 500


def test_all_seeds_may_fail(monkeypatch):
    """With one partitioning most small sets are not firm: they meet by empty choices too."""
    monkeypatch.setattr(P, "SEEDS", 1)
    r = np.random.default_rng(3)
    for size in range(3, 30):
        for _ in range(40):
            for a, b in _pairs(r, size, 80):
                sig, of = P.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
                assert set(sig[of == 0].tolist()) & set(sig[of == 1].tolist())


def test_strangers_share_few_signatures_and_sets_make_few():
    r = np.random.default_rng(5)
    for size in (10, 50, 300, 3000):
        sets = [np.unique(r.integers(1 << 63, size=size, dtype=np.uint64)) for _ in range(200)]
        sig, of = P.signatures(np.concatenate(sets), np.arange(201) * size)
        assert len(np.unique(sig)) > 0.999 * len(sig)
        assert len(sig) / 200 < 1.1 * size + 20


def test_a_band_of_a_plan_is_whole():
    for num in (60, 75, 80, 90):
        known = P.instances(num, 10**6)
        for (low, k, n1, n2, k2), nxt in zip(known, known[1:]):
            high = nxt[0] - 1
            assert n1 * (k2 + 1) > k >= (100 - num) * 2 * high // (100 + num) and n2 > k2
            assert -(-num * nxt[0] // 100) >= low or num * nxt[0] <= 100 * low  # only the band before may link into the next


def test_empty_table(spark, empty):
    assert P.jaccard_components(empty).count() == 0
