import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from lodestrata.llm import minmax_dedup as N
from lodestrata.llm import textkit
from lodestrata.llm.graph import components
from tests.llm.conftest import CLASHING, odd_rows, words

np.seterr(over="ignore")


def _set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def _brute(rows):
    """(n, smallest id reachable) of each row; a null id comes after all others."""
    sets, parent = [_set(r[1]) for r in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        key = (r[0] is None, r[0] or 0)
        least[root(i)] = min(least.get(root(i), key), key)
    return [(len(sets[i]), None if (k := least[root(i)])[0] else k[1]) for i in range(len(rows))]


def _edited(seed, n_docs=150):
    """Groups of copies of copies with more and more edits, and strangers that share a passage."""
    r, rows = random.Random(seed), []
    passage = words(99, 40)
    for g in range(6):
        base = words(100 + g, r.randint(30, 150)).split(" ")
        family = [base]
        for _ in range(n_docs // 8):
            w = list(r.choice(family))
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = "edit" + str(r.randrange(10**6))
            family.append(w)
        rows += [" ".join(w) for w in family]
    rows += [words(1000 + i, 60) + " " + passage for i in range(40)]
    r.shuffle(rows)
    return [(i, t, None, None, None) for i, t in enumerate(rows)]


@pytest.mark.parametrize("rows", [odd_rows(), _edited(1), _edited(2)], ids=["odd", "edited", "edited again"])
def test_equals_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in N.near_duplicates(docs).collect())
    assert got == sorted((str(r[0]), n, str(c)) for r, (n, c) in zip(rows, _brute(rows)))


def test_what_the_center_misses_is_found_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 2)
    rows = _edited(3, 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(docs).collect()}
    assert got == {r[0]: c for r, (_, c) in zip(rows, _brute(rows))}


def test_the_exact_search_equals_brute_force(spark):
    rows = _edited(4, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(docs, exact=True).collect()}
    assert got == {r[0]: c for r, (_, c) in zip(rows, _brute(rows))}


def test_texts_with_a_passage_in_common_are_not_compared(spark, monkeypatch):
    """Half of each text is the same: buckets are hot, but no prefix shingle is shared, so no pair is made."""
    frame = words(5, 60)
    rows = [(i, frame + " " + words(10_000 + i, 60)) for i in range(1500)] + [(9000, frame + " " + words(10_007, 60) + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    search = N._Search(docs, "doc_id", "text")
    members = search.members()
    assert members.groupBy("key").count().agg({"count": "max"}).first()[0] > 300
    sizes = []
    monkeypatch.setattr(N, "written", lambda df, name, w=N.written: sizes.append((name, w(df, name))) or sizes[-1][1])
    none = spark.createDataFrame([], "node long, label long")
    more = search.left_over(members, none)
    assert more.count() == 1 and dict(sizes)["compared"].select("node").distinct().count() == 2 < dict(sizes)["open"].select("node").distinct().count()


def test_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 4, 7, 20, 100):
        for _ in range(30):
            common = np.sort(rng.choice(10**6, 50, replace=False))
            base = np.unique(np.r_[rng.choice(common, min(n, 50) // 2, replace=False), rng.integers(1 << 40, size=n)])[:n]
            other = base.copy()
            other[rng.choice(n, n // 8, replace=False)] = rng.integers(1 << 40, size=n // 8)
            x, y = set(base.tolist()), set(other.tolist())
            if 100 * len(x & y) < 75 * len(x | y):
                continue
            lists = pa.array([sorted(x), sorted(y)], pa.list_(pa.int64()))
            batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), lists], names=["node", "hashes"])
            (out,) = N._prefixes(common, np.arange(50) + 1)([batch])
            first = {k: {h for m, h in zip(out.column(0).to_pylist(), out.column(1).to_pylist()) if m == k} for k in (1, 2)}
            assert first[1] & first[2] and len(first[1]) == len(x) - -(-75 * len(x) // 100) + 1


def test_shingles_that_agree_in_32_bits_are_told_apart():
    high = np.arange(1, 101, dtype=np.uint64) << np.uint64(32)
    a, b, c = high.copy(), high + np.uint64(1), np.r_[high[:90], high[90:] + np.uint64(2)]  # a and c are linked, b with none
    rows = pa.RecordBatch.from_pydict({"key": [1] * 3, "i": [0] * 3, "j": [0] * 3, "mine": [0] * 3, "node": [10, 11, 12], "part": [10, 11, 12],
        "hashes": pa.array([x.view(np.int64) for x in (a, b, c)], pa.list_(pa.int64())), "sketch": pa.array([bytes(240)] * 3, pa.binary())})
    assert N._block(rows, N.AGREE) == ([10], [12])


def test_small_sets_have_more_bands():
    texts = pa.array([words(1, 6), words(2, 80)])
    ((first, hashes, bounds),) = textkit.shingle_sets(texts)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([3, 4]), texts], names=["id", "th", "text"])
    assert [len(x) for x in next(N._sign(iter([batch]))).column("bands").to_pylist()] == [2 * N.BANDS, N.BANDS]


def test_rows_that_repeat_a_text_are_read_once(spark):
    rows = [(1, words(1, 50))] * 300 + [(2, words(1, 50) + " x")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    search = N._Search(docs, "doc_id", "text")
    assert search.texts(search.classes.select("node")).count() == 2
    assert sorted(r["doc_id"] for r in N.drop_near_duplicates(docs).collect()) == [1]


def test_drop_keeps_the_first_of_each_component(odd):
    rows = odd_rows()
    kept = N.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    got = kept.collect()
    ids = sorted(str(r["doc_id"]) for r in got)
    # 10 stays twice: its short text is no copy; texts without words are linked with nothing
    assert ids == sorted(["0", "4", "5", "6", "7", "8", "10", "10", "11", "12", "None"]) and len(rows) > len(ids)
    assert all(r[c] == v for r in got for c, v in CLASHING.items())


def test_empty_table(empty):
    assert N.near_duplicates(empty).count() == 0 and N.drop_near_duplicates(empty).count() == 0


def test_signature_entries_agree_as_often_as_sets_do():
    rng = np.random.default_rng(1)
    both, x, y = (rng.integers(1 << 63, size=n, dtype=np.uint64) for n in (600, 100, 100))
    sets = [np.sort(np.concatenate([both, x])), np.sort(np.concatenate([both, y]))]
    sig = N.signatures(np.concatenate(sets), np.array([0, 700, 1400]))
    assert abs((sig[0] == sig[1]).mean() - 0.75) < 0.12
    assert (N.sketch(sig)[0] == N.sketch(sig)[1]).mean() >= (sig[0] == sig[1]).mean()


def test_shingles_of_a_batch_equal_those_of_strings():
    r = random.Random(4)
    texts = ["", None, "a", "A  b", "x\x0bY\x0c z  q", "é É ß", "  a b"] + [words(i, r.randint(0, 90)) for i in range(60)] + [words(7, 40_000)]
    sets = []
    for size in (64, 4 << 20):
        for _, h, b in textkit.shingle_sets(pa.array(texts), size=size):
            sets += [h[b[i] : b[i + 1]].tolist() for i in range(len(b) - 1)]
    assert sets[: len(texts)] == sets[len(texts) :]
    assert [len(s) for s in sets[: len(texts)]] == [len(_set(t)) for t in texts]
    assert len(set(sets[3])) == 1 and sets[2] != sets[3]


def test_components(spark):
    r = random.Random(2)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {x["node"]: x["label"] for x in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}
