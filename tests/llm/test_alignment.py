import bisect
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lodestrata.llm import alignment as A
from lodestrata.llm.incidence import Csr, product
from tests.llm.conftest import odd_rows

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def aligner():
    return A.Aligner()


def brute(aligner, text):
    """(A ids, B ids, groups as text, linked ids) of one text, by its whole tokens."""
    nothing = [], [], [], []
    if not text:
        return nothing
    a, b = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
    parts = [[aligner.a_bytes[i] for i in a], [aligner.b_bytes[i] for i in b]]
    if any(b"".join(p) != (" " + text).encode() for p in parts):
        return nothing
    ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    groups = [([], []) for _ in cuts]
    for side, ids in enumerate((a, b)):
        for i, e in zip(ids, ends[side]):
            groups[bisect.bisect_left(cuts, e)][side].append(i)
    at = dict(zip(ends[1], b))
    return a, b, [";".join(",".join(map(str, s)) for s in g) for g in groups], [(i, at[e]) for i, e in zip(a, ends[0]) if e in at]


def whole(aligner, rows):
    found = [(r[0], *brute(aligner, r[1])) for r in rows]
    count = Counter(p for f in found for p in f[4])
    most: dict[int, int] = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for i, a, b, groups, links in found:
        digest = hashlib.sha256("|".join(groups).encode()).hexdigest() if a else ""
        out.append((i, len(a), len(b), len(groups), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), digest))
    return sorted(out, key=str)


EXTRA = ["x", " ", "\n", "don't  stop\tnow", "a ▁ b", "  two", "tail  ", "<|endoftext|> and <s> </s> <unk> <0x41>", "中文字 中文", "it's 's", "\r\n\r\nx", "naïve café ﬁ", "\x00 null", "a b 　c"]


def test_query_equals_brute_force(spark, aligner, tmp_path):
    rows = [r[:2] for r in odd_rows()] + [(1000 + i, t) for i, t in enumerate(EXTRA)]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, codes string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r[c] for c in COLUMNS) for r in A.op12_alignment(spark, str(tmp_path)).collect()), key=str)
    assert got == whole(aligner, rows)
    assert sum(r[1] == 0 for r in got) >= 3


def test_chunks_change_nothing(aligner):
    r = random.Random(12)
    signs = [*" \n\t\r  abcXYZ'.,!?-012ß é中文😀 　▁\x00\x1c", "<|endoftext|>", "<s>", "▁", "  ", "'s", " the", "<0x0A>", "<unk>", " word", "\nNext"]
    for _ in range(6000):
        text = "".join(r.choice(signs) for _ in range(r.randint(1, 14)))
        entries = aligner.entries([text])[0]
        if None in entries and len(entries) > 1:
            entries = aligner.aligned([" " + text])
        a, b, groups, links = brute(aligner, text)
        if None in entries:
            assert not a
            continue
        assert [sum(e[k] for e in entries) for k in range(3)] == [len(a), len(b), len(groups)]
        assert "|".join(e[3] for e in entries) == "|".join(groups)
        assert [c for e in entries for c in np.frombuffer(e[4], np.int64).tolist()] == [i * len(aligner.b_bytes) + j for i, j in links]


def test_links_of_one_text(spark, aligner):
    text = "Unbelievable café, naïveté\nx"
    row = A.alignments(spark.createDataFrame([(1, text, "y"), (2, None, "y"), (3, "a▁b", "y")], "doc_id long, text string, a string")).orderBy("doc_id").collect()
    assert row[1]["a_ids"] == [] and row[2]["ends"] == [] and row[0]["a"] == "y"
    a, b, groups, links = brute(aligner, text)
    assert (row[0]["a_ids"], row[0]["b_ids"]) == (a, b)
    assert [(a[x["a"]], b[x["b"]]) for x in row[0]["ends"]] == links
    ranges = [np.cumsum([0, *[len(t[i]) for i in ids]]) for t, ids in ((aligner.a_bytes, a), (aligner.b_bytes, b))]
    want = {(i, j): n for i in range(len(a)) for j in range(len(b)) if (n := min(ranges[0][i + 1], ranges[1][j + 1]) - max(ranges[0][i], ranges[1][j])) > 0}
    assert {(x["a"], x["b"]): x["bytes"] for x in row[0]["overlaps"]} == want
    sizes = [tuple(len(s.split(",")) for s in g.split(";")) for g in groups]
    shared, i, j = set(), 0, 0
    for n, m in sizes:
        shared |= {(x, y) for x in range(i, i + n) for y in range(j, j + m)}
        i, j = i + n, j + m
    assert {(x["a"], x["b"]) for x in row[0]["shared"]} == shared
    with pytest.raises(ValueError):
        A.alignments(spark.createDataFrame([(1, "t", 1)], "doc_id long, text string, ends int"))


def test_products(monkeypatch):
    from lodestrata.llm import incidence

    monkeypatch.setattr(incidence, "BLOCK", 7)
    r = np.random.default_rng(1)
    for _ in range(50):
        n, m, k = r.integers(0, 9, 3)
        x, y = r.integers(0, 3, (n, m)) * (r.random((n, m)) < 0.4), r.integers(0, 3, (m, k)) * (r.random((m, k)) < 0.4)
        csr = lambda z: Csr(np.concatenate([[0], np.cumsum((z > 0).sum(1))]).astype(np.int64), np.nonzero(z)[1], z[np.nonzero(z)], z.shape[1])
        row, column, value = product(csr(x), csr(y)).entries()
        dense = np.zeros((n, k), int)
        dense[row, column] = value
        assert (dense == x @ y).all() and (value > 0).all()
        row, column, value = csr(x).transposed().entries()
        dense = np.zeros((m, n), int)
        dense[row, column] = value
        assert (dense == x.T).all()


def test_pairs_are_bounded_by_the_vocabularies(spark, aligner):
    assert 0 < A.most_pairs(aligner) < 1_000_000
    pairs = A.pair_statistics(spark.createDataFrame([r[:2] for r in odd_rows()], "doc_id long, text string"))[1].collect()
    for p in pairs:
        x, y = aligner.a_bytes[p["a_id"]], aligner.b_bytes[p["b_id"]]
        assert x.endswith(y) or y.endswith(x)


def test_empty_table(spark, empty):
    assert A.pair_statistics(empty)[0].count() == 0 and A.alignments(empty).count() == 0


def test_digest_has_a_bar_in_groups_and_semicolons_between(spark, aligner, tmp_path):
    texts = ["Unbelievable café, naïveté\nx", "one two", "x;\r\r\ny  z", "word"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for row in A.op12_alignment(spark, str(tmp_path)).collect():
        groups = [g.split(";") for g in brute(aligner, texts[row["doc_id"]])[2]]
        assert row["groups_sha256"] == hashlib.sha256(";".join(f"{a}|{b}" for a, b in groups).encode()).hexdigest()
