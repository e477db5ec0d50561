import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import decontaminate as D
from tests.llm.conftest import CLASHING, odd_rows, words

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(t):
    return _WORD.findall((t or "").translate(_LOW))


def _brute(docs, items):
    windows = {}
    for k, t in items:
        w = _words(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if k is None else str(k))
    out = []
    for d in docs:
        w, hit, names = _words(d[1]), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    names |= windows[x]
        out.append((str(d[0]), len(w), len(hit), tuple(sorted(names))))
    return sorted(out)


def _rows(df):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], tuple(r["items"])) for r in df.collect())


@pytest.mark.parametrize("block", [9, 4096])
def test_equals_brute_force_on_odd_rows(odd, benchmark, block, monkeypatch):
    monkeypatch.setattr(D, "_BLOCK", block)
    items = [tuple(r) for r in benchmark.collect()]
    got = _rows(D.contamination(odd, benchmark))
    assert got == _brute(odd_rows(), items)
    assert sum(r[2] > 0 for r in got) >= 4


def test_equals_brute_force_on_common_words(spark):
    """A small vocabulary: every word is common, places overlap, items repeat and begin before documents do."""
    r = random.Random(5)
    say = lambda n: "".join(r.choice(["Aa", "bé", "C1", "É"]) + r.choice([" ", ", ", "-", "\n"]) for _ in range(n))
    items = [(i, say(r.choice([1, 2, 9, 10, 11, 30]))) for i in range(12)]
    docs = [(i, r.choice(["", " .", "x "]) + say(r.choice([0, 1, 5, 40])) + r.choice(["", items[r.randrange(12)][1][5:]]) + say(3)) for i in range(120)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert _rows(D.contamination(d, b)) == _brute(docs, items)


def test_drop_leaves_clean_rows_alone(odd, benchmark):
    items = [tuple(r) for r in benchmark.collect()]
    kept = D.drop_contaminated(odd, benchmark)
    assert kept.columns == odd.columns
    got = kept.collect()
    clean = [x for x in _brute(odd_rows(), items) if x[2] == 0]
    assert sorted((str(r["doc_id"]), len(_words(r["text"]))) for r in got) == sorted(x[:2] for x in clean)
    assert all(r[c] == v for r in got for c, v in CLASHING.items())


def test_a_full_filter_changes_nothing(odd, benchmark, monkeypatch):
    """As if the benchmark had more words than the filter has room for: all words are indexed, by the same plan."""
    from pyspark.sql import functions as F

    items = [tuple(r) for r in benchmark.collect()]
    monkeypatch.setattr(D, "with_filter", lambda df, column, bits, name: df.withColumn(name, F.lit(True)))
    assert _rows(D.contamination(odd, benchmark)) == _brute(odd_rows(), items)


def test_very_long_items(spark):
    """An item of 60,000 words, a document that has it, one that has its middle, and one that has nine words of it."""
    item = words(21, 60_000)
    w = item.split(" ")
    rows = [(1, words(22, 50) + " " + item), (2, " ".join(w[30_000:30_400])), (3, " ".join(w[5:14]) + " end"), (4, words(23, 100))]
    items = [(1, item), (2, " ".join(w[30_100:30_120]))]
    got = _rows(D.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert got == _brute(rows, items)
    assert [r[2] for r in got] == [60_000, 400, 0, 0]


def test_query_by_its_name(spark, odd, benchmark, tmp_path):
    odd.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in D.op10_decontamination(spark, str(tmp_path)).collect())
    want = [(i, n, h, len(k), hashlib.sha256(",".join(k).encode()).hexdigest(), h > 0) for i, n, h, k in _brute(odd_rows(), [tuple(r) for r in benchmark.collect()])]
    assert got == sorted(want)


def test_empty_tables(odd, empty, benchmark):
    assert D.contamination(empty, benchmark).count() == 0
    none = D.contamination(odd, benchmark.limit(0))
    assert none.count() == odd.count() and none.where("n_hit > 0").count() == 0


def test_an_index_of_all_words_serves_any_benchmark(spark, odd, benchmark):
    index = D.build_index(odd)
    assert index.postings.count() == sum(len(_words(r[1])) for r in odd_rows())
    for bench in (benchmark, benchmark.where("item_id = 2")):
        hits = D.phrase_matches(D.Items(bench), index)
        got = sorted((r["id"] is None, r["id"] or 0, r["n"]) for r in hits.selectExpr("doc", "explode(sequence(since, till)) as pos").distinct().groupBy("doc").count().join(index.documents, "doc").selectExpr("id", "count as n").collect())
        want = [(x[0] == "None", 0 if x[0] == "None" else int(x[0]), x[2]) for x in _brute(odd_rows(), [tuple(r) for r in bench.collect()]) if x[2]]
        assert got == sorted(want)


def test_many_repeated_rows_and_places(spark):
    """Time is linear in repeated rows, and in the places of one text."""
    item = words(8, 30)
    rows = [(i % 3, "x " + item + " y") for i in range(3000)] + [(5, " ".join([item] * 400))]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), [(1, item)]
    got = _rows(D.contamination(docs, spark.createDataFrame(items, "item_id long, text string")))
    assert got == sorted([(str(i), 32, 30, ("1",)) for i in (0, 1, 2)] * 1000 + [("5", 12_000, 12_000, ("1",))])


def _near(docs, items):
    """Items of which a posting of the rarest term has every word within twice the item's length, by document."""
    texts = [_words(d[1]) for d in docs]
    count, out = {}, []
    for w in texts:
        for x in w:
            count[x] = count.get(x, 0) + 1
    for w in texts:
        found = set()
        for k, t in items:
            own = set(_words(t))
            if not own or not all(count.get(x) for x in own):
                continue
            least, reach = min(count[x] for x in own), 2 * len(_words(t))
            # the rarest term: of equal ones any, so the tests have one
            (first,) = [x for x in own if count[x] == least] if sum(count[x] == least for x in own) == 1 else [None]
            assert first is not None
            for p in (i for i, x in enumerate(w) if x == first):
                if own <= set(w[max(0, p - reach) : p + reach + 1]):
                    found.add("" if k is None else str(k))
        out.append(len(found))
    return out


def test_proximity(spark):
    r = random.Random(11)
    docs = [(i, " ".join(r.choice(["zig"] * 2 + ["zag"] * 3 + ["zog"] * 4 + ["bip", "the", "of", "a", "so"] * 5) for _ in range(r.choice([0, 5, 40, 300])))) for i in range(150)]
    items = [(1, "zig zag zog"), (2, "zig the zag of zog"), (3, "zag bip"), (4, "nowhere zig"), (5, "zig"), (6, "zog zog zag zog so"), (None, "zag bip")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r["n_near"] for r in D.contamination(d, b).collect()}
    assert [got[i] for i, _ in docs] == _near(docs, items) and len(set(got.values())) > 3
    index, some = D.build_index(d), D.Items(b.where("item_id = 1"))
    assert D.proximity_matches(some, index, reach=F.lit(3)).count() < D.proximity_matches(some, index, reach=F.lit(30)).count()


def test_main_path_has_no_python(odd, benchmark):
    assert not re.search("Python|Pandas|Arrow", D.contamination(odd, benchmark)._jdf.queryExecution().toString())
