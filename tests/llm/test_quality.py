import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import quality as Q
from tests.llm.conftest import CLASHING, odd_rows, words


def _many(spark, n=400):
    """Good prose and shouted, repeated or signed junk."""
    rows = []
    for i in range(n):
        w = words(i, 60).split(" ")
        junk = [" ".join(x.upper() + "!!" for x in w), " ".join([w[0]] * 60), " ".join(x + "%%%" for x in w)][i % 3]
        rows.append((i, junk if i % 4 == 0 else ". ".join(w), "en", "s", 60))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, docs.select("doc_id", (F.col("doc_id") % 4 != 0).cast("int").alias("quality"))


def test_score_is_the_pairwise_sum():
    """The sum-of-squares identity against the sum over all pairs."""
    rng = np.random.default_rng(1)
    size = (1 << Q.WORD_BITS) + len(Q.STATISTICS) * (Q.BINS + 1)
    m = Q.Machine(np.sort(rng.standard_normal((len(Q.STATISTICS), Q.BINS - 1)), 1), 0.3, rng.standard_normal(size) * 0.1, rng.standard_normal((size, Q.FACTORS)) * 0.2)
    texts = pa.array(["a b c a", "", None, "HELLO, wörld 12\nx"])
    (first, last, stats, row, index, value), = Q.features(texts, np.array([3.0, np.nan, 0, 9]))
    got = m.score(last - first, stats, row, index, value)
    flat = m.bins(stats, m.edges)
    for i in range(4):
        xs = {int(k): 1.0 for k in flat[i]} | {int(k): float(v) for r, k, v in zip(row, index, value) if r == i}
        keys = sorted(xs)
        z = m.bias + sum(m.weight[k] * xs[k] for k in keys)
        z += sum(xs[a] * xs[b] * (m.factor[a] @ m.factor[b]) for n, a in enumerate(keys) for b in keys[n + 1 :])
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def test_learns_and_is_the_same_again(spark):
    docs, labels = _many(spark)
    held = Q.fold("doc_id", Q.FOLDS) == Q.HELD_OUT
    score = lambda: Q.with_score(docs, Q.train(docs, labels)).join(labels, "doc_id").where(held).orderBy("doc_id").collect()
    got = score()
    assert np.mean([(r["score"] >= Q.THRESHOLD) == r["quality"] for r in got]) > 0.97
    assert [r["score"] for r in got] == [r["score"] for r in score()]


def test_ids_languages_sources_and_labels_are_no_inputs(spark):
    docs, labels = _many(spark, 120)
    machine = Q.train(docs, labels)
    other = docs.withColumns({"doc_id": F.col("doc_id") + 10**6, "lang": F.lit("xx"), "source": F.lit("y")})
    a, b = (sorted((r["text"], r["score"]) for r in Q.with_score(d, machine).collect()) for d in (docs, other))
    assert a == b


def test_held_out_labels_are_never_learned(spark):
    docs, labels = _many(spark, 120)
    flipped = labels.withColumn("quality", F.when(Q.fold("doc_id", Q.FOLDS) == Q.HELD_OUT, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = Q.train(docs, labels), Q.train(docs, flipped)
    assert np.array_equal(a.weight, b.weight) and np.array_equal(a.factor, b.factor)


def test_an_id_that_repeats_is_learned_once(spark):
    docs, labels = _many(spark, 120)
    many = docs.unionByName(docs).unionByName(docs.withColumn("source", F.lit("z")))
    a, b = Q.train(docs, labels), Q.train(many, labels)
    assert np.array_equal(a.weight, b.weight) and np.array_equal(a.factor, b.factor)


def test_odd_rows(odd, labels):
    got = Q.with_score(odd, Q.train(odd, labels), name="fm").collect()
    assert len(got) == len(odd_rows()) and all(0 <= r["fm"] <= 1 for r in got)
    assert all(r[c] == v for r in got for c, v in CLASHING.items())
    assert len({r["fm"] for r in got if r["text"] in (None, "")}) == 1
    kept = Q.keep_good(odd, labels)
    assert kept.columns == odd.columns and kept.count() <= odd.count()


def test_without_labels_or_rows(odd, empty, labels):
    assert Q.train(odd, labels.limit(0)) is None and Q.train(empty, labels) is None
    assert {r["score_"] for r in Q.with_score(odd, None, name="score_").collect()} == {0.5}
    assert Q.keep_good(empty, labels).count() == 0
    assert Q.with_score(odd.drop("n_chars"), Q.train(odd, labels), name="fm").count() == odd.count()


def test_query_gives_the_scores_of_plain_sums(spark, tmp_path):
    """Every row of the query against the machine's formula over all pairs, text by text."""
    docs, labels = _many(spark, 60)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    m = Q.train(docs, labels)
    got = {r["doc_id"]: r for r in Q.op2_quality(spark, str(tmp_path)).collect()}
    assert len(got) == 60
    for r in docs.collect():
        ((_, _, stats, _, index, value),) = Q.features(pa.array([r["text"]]), np.array([float(r["n_chars"])]))
        xs = {int(k): 1.0 for k in m.bins(stats, m.edges)[0]} | {int(k): float(v) for k, v in zip(index, value)}
        keys = sorted(xs)
        z = m.bias + sum(float(m.weight[k]) * xs[k] for k in keys)
        v = np.array([m.factor[k] * xs[k] for k in keys], float)
        z += sum(float(v[a] @ v[b]) for a in range(len(keys)) for b in range(a + 1, len(keys)))
        want = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        assert got[r["doc_id"]]["score"] == pytest.approx(want, abs=1e-5)
        assert got[r["doc_id"]]["predicted"] == int(got[r["doc_id"]]["score"] >= 0.3)
