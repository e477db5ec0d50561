import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestrata.llm import language as G
from tests.llm.conftest import CLASHING, odd_rows, words

SYLLABLES = {"en": "the and ing", "fr": "les que é", "de": "der und ß", "es": "los ción ñ"}


def _docs(spark, n=320):
    rows = [(i, " ".join(f"{SYLLABLES[x]} {w}" for w in words(i, 25).split(" ")), x if i % 9 else None) for i in range(n) for x in [list(SYLLABLES)[i % 4]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_codes_tell_languages_apart():
    for n in (1, 2, 3, 4, 7, 12):
        c = G.codewords(n)
        assert len(c) == n
        assert all((a != b).any() for a, b in itertools.combinations(c, 2))
    assert G.codewords(4).shape == (4, 7) and min((a != b).sum() for a, b in itertools.combinations(G.codewords(4), 2)) == 4


def test_grams_do_not_cross_texts():
    texts = pa.array(["abcd", "", None, "ab", "AbC", "xyz"])
    from lodestrata.llm.textkit import buffers

    bucket, bounds = G.grams(*buffers(texts))
    assert np.diff(bounds).tolist() == [2, 0, 0, 0, 1, 1]
    assert bucket[0] == bucket[2]  # abc and AbC
    one = [G.grams(*buffers(pa.array([t])))[0].tolist() for t in ("abcd", "AbC", "xyz")]
    assert sum(one, []) == bucket.tolist()


def test_decoding_takes_the_nearest_word_and_flags_ties():
    code = G.codewords(4)
    c = G.Coder(list("abcd"), code, np.zeros((4096, 7)), np.zeros(7), np.ones(7))
    best, score, near = c.decode(code * 4.0)
    assert best.tolist() == [0, 1, 2, 3] and (score > 0.99).all() and not near.any()
    spoiled = code * 4.0
    spoiled[2, 0] *= -1  # one wrong bit is corrected
    assert c.decode(spoiled)[0][2] == 2
    assert c.decode(np.zeros((1, 7)))[2][0]


def test_held_out_accuracy(spark):
    docs = _docs(spark)
    got = G.with_language(docs, G.train(docs)).where(G.fold("doc_id", 4) == 2).collect()
    true = {i: list(SYLLABLES)[i % 4] for i in range(320)}
    assert len(got) > 50 and np.mean([r["lang_pred"] == true[r["doc_id"]] for r in got]) > 0.98


def test_signs_and_number_characters_are_no_letters(spark):
    texts = ["\u00bd \u00b2", "\u2460", "\u2167", "12_3", "\u0301", "a\u00bd", "\u65e5", "\u00aa"]
    docs = _docs(spark)
    got = G.with_language(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), G.train(docs))
    assert [r["lang_pred"] == "und" for r in got.orderBy("doc_id").collect()] == [True, True, True, True, True, False, False, False]


def test_rare_languages_are_in_the_sample(spark):
    known = spark.range(20_000).selectExpr("id", "case when id % 5000 = 7 then 'rare' when id % 3 = 0 then 'b' else 'a' end as lang")
    got = {r["lang"]: r["count"] for r in G.sample_ids(known, 300).groupBy("lang").count().collect()}
    assert got["rare"] == 4 and got["a"] + got["b"] == 296 and 80 < got["b"] < 120  # at least 50 each, the rest as they occur
    assert G.sample_ids(known, 2).count() == 2 and G.sample_ids(known.limit(0), 5).count() == 0
    twice = known.unionByName(known)
    assert sorted(map(tuple, G.sample_ids(twice, 300).collect())) == sorted(map(tuple, G.sample_ids(known, 300).collect()))


def test_an_id_that_repeats_is_learned_once(spark):
    docs = _docs(spark, 60)
    many = docs.unionByName(docs).unionByName(docs)
    assert np.array_equal(G.train(docs).weight, G.train(many).weight)


def test_held_out_rows_and_ids_are_no_inputs(spark):
    docs = _docs(spark, 120)
    changed = docs.withColumn("lang", F.when(G.fold("doc_id", 4) == 2, "xx").otherwise(F.col("lang")))
    a, b = G.train(docs), G.train(changed)
    assert a.langs == b.langs and np.array_equal(a.weight, b.weight)


def test_odd_rows(odd):
    got = G.with_language(odd, G.train(odd), names=("language", "sure", "unsure")).collect()
    assert len(got) == len(odd_rows())
    assert all(r["language"] == "und" and r["sure"] == 0 for r in got if r["text"] in (None, "", " \n ", "12 34 !!"))
    assert all(r["language"] in ("en", "fr", "de") and 0 < r["sure"] <= 1 for r in got if r["text"] and any(c.isalpha() for c in r["text"]))
    assert all(r[c] == v for r in got for c, v in CLASHING.items())


def test_without_rows(odd, empty):
    assert G.train(empty) is None
    assert {r["lang_pred"] for r in G.with_language(odd, None, keep=["doc_id"]).collect()} == {"und"}
    assert G.with_language(empty, G.train(odd)).count() == 0
