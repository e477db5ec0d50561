import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; as extra columns they must not matter.
CLASHING = {c: "x" for c in ("id", "th", "d", "row", "digest", "node", "score", "t", "said", "kept", "text_hash", "first", "part", "n", "size", "shard", "bin", "doc", "pos", "term", "a", "b", "source_", "y")}


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 3))) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in each column, empty and very long texts, ties, repeated rows, near copies."""
    base = words(1, 80)
    near = base.split(" ")
    near[40] = "changed"
    long = words(2, 60_000)
    return [
        (0, base, "en", "s", 10), (1, base, "en", "s", 10), (2, base.replace(" ", "\n\t "), None, None, None), (3, " ".join(near), "en", "s", 1),
        (4, None, "en", "s", 0), (5, "", "en", "s", 0), (6, " \n ", "fr", "s", 3), (7, long, "en", "s", len(long)), (8, "one two", "fr", "s", 7), (9, "ONE two", "fr", "s", 7),
        (10, words(3, 200), "de", "s", 9), (10, words(3, 200), "de", "s", 9), (10, words(4, 20), "de", "s", 9), (None, words(5, 30), "de", "s", 9), (None, base, "en", "s", 9),
        (11, "été à Noël 日本語 😀 <|endoftext|> x", "fr", "s", 9), (12, "12 34 !!", "en", "s", 5), (13, base, "en", "s", 10),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(odd_rows(), SCHEMA).withColumns({c: F.lit(v) for c, v in CLASHING.items()}).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(14)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark):
    w = words(3, 200).split(" ")
    rows = [(1, " ".join(w[50:75])), (2, "One, TWO!"), (3, ""), (4, None), (5, " ".join(w[50:75])), (None, " ".join(w[100:112])), (6, "nowhere to be found at all in any of these texts")]
    return spark.createDataFrame(rows, "item_id long, text string")
