"""Language identification by error-correcting output codes.

Each language has a codeword. For each bit a linear classifier on byte trigrams (A-Z as a-z) predicts the bit of a text's
language; decoding sums, for each codeword, the logistic loss of every bit, weighted by how well that bit's classifier
separates the sample, and takes the codeword with the least. The score is the softmax of the losses; a text is
ambiguous if the second codeword is within `MARGIN` of the first.

Up to seven languages get the exhaustive code (2 ** (n - 1) - 1 bits), more get a random code of ceil(10 log2 n) bits
with the largest least distance of 50 draws. It is fitted on the driver on at most `SAMPLE` rows with a language and
crc32(id as text) mod 4 not 2, those with the least hash of the id; half of the sample is shared evenly among the languages,
so a rare language is learned as well. The language, source and id are never inputs.

Null texts and texts without a letter (Unicode category L) are `und` with score 0, ambiguous. Without rows to learn from all texts are.
Null ids are not held out and never in the sample; of rows that repeat an id and language the text with the least hash is in it. Repeated rows get equal results; a tie takes the language that sorts
first. Empty tables give no row. Extra columns are carried by `with_language` under their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm import textkit
from lodestrata.llm._shared import map_batches, table, unused
from lodestrata.llm.quality import fold

SAMPLE, HELD_OUT, FOLDS = 4000, 2, 4
GRAM_BITS, MARGIN = 12, 0.1
UNKNOWN = "und"
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_ASCII = np.zeros(256, bool)
_ASCII[97:123] = True
_LETTER = regex.compile(r"\p{L}")


def codewords(n: int, seed: int = 3) -> np.ndarray:
    """n rows of -1 and 1."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        columns = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(columns, float).T
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    draws = (rng.choice([-1.0, 1.0], (n, bits)) for _ in range(50))
    return max(draws, key=lambda c: min((a != b).sum() for a, b in itertools.combinations(c, 2)))


def grams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each trigram, bounds): trigrams of text i are bucket[bounds[i]:bounds[i + 1]]; none cross a text's end."""
    low = _LOWER[raw]
    size = np.diff(at)
    if len(raw) < 3:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    h = ((low[:-2] | low[1:-1] << np.uint32(8) | low[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAM_BITS)
    keep = np.ones(len(raw), bool)
    for back in (1, 2):
        keep[np.maximum(at[1:] - back, at[:-1])[size >= back]] = False
    return h[keep[:-2]].astype(np.int64), np.concatenate([[0], np.cumsum(np.maximum(size - 2, 0))])


def shares(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """For runs of texts: (first, share of each bucket in each text's trigrams)."""
    for first, last, raw, at in textkit.pieces(texts, 1 << 20, 512):
        bucket, bounds = grams(raw, at)
        n = last - first
        row = np.repeat(np.arange(n), np.diff(bounds))
        count = np.bincount(row * (1 << GRAM_BITS) + bucket, minlength=n << GRAM_BITS).reshape(n, -1)
        yield first, (count / np.maximum(np.diff(bounds), 1)[:, None]).astype(np.float32)


class Coder:
    """Fitted classifiers, one a bit, and the code."""

    def __init__(self, langs: list[str], code: np.ndarray, weight: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.langs, self.code, self.weight, self.bias, self.trust = langs, code, weight, bias, trust

    def margins(self, share: np.ndarray) -> np.ndarray:
        return np.sqrt(share) @ self.weight + self.bias

    def decode(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, score, ambiguous) for bits' margins."""
        loss = np.stack([(np.logaddexp(0, -f * word) * self.trust).sum(1) for word in self.code], 1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = loss.argmin(1)
        order = np.sort(loss, 1)
        near = order[:, 1] - order[:, 0] < MARGIN * self.trust.sum() if loss.shape[1] > 1 else np.zeros(len(loss), bool)
        return best, p[np.arange(len(p)), best], near


def fit(share: np.ndarray, lang: list[str], *, steps: int = 120) -> Coder:
    """Logistic regression of every bit by accelerated gradient descent on square roots of shares."""
    langs = sorted(set(lang))
    code = codewords(len(langs))
    own = np.array([langs.index(x) for x in lang])
    x, y = np.sqrt(share), (code[own] + 1) / 2
    balance = (len(own) / len(langs) / np.bincount(own, minlength=len(langs)))[own][:, None].astype(np.float32)
    w = old = np.zeros((x.shape[1], code.shape[1]), np.float32)
    b = old_b = np.zeros(code.shape[1], np.float32)
    for t in range(steps):
        m = t / (t + 3)
        at, at_b = w + m * (w - old), b + m * (b - old_b)
        d = ((1 / (1 + np.exp(-np.clip(x @ at + at_b, -40, 40))) - y) * balance).astype(np.float32)
        old, old_b = w, b
        w = at - 4 * (x.T @ d / len(x) + 1e-5 * at)
        b = at_b - 0.5 * d.mean(0)
    right = ((x @ w + b > 0) == (y > 0.5)).mean(0)
    return Coder(langs, code, w, b, np.maximum(2 * right - 1, 0.01))


def sample_ids(known: DataFrame, sample: int) -> DataFrame:
    """At most `sample` rows (id, lang) of a frame with them, by the hash of the id: half of the sample is shared evenly among the languages, the other
    half goes by hash alone, so as the languages occur.

    Only ids and languages are read; of more languages than `sample` the most frequent. Rows far beyond what a language can get
    are turned away by their hash before they are ranked, so the window sorts a few thousand rows of a language, however many there are.
    """
    counts = known.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(sample)
    even = max(1, sample // (2 * max(1, counts.count())))
    near = known.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 30))).join(F.broadcast(counts), "lang")
    near = near.where(F.col("h") / (1 << 30) * F.col("rows") <= 4 * sample).select("id", "lang", "h").distinct()
    rank = Window.partitionBy("lang").orderBy("h", "id")
    ranked = near.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= sample)
    return ranked.orderBy(F.col("rank") > even, "h", "id", "lang").limit(sample).select("id", "lang")


def train(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Coder | None:
    """Fits on at most `sample` rows; None if there are none."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & (fold(key, FOLDS) != HELD_OUT))
    rows = rows.select(F.col(key).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    least = sample_ids(rows.select("id", "lang"), sample)
    rows = rows.join(F.broadcast(least), ["id", "lang"]).groupBy("id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, share in shares(batch.column(2)):
                part = batch.slice(first, len(share))
                row, bucket = share.nonzero()
                cut = np.searchsorted(row, np.arange(len(share) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(cut, x) for x in (bucket.astype(np.int16), share[row, bucket])]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *lists], names=["id", "lang", "bucket", "share"])

    found = map_batches(rows, measure, f"id {dict(rows.dtypes)['id']}, lang string, bucket array<short>, share array<float>").toArrow().combine_chunks()
    found = found.sort_by([("id", "ascending"), ("lang", "ascending")])
    if not found.num_rows:
        return None
    bucket, value = found["bucket"].combine_chunks(), found["share"].combine_chunks()
    share = np.zeros((found.num_rows, 1 << GRAM_BITS), np.float32)
    share[np.repeat(np.arange(found.num_rows), np.diff(bucket.offsets.to_numpy())), bucket.flatten().to_numpy()] = value.flatten().to_numpy()
    return fit(share, found["lang"].to_pylist())


def _no_letter(texts: pa.Array) -> np.ndarray:
    """Texts without a letter; those without an ASCII letter are looked at as strings."""
    out = np.zeros(len(texts), bool)
    for first, last, raw, at in textkit.pieces(texts):
        total = np.concatenate([[0], np.cumsum(_ASCII[_LOWER[raw]])])
        for i in np.flatnonzero(total[at[1:]] == total[at[:-1]]):
            out[first + i] = not _LETTER.search(texts[first + int(i)].as_py() or "")
    return out


def with_language(docs: DataFrame, coder: Coder | None, *, text: str = "text", keep: list[str] | None = None, names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """The columns `keep` (all) of docs, the language, its score and whether it is ambiguous."""
    keep = docs.columns if keep is None else keep
    if coder is None:
        return docs.select(*keep, F.lit(UNKNOWN).alias(names[0]), F.lit(0.0).alias(names[1]), F.lit(True).alias(names[2]))
    shared = docs.sparkSession.sparkContext.broadcast(coder)
    own = unused([*keep, *names], "t")
    rows = docs.select(*keep, F.col(text).cast("string").alias(own))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(len(keep))
            f = np.zeros((len(texts), model.code.shape[1]))
            for first, share in shares(texts):
                f[first : first + len(share)] = model.margins(share)
            best, score, near = model.decode(f)
            none = _no_letter(texts)
            lang = [UNKNOWN if x else model.langs[b] for x, b in zip(none, best)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(np.where(none, 0.0, score)), pa.array(near | none)], names=[*keep, *names])

    return map_batches(rows, predict, docs.select(*keep).schema.add(names[0], "string").add(names[1], "double").add(names[2], "boolean"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents: doc_id, held_out, lang_pred, score, ambiguous."""
    docs = table(spark, sf_dir, "documents")
    found = with_language(docs, train(docs), keep=["doc_id"])
    return found.select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
