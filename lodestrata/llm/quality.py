"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)), so a document takes time
linear in its words. Inputs are hashed words (log counts, unit length), one indicator for the bin of each structure
statistic of the whole text, and one for the bin of the declared number of characters (`n_chars`, where the table has it).
Labels, language, source and id are never inputs.

It is fitted on the driver on at most `SAMPLE` labelled rows, those with the least hash of the id, with
crc32(id as text) mod 5 not 0. Of rows that repeat an id the text with the least hash is learned from. Without labels of both
kinds every score is 0.5.
Null and empty texts are scored as texts without words. Repeated rows get equal scores. Null ids are not held out and
never in the sample. A missing or null `n_chars` has a bin of its own. Empty tables give no row. Extra columns are
carried by `keep_good`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import textkit
from lodestrata.llm._shared import map_batches, table, text_or_empty, unused

SAMPLE, HELD_OUT, FOLDS, THRESHOLD = 6000, 0, 5, 0.3
WORD_BITS, BINS, FACTORS = 16, 8, 8
_U = np.uint64
_CLASS = np.zeros((7, 256), np.float32)
_CLASS[0, 65:91] = 1  # A-Z
_CLASS[1, 97:123] = 1  # a-z
_CLASS[2, 48:58] = 1  # 0-9
_CLASS[3, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1  # signs
_CLASS[4, [44, 46]] = 1  # commas and full stops
_CLASS[5, 10] = 1  # newlines
_CLASS[6, 128:] = 1  # bytes of other characters
_LINE = np.ones(256, bool)
_LINE[10] = False
STATISTICS = ("upper", "lower", "digits", "signs", "stops", "newlines", "other", "bytes", "words", "word length", "distinct words", "repeated next", "sign ends", "shouted", "distinct lines", "longest word", "top word", "declared")


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.float64), np.cumsum(values, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text, and the count of the most frequent."""
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (x[1:] != x[:-1])][: len(d)])
    most = np.zeros(n)
    np.maximum.at(most, d[new], np.diff(np.append(new, len(d))))
    return np.bincount(d[new], minlength=n).astype(float), most


def features(texts: pa.Array, declared: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: (first, last, statistics, text of each word feature, its bucket, its value)."""
    for first, last, raw, at in textkit.pieces(texts):
        n = last - first
        starts, ends, word = textkit.spans(raw, at)
        h = textkit.word_hashes(raw, starts, ends)
        doc = np.repeat(np.arange(n), np.diff(word))
        size, count = np.maximum(np.diff(at), 1), np.diff(word)
        some = np.maximum(count, 1)
        kinds = [_sums(c[raw], at) / size for c in _CLASS]
        last_byte = raw[ends - 1] if len(ends) else raw[:0]
        signs = _CLASS[3][last_byte] * (1 - _CLASS[4][last_byte])
        inside = np.concatenate([np.zeros(1), np.cumsum(_CLASS[0][raw], dtype=np.float64)])
        caps = (inside[ends] - inside[starts]) * 2 > np.maximum(ends - starts, 4)
        again = np.zeros(len(h), np.float32)
        again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        distinct, top = _distinct(doc, h, n)
        s, e, line = textkit.spans(raw, at, _LINE)
        lines = np.diff(line)
        own, _ = _distinct(np.repeat(np.arange(n), lines), textkit.word_hashes(raw, s, e), n)
        longest = np.zeros(n)
        np.maximum.at(longest, doc, ends - starts)
        said = declared[first:last]
        stats = np.stack([
            *kinds, np.log1p(np.diff(at)), np.log1p(count), _sums(ends - starts, word) / some, distinct / some, _sums(again, word) / some,
            _sums(signs, word) / some, _sums(caps, word) / some, own / np.maximum(lines, 1), np.log1p(longest), top / some, np.log1p(said),
        ], axis=1)
        bucket = (h >> _U(64 - WORD_BITS)).astype(np.int64)
        key, times = np.unique(doc * (1 << WORD_BITS) + bucket, return_counts=True)
        row, value = key >> WORD_BITS, np.log1p(times).astype(np.float32)
        norm = np.sqrt(np.maximum(np.bincount(row, value * value, n), 1e-9)).astype(np.float32)
        yield first, last, stats, row, key & ((1 << WORD_BITS) - 1), value / norm[row]


class Machine:
    """A fitted factorisation machine; plain arrays, a few MB."""

    def __init__(self, edges: np.ndarray, bias: float, weight: np.ndarray, factor: np.ndarray):
        self.edges, self.bias, self.weight, self.factor = edges, bias, weight, factor

    @staticmethod
    def bins(stats: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Feature index of the bin of each statistic; the last bin is for missing values."""
        out = np.empty(stats.shape, np.int64)
        for j in range(stats.shape[1]):
            b = np.searchsorted(edges[j], stats[:, j], "right")
            out[:, j] = (1 << WORD_BITS) + j * (BINS + 1) + np.where(np.isnan(stats[:, j]), BINS, b)
        return out

    def score(self, n: int, stats: np.ndarray, row: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        flat = self.bins(stats, self.edges)
        lin = self.weight[flat].sum(1) + np.bincount(row, self.weight[index] * value, n)
        v = self.factor[flat]
        total, square = v.sum(1), (v * v).sum((1, 2))
        for f in range(self.factor.shape[1]):
            x = self.factor[index, f] * value
            total[:, f] += np.bincount(row, x, n)
            square += np.bincount(row, x * x, n)
        return 1 / (1 + np.exp(-np.clip(self.bias + lin + 0.5 * ((total * total).sum(1) - square), -40, 40)))


def fit(label: np.ndarray, stats: np.ndarray, row: np.ndarray, index: np.ndarray, value: np.ndarray, *, rounds: int = 25, seed: int = 5) -> Machine:
    """Mini-batch AdaGrad on the logistic loss; rows of features are sorted by `row`."""
    rng = np.random.default_rng(seed)
    edges = np.stack([np.quantile(s[~np.isnan(s)], np.linspace(0, 1, BINS + 1)[1:-1]) if (~np.isnan(s)).any() else np.zeros(BINS - 1) for s in stats.T])
    size = (1 << WORD_BITS) + stats.shape[1] * (BINS + 1)
    m = Machine(edges, 0.0, np.zeros(size, np.float32), (rng.standard_normal((size, FACTORS)) * 0.02).astype(np.float32))
    flat, begin = m.bins(stats, edges), np.searchsorted(row, np.arange(len(label) + 1))
    gw, gv, g0 = np.full(size, 1e-6, np.float32), np.full((size, FACTORS), 1e-6, np.float32), 1e-6
    for _ in range(rounds):
        order = rng.permutation(len(label))
        for part in np.array_split(order, max(1, len(order) // 256)):
            count = begin[part + 1] - begin[part]
            take = np.repeat(begin[part] - np.cumsum(count) + count, count) + np.arange(count.sum())
            r = np.concatenate([np.repeat(np.arange(len(part)), count), np.repeat(np.arange(len(part)), flat.shape[1])])
            i = np.concatenate([index[take], flat[part].ravel()])
            x = np.concatenate([value[take], np.ones(flat[part].size, np.float32)])
            v = m.factor[i]
            vx = v * x[:, None]
            total = np.stack([np.bincount(r, vx[:, f], len(part)) for f in range(FACTORS)], 1)
            z = m.bias + np.bincount(r, m.weight[i] * x, len(part)) + 0.5 * ((total * total).sum(1) - np.bincount(r, (vx * vx).sum(1), len(part)))
            d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label[part]) / len(part)
            used, where = np.unique(i, return_inverse=True)
            dw = np.bincount(where, d[r] * x) + 1e-5 * m.weight[used]
            each = (d[r] * x)[:, None] * (total[r] - vx)
            dv = np.stack([np.bincount(where, each[:, f]) for f in range(FACTORS)], 1) + 1e-5 * m.factor[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            g0 += d.sum() ** 2
            m.bias -= 0.1 * d.sum() / g0**0.5
            m.weight[used] -= 0.1 * dw / np.sqrt(gw[used])
            m.factor[used] -= 0.05 * dv / np.sqrt(gv[used])
    return m


def fold(key: str, folds: int):
    """crc32 of the id as text, modulo the folds."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(folds))


def _inputs(docs: DataFrame, text: str) -> list:
    said = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return [text_or_empty(text).alias("t"), F.greatest(said, F.lit(0.0)).alias("said")]


def _declared(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(float)


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Machine | None:
    """Fits on at most `sample` labelled rows; None without both labels. A text labelled twice has the smaller label."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (fold(key, FOLDS) != HELD_OUT))
    known = known.groupBy(F.col(key).alias("id")).agg(F.min(label).cast("double").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(key).alias("id"), *_inputs(docs, text)).join(F.broadcast(known), "id")
    rows = rows.groupBy("id", "y").agg(F.min_by(F.struct("t", "said"), F.struct(F.xxhash64("t"), "said")).alias("row")).select("id", "y", "row.t", "row.said")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, stats, row, index, value in features(batch.column("t"), _declared(batch.column("said"))):
                cut = np.searchsorted(row, np.arange(last - first + 1)).astype(np.int32)
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("y"), pa.array(list(stats), pa.list_(pa.float64())), pa.ListArray.from_arrays(cut, index.astype(np.int32)), pa.ListArray.from_arrays(cut, value)],
                    names=["id", "y", "stats", "index", "value"],
                )

    kind = dict(rows.dtypes)["id"]
    found = map_batches(rows, measure, f"id {kind}, y double, stats array<double>, index array<int>, value array<float>").toArrow().combine_chunks().sort_by("id")
    y = found["y"].to_numpy()
    if len(np.unique(y)) < 2:
        return None
    stats = np.array(found["stats"].to_pylist(), float)
    index, value = found["index"].combine_chunks(), found["value"].combine_chunks()
    row = np.repeat(np.arange(len(y)), np.diff(index.offsets.to_numpy()))
    return fit(y, stats, row, index.flatten().to_numpy().astype(np.int64), value.flatten().to_numpy())


def with_score(docs: DataFrame, machine: Machine | None, *, text: str = "text", name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all) of docs and the score of each row."""
    keep = docs.columns if keep is None else keep
    if machine is None:
        return docs.select(*keep, F.lit(0.5).alias(name))
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    t, said = unused([*docs.columns, name], "t"), unused([*docs.columns, name, "t"], "said")
    own = text in keep and docs.schema[text].dataType.typeName() == "string"
    inputs = [c.alias(n) for c, n in zip(_inputs(docs, text), (t, said))]
    rows = docs.select(*keep, *(inputs[1:] if own else inputs))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts = batch.column(names.index(text if own else t))
            out = np.empty(batch.num_rows)
            for first, last, *found in features(texts, _declared(batch.column(names.index(said)))):
                out[first:last] = shared.value.score(last - first, *found)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out)], names=[*names[: len(keep)], name])

    schema = docs.select(*keep).schema.add(name, "double")
    return map_batches(rows, score, schema)


def keep_good(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns."""
    name = unused(docs.columns, "score")
    machine = train(docs, labels, key=key, text=text, sample=sample)
    return with_score(docs, machine, text=text, name=name).where(F.col(name) >= threshold).drop(name)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents: doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents")
    found = with_score(docs, train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return found.select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
