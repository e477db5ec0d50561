"""Jaccard join of shingle sets by PartEnum signatures.

Sets of sizes a and b with J >= t differ in at most (1 - t) / (1 + t) * (a + b) elements. Sizes are cut into bands; an instance takes the sets of
its band and those below that may link into it, so in an instance linked sets differ in at most k elements. A hash cuts
the domain into n1 parts of n2 cells. Sets that differ in k elements or fewer agree, in some part, on all but k2 of its cells, if n1 * (k2 + 1) > k. So
for each part and each choice of n2 - k2 cells a set emits the hash of its elements there, and linked sets share one of these signatures.

A choice of cells that are all empty says nothing and would be shared by all sets with that gap, so it is not emitted. Nothing is lost: to spoil every
other signature of a set, k2 + 1 elements must change in each part, or one in each cell that is not empty where these are fewer. If the sum of that over the
parts is more than k, the set is firm, and shares a signature that is not empty with all it is linked to. A set that is not firm emits, besides, the
signatures of the next of `SEEDS` partitionings, until one makes it firm; linked sets meet in the first one that makes either firm. Sets that none
makes firm emit those of empty choices with the last. So there is no chance to miss a link, but that of 64-bit hashes of shingles.

1. Documents are read once for fingerprints; equal sets become one class. Read again, each class is signed once a task.
2. A batch of signatures is combined where it was made: those that two classes have in the batch are known to be a bucket's, and go on apart from
   the rest, which has each signature once. So one signature of a third of all classes is one entry a batch in the exchange.
3. One exchange by ranges of signatures, as packed arrays: 48 bits of a signature and a short number of its class. A task sorts a range of about `TASK` signatures
   and keeps those of two classes; the others, nearly all, end there. (48 bits and the range: signatures that agree by chance make candidates, no links.)
4. Buckets of the same classes count once. They are linked, confirmed on full sets, and brought to components as in `minmax_dedup`. Pairs are tried on counts first: a class has
   the number of its elements in each of `CELLS` cells, and two sets differ in no less than their counts do in all, so what differs in more than a link allows is none. Members that
   stay apart are compared in blocks, on counts first, then on full sets; a family of them that lies in many buckets is compared as one.

Null and empty texts and texts without words have an empty set and are linked with nothing. A null id comes after all others. Repeated rows each get
their row. Empty tables give empty results; extra columns are ignored. Ids are whole numbers (or cast to them).
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import textkit
from lodestrata.llm._shared import map_batches, skew_join, table, written
from lodestrata.llm.graph import components
from lodestrata.llm.minmax_dedup import _NO_ID, DEN, WIDTH, _compare, _dealt, _matrix, _rows, _Search, _still_open

NUM = 80
#: Partitionings that a set may be signed with before it emits empty choices.
SEEDS = 6
#: Cells in which a class's elements are counted, a byte each.
CELLS = 256
#: Signatures that are combined at once, and those of a range of the exchange.
COMBINED, TASK = 1 << 20, 1 << 21
_U = np.uint64
_ODD = np.random.default_rng(80).integers(1 << 63, size=64, dtype=np.uint64) * _U(2) + _U(1)


@functools.cache
def instances(num: int = NUM, largest: int = 1 << 40) -> list[tuple[int, int, int, int, int]]:
    """(lowest size of the band, k, n1, n2, k2) of each band, from the smallest size that can be linked with another set."""
    differ = lambda size: (DEN - num) * 2 * size // (DEN + num)
    low, out = next(s for s in itertools.count(1) if differ(s)), []
    while low <= largest:
        high = max(low, low * DEN // num - 1)
        k = differ(high)
        out.append((low, k, *_plan(k, -(-num * low // DEN))))
        low = high + 1
    return out


def _plan(k: int, smallest: int) -> tuple[int, int, int]:
    """The (n1, n2, k2) with fewest signatures that leave a signature 2.5 elements of the smallest set, and nine in ten of such sets firm."""
    best = None
    for n2, k2 in ((2, 1), (3, 1), (4, 1), (5, 1), (4, 2), (5, 2), (6, 2), (6, 3), (7, 3)):
        n1 = k // (k2 + 1) + 1
        while True:
            cell = smallest / (n1 * n2)
            full = 1 - np.exp(-cell)
            held = np.arange(n2 + 1)
            p = np.array([_choose(n2, h) * full**h * (1 - full) ** (n2 - h) for h in held])
            worth = np.minimum(held, k2 + 1)
            mean = (p * worth).sum()
            spread = (n1 * ((p * worth**2).sum() - mean**2)) ** 0.5
            if n1 * mean - 1.3 * spread > k or n1 > 2 * k + 4:
                break
            n1 += 1 + n1 // 64
        if cell * (n2 - k2) >= 2.5 and n1 <= 2 * k + 4 and (best is None or n1 * _choose(n2, k2) < best[0]):
            best = (n1 * _choose(n2, k2), n1, n2, k2)
    return best[1:] if best else (k // 2 + 1, 5, 1)


def _choose(n: int, k: int) -> int:
    return len(list(itertools.combinations(range(n), k)))


def signatures(hashes: np.ndarray, bounds: np.ndarray, num: int = NUM) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set) of sets of distinct hashes; set i is hashes[bounds[i]:bounds[i + 1]]."""
    n, known = np.diff(bounds), instances(num)
    lows = np.array([x[0] for x in known])
    band = np.searchsorted(lows, n, "right") - 1
    found, of = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for i in range(int(band.max(initial=-1)) + 2):
        if i >= len(known):
            break
        own = np.flatnonzero((band == i) | ((band < i) & (DEN * n >= num * lows[i])))
        for seed in range(SEEDS):
            if not len(own):
                break
            sign, which, firm = _sign(hashes, bounds, own, i, known[i], seed)
            found.append(sign), of.append(which)
            own = own[~firm]
    return np.concatenate(found), np.concatenate(of)


def _sign(hashes: np.ndarray, bounds: np.ndarray, own: np.ndarray, i: int, plan: tuple[int, int, int, int, int], seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    _, k, n1, n2, k2 = plan
    n, cells = (bounds[1:] - bounds[:-1])[own], n1 * n2
    before = np.concatenate([[0], np.cumsum(n)])
    h = hashes[np.arange(before[-1]) + np.repeat(bounds[:-1][own] - before[:-1], n)]
    h = textkit.mix(h + _ODD[seed])
    place = np.repeat(np.arange(len(own)) * cells, n) + (((h >> _U(32)) * _U(cells)) >> _U(32)).astype(np.int64)
    count = np.bincount(place, minlength=len(own) * cells).reshape(len(own), n1, n2) > 0
    total = np.zeros(len(own) * cells, _U)
    np.add.at(total, place, textkit.mix(h * _ODD[16 + seed]))
    total = total.reshape(len(own), n1, n2)
    firm = np.minimum(count.sum(axis=2), k2 + 1).sum(axis=1) > k
    part = (np.arange(n1, dtype=_U) + _U(1)) * _ODD[32] + _tag((33, i), (34, seed))
    found, of = [], []
    for c, choice in enumerate(itertools.combinations(range(n2), n2 - k2)):
        here = (total[:, :, choice] * _ODD[40 + np.array(choice)]).sum(axis=2, dtype=_U)
        kept = count[:, :, choice].any(axis=2)
        if seed == SEEDS - 1:
            kept |= ~firm[:, None]
        row, at = np.nonzero(kept)
        found.append(textkit.mix(textkit.mix(here[row, at]) + part[at] + _tag((35, c)))), of.append(own[row])
    return np.concatenate(found), np.concatenate(of), firm


def _tag(*terms: tuple[int, int]) -> np.uint64:
    return _U(sum((x + 1) * int(_ODD[place]) for place, x in terms) % (1 << 64))


def _names(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set; zeros for empty ones."""
    a, b = np.zeros((2, len(bounds) - 1), np.int64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        at = bounds[:-1][full]
        a[full] = np.add.reduceat(textkit.mix(hashes), at).view(np.int64)
        b[full] = np.bitwise_xor.reduceat(textkit.mix(hashes * _ODD[50]), at).view(np.int64)
    return a, b


def _counts(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sets by CELLS: how many elements of each set are in each cell, at most 255."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    cell = (textkit.mix(hashes * _ODD[51]) >> _U(56)).astype(np.int64)
    found = np.bincount(row * CELLS + cell, minlength=(len(bounds) - 1) * CELLS).reshape(-1, CELLS)
    return np.minimum(found, 255).astype(np.uint8)


def _may_be(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, num: int) -> np.ndarray:
    """Whether counts x and y (rows) of sets of nx and ny elements allow a link."""
    apart = np.abs(x.astype(np.int16) - y.astype(np.int16)).sum(axis=-1, dtype=np.int64)
    return apart * (DEN + num) <= (DEN - num) * (nx + ny)


def _plausible(num: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                keep = _may_be(_matrix(part.column("su")), _matrix(part.column("sv")), part.column("nu").to_numpy(), part.column("nv").to_numpy(), num)
                yield part.select(["u", "v"]).filter(pa.array(keep))

    return run


def _alive(rows: pa.RecordBatch, _: int, num: int) -> tuple[list[int], list[int]]:
    """(key, node) of the members of a block whose counts allow a link with one of another component."""
    part, mine, n = (rows.column(c).to_numpy() for c in ("part", "mine", "n"))
    counts, found = _matrix(rows.column("sketch")), np.zeros(len(n), bool)
    left, right = np.flatnonzero(mine == rows.column("i")[0].as_py()), np.flatnonzero(mine == rows.column("j")[0].as_py())
    for x in left:
        ys = right[part[right] != part[x]]
        ys = ys[DEN * np.minimum(n[ys], n[x]) >= num * np.maximum(n[ys], n[x])]
        may = ys[_may_be(counts[ys], counts[x][None, :], n[ys], n[x], num)]
        found[may] = True
        found[x] |= len(may) > 0
    nodes = rows.column("node").to_numpy()[found].tolist()
    return [rows.column("key")[0].as_py()] * len(nodes), nodes


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, hashes, bounds in textkit.shingle_sets(batch.column(2), WIDTH):
            a, b = _names(hashes, bounds)
            part = batch.slice(first, len(a))
            sketch = pa.array([c.tobytes() for c in _counts(hashes, bounds)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(bounds).astype(np.int64)), pa.array(a), pa.array(b), sketch], names=["id", "th", "n", "a", "b", "sketch"])


_PACKED = "range int, met boolean, sigs binary, at binary, nodes binary"


def _key(low: np.ndarray, range_: np.ndarray | int) -> np.ndarray:
    """The name of a bucket from 48 bits of its signature and its range."""
    return textkit.mix(low + np.asarray(range_).astype(_U) * _ODD[36]).view(np.int64)


def _signed(num: int, ranges: int):
    """Rows of _PACKED: entries of one range, in order; met rows have names of buckets, that two classes are known to have, in any range."""

    def packed(range_: int, met: bool, values: np.ndarray, node: np.ndarray) -> tuple:
        names, at = np.unique(node, return_inverse=True)
        raw = values.tobytes() if met else np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
        return range_, met, raw, at.astype(np.uint16 if len(names) <= 1 << 16 else np.uint32).tobytes(), names.tobytes()

    def combined(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        sig, node = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        first = np.r_[True, sig[1:] != sig[:-1]][: len(sig)]
        differs = first | np.r_[True, node[1:] != node[:-1]][: len(sig)]
        sig, node, first = sig[differs], node[differs], first[differs]
        range_, low = (((sig >> _U(32)) * _U(ranges)) >> _U(32)).astype(np.int64), sig & _U((1 << 48) - 1)
        several = ~first | np.r_[~first[1:], False][: len(sig)]
        rows = []
        if several.any():
            rows.append(packed(int(low[0] % _U(ranges)), True, _key(low[several], range_[several]), node[several]))
        low, node, range_ = low[first], node[first], range_[first]
        cuts = np.r_[0, np.flatnonzero(range_[1:] != range_[:-1]) + 1, len(range_)]
        rows += [packed(int(range_[i]), False, low[i:j], node[i:j]) for i, j in zip(cuts[:-1], cuts[1:]) if j > i]
        types = {"range": pa.int32(), "met": pa.bool_(), "sigs": pa.binary(), "at": pa.binary(), "nodes": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types.values())], names=list(types))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], None] = {}
        held, size = [], 0
        for batch in batches:
            for _, hashes, bounds in textkit.shingle_sets(batch.column(0), WIDTH):
                a, b = _names(hashes, bounds)
                new = []
                for i, key in enumerate(zip(a.tolist(), b.tolist())):
                    if key not in seen and bounds[i + 1] > bounds[i]:
                        seen[key] = None
                        new.append(i)
                while len(seen) > 200_000:
                    seen.pop(next(iter(seen)))
                own = np.array(new, np.int64)
                n = np.diff(bounds)[own]
                cut = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
                sig, which = signatures(hashes[np.arange(cut[-1]) + np.repeat(bounds[own] - cut[:-1], n)], cut, num)
                if len(sig):
                    held.append((sig, a[own][which]))
                    size += len(sig)
                if size > COMBINED:
                    yield combined(held)
                    held, size = [], 0
        if held:
            yield combined(held)

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node) of buckets of two classes, from rows of _PACKED in order of range; one range is held at a time."""
    names = ["key", "node"]
    range_, low, node = None, [], []

    def done() -> pa.RecordBatch:
        sig, of = np.concatenate(low), np.concatenate(node)
        order = np.argsort(sig, kind="stable")
        sig, of = sig[order], of[order]
        cuts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        least, most = np.minimum.reduceat(of, cuts), np.maximum.reduceat(of, cuts)
        kept = np.repeat(least != most, np.diff(np.r_[cuts, len(sig)]))
        low.clear(), node.clear()
        return pa.RecordBatch.from_arrays([pa.array(_key(sig[kept], range_)), pa.array(of[kept])], names=names)

    for batch in batches:
        for r, met, sigs, at, known in zip(*(c.to_pylist() for c in batch.columns)):
            n = len(sigs) // (8 if met else 6)
            of = np.frombuffer(known, np.int64)[np.frombuffer(at, np.uint16 if len(at) == 2 * n else np.uint32)]
            if met:
                for i in range(0, n, 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(sigs, np.int64)[i : i + (1 << 18)]), pa.array(of[i : i + (1 << 18)])], names=names)
                continue
            if r != range_ and low:
                yield done()
            range_ = r
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :6] = np.frombuffer(sigs, np.uint8).reshape(n, 6)
            low.append(wide.view("<u8").ravel()), node.append(of)
    if low:
        yield done()


class _PartEnum(_Search):
    def __init__(self, docs: DataFrame, key: str, text: str, num: int):
        self.rows, self.num, self.least, self.exact = _rows(docs, key, text), num, 0, True
        self.signed = written(map_batches(self.rows, _fingerprints, "id long, th long, n long, a long, b long, sketch binary"), "fingerprints")
        found = self.signed.where("n > 0").groupBy("a", "b").agg(F.min("id").alias("id"), F.min_by("th", "id").alias("th"), F.max("n").alias("n"), F.max("sketch").alias("sketch"))
        self.classes = written(found.withColumnRenamed("a", "node"), "classes")

    def members(self) -> DataFrame:
        """(key, node) of signatures that two classes or more have."""
        shingles = self.classes.agg(F.sum("n")).first()[0] or 0
        ranges = max(1, -(-shingles // TASK))
        rows = map_batches(self.rows.select("text"), _signed(self.num, ranges), _PACKED).repartition(ranges, "range").sortWithinPartitions("range")
        met = written(map_batches(rows, _met, "key long, node long").distinct(), "met")
        same = met.groupBy("key").agg(F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.count("*").alias("n"))
        one = same.groupBy("x", "y", "n").agg(F.min("key").alias("key")).select("key")  # sets that are alike share many signatures: buckets of the same classes count once
        return written(met.join(one, "key", "left_semi"), "buckets")

    def plausible(self, pairs: DataFrame) -> DataFrame:
        """Pairs (u, v) whose counts allow a link."""
        side = lambda x: self.classes.select(F.col("node").alias(x), F.col("n").alias("n" + x), F.col("sketch").alias("s" + x))
        return written(map_batches(pairs.join(side("u"), "u").join(side("v"), "v"), _plausible(self.num), "u long, v long"), "plausible")

    def left_over(self, members: DataFrame, labels: DataFrame) -> DataFrame:
        """(u, v): links between different components in a bucket; enough to join all such components."""
        placed = members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("part"))
        placed = written(_still_open(placed, 2), "open")  # two members have met in the star
        counts = self.classes.select("node", F.col("n"), "sketch")
        alive = map_batches(_dealt(placed, counts, ["n", "sketch"]), _compare(0, self.num, _alive), "u long, v long")
        alive = written(alive.select(F.col("u").alias("key"), F.col("v").alias("node")).distinct(), "alive")
        placed = self.regrouped(written(placed.drop("blocks").join(alive, ["key", "node"]), "apart"))
        placed = written(_still_open(placed, 1), "compared")
        sets = self.sets(placed.select("node").distinct()).withColumn("sketch", F.lit(b""))
        return written(map_batches(_dealt(placed, sets, ["hashes", "sketch"]), _compare(0, self.num), "u long, v long").distinct(), "left-over")

    def regrouped(self, placed: DataFrame) -> DataFrame:
        """Similar sets share many signatures, so what is left of a family of them lies in many buckets. Where that costs less pairs, all of it becomes one."""
        least = placed.groupBy("key").agg(F.min("node").alias("v"))
        family = written(components(placed.join(least, "key").select(F.col("node").alias("u"), "v")), "families").select("node", F.col("label").alias("family"))
        of = written(placed.join(family, "node"), "placed")
        squares = of.groupBy("family", "key").agg(F.count("*").alias("n")).groupBy("family").agg(F.sum(F.col("n").cast("double") ** 2).alias("apart"))
        whole = of.groupBy("family").agg((F.countDistinct("node").cast("double") ** 2).alias("whole"))
        chosen = squares.join(whole, "family").select("family", (F.col("whole") <= F.col("apart")).alias("one"))
        rows = skew_join(of, chosen, "family")
        return rows.select(F.when(F.col("one"), F.col("family")).otherwise(F.col("key")).alias("key"), "node", "part").distinct()


def jaccard_components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", num: int = NUM) -> DataFrame:
    """One row per row of docs: key, n_shingles, component_id; linked if 100 * intersection >= num * union of 5-word shingle sets."""
    found = _PartEnum(docs, key, text, num).decided()
    real = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return found.select(real("id").alias(key), F.col("n").alias("n_shingles"), real("top").alias("component_id"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of `documents` linked at 0.8: doc_id, n_shingles, component_id."""
    return jaccard_components(table(spark, sf_dir, "documents"))
