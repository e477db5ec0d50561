"""Near-duplicate documents by min-max hashing.

A document's set holds its distinct 5-word shingles (words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased). Each of
`PERMUTATIONS` permutations of 32-bit values gives two signature entries, its minimum and its maximum over the
set; each is equal for two sets with the probability of their similarity, so half the hash evaluations
are needed. Bands of `ROWS` entries are hashed to bucket keys. Sets of at most `SMALL` shingles get as many bands again from
other permutations, as minimum and maximum of one permutation depend on each other there.

1. Documents are read once: set fingerprint (128 bits), size, band keys, and a sketch of 8 bits an entry.
   Equal sets are one class; classes are what is linked.
2. Each bucket of two classes or more links its members with its center: the class with most company in all
   its buckets, which in a group of copies is the text that was copied. Links whose sketches agree too
   little for a similarity of 0.75 (five standard deviations) are put aside; the rest are confirmed on
   full sets from whole texts.
3. What is left are buckets whose members are in different components. Of these members, only those stay that share a prefix
   shingle with a member of another component: shingles are ordered by how common they are, the rarest first, and two sets linked at
   0.75 share one among the first quarter of each. So texts that have common passages alone in common go, however many they are.
   The rest are compared in blocks of `BLOCK`: sizes and sketches first, then full sets. Pairs that join components
   not yet joined in the block are links.
4. The component's first document is the one with the smallest id.

Classes are named by 64 bits of their fingerprint; two of n different sets share a name with a chance of about
n * n / 2**65. Shingles are 64-bit hashes. So only classes that may be similar make rows of pairs, and a hot bucket is dealt in blocks.
The chance to miss a link at 0.75 exactly is about 2e-6 by banding and 3e-7 by sketches, less above. With `exact=True` the buckets are prefix shingles
of all classes instead of bands, and sketches turn nothing away: no link is missed, at the cost of more buckets.

Ids are whole numbers (or cast to them). Null or empty texts and texts without words have an empty set and are linked with nothing. A null
id comes after all others. Rows that repeat id and text are one class; `near_duplicates` gives each its row, `drop_near_duplicates` keeps one.
Empty tables give empty results. Extra columns are carried by `drop_near_duplicates`, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import textkit
from lodestrata.llm._shared import drop_rows, hash_filter, map_batches, skew_join, table, text_or_empty, with_filter, written
from lodestrata.llm.graph import components

WIDTH, ROWS, BANDS = 5, 5, 48
PERMUTATIONS = ROWS * BANDS // 2
NUM, DEN = 75, 100  # linked if DEN * intersection >= NUM * union
#: Entries that agree at least in sketches of sets at the threshold: the mean less five standard deviations.
AGREE = int(ROWS * BANDS * 0.75 - 5 * (ROWS * BANDS * 0.75 * 0.25) ** 0.5)
BLOCK = 512
SMALL = 32
#: Most shingles whose count is told to every task, 16 bytes each; the order of the others is by hash alone, which costs time, not links.
FREQUENT = 1 << 18

_RNG = np.random.default_rng(75)
_MULTIPLY = _RNG.integers(1 << 31, size=2 * PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FLIP = _RNG.integers(1 << 32, size=2 * PERMUTATIONS, dtype=np.uint32)
_BAND = _RNG.integers(1 << 63, size=(ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _RNG.integers(1 << 63, size=2 * BANDS, dtype=np.uint64)


def signatures(hashes: np.ndarray, bounds: np.ndarray, more: bool = False) -> np.ndarray:
    """Minimum and maximum of each permutation (with `more`, of the other ones) over each set (none empty): sets x 2 * PERMUTATIONS."""
    h, starts = (hashes >> np.uint64(32)).astype(np.uint32), bounds[:-1]
    out = np.empty((2 * PERMUTATIONS, len(starts)), np.uint32)
    for j in range(PERMUTATIONS):
        k = j + more * PERMUTATIONS
        x = (h ^ _FLIP[k]) * _MULTIPLY[k]
        np.minimum.reduceat(x, starts, out=out[2 * j])
        np.maximum.reduceat(x, starts, out=out[2 * j + 1])
    return out.T


def band_keys(signature: np.ndarray, more: bool = False) -> np.ndarray:
    cut = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    return textkit.mix((cut @ _BAND)[:, :, 0] + _SALT[more * BANDS : (1 + more) * BANDS]).view(np.int64)


def sketch(signature: np.ndarray) -> np.ndarray:
    x = signature ^ (signature >> np.uint32(15))
    return ((x * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


_SIGNED = "id long, th long, n long, a long, b long, bands array<long>, sketch binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[tuple[int, int], None] = {}
    for batch in batches:
        for first, hashes, bounds in textkit.shingle_sets(batch.column(2), WIDTH):
            n = np.diff(bounds)
            full = np.flatnonzero(n)
            a, b = np.zeros((2, len(n)), np.int64)
            keys, short = np.zeros((len(full), BANDS), np.int64), np.zeros((len(full), ROWS * BANDS), np.uint8)
            if len(full):
                at = np.append(bounds[:-1][full], bounds[-1])
                a[full] = np.add.reduceat(textkit.mix(hashes), at[:-1]).view(np.int64)
                b[full] = np.bitwise_xor.reduceat(textkit.mix(hashes * np.uint64(0x9E3779B97F4A7C15)), at[:-1]).view(np.int64)
                signature = signatures(hashes, at)
                keys, short = band_keys(signature), sketch(signature)
            more = {}
            if len(few := np.flatnonzero((n > 0) & (n <= SMALL))):
                cut = np.concatenate([[0], np.cumsum(n[few])])
                own = np.repeat(bounds[few] - cut[:-1], n[few]) + np.arange(cut[-1])
                more = dict(zip(few.tolist(), band_keys(signatures(hashes[own], cut, True), True)))
            bands, sketches = [None] * len(n), [None] * len(n)
            for k, i in enumerate(full):  # a class is signed once in a task
                if (key := (int(a[i]), int(b[i]))) not in seen:
                    seen[key] = None
                    bands[i], sketches[i] = np.concatenate([keys[k], more[i]]) if i in more else keys[k], short[k].tobytes()
            while len(seen) > 200_000:
                seen.pop(next(iter(seen)))
            part = batch.slice(first, len(n))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(n.astype(np.int64)), pa.array(a), pa.array(b), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                names=["id", "th", "n", "a", "b", "bands", "sketch"],
            )


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    t = text_or_empty(text)
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(t).alias("th"), t.alias("text"))


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x == y).sum(axis=1, dtype=np.int32)


def _matrix(column: pa.Array) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    return raw.reshape(len(column), len(raw) // max(len(column), 1))


def _sizes_fit(x: np.ndarray, y: np.ndarray, num: int) -> np.ndarray:
    return DEN * np.minimum(x, y) >= num * np.maximum(x, y)


def _may_link(least: int, num: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                keep = _sizes_fit(part.column("nu").to_numpy(), part.column("nv").to_numpy(), num)
                keep &= _agree(_matrix(part.column("su")), _matrix(part.column("sv"))) >= least
                yield part.select(["u", "v"]).filter(pa.array(keep))

    return run


def _confirm(batches: Iterator[pa.RecordBatch], num: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            texts = pa.concat_arrays([part.column("tu").cast(pa.large_string()), part.column("tv").cast(pa.large_string())])
            codes = texts.dictionary_encode()
            sets: list[np.ndarray] = []
            for _, hashes, bounds in textkit.shingle_sets(codes.dictionary, WIDTH):
                sets += [hashes[bounds[k] : bounds[k + 1]] for k in range(len(bounds) - 1)]
            code, n = codes.indices.to_numpy(), part.num_rows
            keep = np.zeros(n, bool)
            for k in range(n):
                x, y = sets[code[k]], sets[code[n + k]]
                if len(x) > len(y):
                    x, y = y, x
                both = _common(x, y)
                keep[k] = both > 0 and DEN * both >= num * (len(x) + len(y) - both)
            yield part.select(["u", "v"]).filter(pa.array(keep))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted shingle hashes of each text."""
    for batch in batches:
        for first, hashes, bounds in textkit.shingle_sets(batch.column(1), WIDTH):
            lists = pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(lists)), lists], names=["node", "hashes"])


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds) of a list column."""
    bounds = column.offsets.to_numpy()
    return column.values.to_numpy()[bounds[0] : bounds[-1]], bounds - bounds[0]


def _prefixes(common: np.ndarray, rank: np.ndarray, num: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(node, h): the first shingles of each set, so many that any set linked with it has one of them among its own first ones.

    The order is by rank of the sorted `common` hashes, 0 for others, then by hash: the same for all sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, bounds = _lists(batch.column(1))
            n = np.diff(bounds)
            row, level = np.repeat(np.arange(len(n)), n), np.zeros(len(value), np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, value), len(common) - 1)
                level = np.where(common[at] == value, rank[at], 0)
            order = np.lexsort((value, level, row))
            first = order[np.arange(len(value)) - np.repeat(bounds[:-1], n) < np.repeat(n + num * n // -DEN + 1, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[first])), pa.array(value[first])], names=["node", "h"])

    return run


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Values of sorted x that are in sorted y."""
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(y) else 0


def _block(rows: pa.RecordBatch, least: int, num: int) -> tuple[list[int], list[int]]:
    node, part, mine = (rows.column(c).to_numpy() for c in ("node", "part", "mine"))
    value, bounds = _lists(rows.column("hashes"))
    value = value.view(np.uint64)
    n, s = np.diff(bounds), _matrix(rows.column("sketch"))
    own = lambda k: value[bounds[k] : bounds[k + 1]]
    i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
    left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
    joined = part.copy()
    u, v = [], []
    for x in left:
        ys = right[right > x] if i == j else right
        ys = ys[(joined[ys] != joined[x]) & _sizes_fit(n[ys], n[x], num)]
        if not len(ys):
            continue
        agree = _agree(s[ys], s[x][None, :])
        ys = ys[np.argsort(-agree, kind="stable")[: int((agree >= least).sum())]]
        for y in ys:
            if joined[x] != joined[y]:
                both = _common(own(x), own(y))
                if DEN * both >= num * (int(n[x]) + int(n[y]) - both):
                    u.append(min(node[x], node[y])), v.append(max(node[x], node[y]))
                    joined[joined == joined[y]] = joined[x]
    return u, v


def _compare(least: int, num: int, block: Callable = _block) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(u, v) that `block` finds in each block. Blocks come in order of (key, i, j); one is held at a time."""

    def ends(b: pa.RecordBatch) -> tuple:
        return tuple(b.column(c)[0].as_py() for c in ("key", "i", "j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            u, v = block(pa.Table.from_batches(held).combine_chunks().to_batches()[0], least, num)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")])
            cuts = np.r_[0, np.flatnonzero((names[:, 1:] != names[:, :-1]).any(0)) + 1, batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                part = batch.slice(a, b - a)
                if held and ends(held[0]) != ends(part):
                    yield done()
                held.append(part)
        if held:
            yield done()

    return run


#: Stands for a null id, which comes after all others.
_NO_ID = (1 << 63) - 1


def _still_open(placed: DataFrame, more_than: int) -> DataFrame:
    """Rows of buckets with several components, and the bucket's number of blocks."""
    found = placed.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("size")).where(f"lo <> hi and size > {more_than}")
    return skew_join(placed, found.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "key")


def _dealt(placed: DataFrame, with_: DataFrame, columns: list[str]) -> DataFrame:
    """Members of open buckets with the columns of `with_`, in blocks (key, i, j), each pair of members in one of them."""
    mine = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    ij = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, mine).alias("i"), F.greatest(k, mine).alias("j")))
    dealt = placed.withColumn("mine", mine).select("key", "node", "part", "mine", F.explode(ij).alias("ij")).select("key", "ij.i", "ij.j", "mine", "node", "part")
    dealt = dealt.join(with_, "node").select("key", "i", "j", "mine", "node", "part", *columns)
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


class _Search:
    """The tables of one run, all in the shared folder. Linked if DEN * intersection >= num * union."""

    num = NUM

    def __init__(self, docs: DataFrame, key: str, text: str, exact: bool = False):
        self.rows, self.exact, self.least = _rows(docs, key, text), exact, 0 if exact else AGREE
        self.signed = written(map_batches(self.rows, _sign, _SIGNED), "signed")
        found = self.signed.where("n > 0").groupBy("a", "b").agg(F.min("id").alias("id"), F.min_by("th", "id").alias("th"), F.max("n").alias("n"), F.max("sketch").alias("sketch"))
        self.classes = written(found.withColumnRenamed("a", "node"), "classes")

    def members(self) -> DataFrame:
        """(key, node) of buckets with two classes or more."""
        if self.exact:
            band = self.prefixes(self.sets(self.classes.select("node"))).select(F.col("h").alias("key"), "node")
        else:
            band = self.signed.where("bands is not null").select(F.explode("bands").alias("key"), F.col("a").alias("node"))
        several = band.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key")
        return written(skew_join(band, several, "key").distinct(), "buckets")

    def star(self, members: DataFrame) -> DataFrame:
        """(u, v): each bucket's members with its center, the class whose buckets have most members in all."""
        company = skew_join(members, members.groupBy("key").agg(F.count("*").alias("size")), "key").groupBy("node").agg(F.sum("size").alias("company"))
        center = members.join(company, "node").groupBy("key").agg(F.max(F.struct("company", "node"))["node"].alias("center"))
        pairs = skew_join(members, center, "key").where("node <> center")
        return written(pairs.select(F.least("node", "center").alias("u"), F.greatest("node", "center").alias("v")).distinct(), "star")

    def plausible(self, pairs: DataFrame) -> DataFrame:
        """Pairs (u, v) whose sizes and sketches agree enough."""
        side = lambda x: self.classes.select(F.col("node").alias(x), F.col("n").alias("n" + x), F.col("sketch").alias("s" + x))
        return written(map_batches(pairs.join(side("u"), "u").join(side("v"), "v"), _may_link(self.least, self.num), "u long, v long"), "plausible")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Those of the written pairs (u, v) that are linked, by the sets of whole texts."""
        nodes = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
        texts = written(self.texts(nodes), "texts")
        side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias("t" + x))
        return written(map_batches(pairs.join(side("u"), "u").join(side("v"), "v"), functools.partial(_confirm, num=self.num), "u long, v long").distinct(), "confirmed")

    def texts(self, nodes: DataFrame) -> DataFrame:
        """(node, text) of the nodes, once each: of all documents only the texts that pass a filter of 8 MB are moved."""
        needed = written(nodes.join(self.classes, "node").select("node", "id", "th"), "needed")
        some = with_filter(self.rows, "th", hash_filter(needed, "th"), "maybe").where("maybe")
        some = some.groupBy("id", "th").agg(F.first("text").alias("text"))  # rows that repeat id and text
        return some.join(needed.hint("merge"), ["id", "th"]).select("node", "text")

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, hashes) of the nodes: sorted shingle hashes."""
        return written(map_batches(self.texts(nodes), _sets, "node long, hashes array<long>"), "sets")

    def prefixes(self, sets: DataFrame) -> DataFrame:
        """(node, h): the prefix shingles of sets. At most FREQUENT counts, of the most common shingles, come to the driver."""
        counts = written(sets.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n >= 2"), "counts")
        levels = counts.groupBy(F.floor(F.log2("n")).alias("level")).count().orderBy(F.desc("level")).collect()  # 60 rows at most
        total, least = 0, 1 << 62
        for r in levels:
            total += r["count"]
            if total > FREQUENT:
                break
            least = 1 << r["level"]
        common = counts.where(F.col("n") >= least).orderBy("n", "h").toArrow()
        h = common["h"].to_numpy()
        by_hash = np.argsort(h)
        shared, num = self.rows.sparkSession.sparkContext.broadcast((h[by_hash], by_hash + 1)), self.num

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _prefixes(*shared.value, num)(batches)

        return map_batches(sets, run, "node long, h long")

    def regrouped(self, placed: DataFrame) -> DataFrame:
        """The rows (key, node, part) of open buckets, or of others in which all pairs of these meet too."""
        return placed

    def left_over(self, members: DataFrame, labels: DataFrame) -> DataFrame:
        """(u, v): links between different components in a bucket; enough to join all such components."""

        placed = members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("part"))
        placed = written(self.regrouped(_still_open(placed, 2).drop("blocks")), "open")  # two members have met in the star
        nodes = placed.select("node", "part").distinct()
        sets = self.sets(nodes.select("node"))
        first = written(self.prefixes(sets).join(nodes, "node"), "prefixes")
        shared = first.groupBy("h").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("h")
        alive = written(skew_join(first, shared, "h").select("node").distinct(), "alive")
        placed = written(_still_open(placed.join(alive, "node"), 1), "compared")
        sets = sets.join(placed.select("node").distinct(), "node").join(self.classes.select("node", "sketch"), "node")
        dealt = _dealt(placed, sets, ["hashes", "sketch"])
        return written(map_batches(dealt, _compare(self.least, self.num), "u long, v long").distinct(), "left-over")

    def labels(self) -> DataFrame:
        """(node, label) of all classes that are linked."""
        members = self.members()
        links = self.confirmed(self.plausible(self.star(members)))
        labels = written(components(links), "labels")
        more = self.left_over(members, labels)
        return written(components(links.union(more)), "labels") if more.limit(1).count() else labels

    def decided(self) -> DataFrame:
        """Every row's id, th and n, and top and top_th, id and text hash of the first document of its component."""
        placed = written(self.labels().join(self.classes.select("node", "id", "th"), "node"), "placed")
        least = placed.groupBy("label").agg(F.min("id").alias("top"), F.min_by("th", "id").alias("top_th"))
        firsts = skew_join(placed, least, "label").select("node", "top", "top_th")
        whole = self.classes.select("node", "b", "id", "th").join(firsts, "node", "left")
        whole = whole.select(F.col("node").alias("a"), "b", F.coalesce("top", "id").alias("top"), F.coalesce("top_th", "th").alias("top_th"))
        rows = self.signed.select("id", "th", "n", "a", "b")
        alone = rows.where("n = 0").select("id", "th", "n", F.col("id").alias("top"), F.col("th").alias("top_th"))
        return rows.where("n > 0").join(whole, ["a", "b"]).select("id", "th", "n", "top", "top_th").unionByName(alone)


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", exact: bool = False) -> DataFrame:
    """One row per row of docs: key, n_shingles, component_id, kept."""
    found = _Search(docs, key, text, exact).decided()
    real = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return found.select(real("id").alias(key), F.col("n").alias("n_shingles"), real("top").alias("component_id"), (F.col("id") == F.col("top")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", exact: bool = False) -> DataFrame:
    """The rows of docs that are first in their component, with all their columns."""
    found = _Search(docs, key, text, exact).decided()
    pairs = found.groupBy("id", "th").agg(F.bool_and((F.col("id") == F.col("top")) & (F.col("th") == F.col("top_th"))).alias("one"), F.count("*").alias("rows"))
    listed = written(pairs.where("not one or rows > 1").select("id", "th", "one"), "listed")
    return drop_rows(docs, listed, F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID)), text)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of `documents`: doc_id, n_shingles, component_id, kept."""
    return near_duplicates(table(spark, sf_dir, "documents"))
