"""Alignment of the tokens that two tokenizers make of one text, by products of token-byte incidence matrices.

A is a byte-level BPE on space+text, B a piece model on the text (it adds that space itself). Both are sequences of byte ranges of
space+text. `Csr` rows are tokens, columns are bytes: A times B transposed has the overlap in bytes of each pair of tokens (overlap
links). Offsets where tokens of both end cut the bytes into groups; with rows as tokens and columns as groups the product has the
pairs in one group (shared-group links). Overlap links whose ranges end together are end links.

1. A text is cut where neither tokenizer can have a token across: before white space that follows a character that every pattern
   engine takes for none. Chunks are aligned once, many in one block-diagonal matrix, and kept in a bounded memo; a text is then a
   join of its chunks' results. Chunks of any length are whole, none is cut by size.
2. Tasks keep, per text, the distinct pairs of ids that its end links hold, with their number, and hand on the sum of these over the task.
3. A pair of ids can end together only if one's bytes end with the other's, so the two vocabularies bound the number of
   different pairs (`most_pairs`), whatever the corpus is. The sums by pair are broadcast with that bound, and each text's row is completed
   where it lies. No text and no occurrence is shuffled.

Texts that are null or empty, and texts whose tokens' bytes are not space+text (as when the text has U+2581), have no tokens. Special
tokens' strings are plain text. Repeated rows each count and each get their row; null ids stay null. Empty tables give no rows; extra columns are
carried by `alignments` and ignored by `pair_statistics`.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm._shared import map_batches, table, unused, written
from lodestrata.llm.incidence import Csr, product
from lodestrata.llm.tokens import byte_alphabet

A_TOKENIZER, B_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Most chunks in the memo of a worker (about 400 bytes each), and the longest chunk that goes into it.
MEMO, LONGEST = 300_000, 64
#: Bytes of texts that are aligned at once; a longer text is alone.
RUN = 1 << 20
_SOLID = "!-~¡-¬®-ɏΑ-ΡΣ-ωА-я–—‘-„…€一-龥"
_SPACES = " \t\n\r"
_CUT = re.compile(f"(?<=[{_SOLID}])(?=[{_SPACES}])")
#: The apostrophe is no sign here, as the pattern knows 's, 't and others.
_PLAIN = re.compile(r"([ \n])([A-Za-z]+)([!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]*)")
_WORD = re.compile(f"[{_SOLID}]+")
#: Entries have a group as `a1,a2;b1` and `|` between groups; a digest is of `a1,a2|b1;a3|b2,b3`.
_DIGESTED = bytes.maketrans(b";|", b"|;")
_CACHE: dict = {}


class Aligner:
    """Both tokenizers, the bytes of their ids, and the memo of chunks."""

    def __init__(self, a: str = A_TOKENIZER, b: str = B_TOKENIZER):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        path = lambda name: name if os.path.isabs(name) else public_tokenizers.path(name)
        self.a = Tokenizer.from_file(path(a))
        self.a.encode_special_tokens = True  # their strings are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path(b))
        known = {chr(c): v for v, c in byte_alphabet().items()}
        self.a_bytes = [bytes(known[c] for c in token) if set(token) <= known.keys() else token.encode() for token in map(self.a.id_to_token, range(self.a.get_vocab_size()))]
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces]
        self.a_size, self.b_size = (np.array([len(t) for t in tokens]) for tokens in (self.a_bytes, self.b_bytes))
        self.lead = self.b.piece_to_id("▁")
        self.model, self.space = self.a.model, chr(byte_alphabet()[32])
        self.newline = self.a.encode("\n", add_special_tokens=False).ids
        self.signs: dict[str, list[int]] = {}
        self.memo: dict[str, tuple] = {}

    @classmethod
    def shared(cls, a: str, b: str) -> Aligner:
        """One a worker process."""
        if (a, b) not in _CACHE:
            _CACHE[a, b] = cls(a, b)
        return _CACHE[a, b]

    def tokens(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids by A and B of chunks; B's space before a chunk is the chunk's own first character, or is taken off again."""
        a: list = [self._plain(c) for c in chunks]
        rest = [i for i, ids in enumerate(a) if ids is None]
        for i, found in zip(rest, self.a.encode_batch_fast([chunks[i] for i in rest], add_special_tokens=False)):
            a[i] = found.ids
        b = self.b.encode([c[1:] if c[:1] == " " else c for c in chunks], num_threads=1)
        return a, [ids if c[:1] == " " else ids[1:] if ids[:1] == [self.lead] else None for c, ids in zip(chunks, b)]

    def _plain(self, chunk: str) -> list[int] | None:
        """A's ids of white space, ASCII letters and signs: the tokenizer's pattern parts them so, and its model encodes each part."""
        if (parts := _PLAIN.fullmatch(chunk)) is None:
            return None
        space, letters, signs = parts.groups()
        ids = [t.id for t in self.model.tokenize(self.space + letters if space == " " else letters)]
        if signs:
            if signs not in self.signs:
                if len(self.signs) > 10_000:
                    self.signs.clear()
                self.signs[signs] = self.a.encode(signs, add_special_tokens=False).ids
            ids += self.signs[signs]
        return ids if space == " " else self.newline + ids

    def same_bytes(self, chunk: str, a: list[int], b: list[int] | None) -> bool:
        raw = chunk.encode()
        return b is not None and b"".join([self.a_bytes[i] for i in a]) == raw and b"".join([self.b_bytes[i] for i in b]) == raw

    def chunks(self, text: str) -> list[str]:
        """space+text in pieces that no token of either tokenizer crosses."""
        whole = " " + text
        if "\n" not in whole and "\t" not in whole and "\r" not in whole:
            parts = whole[1:].split(" ")
            if all(map(_WORD.fullmatch, parts)):
                return [" " + p for p in parts]
        return _CUT.split(whole)

    def aligned(self, chunks: list[str]) -> list[tuple | None]:
        """For each chunk (A tokens, B tokens, groups, their text, codes of end links); None if its tokens have other bytes."""
        a_ids, b_ids = self.tokens(chunks)
        raw = [c.encode() for c in chunks]
        whole = b"".join(raw)
        if None in b_ids or whole != self._bytes(self.a_bytes, a_ids) or whole != self._bytes(self.b_bytes, b_ids):
            good = [i for i, c in enumerate(chunks) if self.same_bytes(c, a_ids[i], b_ids[i])]
            if len(good) < len(chunks):
                found = iter(self.aligned([chunks[i] for i in good]) if good else ())
                kept = set(good)
                return [next(found) if i in kept else None for i in range(len(chunks))]
        n_a, n_b = list(map(len, a_ids)), list(map(len, b_ids))
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64, sum(n)) for ids, n in ((a_ids, n_a), (b_ids, n_b)))
        link = Alignment(self.a_size[a], self.b_size[b])
        codes = (a[link.ends[0]] * len(self.b_bytes) + b[link.ends[1]]).tobytes()
        a_text, b_text = (list(map(str, ids.tolist())) for ids in (a, b))
        edges_a, edges_b = (np.concatenate([[0], link.ends[side] + 1]).tolist() for side in (0, 1))
        groups = [",".join(a_text[p:q]) + ";" + ",".join(b_text[r:s]) for p, q, r, s in zip(edges_a, edges_a[1:], edges_b, edges_b[1:])]
        last = np.searchsorted(link.cuts, np.cumsum(list(map(len, raw))), "right").tolist()
        return [(x, y, j - i, "|".join(groups[i:j]), codes[8 * i : 8 * j]) for x, y, i, j in zip(n_a, n_b, [0, *last], last)]

    @staticmethod
    def _bytes(known: list[bytes], ids: list[list[int]]) -> bytes:
        return b"".join([known[i] for i in chain.from_iterable(ids)])

    def entries(self, texts: list[str]) -> list[list[tuple | None]]:
        """The chunks' results of each text."""
        cut, memo = [self.chunks(t) for t in texts], self.memo
        new = [c for c in dict.fromkeys(c for chunks in cut for c in chunks) if c not in memo]
        found: dict[str, tuple | None] = {}
        i = 0
        while i < len(new):
            j, size = i, 0
            while j < len(new) and (j == i or size + len(new[j]) <= RUN // 8):
                size += len(new[j])
                j += 1
            for c, e in zip(new[i:j], self.aligned(new[i:j])):
                if e is not None and len(memo) < MEMO and len(c) <= LONGEST:
                    memo[c] = e
                else:
                    found[c] = e
            i = j
        return [[memo[c] if c in memo else found[c] for c in chunks] for chunks in cut]


class Alignment:
    """Links of the tokens whose sizes in bytes are given, both in order over the same bytes."""

    def __init__(self, a_size: np.ndarray, b_size: np.ndarray):
        a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
        n = int(a_end[-1]) if len(a_end) else 0
        self.a, self.b = Csr.of_ranges(a_end - a_size, a_end, n), Csr.of_ranges(b_end - b_size, b_end, n)
        #: (A place, B place, bytes in common)
        self.overlaps = product(self.a, self.b.transposed()).entries()
        together = a_end[self.overlaps[0]] == b_end[self.overlaps[1]]
        #: places of A and B tokens whose ranges end together, in order
        self.ends = self.overlaps[0][together], self.overlaps[1][together]
        self.cuts = a_end[self.ends[0]]
        self._ends = a_end, b_end

    def shared(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(A place, B place, 1) of the pairs in one group."""
        of = [np.searchsorted(self.cuts, ends, "left") for ends in self._ends]
        a, b = (Csr.of_ranges(g, g + 1, len(self.cuts)) for g in of)
        return product(a, b.transposed()).entries()


def most_pairs(aligner: Aligner) -> int:
    """The most different pairs (A id, B id) that can end together: those where one's bytes end with the other's."""
    known = {}
    for t in aligner.b_bytes:
        known[t] = known.get(t, 0) + 1
    same = sum(known.get(t[k:], 0) for t in aligner.a_bytes for k in range(len(t)))
    known = {}
    for t in aligner.a_bytes:
        known[t] = known.get(t, 0) + 1
    return same + sum(known.get(t[k:], 0) for t in aligner.b_bytes for k in range(1, len(t)))


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= RUN):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


_STORED = "n_a long, n_b long, n_groups long, groups_sha256 string, codes array<long>, times array<long>, tally boolean"


def _store(a: str, b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, tally, type_ = Aligner.shared(a, b), (np.zeros(0, np.int64), np.zeros(0, np.int64)), None
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def settle() -> tuple[np.ndarray, np.ndarray]:
            codes, at = np.unique(np.concatenate([tally[0], *[c for c, _ in waiting]]), return_inverse=True)
            counts = np.zeros(len(codes), np.int64)
            np.add.at(counts, at, np.concatenate([tally[1], *[n for _, n in waiting]]))
            waiting.clear()
            return codes, counts

        def rows(ids: pa.Array, found: list[tuple], is_tally: bool) -> pa.RecordBatch:
            lists = [pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in (4, 5)]
            numbers = [pa.array([f[k] for f in found], pa.int64()) for k in range(3)]
            return pa.RecordBatch.from_arrays([ids, *numbers, pa.array([f[3] for f in found], pa.string()), *lists, pa.array([is_tally] * len(found))], names=["id", "n_a", "n_b", "n_groups", "groups_sha256", "codes", "times", "tally"])

        for batch in batches:
            type_ = batch.column(0).type
            texts = batch.column(1).fill_null("").to_pylist()
            for i, j in _runs(texts):
                found = []
                for text, entries in zip(texts[i:j], aligner.entries(texts[i:j])):
                    if None in entries and len(entries) > 1:  # held against the whole text
                        entries = aligner.aligned([" " + text])
                    if not text or None in entries:
                        found.append((0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)))
                        continue
                    n_a, n_b, n_groups, groups, codes = zip(*entries)
                    codes, times = np.unique(np.frombuffer(b"".join(codes), np.int64), return_counts=True)
                    found.append((sum(n_a), sum(n_b), sum(n_groups), hashlib.sha256("|".join(groups).encode().translate(_DIGESTED)).hexdigest(), codes, times))
                    waiting.append((codes, times))
                yield rows(batch.column(0).slice(i, j - i), found, False)
                if sum(len(c) for c, _ in waiting) > 1 << 20:
                    tally = settle()
        if waiting or len(tally[0]):
            tally = settle()
            yield rows(pa.nulls(1, type_), [(0, 0, 0, "", *tally)], True)

    return run


def pair_statistics(docs: DataFrame, *, key: str = "doc_id", text: str = "text", a: str = A_TOKENIZER, b: str = B_TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(one row per row of docs, one row per pair of ids).

    Rows: key, n_a, n_b, n_groups, n_links (end links), n_best (links whose pair is the most frequent of its B id, ties included), count_sum (over
    links, how many links of the corpus hold the pair), groups_sha256 (of `a1,a2|b1;a3|b2,b3`, ids by group). Pairs: a_id, b_id, n_links, best.
    """
    spark, names = docs.sparkSession, [f.split()[0] for f in _STORED.split(", ")]
    slim = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    stored = written(map_batches(slim, _store(a, b), T.StructType([T.StructField("id", slim.schema["id"].dataType), *T.StructType.fromDDL(_STORED)])), "aligned")
    sizes = Aligner.shared(a, b)
    n_b = len(sizes.b_bytes)
    counts = stored.where("tally").select(F.explode(F.arrays_zip("codes", "times")).alias("p")).groupBy(F.col("p.codes").alias("code")).agg(F.sum("p.times").alias("n_links"))
    counts = written(counts.withColumn("b_id", (F.col("code") % n_b).cast("int")), "pair-counts")
    most = counts.groupBy("b_id").agg(F.max("n_links").alias("most"))
    pairs = counts.join(most, "b_id").select(F.expr(f"int(code div {n_b})").alias("a_id"), "b_id", "n_links", (F.col("n_links") == F.col("most")).alias("best"), "code")
    held = pairs.select("code", "n_links", "best").orderBy("code").toArrow()  # most_pairs rows at most, 17 bytes each
    shared = spark.sparkContext.broadcast(tuple(held[c].to_numpy() for c in ("code", "n_links", "best")))

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, count, best = shared.value
        for batch in batches:
            codes, times = (batch.column(c) for c in ("codes", "times"))
            bounds = codes.offsets.to_numpy()
            at, n = np.searchsorted(code, codes.values.to_numpy()[bounds[0] : bounds[-1]]), times.values.to_numpy()[bounds[0] : bounds[-1]]
            total = lambda x: pa.array((c := np.concatenate([[0], np.cumsum(x)]))[bounds[1:] - bounds[0]] - c[bounds[:-1] - bounds[0]])
            columns = {c: batch.column(c) for c in ("id", "n_a", "n_b", "n_groups")} | {"n_links": total(n), "n_best": total(n * best[at]), "count_sum": total(n * count[at])}
            yield pa.RecordBatch.from_pydict(columns | {"groups_sha256": batch.column("groups_sha256")})

    out = T.StructType([stored.schema["id"], *T.StructType.fromDDL("n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")])
    rows = map_batches(stored.where("not tally").select(*["id", *names[:-1]]), complete, out)
    return rows.withColumnRenamed("id", key), pairs.drop("code")


def alignments(docs: DataFrame, *, text: str = "text", a: str = A_TOKENIZER, b: str = B_TOKENIZER) -> DataFrame:
    """docs with a_ids, b_ids and the links between their places: `overlaps` (a, b, bytes), `shared` (a, b) in one group, `ends` (a, b)."""
    place = "a:int,b:int"
    added = T.StructType.fromDDL(f"a_ids array<int>, b_ids array<int>, overlaps array<struct<{place},bytes:int>>, shared array<struct<{place}>>, ends array<struct<{place}>>")
    if taken := {c.lower() for c in docs.columns} & {f.name for f in added}:
        raise ValueError(f"the columns {sorted(taken)} are in the table already")
    own = unused([*docs.columns, *added.names], "aligned_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.shared(a, b)
        for batch in batches:
            for i in range(batch.num_rows):
                whole = batch.column(own)[i].as_py()
                row: dict = {f.name: [] for f in added}
                if whole:
                    a_ids, b_ids = (ids[0] for ids in aligner.tokens([" " + whole]))
                    if aligner.same_bytes(" " + whole, a_ids, b_ids):
                        link = Alignment(aligner.a_size[np.array(a_ids)], aligner.b_size[np.array(b_ids)])
                        named = lambda arrays, names: [dict(zip(names, map(int, x))) for x in zip(*arrays)]
                        row = {"a_ids": a_ids, "b_ids": b_ids, "overlaps": named(link.overlaps, ("a", "b", "bytes")), "shared": named(link.shared()[:2], ("a", "b")), "ends": named(link.ends, ("a", "b"))}
                rest = batch.slice(i, 1).select([c for c in batch.schema.names if c != own])
                new = pa.Table.from_pylist([row], schema=arrow_schema).combine_chunks()
                yield pa.RecordBatch.from_arrays([*rest.columns, *[c.chunk(0) for c in new.columns]], names=[*rest.schema.names, *new.column_names])

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_schema = to_arrow_schema(added)
    rows = docs.withColumn(own, F.coalesce(F.col(text).cast("string"), F.lit("")))
    return map_batches(rows, run, T.StructType([*docs.schema, *added]))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of both tokenizers' tokens in `documents`: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    return pair_statistics(table(spark, sf_dir, "documents"))[0]
