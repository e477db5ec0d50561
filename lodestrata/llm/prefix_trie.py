"""Prefix trie of conversations, by adaptive radix trees over fixed-width big-endian turn ids.

A turn's id is the first 16 bytes of SHA-256 over its role and text (two of n different turns share one with a chance of about n * n / 2**129), so a
conversation is a key of 16 bytes a turn, and a trie node is a prefix that ends at a multiple of 16 bytes.

1. Conversations become keys; equal ones are counted and become one key first, so copies need no place in a tree.
2. Keys are dealt by range, so a prefix that many share is cut over tasks. A task takes its keys in order, in runs of `RUN` bytes,
   and builds one radix tree a run. Only turn-aligned depths of its (compressed) paths emit nodes.
3. A node that is no prefix of its run's first or last key occurs in that run alone, and is whole. The nodes on these two paths, some for each run, may
   go on in other runs. They are merged by the hash of their prefix, and their sums over subtrees follow from suffix sums along
   the paths, where each node counts in the first path that has it. Whole nodes below such a node get its smallest member by path and depth.
4. Ids of the members that end at a node are joined in pieces where they lie in order, and the pieces are hashed one after the other.

Turns are ordered by turn (null first), then role, then id. Null role or text is empty; turns with a null id belong to no conversation and are
left out; repeated rows are repeated turns. Empty tables give no node. Extra columns are ignored. A conversation's key is one row (its texts are never
gathered), and holds up to 100 million turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm._shared import map_batches, skew_join, table, written
from lodestrata.llm.radix import Node, RadixTree

WIDTH = 16
#: Bytes of keys in one radix tree, and in the range of one task.
RUN, RANGE = 4 << 20, 64 << 20
#: Bytes of joined ids that are handed on at once.
PIECE = 1 << 20
_NOTHING = hashlib.sha256(b"").hexdigest()


def ordered_turns(turns: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turns): each conversation's turns in order, as structs of id (hex) and size (bytes of the text)."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    id_ = F.substring(F.sha2(F.concat(F.octet_length(said(role)).cast("string"), F.lit(":"), said(role), said(text)), 256), 1, 2 * WIDTH)
    each = F.struct(F.col(turn).alias("turn"), said(role).alias("role"), id_.alias("id"), F.octet_length(said(text)).cast("long").alias("size"))
    found = turns.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("conv")).agg(F.sort_array(F.collect_list(each)).alias("turns"))
    return found.select("conv", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("turns"))


def rebuilt(found: DataFrame) -> DataFrame:
    """Conversation c with the first h turns of c - c % 5 in place of its own first h; h is crc32 of c in decimal, modulo 9."""
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % 9).cast("int")
    found = written(found, "ordered")
    base = found.where("conv % 5 = 0").select(F.col("conv").alias("base"), F.slice("turns", 1, 8).alias("head"))
    rest = found.where("conv % 5 <> 0").withColumns({"base": F.col("conv") - F.col("conv") % 5, "h": h}).join(base, "base", "left")
    none = F.slice("turns", 1, 0)
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    rest = rest.select("conv", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), none), own).alias("turns"))
    return found.where("conv % 5 = 0").select("conv", "turns").unionByName(rest)


_TREE = "conv long, depth long, parent_conv long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, path long, node binary, parent binary, size long"


class TurnNodes:
    """The turn-aligned nodes of a tree in preorder, as lists; a node's parent stands before it. Values are (member, members, sizes, ends)."""

    def __init__(self, tree: RadixTree):
        for node in tree.upwards():  # (members, smallest one, sizes of any)
            found = [k.total for k in node.kids()] + ([(node.value[1], node.value[0], node.value[2])] if node.value is not None else [])
            node.total = (sum(f[0] for f in found), min(f[1] for f in found), found[0][2])
        self.depth, self.parent, self.n, self.conv, self.size, self.value = [0], [-1], [tree.root.total[0]], [tree.root.total[1]], [0], [tree.root.value]
        stack = [(k, 0, 0) for k in reversed(tree.root.kids())]
        while stack:
            node, start, above = stack.pop()
            end = start + len(node.path)
            n, conv, sizes = node.total
            for d in range(start // WIDTH + 1, end // WIDTH + 1):
                self.depth.append(d), self.parent.append(above), self.n.append(n), self.conv.append(conv), self.size.append(sizes[d - 1])
                self.value.append(node.value if d * WIDTH == end else None)
                above = len(self.depth) - 1
            stack += [(k, end, above) for k in reversed(node.kids())]

    def path_to(self, i: int) -> list[int]:
        """The places of node i and all above it, the root first."""
        out = []
        while i >= 0:
            out.append(i)
            i = self.parent[i]
        return out[::-1]

    def rows(self, first: bytes, last: bytes, path: int) -> Iterator[tuple]:
        """Rows of _TREE. Whole nodes have no `node`; partial ones, which are on the paths of the first and the last key, have one, and sums of the
        whole nodes below them alone. Nodes on both paths come again with the second, with nothing in them."""
        count = len(self.depth)
        sides = [self.path_to(next(i for i in range(count) if self.value[i] is not None)), self.path_to(count - 1)]
        side = dict.fromkeys(sides[1], path + 1) | dict.fromkeys(sides[0], path)
        kids, leaves, saved = [0] * count, [0] * count, [0] * count
        for i in range(count - 1, 0, -1):
            if i not in side:
                leaves[i] += not kids[i]
                saved[i] += (self.n[i] - 1) * self.size[i]
                up = self.parent[i]
                kids[up], leaves[up], saved[up] = kids[up] + 1, leaves[up] + leaves[i], saved[up] + saved[i]
        for i in range(count):
            if i not in side:
                ends, up = self.value[i][3] if self.value[i] is not None else None, self.parent[i]
                yield self.conv[i], self.depth[i], None if up in side else self.conv[up], self.n[i], kids[i], leaves[i], saved[i], ends, side.get(up), None, None, None
        for key, places, at in ((first, sides[0], path), (last, sides[1], path + 1)):
            if at > path and first == last:
                continue
            h, above = hashlib.sha256(), None
            for d, i in enumerate(places):
                h.update(key[(d - 1) * WIDTH : d * WIDTH] if d else b"")
                name, ends = h.digest(), self.value[i][3] if self.value[i] is not None else None
                yield self.conv[i], d, None, *((self.n[i], kids[i], leaves[i], saved[i]) if side[i] == at else (0, 0, 0, 0)), ends, at, name, above, self.size[i]
                above = name


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys come in order; runs of RUN bytes become trees."""
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(name, types[type_]) for name, type_ in (field.split() for field in _TREE.split(", "))])
    run, tree, first, last, held = 0, RadixTree(), None, b"", 0

    def done() -> Iterator[pa.RecordBatch]:
        rows = list(TurnNodes(tree).rows(first, last, (TaskContext.get().partitionId() << 34) + 2 * run))
        for i in range(0, len(rows), 1 << 16):
            columns = zip(*rows[i : i + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], names=schema.names)

    for batch in batches:
        for key, conv, n, sizes, ends in zip(*(batch.column(c).to_pylist() for c in ("key", "conv", "n", "sizes", "ends"))):
            if first is not None and held + len(key) > RUN:
                yield from done()
                run, tree, first, held = run + 1, RadixTree(), None, 0
            first, last, held = key if first is None else first, key, held + len(key) + WIDTH
            tree.insert(key, (conv, n, sizes, ends))
    if first is not None:
        yield from done()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, from, n, ids): runs of members of one name in order, as joined decimal ids of about PIECE bytes."""
    name, convs = None, []

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"name": pa.array([name], pa.binary()), "since": pa.array([convs[0]], pa.int64()), "n": pa.array([len(convs)], pa.int64()), "ids": [",".join(map(str, convs))]})

    out: list[pa.RecordBatch] = []
    for batch in batches:
        for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if convs and (key != name or len(convs) > PIECE // 12):
                out.append(piece())
                convs = []
            name = key
            convs.append(conv)
        yield from pa.Table.from_batches(out).combine_chunks().to_batches() if out else ()
        out = []
    if convs:
        yield piece()


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, conv, n, ends) from pieces in order of name and since; one piece is held at a time."""
    name, conv, n, digest = None, None, 0, hashlib.sha256()
    for batch in batches:
        rows = []
        for key, since, count, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if key != name:
                if name is not None:
                    rows.append((name, conv, n, digest.hexdigest()))
                name, conv, n, digest = key, since, 0, hashlib.sha256()
            digest.update((("," if n else "") + ids).encode())
            n += count
        yield _end_rows(rows)
    yield _end_rows([(name, conv, n, digest.hexdigest())] if name is not None else [])


def _end_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = {"name": pa.binary(), "conv": pa.int64(), "n": pa.int64(), "ends": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types.values())], names=list(types))


def _tasks(total: int, size: int) -> int:
    return max(1, -(-(total or 0) // size))


def distinct_keys(found: DataFrame) -> DataFrame:
    """(key, conv, n, sizes, ends) of the rows (conv, turns): each different sequence once, with its smallest member, their number and the hash of their ids."""
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), ""))
    keyed = written(found.select("conv", key.alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes")).withColumn("name", F.unhex(F.substring(F.sha2("key", 256), 1, 2 * WIDTH))), "keyed")
    total = keyed.agg(F.sum(F.octet_length("key")), F.count("*")).first()
    by_name = keyed.select("name", "conv").repartitionByRange(_tasks(32 * total[1], RANGE), "name", "conv").sortWithinPartitions("name", "conv")
    pieces = map_batches(by_name, _pieces, "name binary, since long, n long, ids string")
    ordered = pieces.repartition(_tasks(32 * total[1], RANGE), "name").sortWithinPartitions("name", "since")
    ends = map_batches(ordered, _ends, "name binary, conv long, n long, ends string")
    return written(keyed.groupBy("name", "key").agg(F.first("sizes").alias("sizes")).join(ends, "name").select("key", "conv", "n", "sizes", "ends"), "keys")


def trie(found: DataFrame) -> DataFrame:
    """One row per node of the trie over the rows (conv, turns): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    keys = distinct_keys(found)
    tasks = _tasks(keys.agg(F.sum(F.octet_length("key"))).first()[0], RANGE)
    nodes = written(map_batches(keys.repartitionByRange(tasks, "key").sortWithinPartitions("key"), _trees, _TREE), "trees")
    sides = nodes.where("node is not null")
    merged = sides.groupBy("node").agg(
        F.min("path").alias("rep"), F.first("parent").alias("parent"), F.max("size").alias("size"), F.sum("n_convs").alias("n_convs"), F.min("conv").alias("conv"),
        F.sum("n_children").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("ends").alias("ends"),
    )
    merged = written(merged, "merged")
    more = merged.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("more"))
    above = merged.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv"))
    merged = merged.join(more, "node", "left").withColumn("kids", F.col("kids") + F.coalesce("more", F.lit(0)))
    merged = written(merged.withColumns({"leaves": F.col("leaves") + (F.col("kids") == 0).cast("long"), "saved": F.col("saved") + (F.col("n_convs") - 1) * F.col("size")}), "sides")
    placed = skew_join(sides.select("path", "depth", "node"), merged.select("node", "rep", "leaves", "saved", "conv"), "node")
    placed = written(placed, "placed")
    counts: Column = F.col("rep") == F.col("path")
    deeper = Window.partitionBy("path").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.select("path", "depth", "node", F.when(counts, F.col("leaves")).otherwise(0).alias("leaves"), F.when(counts, F.col("saved")).otherwise(0).alias("saved"))
    sums = sums.withColumns({c: F.sum(c).over(deeper) for c in ("leaves", "saved")}).groupBy("node").agg(F.max("depth").alias("depth"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    top = sums.join(merged.drop("leaves", "saved"), "node").join(above, "parent", "left")
    columns = ("conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")
    whole = nodes.where("node is null")
    beside = placed.select("path", (F.col("depth") + 1).alias("depth"), F.col("conv").alias("above_conv"))
    below = whole.where("path is not null").join(beside, ["path", "depth"]).withColumn("parent_conv", F.col("above_conv"))
    every = whole.where("path is null").select(*columns).unionByName(below.select(*columns)).unionByName(top.withColumn("n_children", F.col("kids")).select(*columns))
    return every.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.lit(_NOTHING)).alias("ends_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt `conversations`."""
    return trie(rebuilt(ordered_turns(table(spark, sf_dir, "conversations"))))


#: crc32 of the decimal id is folded over its bytes, each followed by eight steps (-1) of the reflected polynomial.
OP11_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] AS id
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, id, strlen(text) AS size, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, id) - 1 AS pos FROM t),
convs AS (
  SELECT c, c - c % 5 AS base,
         xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
                         lambda a, v: CASE WHEN v >= 0 THEN xor(a, v) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT c FROM own)),
built AS (
  SELECT convs.c, id, size, pos FROM convs JOIN own ON own.c = convs.base AND pos < h
  UNION ALL SELECT convs.c, id, size, pos FROM convs JOIN own ON own.c = convs.c AND pos >= h),
placed AS (SELECT c, size, row_number() OVER w AS d, string_agg(id, '') OVER w AS node FROM built WINDOW w AS (PARTITION BY c ORDER BY pos)),
members AS (SELECT c, d, size, node FROM placed UNION ALL SELECT c, 0, 0, '' FROM convs),
nodes AS (SELECT node, max(d) AS d, min(c) AS conv, count(*) AS n, max(size) AS size FROM members GROUP BY node),
kids AS (SELECT left(node, 32 * (CAST(d AS INTEGER) - 1)) AS node, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1),
sums AS (
  SELECT m.node, count(*) FILTER (kids.k IS NULL) AS leaves, sum((u.n - 1) * u.size) AS saved
  FROM nodes u LEFT JOIN kids ON kids.node = u.node JOIN members m ON m.c = u.conv AND m.d <= u.d GROUP BY m.node),
lasts AS (SELECT node, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(node, d) AS node FROM members GROUP BY c) GROUP BY node)
SELECT nodes.conv AS conv_id, CAST(nodes.d AS BIGINT) AS depth, p.conv AS parent_conv_id, nodes.n AS n_convs, coalesce(kids.k, 0) AS n_children,
       sums.leaves AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, sha256(coalesce(lasts.ids, '')) AS ends_sha256
FROM nodes JOIN sums ON sums.node = nodes.node LEFT JOIN kids ON kids.node = nodes.node LEFT JOIN lasts ON lasts.node = nodes.node
LEFT JOIN nodes p ON nodes.d > 0 AND p.node = left(nodes.node, 32 * (CAST(nodes.d AS INTEGER) - 1))
"""
