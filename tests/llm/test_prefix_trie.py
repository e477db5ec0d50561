import hashlib
import random
import zlib

import duckdb
import pytest

from lodestrata.llm import prefix_trie as P
from lodestrata.llm.radix import RadixTree

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"


def make(seed: int, n: int, skew: bool) -> list[tuple]:
    r, rows = random.Random(seed), []
    for c in r.sample(range(3 * n), n):
        length = 300 if c == 7 else r.randint(1, 12)
        rows += [(c, t, r.choice("us"), "the same" if skew and t < 3 else r.choice(["a", "b", "ü" * 3, None])) for t in range(length)]
    return rows + [(5, None, None, None), (5, None, "z", ""), (None, 1, "user", "no id"), (11, 4, "x", "y"), (11, 4, "x", "y"), (-7, 0, "u", "minus"), (-5, 0, "u", "base of it")]


def brute(rows: list[tuple]) -> list[tuple]:
    own: dict[int, list] = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append(((t is not None, t or 0), role, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), text))
    own = {c: [(x[1], x[3]) for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members: dict[tuple, list[int]] = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    kids, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, of in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(of) - 1) * len(node[-1][1].encode()) if node else 0
    out = []
    for node, of in members.items():
        ends = ",".join(map(str, sorted(c for c in of if whole[c] == node)))
        out.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), kids[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("run", [4 << 20, 700, 1])
def test_equals_brute_force_however_the_keys_are_cut(spark, tmp_path, monkeypatch, run):
    rows = make(run, 60, run != 700)
    monkeypatch.setattr(P, "RUN", run)
    monkeypatch.setattr(P, "RANGE", 1 << 12)
    monkeypatch.setattr(P, "PIECE", 36)
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", conv string").repartition(3).write.parquet(path)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in P.op11_prefix_trie(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(rows)
    con = duckdb.connect()
    con.sql(f"create view conversations as from '{path}/*.parquet'")
    assert sorted(con.sql(P.OP11_SQL).select(*COLUMNS).fetchall(), key=str) == got


def test_many_copies_meet_as_one_key(spark):
    rows = [(5 * c, t, "user", "same") for c in range(300) for t in range(4)]
    got = sorted((tuple(r[c] for c in COLUMNS) for r in P.trie(P.rebuilt(P.ordered_turns(spark.createDataFrame(rows, SCHEMA)))).collect()), key=str)
    assert got == brute(rows) and len(got) == 5


def test_empty_table(spark):
    assert P.trie(P.rebuilt(P.ordered_turns(spark.createDataFrame([], SCHEMA)))).count() == 0


@pytest.mark.parametrize("fan", [1, 4, 5, 16, 17, 48, 49, 256])
def test_radix_layouts(fan):
    r, tree = random.Random(fan), RadixTree()
    keys = {bytes([0, b]) * 8 + bytes(r.choices(range(3), k=8)) for b in r.sample(range(256), fan)} | {b"", bytes(4)}
    for k in r.sample(sorted(keys), len(keys)):
        tree.insert(k, k.hex() + "!")
    assert all(tree.get(k) == k.hex() + "!" for k in keys) and tree.get(b"nothing") is None and tree.get(bytes(3)) is None
    seen = []

    def walk(node, at):
        at += node.path
        seen.extend([at] if node.value is not None else [])
        assert node.path or node is tree.root
        for kid in node.kids():
            walk(kid, at)

    walk(tree.root, b"")
    assert seen == sorted(keys)
    for node in tree.upwards():
        n = len(node.kids())
        if n:
            assert type(node.children).__name__ == ("_Sorted" if n <= 16 else "_Indexed" if n <= 48 else "_Direct")
