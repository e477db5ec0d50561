import duckdb
import pytest

from lodestrata.llm import preferences as P

ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello there"), (1, 3, "user", "more"), (1, 4, "assistant", "yes"), (1, 5, "user", "bye"),
    (2, 0, "user", "hi"), (2, 1, "assistant", "é😀 x"), (3, 0, "user", "alone"), (4, 0, "assistant", ""), (5, None, None, None), (5, 1, "assistant", None), (5, 1, "assistant", "b"),
    (None, 0, "assistant", "no id"), (7, 0, "assistant", "twice"), (7, 0, "assistant", "twice"), (8, 0, "user", "x" * 50_000), (8, 1, "assistant", "y z" * 20_000),
]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame([(*r, "z") for r in ROWS], "conv_id long, turn long, role string, text string, id string").repartition(3)


def _render(turns):
    return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)


def _mask(turns):
    at, out = 0, []
    for r, t in turns:
        head = len(f"<|{r}|>\n")
        if r == "assistant":
            out.append(f"{at + head}-{at + head + len(t) + 8}")
        at += head + len(t) + 8
    return ",".join(out)


def test_query_sql_agrees(spark, turns, tmp_path):
    turns.drop("id").write.parquet(str(tmp_path / "conversations.parquet"))
    got = P.op3_preferences(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view conversations as from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(P.OP3_SQL)
    names = want.columns
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[c] for c in names)) for r in got.collect())


def test_pairs_equal_brute_force(spark, turns):
    ids = [(1, 1), (1, 2), (2, 1), (3, 1), (4, 3), (1, 99), (7, 2), (8, 8), (None, 1), (1, None)]
    pairs = P.pair_up(turns, spark.createDataFrame(ids, "chosen_id long, rejected_id long"))
    got = {(r["chosen_id"], r["rejected_id"]): r for r in P.format_preferences(pairs).collect()}
    conv = {}
    for c, n, r, t in sorted(ROWS, key=lambda x: (str(x[0]), -1 if x[1] is None else x[1], x[2] or "", x[3] or "")):
        conv.setdefault(c, []).append((r or "", t or ""))
    assert set(got) == {p for p in ids if p[1] in conv}
    for (a, b), r in got.items():
        x, y = conv[a], conv[b]
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        assert (r["n_common"], r["prompt"], r["chosen"], r["rejected"]) == (n, _render(x[:n]), _render(x[n:]), _render(y[n:]))
        assert (r["chosen_mask"], r["rejected_mask"]) == (_mask(x[n:]), _mask(y[n:]))
        for text, mask in ((r["chosen"], r["chosen_mask"]), (r["rejected"], r["rejected_mask"])):
            assert all(text[int(s.split("-")[0]) : int(s.split("-")[1])].endswith("<|end|>\n") for s in mask.split(",") if s)


def test_empty_table(turns):
    assert P.format_preferences(P.spoiled_pairs(turns.limit(0))).count() == 0
