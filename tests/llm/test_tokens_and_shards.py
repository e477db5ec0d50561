import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lodestrata.llm import sstable
from lodestrata.llm._shared import new_dir
from lodestrata.llm.tokens import PackedEncoder, byte_alphabet
from tests.llm.conftest import odd_rows, words

ODD = ["", " ", "  a", "a  b", "a\n\nb", "\n", "a\n", " a\tb \n c", "x y z", "<|endoftext|> x", "a '’s it's don't I'LL", "1 22 333", "\n\n\nX y", "é è\r\n z", "日本 語", "😀 😀", "q.%%% end***", "İ ı ß", "á b", "x\x1cy"]


def test_chunks_give_the_ids_of_whole_texts():
    e, r = PackedEncoder(memo=50), random.Random(1)
    parts = ["a", "B", "word", " ", " ", "\n", "\t", "'s", "1", ".", "é", " ", "日", ",", "it"]
    for text in ODD + ["".join(r.choice(parts) for _ in range(r.randint(0, 15))) for _ in range(3000)] + [words(1, 500)] * 2:
        assert e.encode(text) == e.whole(text), text
        assert e.count(text) == len(e.whole(text)) // e.width, text


def test_ids_are_those_of_the_tokenizer_as_dealt():
    import public_tokenizers
    from tokenizers import Tokenizer

    fresh, e = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), PackedEncoder(memo=50)
    for text in [*ODD, "abc <|endoftext|> def", "<|endoftext|>", "a<|endoftext|><|endoftext|> \n b", "<|endoftext", *[r[1] or "" for r in odd_rows()]]:
        want = fresh.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(e.encode(text), e.dtype).tolist() == want and e.count(text) == len(want)


def test_arrays_give_the_ids_of_whole_texts_and_encode_a_chunk_once():
    e, r = PackedEncoder(memo=50), random.Random(2)
    parts = ["a", "B", "word", " ", " ", "\n", "\nÉté", "\t", "'s", "1", ".", "é", " ", "日", ",", "it", "\x00", "<|endoftext|>"]
    texts = [*ODD, *("".join(r.choice(parts) for _ in range(r.randint(0, 15))) for _ in range(3000)), "", *[words(1, 500)] * 2]
    want = [e.whole(t) for t in texts]
    assert e.encode_all(pa.array(texts)) == want and e.encode_all(pa.array(texts).slice(7, 900)) == want[7:907] and e.encode_all(pa.array([], pa.string())) == []
    assert e.encode_all(pa.array(["", ""])) == [b"", b""] and e.encode_all(pa.array(["<|endoftext|>"])) == [e.whole("<|endoftext|>")]
    # without any room in the memo a chunk is still encoded once an array, with or without signs after it
    e, met = PackedEncoder(memo=0), []
    letters = e.letters
    e.letters = lambda word, before: met.append(before + word) or letters(word, before)
    e.encode_all(pa.array(["So alpha beta\nGamma alpha"] * 100))
    assert len(met) == 100 + 3


def test_byte_alphabet_is_one_to_one():
    assert len(set(byte_alphabet().values())) == 256


def _expected(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    return [(k, [*fresh.encode(t or "", add_special_tokens=False).ids, 0]) for k, t, *_ in order]


def test_shards_round_trip(spark, odd):
    out = new_dir(spark, "test")
    sstable.write_token_shards(odd, out, shard_bytes=20_000)
    got = sstable.read_token_shards(spark, out).orderBy("start").collect()
    want = _expected(odd_rows())
    assert [r["doc_id"] for r in got] == [k for k, _ in want]
    assert sorted((str(r["doc_id"]), tuple(r["ids"])) for r in got) == sorted((str(k), tuple(i)) for k, i in want)
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    assert sstable.manifest(spark, out).count() > 1


def test_lookup_by_key(spark, odd):
    out = new_dir(spark, "test")
    sstable.write_token_shards(odd, out)
    want = {}
    for k, ids in _expected(odd_rows()):
        want.setdefault(k, []).append(tuple(ids))
    found, misses = {}, 0
    for m in sstable.manifest(spark, out).collect():
        shard = sstable.open_shard(m["path"])
        for k in [*want, 777, -5]:
            found.setdefault(k, []).extend(tuple(map(int, x)) for x in shard.get(k))
        misses += sum(not shard.may_have(sstable.key_bytes(k)) for k in range(10_000, 11_000))
    assert {k: sorted(v) for k, v in found.items() if v} == {k: sorted(v) for k, v in want.items()}
    assert misses > 900  # the filter turns nearly all away


def test_blocks_share_prefixes_and_repeated_keys_cross_blocks(tmp_path):
    path = str(tmp_path / "x.sst")
    rows = [(sstable.key_bytes(k // 3), np.arange(k % 50, dtype="<u2").tobytes()) for k in range(900)]
    with open(path, "wb") as f:
        w = sstable.ShardWriter(f, 2, block=200)
        for k, v in rows:
            w.add(k, v)
        with pytest.raises(ValueError):
            w.add(sstable.key_bytes(1), b"")
        w.close()
    s = sstable.open_shard(path)
    assert list(s) == rows and len(s.index) > 50
    assert [len(x) for x in s.get(10)] == [30, 31, 32]
    assert s.get(300) == [] and s.get("a") == []


def test_damage_is_found(tmp_path):
    path = tmp_path / "x.sst"
    with path.open("wb") as f:
        w = sstable.ShardWriter(f, 2)
        w.add(sstable.key_bytes(1), b"abcdef")
        w.close()
    raw = bytearray(path.read_bytes())
    raw[5] ^= 1
    path.write_bytes(raw)
    with pytest.raises(ValueError):
        list(sstable.open_shard(str(path)))
    path.write_bytes(raw[:-1])
    with pytest.raises(Exception):  # noqa: B017
        sstable.open_shard(str(path))


def test_keys_sort_as_values():
    keys = [None, -(1 << 63), -1, 0, 5, (1 << 63) - 1, "", "a", "é"]
    raw = [sstable.key_bytes(k) for k in keys]
    assert raw == sorted(raw) and [sstable.key_value(r) for r in raw] == keys


def test_empty_table_and_string_keys(spark, empty):
    out = new_dir(spark, "test")
    sstable.write_token_shards(empty, out)
    assert sstable.read_token_shards(spark, out).count() == 0
    out = new_dir(spark, "test")
    sstable.write_token_shards(spark.createDataFrame([("b", "x"), ("a", None)], "doc_id string, text string"), out)
    assert [(r[0], r[1]) for r in sstable.read_token_shards(spark, out, string_keys=True, ids=False).orderBy("start").collect()] == [("a", 0), ("b", 1)]


def test_a_rerun_gives_the_same_shards_under_names_of_its_own(spark, odd):
    """What a first run left behind, named by no manifest, plays no part."""
    out = new_dir(spark, "test")
    sstable.write_token_shards(odd, out)
    first = sorted(map(str, sstable.read_token_shards(spark, out, ids=False).collect()))
    before = {r["path"] for r in sstable.manifest(spark, out).collect()}
    import shutil

    shutil.rmtree(out.removeprefix("file://") + "/_manifest")
    sstable.write_token_shards(odd, out)
    assert sorted(map(str, sstable.read_token_shards(spark, out, ids=False).collect())) == first
    assert not before & {r["path"] for r in sstable.manifest(spark, out).collect()}


def test_a_failing_task_removes_its_files(spark):
    out = new_dir(spark, "test")
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "doc_id string, text string").coalesce(1)
    with pytest.raises(Exception, match="no_such_tokenizer|Permission|No such file|not found|exist"):
        sstable.write_token_shards(rows, out, tokenizer="no_such_tokenizer.json")
    import glob

    assert not glob.glob(out.removeprefix("file://") + "/*.sst")
