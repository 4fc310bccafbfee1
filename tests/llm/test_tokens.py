import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from odd_rows import ODD
from shotspark.llm import bpe, pieces, token_output
from shotspark.scale import scratch_path

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def tokenizer():
    """The library with its own defaults: an added token that stands in a text has its own id."""
    return Tokenizer.from_file(JSON)


def merges():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_files_hold_the_ids_of_the_library_in_order(spark, odd_docs):
    path = scratch_path(spark, "tokens")
    token_output.write_tokens(odd_docs, path, JSON, end_id=2, shard_tokens=5_000)
    got = sorted(token_output.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    lib = tokenizer()
    want = sorted(((i is not None, i or 0, lib.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in ODD), key=str)
    have = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, np.frombuffer(r["ids"], "<u4").tolist()) for r in got), key=str)
    assert have == want
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert keys == sorted(keys)
    at = 0
    for r in got:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]) // 4)
        at += r["n_tokens"]


def test_ranks_follow_frequency(spark, odd_docs):
    path = scratch_path(spark, "tokens")
    token_output.write_tokens(odd_docs, path, JSON, end_id=2)
    rows = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(len(rows)))
    assert [(-r["n"], r["id"]) for r in rows] == sorted((-r["n"], r["id"]) for r in rows)


def test_empty_table(spark, make_docs):
    path = scratch_path(spark, "tokens")
    token_output.write_tokens(make_docs([]), path, JSON, end_id=2)
    assert token_output.read_tokens(spark, path).count() == 0
    assert bpe.decode_bpe(bpe.encode_bpe(make_docs([]), RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300)), max_size=6))
def test_codes_round_trip(lists):
    counts = np.array([len(x) for x in lists], np.int64)
    ranks = np.array([v for x in lists for v in x], np.uint32)
    control, data = token_output.pack_ranks(ranks, counts)
    assert [len(c) for c in control] == [-(-n // 4) for n in counts]
    assert token_output.unpack_ranks(control, data, counts).tolist() == ranks.tolist()


def test_query_one(spark, sf):
    got = {r["doc_id"]: r for r in token_output.op1_token_output(spark, sf).collect()}
    lib, at = tokenizer(), 0
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert len(got) == len(rows)
    for i, text in rows:
        ids = lib.encode(text or "", add_special_tokens=False).ids + [2]
        assert (got[i]["start"], got[i]["n_tokens"]) == (at, len(ids))
        assert got[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


@pytest.fixture(scope="module")
def replay():
    return bpe.MergeReplay(bpe.load_ranks(RANKS))


def test_merge_replay_is_the_library(replay):
    lib = merges()

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.text(alphabet=st.sampled_from(list("abehtino  \n\t's1,.é漢\u2003\xa0\x00\x1c")), max_size=60), max_size=5))
    def check(texts):
        coder = bpe.PieceCoder(public_tokenizers.PATTERN, replay.encode_words, limit=40)
        for _ in range(2):
            got = [np.frombuffer(b, "<u4").tolist() for b in coder.encode(texts)]
            assert got == [lib.encode_ordinary(t) for t in texts]

    check()


def test_late_merges_are_settled_one_by_one():
    # "ab" + "c" = "abc" has a lower rank than "bc", which makes it possible
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 300, b"bc": 400, b"cb": 350, b"bcb": 500}
    lib = tiktoken.Encoding("t", pat_str=r"\S+|\s+", mergeable_ranks={**ranks, **{f"~{i}".encode(): i for i in range(256, 300)}}, special_tokens={})
    replay = bpe.MergeReplay(ranks)
    for word in ["abcbc", "bcabc", "abcabcb", "cbabcbc", "bcbcbabc"]:
        assert list(replay.encode([word.encode()])[0]) == lib.encode_ordinary(word)


def test_encoding_and_decoding_of_odd_rows(spark, odd_docs):
    lib = merges()
    encoded = bpe.encode_bpe(odd_docs, RANKS, public_tokenizers.PATTERN)
    got = bpe.decode_bpe(encoded, RANKS, numbers=True).collect()
    want = sorted(str((i, len(x := lib.encode_ordinary(t or "")), (t or "").encode(), " ".join(map(str, x)))) for i, t in ODD)
    assert sorted(str((r["doc_id"], r["n_tokens"], bytes(r["decoded"]), r["numbers"])) for r in got) == want


def test_added_tokens_in_a_text_are_those_of_the_library(spark, make_docs):
    lib = Tokenizer.from_file(JSON)  # with its default setting
    texts = ["x <|endoftext|> y", "<|endoftext|>", " <|endoftext|><|endoftext|>\n", "<|endoftext| >", "plain", None, ""]
    path = scratch_path(spark, "tokens")
    token_output.write_tokens(make_docs(list(enumerate(texts))), path, JSON, end_id=2)
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in token_output.read_tokens(spark, path).collect()}
    assert got == {i: lib.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    assert got[0] == [87, 220, 50256, 331, 2]


ALPHABET = list("abstrevmdl09'\".,(-_ \n\t\r\x00\x7féßÀ×÷ªº’“€łжз漢́\x1c\xa0 ½²😀")


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(ALPHABET), min_size=1, max_size=40), min_size=1, max_size=4))
def test_certain_cuts_are_borders_of_the_pattern(texts):
    texts = [t for t in texts if not pieces._ODD_SPACE.search(t)]  # those are cut by the pattern itself
    raw = [t.encode() for t in texts]
    first = np.cumsum([0, *map(len, raw)])[:-1]
    data = np.frombuffer(b"".join(raw), np.uint8)
    cut, odd = pieces.word_cuts(data, first)
    find = regex.compile(public_tokenizers.PATTERN).findall
    starts = np.flatnonzero(cut).tolist()
    assert set(first.tolist()) <= set(starts)
    words = []
    for a, b in zip(starts, [*starts[1:], len(data)]):
        here = find(data[a:b].tobytes().decode())
        assert len(here) == 1 or odd[a:b].any()
        words += here
    assert words == [w for t in texts for w in find(t)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(ALPHABET), max_size=40), max_size=4))
def test_pieces_give_the_ids_of_the_library(texts):
    coder, empty = token_output._coder(JSON)
    lib = tokenizer()
    got = [np.frombuffer(b, f"<u{empty.itemsize}").tolist() for b in coder.encode(texts)]
    assert got == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_are_remembered_without_their_marks():
    words = [f"w{chr(97 + i)}{chr(97 + k)}" for i in range(10) for k in range(10)]
    marks = [",", ".", ";", '."', ")", "\n", " \n", "!?", ".\n\n"]
    learned = []

    def encode_words(words):
        learned.extend(words)
        return np.arange(len(words), dtype="<u4"), np.ones(len(words), np.int64)

    coder = pieces.PieceCoder(public_tokenizers.PATTERN, encode_words)
    coder.encode([" ".join(w + m for w in words) for m in marks])
    assert len(learned) == len(set(learned)) == coder.newer.n  # no piece beside the words of the pattern
    assert coder.newer.n <= 2 * len(words) + 2 * len(marks)


def test_hashes_tell_near_pieces_apart():
    raw = {bytes(n) for n in range(1, 40)} | {b"a" * n for n in range(1, 600)}
    raw |= {b"x" * k + bytes([c]) + b"x" * (n - k - 1) for n in (7, 8, 9, 15, 16, 17, 33) for k in range(n) for c in (0, 1, 128, 255)}
    raw = sorted(b for b in raw if len(b) <= pieces.LONG)
    sizes = np.array([len(b) for b in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    one, two = pieces.hashed(data, np.cumsum(sizes) - sizes, sizes)
    assert len(set(zip(one.tolist(), two.tolist()))) == len(raw)
    again = pieces.hashed(np.concatenate([data[:5], data]), np.cumsum(sizes) - sizes + 5, sizes)
    assert (again[0] == one).all() and (again[1] == two).all()


def test_ids_are_counted_together(monkeypatch):
    """A count of each document alone costs a row of the whole vocabulary for each of them."""
    import pyarrow as pa
    import zstandard

    calls, bincount = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *x, **k: calls.append(1) or bincount(*x, **k))
    press = zstandard.ZstdCompressor().compress
    packed = [b"\x02" + press(np.array([i % 7, 50_000, 2], "<u2").tobytes()) for i in range(300)]

    class Frame:  # takes the function that a task runs
        def select(self, *_):
            return self

        def mapInArrow(self, f, _):
            self.got = list(f([pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], ["ids"])]))
            raise StopIteration

    frame = Frame()
    with pytest.raises(StopIteration):
        token_output._id_counts(frame)
    n = dict(zip(frame.got[0].column(0).to_pylist(), frame.got[0].column(1).to_pylist()))
    assert n == {i: sum(k % 7 == i for k in range(300)) + 300 * (i == 2) for i in range(7)} | {50_000: 300}
    assert len(calls) == 1
