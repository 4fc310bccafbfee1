"""Byte-level BPE by merge replay over many words at once.

The distinct words of a block of texts are laid out as one chain of byte symbols. An inverted index
holds, for each position of the chain, the rank of the merge that its pair is open to; a wave takes from it
the positions of the next merge of every word, in rank order within each word, applies them all, and
renews the index at the neighbours that were touched only. Words without a further merge leave the chain.
Blocks are the batches that Spark deals out; words met before are not replayed again.

Cases: a null or empty text has no ids and decodes to nothing; keys may be null or repeat, rows
stay as they are; empty tables give empty results. Only the key and the text are read, so further
columns cannot clash. Texts are never cut, and memory is bounded by the dictionary limits plus
the longest text.
"""

import base64
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotspark.llm.common import slices, table
from shotspark.llm.pieces import BYTES, PieceCoder

_states: dict = {}  # of this Python worker, by rank file
_spelled: dict = {}


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, one base64 token and one number on a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


LONG = 256  # bytes of a word that is replayed on its own
NONE = np.int32(2**31 - 1)  # the pair of a position is no merge


class PairRanks:
    """Rank of the merge of two symbols, looked up for whole arrays in a table of open addresses."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        keys, values = np.array(keys, np.int64), np.array(values, np.int32)
        slot = self._slot(keys)
        while len(keys):  # the first of those that want a free slot gets it, all others go on
            _, first = np.unique(slot, return_index=True)
            first = first[self.keys[slot[first]] < 0]
            self.keys[slot[first]], self.values[slot[first]] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys):
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 32 | b
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[open_]]
            found = held == keys[open_]
            out[open_[found]] = self.values[slot[open_[found]]]
            open_ = open_[~found & (held >= 0)]
        return out


class MergeReplay:
    """Ids of many words at once by the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = PairRanks(ranks)

    def encode(self, words: list[bytes]) -> list[tuple[int, ...]]:
        return [tuple(np.frombuffer(b, "<u4").tolist()) for b in self.encode_bytes(words)]

    def encode_bytes(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        get, out, open_words = self.ranks.get, [], []
        for i, w in enumerate(words):
            rank = get(w)
            if rank is not None:
                out.append(rank.to_bytes(4, "little"))
            elif len(w) > LONG:
                out.append(np.array(self._one(w), "<u4").tobytes())
            else:
                out.append(b"")
                if w:
                    open_words.append(i)
        for i, ids in zip(open_words, self._replay([words[i] for i in open_words])):
            out[i] = ids
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        blobs = self.encode_bytes([w.encode() for w in words])
        return np.frombuffer(b"".join(blobs), "<u4"), np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4

    def _replay(self, words: list[bytes]) -> list[bytes]:
        if not words:
            return []
        size = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.single[np.frombuffer(b"".join(words), np.uint8)]
        word = np.arange(len(words))  # those still in the chain
        last = np.zeros(len(symbol), bool)
        last[np.cumsum(size) - 1] = True
        rank = np.full(len(symbol), NONE, np.int32)
        inside = np.flatnonzero(~last)
        rank[inside] = self.pairs.of(symbol[inside], symbol[inside + 1])
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while True:
            least = np.minimum.reduceat(rank, np.cumsum(size) - size)
            open_ = least < NONE
            if not open_.all():
                stays = np.repeat(open_, size)
                done.append((word[~open_], size[~open_], symbol[~stays]))
                word, size, least = word[open_], size[open_], least[open_]
                symbol, rank, last = symbol[stays], rank[stays], last[stays]
                if not len(word):
                    break
            at = np.flatnonzero(rank == np.repeat(least, size))
            # of pairs that overlap, every other one from the left
            fresh = np.diff(at, prepend=-2) != 1
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            symbol[at], last[at] = rank[at], last[at + 1]
            stays = np.ones(len(symbol), bool)
            stays[at + 1] = False
            size -= np.bincount(np.searchsorted(np.cumsum(size), at, side="right"), minlength=len(size))
            symbol, rank, last = symbol[stays], rank[stays], last[stays]
            at -= np.arange(len(at))
            before = at[at > 0] - 1
            touched = np.concatenate([at, before[~last[before]]])
            inside = touched[~last[touched]]
            rank[touched] = NONE
            rank[inside] = self.pairs.of(symbol[inside], symbol[inside + 1])
        out: list[bytes] = [b""] * len(words)
        for numbers, sizes, symbols in done:
            raw, ends = symbols.astype("<u4").tobytes(), (np.cumsum(sizes) * 4).tolist()
            for i, a, b in zip(numbers.tolist(), [0, *ends], ends):
                out[i] = raw[a:b]
        return out

    def _one(self, word: bytes):
        """The lowest-ranked leftmost pair first, for words whose merges do not come in rank order."""
        ranks, parts, n = self.ranks, [bytes([b]) for b in word], len(word)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def offer(i):
            if i >= 0 and right[i] < n:
                both = parts[i] + parts[right[i]]
                if both in ranks:
                    heapq.heappush(heap, (ranks[both], i, both))

        for i in range(n):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = right[i]
            if not parts[i] or j >= n or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, b""
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(left[i])
            offer(i)
        return tuple(ranks[p] for p in parts if p)


def _coder(path: str, pattern: str) -> PieceCoder:
    if (path, pattern) not in _states:
        _states[path, pattern] = PieceCoder(pattern, MergeReplay(load_ranks(path)).encode_words)
    return _states[path, pattern]


class Spelling:
    """Strings by number; ``of(numbers)`` puts those of an array in a row and tells how long each is."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.first = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(strings), np.uint8)

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        at = np.repeat(self.first[numbers] - (ends - sizes), sizes)
        at += np.arange(len(at))
        return self.letters[at], ends


def _spellings(path: str) -> tuple[Spelling, Spelling]:
    """Bytes of the tokens, and their ids in decimals with a space behind."""
    if path not in _spelled:
        tokens = {r: t for t, r in load_ranks(path).items()}
        size = max(tokens) + 1
        _spelled[path] = Spelling([tokens.get(i, b"") for i in range(size)]), Spelling([b"%d " % i for i in range(size)])
    return _spelled[path]


def _encoded(batch: pa.RecordBatch, coder: PieceCoder) -> pa.RecordBatch:
    blobs = coder.encode(batch.column("text").to_pylist())
    counts = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), pa.array(blobs, pa.binary())], ["doc_id", "n_tokens", "ids"])


def _decoded(batch: pa.RecordBatch, rank_file: str, numbers: bool, keep_ids: bool) -> pa.RecordBatch:
    spelled, digits = _spellings(rank_file)
    blobs = batch.column("ids").to_pylist()
    ids = np.frombuffer(b"".join(blobs), "<u4")
    ends = np.cumsum(np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4)

    def texts(spelling, less=0):
        letters, at = spelling.of(ids)
        raw, to = letters.tobytes(), np.concatenate([[0], at])[ends].tolist()
        return [raw[a : max(a, b - less)] for a, b in zip([0, *to], to)]

    columns = {"doc_id": batch.column("doc_id"), "n_tokens": batch.column("n_tokens"), "decoded": pa.array(texts(spelled), pa.binary())}
    if numbers:
        columns["numbers"] = pa.array(texts(digits, 1), pa.binary()).cast(pa.string())
    if keep_ids:
        columns["ids"] = batch.column("ids")
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))


def _decoded_schema(key_type: str, numbers: bool, keep_ids: bool) -> str:
    return f"doc_id {key_type}, n_tokens long, decoded binary" + ", numbers string" * numbers + ", ids binary" * keep_ids


def encode_bpe(docs: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) of each text."""

    def encode(batches):
        coder = _coder(rank_file, pattern)
        for whole in batches:
            for batch in slices(whole, "text", BYTES):
                yield _encoded(batch, coder)

    key_type = docs.schema[key].dataType.simpleString()
    return _texts(docs, key, text).mapInArrow(encode, f"doc_id {key_type}, n_tokens long, ids binary")


def decode_bpe(encoded: DataFrame, rank_file: str, numbers: bool = False, keep_ids: bool = False) -> DataFrame:
    """The bytes of each row of ``encode_bpe``; with ``numbers`` also the ids as decimal text, with
    ``keep_ids`` the ids as they came."""

    def decode(batches):
        for whole in batches:
            for batch in slices(whole, "ids", BYTES):
                yield _decoded(batch, rank_file, numbers, keep_ids)

    key_type = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.mapInArrow(decode, _decoded_schema(key_type, numbers, keep_ids))


def round_trip(
    docs: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text", numbers: bool = False, keep_ids: bool = False
) -> DataFrame:
    """``decode_bpe`` of ``encode_bpe`` in the same Python worker, which halves their number."""

    def both(batches):
        coder = _coder(rank_file, pattern)
        for whole in batches:
            for batch in slices(whole, "text", BYTES):
                yield _decoded(_encoded(batch, coder), rank_file, numbers, keep_ids)

    key_type = docs.schema[key].dataType.simpleString()
    return _texts(docs, key, text).mapInArrow(both, _decoded_schema(key_type, numbers, keep_ids))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of each document and of what they decode to."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, numbers=True).select(
        "doc_id",
        "n_tokens",
        F.sha2(F.col("numbers").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
