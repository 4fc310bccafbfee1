"""Token ids as files: frequency ranks in byte-aligned variable-length code.

``write_tokens`` encodes texts, replaces each id by its frequency rank (0: most frequent, ties
by id) and writes each rank in one to four bytes. Lengths stand apart from the data, two bits
each, four to a control byte. ``read_tokens`` decodes whole batches with a 256 x 4 table of
lengths. The folder holds Parquet files:

- ``blocks``: one row per document, files and rows in ascending key order: shard, doc_id, first
  (ids of the shard before it), n_tokens, control, data
- ``ranks``: rank, id, n (how often)
- ``shards``: shard, n_docs, n_tokens, start (ids of all shards before it)

Cases: a null or empty text has the end id only; null keys come first; rows that share a key all
stay, ordered by their ids and then by input order; an empty table gives empty files. Only the
key and the text are read, so further columns cannot clash. A text is one row and is never cut;
a lost task is recomputed from the written ids. An added token of the vocabulary that stands in a
text gives its own id, as the library does with ``add_special_tokens=False``.
"""

import json
import math
import re
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotspark.llm.common import delete, slices, stored, table
from shotspark.llm.pieces import BYTES, PATTERN, PieceCoder, byte_letters

SHARD_TOKENS = 4_000_000  # ids in a shard, on average

#: Bytes of four values for each control byte, first value in the lowest two bits.
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)

_coders: dict = {}  # of this Python worker, by vocabulary


class TextCoder:
    """``encode(texts)`` gives the ids of each text as bytes. Texts that hold an added token of the
    vocabulary go through the library's own ``encode``, all others through the pieces."""

    def __init__(self, pieces: PieceCoder, tokenizer, added: list[str], code: str):
        self.pieces, self.tokenizer, self.code = pieces, tokenizer, code
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None

    def encode(self, texts) -> list[bytes]:
        whole = [bool(t) and self.added(t) is not None for t in texts]
        out = self.pieces.encode([None if w else t for t, w in zip(texts, whole)])
        for i, t in enumerate(texts):
            if whole[i]:
                out[i] = array(self.code, self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes()
        return out


def _coder(vocabulary: str) -> tuple[TextCoder, array]:
    """The coder, and an empty array of the integers that it gives."""
    if vocabulary not in _coders:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        parts = json.loads(tokenizer.to_str())
        byte_level = (parts.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
        if not byte_level or parts.get("normalizer") or parts["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a byte-level vocabulary without normalizer is needed")
        letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        tokenize, blank = tokenizer.model.tokenize, byte_letters()[32]

        code, dtype = ("H", "<u2") if tokenizer.get_vocab_size() <= 1 << 16 else ("I", "<u4")

        def encode_words(words):
            # printable ASCII stands for itself, but the space
            spelled = [
                w.replace(" ", blank) if w.isascii() and w.isprintable() else w.encode().decode("latin1").translate(letters) for w in words
            ]
            found = [array(code, [t.id for t in tokenize(s)]) for s in spelled]
            return np.frombuffer(b"".join(found), dtype), np.fromiter(map(len, found), np.int64, len(found))

        added = [t["content"] for t in parts.get("added_tokens") or [] if t["content"]]
        _coders[vocabulary] = TextCoder(PieceCoder(PATTERN, encode_words, dtype), tokenizer, added, code), array(code)
    return _coders[vocabulary]


def _unpacked(blobs: list[bytes]) -> list[np.ndarray]:
    """Ids of packed texts: the width of an id, then all of them compressed."""
    press = zstandard.ZstdDecompressor()
    return [np.frombuffer(press.decompress(b[1:]), f"<u{b[0]}") for b in blobs]


def encode_texts(docs: DataFrame, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (packed) of each text, with the end id."""
    key_type = docs.schema[key].dataType.simpleString()

    def encode(batches):
        coder, empty = _coder(vocabulary)
        end, width = array(empty.typecode, [end_id]).tobytes(), bytes([empty.itemsize])
        press = zstandard.ZstdCompressor(level=3).compress
        for whole in batches:
            for batch in slices(whole, "text", BYTES):
                blobs = coder.encode(batch.column("text").to_pylist())
                counts = [len(b) // empty.itemsize + 1 for b in blobs]
                packed = [width + press(b + end) for b in blobs]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())],
                    ["doc_id", "n_tokens", "ids"],
                )

    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        encode, f"doc_id {key_type}, n_tokens long, ids binary"
    )


def _id_counts(encoded: DataFrame) -> DataFrame:
    """How often each id occurs; a task gives one row per id."""

    def count(batches):
        total = np.zeros(1, np.int64)
        for batch in batches:
            for part in slices(batch, "ids", BYTES):  # one count of all, each has a row of the whole vocabulary
                here = np.bincount(np.concatenate(_unpacked(part.column(0).to_pylist())))
                if len(here) > len(total):
                    total = np.concatenate([total, np.zeros(len(here) - len(total), np.int64)])
                total[: len(here)] += here
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    return encoded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def pack_ranks(ranks: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control and data bytes of each document; ``ranks`` holds all of them in a row."""
    more = (ranks > 0xFF).view(np.uint8)  # bytes after the first
    if ranks.max(initial=0) > 0xFFFF:
        more = more + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    at = np.concatenate([[0], np.cumsum(more, dtype=np.int64)]) + np.arange(len(ranks) + 1)
    data = np.empty(at[-1], np.uint8)
    data[at[:-1]] = ranks & 0xFF
    for k in (1, 2, 3):
        longer = np.flatnonzero(more >= k)
        if len(longer):
            data[at[longer] + k] = (ranks[longer] >> (8 * k)) & 0xFF
    data_at = at[np.concatenate([[0], np.cumsum(counts)])]
    groups = -(-counts // 4)
    first = np.concatenate([[0], np.cumsum(groups)])
    spread = np.zeros(first[-1] * 4, np.uint8)
    spread[np.arange(len(ranks)) + np.repeat(first[:-1] * 4 - (np.cumsum(counts) - counts), counts)] = more
    control = spread[::4] | spread[1::4] << 2 | spread[2::4] << 4 | spread[3::4] << 6
    return (
        [control[a:b].tobytes() for a, b in zip(first[:-1], first[1:])],
        [data[a:b].tobytes() for a, b in zip(data_at[:-1], data_at[1:])],
    )


def unpack_ranks(control: list[bytes], data: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Ranks of all documents in a row, by table lookup over all control bytes at once."""
    lengths = LENGTHS[np.frombuffer(b"".join(control), np.uint8)].ravel()
    groups = -(-counts // 4)
    ends, filled = np.cumsum(groups) * 4, np.ones(len(lengths), bool)
    for k in (1, 2, 3):  # without the padding of the last group
        filled[ends[groups * 4 - counts >= k] - k] = False
    lengths = lengths[filled]
    raw = np.concatenate([np.frombuffer(b"".join(data), np.uint8), np.zeros(3, np.uint8)])
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    ranks = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(lengths > k)
        if len(more):
            ranks[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text",
    shard_tokens: int = SHARD_TOKENS,
) -> None:
    """Encode ``docs`` and write the files described above to ``path``."""
    spark = docs.sparkSession
    # the written ids fix the input order of rows with equal keys, and nothing is encoded twice
    encoded, place = stored(
        encode_texts(docs, vocabulary, end_id, key, text).withColumn("row", F.monotonically_increasing_id()), "ids"
    )
    found = sorted(((r["id"], r["n"]) for r in _id_counts(encoded).collect()), key=lambda x: (-x[1], x[0]))
    ranked = [(k, i, n) for k, (i, n) in enumerate(found)]  # bounded by the vocabulary
    spark.createDataFrame(ranked, "rank long, id long, n long").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(1 + max((i for _, i, _ in ranked), default=0), np.uint32)
    for k, i, _ in ranked:
        rank_of[i] = k
    shared = spark.sparkContext.broadcast(rank_of)
    total = encoded.agg(F.sum("n_tokens")).first()[0] or 0

    def recode(batches):
        shard, first, ranks = TaskContext.get().partitionId(), 0, shared.value
        for whole in batches:
            for batch in slices(whole, "ids", BYTES):
                parts = _unpacked(batch.column("ids").to_pylist())
                counts = np.fromiter(map(len, parts), np.int64, len(parts))
                control, data = pack_ranks(ranks[np.concatenate(parts)], counts)
                before = first + np.cumsum(counts) - counts
                first += int(counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard] * len(parts), pa.int32()), batch.column("doc_id"), pa.array(before),
                        pa.array(counts), pa.array(control, pa.binary()), pa.array(data, pa.binary()),
                    ],
                    ["shard", "doc_id", "first", "n_tokens", "control", "data"],
                )

    order = ["doc_id", F.xxhash64("ids"), "row"]
    key_type = encoded.schema["doc_id"].dataType.simpleString()
    (
        encoded.repartitionByRange(max(1, math.ceil(total / shard_tokens)), *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "ids")
        .mapInArrow(recode, f"shard int, doc_id {key_type}, first long, n_tokens long, control binary, data binary")
        .write.option("compression", "zstd")
        .parquet(f"{path}/blocks")
    )
    delete(spark, place)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    (
        spark.read.parquet(f"{path}/blocks")
        .groupBy("shard")
        .agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        .withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
        .write.parquet(f"{path}/shards")
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned
    32-bit integers) of each document in the files below ``path``."""
    pairs = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()  # bounded by the vocabulary
    shared = spark.sparkContext.broadcast(np.array([r["id"] for r in pairs], np.uint32))
    blocks = spark.read.parquet(f"{path}/blocks")
    key_type = blocks.schema["doc_id"].dataType.simpleString()

    def decode(batches):
        id_of = shared.value
        for whole in batches:
            for batch in slices(whole, "data", BYTES):
                counts = batch.column("n_tokens").to_numpy()
                ranks = unpack_ranks(batch.column("control").to_pylist(), batch.column("data").to_pylist(), counts)
                ids, ends = id_of[ranks].astype("<u4"), np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("shard"), batch.column("doc_id"), batch.column("first"), batch.column("n_tokens"),
                        pa.array([ids[e - n : e].tobytes() for e, n in zip(ends, counts)], pa.binary()),
                    ],
                    ["shard", "doc_id", "first", "n_tokens", "ids"],
                )

    decoded = blocks.mapInArrow(decode, f"shard int, doc_id {key_type}, first long, n_tokens long, ids binary")
    return decoded.join(spark.read.parquet(f"{path}/shards").select("shard", F.col("start").alias("_s")), "shard").select(
        "doc_id", (F.col("_s") + F.col("first")).alias("start"), "n_tokens", "ids"
    )


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, number and checksum of the ids of each document, read back from the files."""
    import public_tokenizers

    from shotspark.scale import scratch_path

    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
