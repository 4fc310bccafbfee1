"""Benchmark decontamination by Wu-Manber search over words.

Texts are lower-cased (A-Z) and cut into words. A pattern is a window of consecutive words of a
benchmark item, or the whole item if it is shorter. For the patterns of one length, a shift table
over blocks of two words says how far the search may jump; blocks that end a pattern lead to a
bucket (by last and first block), whose test strings are compared word by word.

Benchmark items are dealt to workers in blocks of ``block_bytes`` of text, each broadcast; the
documents pass through one search per block in the same stage, without a shuffle.

Cases: null and empty texts have no words and no hits; items without words are never found; equal
items are all found; keys may be null or repeat, rows stay as they are; an empty benchmark finds
nothing. Only keys and texts are read, so further columns cannot clash.
"""

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotspark.llm.common import slices, table

WINDOW = 10  # words of a pattern
BLOCK_BYTES = 2_000_000  # item text that one worker holds at a time

#: Bytes that are no part of a word become spaces, A-Z become a-z (fixed by the word pattern).
LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

_searches: dict = {}  # of this Python worker, by search


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LETTERS).split()


class WuManber:
    """Finds all occurrences of word sequences of one length."""

    def __init__(self, patterns: dict[tuple, set]):
        """``patterns``: items of each word sequence; all have the same length."""
        self.length = length = len(next(iter(patterns)))
        self.block = block = min(2, length)
        self.jump = length - block + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for words, items in patterns.items():
            for end in range(block, length + 1):
                b = words[end - block : end]
                self.shift[b] = min(self.shift.get(b, self.jump), length - end)
            self.buckets.setdefault(words[-block:], {}).setdefault(words[:block], []).append((words, items))

    def search(self, words: list[bytes]):
        """First word and items of each occurrence."""
        length, block, jump, shift, buckets = self.length, self.block, self.jump, self.shift, self.buckets
        end, n = length, len(words)
        while end <= n:
            tail = tuple(words[end - block : end])
            step = shift.get(tail, jump)
            if step:
                end += step
                continue
            start = end - length
            for test, items in buckets[tail].get(tuple(words[start : start + block]), ()):
                if list(test) == words[start:end]:
                    yield start, items
            end += 1


def searches_for(items: list[tuple[str, str]], window: int) -> list[WuManber]:
    by_length: dict[int, dict] = {}
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            by_length.setdefault(size, {}).setdefault(tuple(words[i : i + size]), set()).add(item)
    return [WuManber(p) for p in by_length.values()]


def item_blocks(benchmark: DataFrame, key: str, text: str, block_bytes: int):
    """Lists of (item, text) of about ``block_bytes``; the driver holds one partition at a time."""
    rows, size = [], 0
    items = benchmark.select(F.col(key).cast("string"), F.col(text).cast("string")).filter(F.col(text).isNotNull())
    for item, words in items.toLocalIterator():
        rows.append((item if item is not None else "", words))
        size += len(words.encode())
        if size >= block_bytes:
            yield rows
            rows, size = [], 0
    yield rows  # may be empty; the words are counted all the same


def contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: bool = False,
) -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurrence), hits (a byte for each word), items
    (found item keys, sorted as strings). With ``keep`` all columns of ``docs`` come along, in a
    struct named ``row``."""
    spark = docs.sparkSession
    carried = ["doc_id", "text", *(["row"] if keep else [])]
    found = docs.select(
        F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"),
        *([F.struct(*[F.col(c) for c in docs.columns]).alias("row")] if keep else []),
    ).select(
        *carried, F.lit(None).cast("binary").alias("hits"), F.lit(0).cast("long").alias("n_hit"),
        F.array().cast("array<string>").alias("items"),
    )
    for block in item_blocks(benchmark, item, item_text, block_bytes):
        found = _searched(found, spark.sparkContext.broadcast(block), window)
    return found.select(
        *[c for c in carried if c != "text"], F.length("hits").cast("long").alias("n_words"), "n_hit", "hits", "items"
    )


def _searched(found: DataFrame, block, window: int) -> DataFrame:
    schema, key = found.schema, uuid.uuid4().hex

    def search(batches):
        if key not in _searches:
            _searches.clear()
            _searches[key] = searches_for(block.value, window)
        searches = _searches[key]
        for whole in batches:
            for batch in slices(whole, "text"):
                texts, before, known = (batch.column(c).to_pylist() for c in ("text", "hits", "items"))
                for i, text in enumerate(texts):
                    words = words_of(text)
                    hits, items = bytearray(before[i] or bytes(len(words))), set(known[i])
                    for s in searches:
                        for start, names in s.search(words):
                            hits[start : start + s.length] = b"\1" * s.length
                            items |= names
                    before[i], known[i] = bytes(hits), sorted(items)
                columns = dict(zip(batch.schema.names, batch.columns))
                columns["hits"] = pa.array(before, pa.binary())
                columns["n_hit"] = pa.array([h.count(1) for h in before], pa.int64())
                columns["items"] = pa.array(known, pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return found.mapInArrow(search, schema)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words inside occurrences of benchmark windows, and the items found, for each document."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: Words as lists; windows as text, joined by equality for each length that a pattern has.
_SQL_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
OP6_SQL = f"""
with d as (select doc_id, {_SQL_WORDS} as w from documents),
b as (select item_id, {_SQL_WORDS} as w from benchmark),
items as (
  select distinct item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j : j + k - 1], ' '))) as g
  from (select *, least({WINDOW}, len(w)) as k from b where len(w) > 0) t),
windows as (
  select doc_id, k, unnest(range(1, len(w) - k + 2)) as i,
         unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j : j + k - 1], ' '))) as g
  from d, (select distinct k from items) t where len(w) >= k),
hits as (select doc_id, i, items.k, item_id from windows join items on items.k = windows.k and items.g = windows.g),
words as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from hits) t group by doc_id),
found as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as list
  from (select distinct doc_id, cast(item_id as varchar) as item from hits) t group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(list, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words on words.doc_id = d.doc_id left join found on found.doc_id = d.doc_id
"""
