"""Repeated passages by relative Lempel-Ziv parsing.

A passage is a window of ``words`` consecutive words; a word goes if a window over it has the same
words as another window that starts anywhere else, in the same text or another one.

1. Index. Every window has an anchor, the leftmost smallest of its seeds (hashes of a third of its
   words), so equal windows have equal anchors. Reference blocks are kept by seed: the index has one
   entry for each factor, which is an anchor with all words that its windows can reach, and says how
   often the factor stands in the corpus. Seeds that stand once can be in no repeated window and
   are left out, so a text is parsed against every block that may hold a match and against no other.
2. Parsing. At each of its anchors a text takes the longest factor that the block of the seed offers. A
   factor found twice is long enough for all its windows, and becomes a duplicate span at once;
   neighbouring spans run together.
3. Borders. Where the whole factor is found once but its seed more often, a match ends inside the
   factor. There the windows of the anchor are compared one by one with those of all different factors
   of the seed.

Entries are counted before they are compared, so a passage that a third of all texts share is one
entry per task, and no task sees all copies. Words and windows are compared as 64-bit and 128-bit
hashes.

Cases: a null, empty or blank text has no words; a text with fewer words than a window keeps all;
keys may be null or repeat, rows stay as they are; equal texts repeat each other; an empty table
gives an empty result. Texts are never cut; memory is bounded by the longest text, whose words
take some 40 bytes each. Only key and text are read, so further columns cannot clash.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotspark.llm.common import delete, slices, stored, table

WORDS = 35
LONG = 4096  # bytes of a word that is hashed on its own
CHUNK = 1 << 18  # bytes or windows handled together

_random = np.random.default_rng(42)
_LETTERS = _random.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _random.integers(0, 1 << 61, 4, np.uint64) * np.uint64(8) + np.uint64(5)  # of letters, seeds, windows
_POWERS = np.cumprod(np.full(LONG, _STEP[0]))
_MIX = _random.integers(0, 1 << 63, 2, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


def _rolled(hashes: np.ndarray, starts: np.ndarray, sizes, step: np.uint64) -> np.ndarray:
    """Hash of ``sizes`` word hashes (a number or one for each) from each start."""
    out = np.zeros(len(starts), np.uint64)
    longest = int(np.max(sizes, initial=0))
    for t in range(longest):
        if np.ndim(sizes) == 0:
            out = out * step + hashes[starts + t]
        else:
            more = np.flatnonzero(sizes > t)
            out[more] = out[more] * step + hashes[starts[more] + t]
    return _mixed(out)


class Words:
    """All words of some texts in a row: ``starts`` and ``ends`` in ``data``, ``first`` the number of
    the first word of each text and, at the end, of all words."""

    def __init__(self, texts: list[bytes], words: int = WORDS):
        self.data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        blank = (self.data == 32) | ((self.data >= 9) & (self.data <= 13))
        edge = np.diff(np.concatenate([[True], blank]).view(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.first = np.searchsorted(self.starts, np.concatenate([[0], np.cumsum(sizes)]))
        self.counts = np.diff(self.first)
        self.words, self.seed = words, max(1, (words + 1) // 3)
        self.reach = words - self.seed  # words of a window before and after its seed

    def hashes(self) -> np.ndarray:
        """One number for each word."""
        out, size = np.empty(len(self.starts), np.uint64), self.ends - self.starts
        short = np.where(size > LONG, 1, size)
        at = 0
        while at < len(out):
            to = max(at + 1, int(np.searchsorted(self.starts, self.starts[at] + CHUNK)))
            n = short[at:to]
            head = np.cumsum(n) - n
            inside = np.arange(n.sum()) - np.repeat(head, n)
            letters = self.data[inside + np.repeat(self.starts[at:to], n)]
            out[at:to] = np.add.reduceat(_LETTERS[letters] * _POWERS[inside], head)
            at = to
        out = _mixed(out)
        for i in np.flatnonzero(size > LONG):
            out[i] = xxhash.xxh64_intdigest(self.data[self.starts[i] : self.ends[i]].tobytes())
        return out

    def windows(self, hashes: np.ndarray):
        """Starts of windows and their anchors, in pieces."""
        if len(hashes) < self.words:
            return
        span = self.reach + 1
        text_of = np.repeat(np.arange(len(self.counts)), self.counts)
        whole = np.flatnonzero(text_of[: len(hashes) - self.words + 1] == text_of[self.words - 1 :])
        for at in range(0, len(whole), CHUNK):
            starts = whole[at : at + CHUNK]
            low, high = starts[0], starts[-1] + span
            seeds = _rolled(hashes, np.arange(low, high), self.seed, _STEP[1])
            yield starts, starts + sliding_window_view(seeds, span)[starts - low].argmin(axis=1)

    def anchors(self, hashes: np.ndarray) -> tuple:
        """Number of the word, text, seed and factor of each anchor, in order."""
        found = [np.unique(a) for _, a in self.windows(hashes)]
        at = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        text = np.searchsorted(self.first, at, side="right") - 1
        low = np.maximum(at - self.reach, self.first[text])
        high = np.minimum(at + self.words, self.first[text + 1])
        factor = _rolled(hashes, low, high - low, _STEP[2]) + _mixed((at - low).astype(np.uint64) + np.uint64(1))
        return at, text, _rolled(hashes, at, self.seed, _STEP[1]), _mixed(factor + (high - low).astype(np.uint64))

    def kept(self, gone: np.ndarray) -> list[bytes]:
        """The words of each text that are not ``gone``, joined by single spaces."""
        out, bounds = [], np.append(self.first, self.first[-1])
        for i in range(len(self.counts)):
            a, b = bounds[i], bounds[i + 1]
            stay = np.flatnonzero(~gone[a:b]) + a
            if not len(stay):
                out.append(b"")
                continue
            low, high = self.starts[a], self.ends[b - 1] + 1  # white space follows each word
            change = np.zeros(high - low + 1, np.int8)
            change[self.starts[stay] - low] += 1
            np.add.at(change, self.ends[stay] + 1 - low, -1)
            piece = self.data[low:high].copy()
            piece[self.ends[a:b] - low] = 32
            out.append(piece[np.cumsum(change[:-1], dtype=np.int8) > 0].tobytes()[:-1])
        return out


def _texts(column: pa.Array) -> list[bytes]:
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def _lists(values: np.ndarray, counts: np.ndarray, kind) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(counts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def _parsed(docs: DataFrame, words: int) -> DataFrame:
    """key, text, n_words, digest of all words, and the anchors (at, seed, factor) of each text."""

    def compute(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                w = Words(_texts(batch.column("text")), words)
                at, text, seed, factor = w.anchors(w.hashes())
                n = np.bincount(text, minlength=batch.num_rows)
                joined = w.kept(np.zeros(len(w.starts), bool))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key"), batch.column("text"), pa.array(w.counts),
                        pa.array([hashlib.sha256(j).digest() for j in joined], pa.binary()),
                        _lists((at - w.first[text]).astype(np.int32), n, pa.int32()),
                        _lists(seed.view(np.int64), n, pa.int64()), _lists(factor.view(np.int64), n, pa.int64()),
                    ],
                    ["key", "text", "n_words", "digest", "at", "seed", "factor"],
                )

    key_type = docs.schema["key"].dataType.simpleString()
    schema = f"key {key_type}, text string, n_words long, digest binary, at array<int>, seed array<long>, factor array<long>"
    return docs.mapInArrow(compute, schema)


def _border_windows(texts: DataFrame, words: int) -> DataFrame:
    """row, at, high, low, weight: the windows of the anchors in ``checks``."""

    def compute(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                w = Words(_texts(batch.column("text")), words)
                hashes, checks = w.hashes(), batch.column("checks")
                n = pc.list_value_length(checks).to_numpy(zero_copy_only=False)
                wanted = checks.flatten()
                at = wanted.field("at").to_numpy().astype(np.int64) + np.repeat(w.first[:-1], n)
                weight = np.zeros(len(hashes) + 1, np.int8)
                weight[at] = wanted.field("weight").to_numpy()
                rows = batch.column("row").to_numpy()
                for starts, anchors in w.windows(hashes):
                    here = np.flatnonzero(weight[anchors])
                    start = starts[here]
                    text = np.searchsorted(w.first, start, side="right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(rows[text]), pa.array((start - w.first[text]).astype(np.int32)),
                            pa.array(_rolled(hashes, start, words, _STEP[2]).view(np.int64)),
                            pa.array(_rolled(hashes, start, words, _STEP[3]).view(np.int64)),
                            pa.array(weight[anchors[here]].astype(np.int32)),
                        ],
                        ["row", "at", "high", "low", "weight"],
                    )

    return texts.select("row", "text", "checks").mapInArrow(compute, "row long, at int, high long, low long, weight int")


def _removed(texts: DataFrame, words: int) -> DataFrame:
    """key, n_words, n_removed, kept of texts with duplicate spans."""
    reach = words - max(1, (words + 1) // 3)

    def spans(w, column, before, after):
        n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        at = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        text = np.repeat(np.arange(len(n)), n)
        at = at + w.first[text]
        return np.maximum(at - before, w.first[text]), np.minimum(at + after, w.first[text + 1])

    def compute(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                w = Words(_texts(batch.column("text")), words)
                change = np.zeros(len(w.starts) + 1, np.int64)
                for low, high in (spans(w, batch.column("long"), reach, words), spans(w, batch.column("single"), 0, words)):
                    np.add.at(change, low, 1)
                    np.add.at(change, high, -1)
                gone = np.cumsum(change[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(gone)])[w.first]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), pa.array(w.counts), pa.array(np.diff(total)), pa.array(w.kept(gone), pa.binary())],
                    ["key", "n_words", "n_removed", "kept"],
                )

    key_type = texts.schema["key"].dataType.simpleString()
    return texts.select("key", "text", "long", "single").mapInArrow(
        compute, f"key {key_type}, n_words long, n_removed long, kept binary"
    )


def parse(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """Texts with duplicate spans (key, n_words, n_removed, kept) and those without (key, n_words,
    digest of all words)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    # rows are numbered once and written, so that repeated and missing keys can be told apart
    parsed, _ = stored(_parsed(docs, words).withColumn("row", F.monotonically_increasing_id()), "parsed")
    each = parsed.select("row", F.explode(F.arrays_zip("at", "seed", "factor")).alias("a")).select("row", "a.*")
    seeds = parsed.select(F.explode("seed").alias("seed")).groupBy("seed").count()
    shared, _ = stored(seeds.filter("count > 1").select("seed"), "shared-seeds")
    hits, hits_place = stored(each.join(shared, "seed"), "hits")
    entries = hits.groupBy("seed", "factor").agg(F.count("*").alias("n"), F.min(F.struct("row", "at")).alias("where"))
    index, index_place = stored(entries, "index")
    # seeds with more than one factor, of which some stand once
    border = index.groupBy("seed").agg(F.min("n").alias("low"), F.count("*").alias("k")).filter("low = 1 and k > 1")
    # written, so that the join below may split a seed with very many factors
    border, _ = stored(border.select("seed"), "border-seeds")
    checks = index.join(border, "seed").select(
        "where.row", "where.at", F.least("n", F.lit(2)).cast("int").alias("weight")
    )
    long = hits.join(index.filter("n > 1").select("seed", "factor"), ["seed", "factor"]).select("row", "at", F.lit(0).alias("weight"))
    # no more entries than words of the text
    spans = long.union(checks).groupBy("row").agg(
        F.collect_list(F.when(F.col("weight") == 0, F.col("at"))).alias("long"),
        F.collect_list(F.when(F.col("weight") > 0, F.struct("at", "weight"))).alias("checks"),
    )
    todo, _ = stored(spans, "spans")
    delete(spark, hits_place)
    delete(spark, index_place)
    texts, _ = stored(parsed.select("row", "key", "text").join(todo, "row"), "texts")
    windows, _ = stored(_border_windows(texts.filter(F.size("checks") > 0), words), "windows")
    twice = windows.groupBy("high", "low").agg(F.sum("weight").alias("n")).filter("n > 1").select("high", "low")
    single = windows.filter("weight = 1").join(twice, ["high", "low"]).groupBy("row").agg(F.collect_list("at").alias("single"))
    single, _ = stored(single, "single")
    marked = texts.select("row", "key", "text", "long").join(single, "row", "left").filter("size(long) > 0 or single is not null")
    clean = parsed.select("row", "key", "n_words", "digest").join(
        todo.filter("size(long) > 0").select("row").union(single.select("row")), "row", "left_anti"
    )
    return _removed(marked, words), clean.select("key", "n_words", "digest")


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, removed words and digest of the kept ones of each document."""
    marked, clean = parse(table(spark, sf_dir, "documents"))
    return marked.select(
        F.col("key").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    ).union(clean.select("key", "n_words", F.lit(0).cast("long"), F.lower(F.hex("digest"))))


OP11_SQL = r"""with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d),
win as (select r, i, array_to_string(list_slice(w, i, i + 34), ' ') as s
  from (select r, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35)),
twice as (select s from win group by s having count(*) > 1),
hit as (select r, i, 1 as h from win semi join twice using (s)),
m as (select p.r, p.i, p.word, coalesce(max(h) over (partition by p.r order by p.i rows between 34 preceding and current row), 0) as gone
  from p left join hit on hit.r = p.r and hit.i = p.i),
k as (select r, sum(gone) as n_removed, coalesce(string_agg(word, ' ' order by i) filter (gone = 0), '') as kept from m group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed,
  sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (r)"""
