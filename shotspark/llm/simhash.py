"""Near-duplicate groups by SimHash fingerprints.

A fingerprint has 64 bits; bit b is set if more than half of the XXH64 values of the word
shingles have it. Two fingerprints link if at most RADIUS bits differ. Links are found in
three steps:

1. Embedding: each fingerprint becomes the vector of the bit counts of its segments. The
   Manhattan distance of two vectors is never above the number of differing bits.
2. Grid range join: two vectors at distance 2 or less have a common grid point at distance 1 or
   less from each. Every fingerprint is dealt to its own grid point and the points next to it, and
   the fingerprints that meet at a point are the candidates.
3. Verification: candidates link if the exact number of differing bits is within the radius.

A point with more than ``CELL`` fingerprints is not expanded into pairs: its fingerprints are dealt
on to all values one bit away, within the point. Fingerprints that meet there differ in two bits
at most, so linking each to the smallest of them keeps all groups whole and exact.

Groups are the connected components over distinct fingerprints, found by alternating star
contraction; each round is written to the checkpoint folder.

Cases: null, empty and blank texts have no words and the fingerprint zero, which links like any
other; fewer words than a shingle make one shingle of all of them; keys may repeat, rows stay as
they are; a null key is never the name of a group unless all keys of the group are null; an empty
table gives an empty result. Only key and text are read, so further columns cannot clash.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotspark.llm.common import delete, slices, stored, table

SEGMENT = 4  # bits of a segment
CELL = 24  # fingerprints of a grid point that are compared pair by pair
RADIUS = 2  # differing bits of linked fingerprints; grid points one step away cover just these
SEED = 42


def fingerprint(text: str | None, words: int) -> int:
    """Signed 64-bit value of the fingerprint."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    stops = (ends[len(tokens) - n :] - 1).tolist()
    xxh = xxhash.xxh64_intdigest
    bits = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):  # bounded memory for very long texts
        values = [xxh(joined[a:b], SEED) for a, b in zip(starts[at : at + 65_536], stops[at : at + 65_536])]
        wide = np.unpackbits(np.array(values, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bits += wide.sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fp (signed 64-bit value) of each row."""
    key_type = docs.schema[key].dataType.simpleString()

    def compute(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                values = [fingerprint(t, words) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        compute, f"doc_id {key_type}, fp long"
    )


def _cells(distinct: DataFrame) -> DataFrame:
    """cell, fp: the grid points at Manhattan distance 1 or less from the vector of each
    fingerprint. A grid point is a number whose digits to the base SEGMENT + 1 are the counts."""
    segments, mask, base = 64 // SEGMENT, (1 << SEGMENT) - 1, SEGMENT + 1
    counts = {
        f"c{i}": F.bit_count(F.shiftrightunsigned("fp", SEGMENT * i).bitwiseAND(F.lit(mask).cast("long"))).cast("long")
        for i in range(segments)
    }
    own = distinct.select("fp", *[c.alias(n) for n, c in counts.items()])
    own = own.withColumn("at", sum((F.col(f"c{i}") * base**i for i in range(segments)), F.lit(0).cast("long")))
    down = [F.when(F.col(f"c{i}") > 0, F.col("at") - base**i) for i in range(segments)]
    up = [F.when(F.col(f"c{i}") < SEGMENT, F.col("at") + base**i) for i in range(segments)]
    return own.select(F.explode(F.array("at", *down, *up)).alias("cell"), "fp").filter("cell is not null")


def links(distinct: DataFrame) -> DataFrame:
    """a, b: pairs of different fingerprints that differ in RADIUS bits or fewer, enough of them
    to connect all that do."""
    cells, place = stored(_cells(distinct), "cells")
    sizes, _ = stored(cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1"), "cell-sizes")
    met, _ = stored(cells.join(sizes, "cell"), "met")
    delete(distinct.sparkSession, place)
    # a group of at most CELL fingerprints may meet in one row
    groups = met.filter(F.col("n") <= CELL).groupBy("cell").agg(F.array_sort(F.collect_list("fp")).alias("g"))
    pairs = (
        groups.select("g", F.posexplode("g").alias("i", "a"))
        .select("a", F.explode(F.slice("g", F.col("i") + 2, F.size("g"))).alias("b"))
        .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
    )
    middles = F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))"))
    near = met.filter(F.col("n") > CELL).select("cell", "fp", middles.alias("middle"))
    lowest, _ = stored(
        near.groupBy("cell", "middle").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n"), "lowest"
    )
    stars = near.join(lowest, ["cell", "middle"]).select("a", F.col("fp").alias("b")).filter("a < b")
    return pairs.union(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of ``edges`` (a, b) can reach.

    Alternating star contraction: every node hands its larger neighbours, then its smaller ones,
    to the smallest node it knows. Minima are taken in partial aggregations and joined back, so a
    node with very many neighbours is never gathered in one task."""

    def star(pairs, both):
        """Each node's neighbours (with ``both``) or its smaller ones, pointed to its minimum."""
        if both:
            pairs = pairs.union(pairs.select("b", "a")).toDF("u", "v")
        else:
            pairs = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        lowest, _ = stored(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "lowest")
        joined = pairs.join(lowest, "u")
        if both:
            out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select("v", "m").union(lowest.select("u", "m")).toDF("a", "b")
        return out.filter("a <> b").distinct()

    def mark(pairs):
        return pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges, _ = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = mark(edges)
    while before[0]:
        wide, _ = stored(star(edges, both=True), "stars")
        edges, _ = stored(star(wide, both=False), "edges")
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b"), F.col("b")).distinct()
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fp, component_id (the smallest key of the group) of each row of ``docs``."""
    marked, _ = stored(fingerprints(docs, key, text, words), "fingerprints")
    distinct, _ = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots, _ = stored(components(links(distinct.select("fp"))).toDF("fp", "root"), "roots")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low, _ = stored(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "components")
    named, _ = stored(rooted.join(low, "root").select("fp", "component_id"), "named")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of each document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
