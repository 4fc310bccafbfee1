from itertools import combinations

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_rows import ODD
from pyspark.sql import functions as F

from shotspark.llm import simhash


def plain_fingerprint(text, words=3):
    """Bit by bit, from the definition."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    tokens = [t for t in "".join(" " if c in " \t\n\v\f\r" else c for c in lowered).split(" ") if t]
    shingles = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_groups(values):
    """Smallest index that each value reaches over links of two bits or fewer."""
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(values)), 2):
        if ((values[i] ^ values[j]) & (1 << 64) - 1).bit_count() <= 2:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [root(i) for i in range(len(values))]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aAbÉé \t\n\x1c漢.")), max_size=40), st.integers(1, 5))
def test_fingerprint(text, words):
    assert simhash.fingerprint(text, words) & (1 << 64) - 1 == plain_fingerprint(text, words)


def test_spark_hash_is_the_same(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0]
    assert row == simhash.fingerprint("a b c", 3)


@pytest.mark.parametrize("cell", [24, 2])
def test_groups_are_exact(spark, monkeypatch, cell):
    """Chains, dense balls (many values around one) and far values; with a small CELL the crowded
    grid points take the other way."""
    monkeypatch.setattr(simhash, "CELL", cell)
    centre = 0x0123456789ABCDEF
    values = {centre} | {centre ^ 1 << b for b in range(0, 64, 2)} | {centre ^ 1 << b ^ 1 << b + 1 for b in range(0, 60, 3)}
    for k in range(6):  # a chain, three bits from the ball
        values.add(~centre & (1 << 64) - 1 ^ ((1 << 2 * k) - 1))
    values |= {0, 1, 6, (1 << 64) - 1, 0xF0F0F0F0F0F0F0F0, 0xF0F0F0F0F0F0F00F}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    for a, b in edges.collect():
        assert a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    want = plain_groups(signed)
    got = [roots.get(v, v) for v in signed]
    for i, j in combinations(range(len(signed)), 2):
        assert (want[i] == want[j]) == (got[i] == got[j])


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 130)] + [(205, 200), (203, 205)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 130)} | {200: 200, 203: 200, 205: 200}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def check(rows, docs):
    fps = [plain_fingerprint(t) for _, t in docs]
    groups = plain_groups(fps)
    keys: dict = {}
    for (i, _), g in zip(docs, groups):
        keys.setdefault(g, []).append(i)
    want = sorted(
        (str(i), f"{fp:016x}", str(min((k for k in keys[g] if k is not None), default=None))) for (i, _), fp, g in zip(docs, fps, groups)
    )
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in rows) == want


def test_odd_rows(spark, odd_docs):
    found = simhash.near_duplicates(odd_docs).withColumn("fingerprint", F.lower(F.lpad(F.hex("fp"), 16, "0")))
    check(found.collect(), ODD)


def test_empty(make_docs):
    assert simhash.near_duplicates(make_docs([])).count() == 0


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(simhash.op4_simhash(spark, sf).collect(), docs)
