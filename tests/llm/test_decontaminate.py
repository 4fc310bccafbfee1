import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from odd_rows import ODD
from pyspark.sql import functions as F

from shotspark.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, items, window=10):
    words = plain_words(text)
    hit, found = set(), set()
    for key, item in items:
        w = plain_words(item)
        size = min(window, len(w))
        wanted = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if size else set()
        for i in range(len(words) - size + 1 if size else 0):
            if tuple(words[i : i + size]) in wanted:
                hit.update(range(i, i + size))
                found.add(str(key))
    return len(words), len(hit), sorted(found)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=6))
def test_search(doc, items):
    rows = [(str(i), " ".join(x)) for i, x in enumerate(items)]
    words = decontaminate.words_of(" ".join(doc))
    hit, found = set(), set()
    for s in decontaminate.searches_for(rows, window=4):
        for start, names in s.search(words):
            hit.update(range(start, start + s.length))
            found |= names
    assert (len(words), len(hit), sorted(found)) == plain(" ".join(doc), rows, window=4)


def test_words():
    for text in ["A-B c_d É1é\x7fx 漢字 don't Ωmega", "", None, "...", "  x "]:
        assert [w.decode() for w in decontaminate.words_of(text)] == plain_words(text)


def test_odd_rows_and_items_in_blocks(spark, odd_docs):
    items = [(1, "The CAT sat"), (2, None), (3, ""), (4, "word " * 12), (5, "the cat sat"), (11, "x"), (12, "not there at all")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("hits", F.lit(1))
    got = decontaminate.contamination(odd_docs, bench, block_bytes=8).collect()
    want = sorted(str((i, *plain(t, items))) for i, t in ODD)
    assert sorted(str((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]))) for r in got) == want
    kept = decontaminate.contamination(odd_docs, bench, keep=True).filter("n_hit = 0").select("row.*")
    assert kept.columns == odd_docs.columns
    assert kept.count() == sum(plain(t, items)[1] == 0 for _, t in ODD)


def test_no_items(spark, odd_docs, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contamination(odd_docs, none).collect()
    assert sorted(r["n_words"] for r in got) == sorted(len(plain_words(t)) for _, t in ODD)
    assert not any(r["n_hit"] for r in got)
    assert decontaminate.contamination(make_docs([]), none).count() == 0


def test_query(spark, sf):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in decontaminate.op6_decontaminate(spark, sf).collect()}
    assert len(got) == len(docs) and any(r["contaminated"] for r in got.values())
    for i, text in docs:
        n, hit, found = plain(text, items)
        digest = hashlib.sha256(",".join(found).encode()).hexdigest()
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, len(found), digest, hit > 0)
