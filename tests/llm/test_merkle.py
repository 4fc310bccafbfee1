import hashlib

import pytest
from odd_rows import ODD
from pyspark.sql import functions as F

from shotspark.llm import merkle


def neighbours(docs, tie):
    """Rows in order of key and hash, with the text of the next one."""
    rows = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1] or ""]))
    return [(i, t or "", (rows[(k + 1) % len(rows)][1] or "")) for k, (i, t) in enumerate(rows)]


def hashes(spark, texts):
    df = spark.createDataFrame([(t,) for t in set(texts)], "t string")
    return {r[0]: r[1] for r in df.select("t", F.xxhash64("t")).collect()}


def check(spark, got, docs):
    want = []
    for i, text, after in neighbours(docs, hashes(spark, [t or "" for _, t in docs])):
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        want.append((str(i), len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    by_text = {}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if r["fingerprint"] == r["edited_fingerprint"]:
            assert r["near_edited"] == 1
    return by_text


def run(spark, tmp_path, rows, name="documents"):
    rows.write.parquet(str(tmp_path / f"{name}.parquet"))
    return merkle.op8_merkle(spark, str(tmp_path)).collect()


def test_odd_rows(spark, odd_docs, tmp_path):
    check(spark, run(spark, tmp_path, odd_docs), ODD)


def test_single_and_empty(spark, make_docs, tmp_path):
    (one,) = run(spark, tmp_path / "a", make_docs([(4, "abcdefgh")]))
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and one["near_next"] == 1
    assert run(spark, tmp_path / "b", make_docs([])) == []


@pytest.mark.parametrize("size", [200, 3_000])
def test_many_slices(spark, sf, monkeypatch, size, tmp_path):
    monkeypatch.setattr(merkle.with_next, "__defaults__", (*merkle.with_next.__defaults__[:-1], size))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    check(spark, merkle.op8_merkle(spark, sf).collect(), [tuple(r) for r in docs.collect()])


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = merkle.op8_merkle(spark, sf).collect()
    check(spark, got, docs)
    marks: dict = {}
    text_of = dict(docs)
    for r in got:
        marks.setdefault(text_of[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(m) == 1 for m in marks.values())
    assert len({next(iter(m)) for m in marks.values()}) == len(marks)
    long = [r for r in got if r["n_chars"] > 400]
    assert sum(r["near_edited"] > r["near_next"] for r in long) > 0.95 * len(long)


def test_differing_branches_locate_an_edit(spark):
    lines = [f"line {i} " + " ".join(str(i * j) for j in range(20)) for i in range(60)]
    other = lines[:30] + ["something else"] + lines[31:]
    df = spark.createDataFrame([("\n".join(lines), "\n".join(other))], "a string, b string")
    df = merkle.with_fingerprint(merkle.with_fingerprint(df, "a", "x"), "b", "y")
    row = df.select(
        merkle.likeness(F.col("x"), F.col("y")).alias("same"), F.size(merkle.differing(F.col("x"), F.col("y"))).alias("n"),
        F.size(F.split("x", r"\|")).alias("sections"),
    ).first()
    assert 0.9 < row["same"] < 1 and 1 <= row["n"] <= 2 < row["sections"]


def test_plan_has_no_python(spark, sf):
    plan = merkle.op8_merkle(spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
