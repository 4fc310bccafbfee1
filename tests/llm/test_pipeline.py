import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from shotspark.llm import bpe
from test_decontaminate import plain
from test_simhash import plain_fingerprint, plain_groups

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def larger(sf):
    return sf.replace("sf0.001", "sf0.01")


@pytest.fixture(scope="module")
def kept(spark, larger, tmp_path_factory):
    """What each stage keeps."""
    docs, out = spark.read.parquet(f"{larger}/documents.parquet"), {}
    out["documents"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, larger).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs.collect()
    return out


def test_columns_stay(spark, larger, kept):
    names = spark.read.parquet(f"{larger}/documents.parquet").columns
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert kept[name][0].__fields__ == names


def test_models_reject_what_is_labelled_and_keep_the_rest(spark, larger, kept):
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    left = {r["doc_id"] for r in kept["toxicity"]}
    toxic = [i for i, r in labels.items() if r["toxic"] == 1]
    clean = [i for i, r in labels.items() if r["toxic"] == 0]
    assert sum(i in left for i in toxic) <= 0.1 * len(toxic)
    assert sum(i in left for i in clean) >= 0.98 * len(clean)
    after = {r["doc_id"] for r in kept["quality"]}
    good = [i for i, r in labels.items() if i in left and r["quality"] == 1]
    poor = [i for i, r in labels.items() if i in left and r["quality"] == 0]
    assert sum(i in after for i in good) >= 0.98 * len(good)
    assert sum(i in after for i in poor) <= 0.1 * len(poor)


def test_one_document_of_each_group(kept):
    rows = sorted((r["doc_id"], r["text"]) for r in kept["quality"])
    groups = plain_groups([plain_fingerprint(t) for _, t in rows])
    assert sorted(r["doc_id"] for r in kept["near_duplicates"]) == sorted({rows[g][0] for g in groups})


def test_contaminated_documents_go(spark, larger, kept):
    items = [tuple(r) for r in spark.read.parquet(f"{larger}/benchmark.parquet").select("item_id", "text").collect()]
    want = sorted(r["doc_id"] for r in kept["near_duplicates"] if plain(r["text"], items)[1] == 0)
    assert sorted(r["doc_id"] for r in kept["decontamination"]) == want
    assert len(want) < len(kept["near_duplicates"])


def test_tokens(kept):
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in kept["decontamination"]}
    assert len(kept["tokens"]) == len(texts)
    for r in kept["tokens"]:
        ids = lib.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert b"".join(i.to_bytes(4, "little") for i in ids) == bytes(r["ids"])


def test_repeated_and_missing_keys(spark, odd_docs):
    rows = corpus_pipeline.dedup(spark, odd_docs, "").collect()
    texts = [r["text"] for r in rows]
    assert rows[0].__fields__ == odd_docs.columns
    assert texts.count("x") == 1  # repeated rows
    assert sum(not (t or "").split() for t in texts) == 1  # null, empty, blank: one fingerprint
    assert "no key" in texts


def test_empty_documents(spark, odd_docs, larger):
    docs = odd_docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, larger).count() == 0
