"""Training corpus from documents: five stages, each over all that the one before has kept.

A stage takes (spark, docs, sf_dir) and returns rows with the columns of ``documents``; the last
one returns token ids. Decisions:

- toxicity: fitted on the labelled documents among its input; documents with a score of 0.5 or
  more go
- quality: fitted likewise; documents with a score below 0.5 go
- near_duplicates: groups of SimHash fingerprints over three-word shingles that link at two differing
  bits or fewer; the document with the smallest doc_id stays (of repeated rows one), rows without a
  doc_id only where a group has no other
- decontamination: documents that hold a window of a benchmark item go
- tokens: ids of each document, and the digest of what they decode to
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotspark.llm.bpe import round_trip
from shotspark.llm.common import stored, table
from shotspark.llm.decontaminate import contamination
from shotspark.llm.quality import fit_quality, score_quality
from shotspark.llm.simhash import near_duplicates
from shotspark.llm.toxicity import fit_toxicity, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    machine = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, machine, keep=True).filter("score < 0.5").select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trees = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, trees, keep=True).filter("score >= 0.5").select("row.*")


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # rows are numbered once and written, so that repeated and missing keys can be told apart
    numbered, _ = stored(
        docs.select(F.struct("*").alias("row")).withColumn("number", F.monotonically_increasing_id()), "numbered"
    )
    keyed = numbered.select(
        F.struct(F.col("row.doc_id").isNull().alias("unknown"), F.col("row.doc_id").alias("doc_id"), "number").alias("key"),
        F.col("row.text").alias("text"),
    )
    found = near_duplicates(keyed, key="key", words=3)
    kept = found.filter("doc_id = component_id").select(F.col("doc_id.number").alias("number"))
    return numbered.join(kept, "number", "left_semi").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination(docs, table(spark, sf_dir, "benchmark"), keep=True).filter("n_hit = 0").select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return round_trip(docs, ranks, public_tokenizers.PATTERN, keep_ids=True).select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_duplicates", dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: Fitted models, SimHash and byte-pair merges are beyond SQL; see tests/llm for brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
