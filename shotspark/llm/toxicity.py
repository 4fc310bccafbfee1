"""Toxicity by a factorization machine over hashed terms.

The terms of a text are its distinct words and their first four and five letters, hashed to
BUCKETS numbers. The machine adds a weight for each term that occurs and, through a short vector
per term, a weight for each pair of terms, so it also learns pairs that matter only together.

Fitting: the labelled rows are sampled by a hash of their key down to about ``max_rows`` (the
documented bound), and terms are counted by label over all of these rows in Spark. Into the machine go
the ``n_terms`` that tell the labels apart best by themselves, and the terms of pairs that tell more
together than their members do: pairs are counted among PAIR_TERMS terms that are neither rare nor
everywhere, and those that tell the labels apart best. Only the numbers of such terms, for at most about
``max_rows`` rows, reach the driver. Scoring reads whole texts and needs no shuffle.

Cases: null and empty texts have no terms and get the score of the bias; unlabelled rows and null
labels are not learned from; a key that is labelled more than once takes its largest label; with
one class of labels only, or none, the score is constant; keys may be null or repeat, rows stay as
they are; very long texts are scored whole, in memory that their distinct words bound; empty tables give
empty results. Columns other than key and text are ignored.
"""

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotspark.llm.common import key_crc, slices, stored, table

BUCKETS = 1 << 20  # numbers of terms
MAX_ROWS = 20_000  # labelled rows that a fit takes, on average
N_TERMS = 6_000  # terms of the machine
MIN_ROWS = 3  # rows that a term must occur in
MIN_GAIN = 2.0  # log-likelihood ratio of a term; below it the term tells nothing about the label
PAIR_TERMS = 1_500  # terms whose pairs are counted, besides as many of the best single ones
PAIR_GAIN = 20.0  # log-likelihood ratio that a pair has above those of its members
PAIRS = 500  # pairs whose terms go into the machine
FACTORS = 6  # length of the vector of a term
KNOWN = 200_000  # distinct words whose terms a worker remembers

WORD = re.compile(r"\w+")


def term_numbers(word: str) -> list[int]:
    parts = {word} | {word[:n] + "*" for n in (4, 5) if len(word) >= n}
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts]


class Terms:
    """Distinct term numbers of texts; those outside ``wanted`` are left out."""

    def __init__(self, wanted=None):
        self.wanted, self.known = wanted, {}

    def of(self, text: str | None) -> list[int]:
        words = set(WORD.findall((text or "").lower()))
        known, wanted = self.known, self.wanted
        if len(known) > KNOWN:
            known.clear()
        for w in [w for w in words if w not in known]:
            known[w] = tuple([t for t in term_numbers(w) if wanted is None or t in wanted])
        found = set()
        for w in words:
            found.update(known[w])
        return sorted(found)


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))


def _segments(lists) -> tuple[np.ndarray, np.ndarray]:
    """All numbers in a row, and the row that each belongs to."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((x for one in lists for x in one), np.int64, int(sizes.sum()))
    return flat, np.repeat(np.arange(len(lists)), sizes)


@dataclass
class FactorizationMachine:
    """``terms`` are the sorted term numbers; row t of the weights belongs to terms[t]."""

    terms: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, lists) -> np.ndarray:
        """Probability for each list of term numbers (all of them in ``terms``)."""
        flat, row = _segments(lists)
        at = np.searchsorted(self.terms, flat)
        n = len(lists)
        out = np.full(n, self.bias) + np.bincount(row, self.linear[at], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[at, f]
            out += 0.5 * (np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))

    @staticmethod
    def fit(terms, lists, labels, factors=FACTORS, epochs=12, steps=200, rate=0.05, decay=1e-2, seed=7):
        """Logistic loss, adaptive gradient steps over batches of 256 rows: ``epochs`` times over all
        rows, and ``steps`` batches at least."""
        y = np.asarray(labels, float)
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
        rng = np.random.default_rng(seed)
        machine = FactorizationMachine(
            np.asarray(terms, np.int64), math.log(share / (1 - share)), np.zeros(len(terms)),
            rng.normal(0, 0.01, (len(terms), factors)),
        )
        if len(y) == 0 or y.min() == y.max() or not len(terms):
            return machine
        w, v, bias = machine.linear, machine.factors, machine.bias
        gw, gv, gb = np.full(w.shape, 1e-8), np.full(v.shape, 1e-8), 1e-8
        flat, row = _segments(lists)
        at = np.searchsorted(machine.terms, flat)
        first = np.searchsorted(row, np.arange(len(y) + 1))
        for _ in range(max(epochs, math.ceil(steps * 256 / len(y)))):
            order = rng.permutation(len(y))
            for start in range(0, len(y), 256):
                rows = order[start : start + 256]
                take = np.concatenate([np.arange(first[r], first[r + 1]) for r in rows])
                t, size = at[take], (first[rows + 1] - first[rows])
                r = np.repeat(np.arange(len(rows)), size)
                vt = v[t]
                sums = np.zeros((len(rows), factors))
                np.add.at(sums, r, vt)
                squares = np.bincount(r, (vt * vt).sum(axis=1), len(rows))
                out = bias + np.bincount(r, w[t], len(rows)) + 0.5 * ((sums**2).sum(axis=1) - squares)
                error = 1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[rows]
                seen, slot = np.unique(t, return_inverse=True)
                dw = np.bincount(slot, error[r], len(seen)) + decay * w[seen]
                dv = np.zeros((len(seen), factors))
                np.add.at(dv, slot, error[r][:, None] * (sums[r] - vt))
                dv += decay * v[seen]
                gw[seen] += dw * dw
                gv[seen] += dv * dv
                gb += error.sum() ** 2
                w[seen] -= rate * dw / np.sqrt(gw[seen])
                v[seen] -= rate * dv / np.sqrt(gv[seen])
                bias -= rate * error.sum() / math.sqrt(gb)
        machine.bias = bias
        return machine


def sampled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, key="doc_id", text="text") -> DataFrame:
    """doc_id, text, label of the labelled rows, thinned by a hash of the key to about ``max_rows``."""
    marks = (
        labels.select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter("doc_id is not null and label is not null")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    rows = marks.count()
    if rows > max_rows:
        limit = int(2**31 * max_rows / rows)
        thin = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), F.col("doc_id")), 33) < limit
        # the same test on both sides, so only the texts of the sample are shuffled
        return _texts(docs, key, text).filter(thin).join(marks.filter(thin), "doc_id")
    return _texts(docs, key, text).join(marks, "doc_id")


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, n_terms: int = N_TERMS,
    key: str = "doc_id", text: str = "text",
) -> FactorizationMachine:
    """Fit a machine to the labels of ``labels`` (key and label) that belong to rows of ``docs``."""

    def terms_of(batches):
        terms = Terms()
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [terms.of(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label"), pa.array(found, pa.list_(pa.int32()))], ["label", "terms"]
                )

    sample = sampled(docs, labels, label, max_rows, key, text).select("label", "text")
    rows, _ = stored(sample.mapInArrow(terms_of, "label int, terms array<int>"), "terms")
    total = {r["label"]: r["n"] for r in rows.groupBy((F.col("label") > 0).alias("label")).agg(F.count("*").alias("n")).collect()}
    pos, neg = total.get(True, 0), total.get(False, 0)
    counts = (
        rows.select(F.explode("terms").alias("term"), (F.col("label") > 0).cast("long").alias("y"))
        .groupBy("term")
        .agg(F.sum("y").alias("a"), F.count("*").alias("n"))
        .filter(F.col("n") >= MIN_ROWS)
    )
    # log-likelihood ratio of the term's occurrence against the label
    a, n, rows_all = F.col("a"), F.col("n"), pos + neg

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    share, rest = n / F.lit(max(rows_all, 1)), 1 - n / F.lit(max(rows_all, 1))
    gain = (
        part(a, share * pos) + part(n - a, share * neg) + part(pos - a, rest * pos) + part(neg - n + a, rest * neg)
    )
    best = counts.select("term", gain.alias("gain")).filter(F.col("gain") >= MIN_GAIN).orderBy(F.desc("gain"), "term").limit(n_terms)
    alone = [r["term"] for r in best.collect()]  # n_terms at most
    often = counts.orderBy(F.desc(F.least(n, F.lit(rows_all) - n)), "term").limit(PAIR_TERMS)
    paired = sorted({r["term"] for r in often.collect()} | set(alone[:PAIR_TERMS]))
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(alone) | frozenset(paired))

    def keep(batches):
        for batch in batches:
            lists = [[t for t in x if t in shared.value] for x in batch.column("terms").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(lists, pa.list_(pa.int32()))], ["label", "terms"])

    kept = rows.mapInArrow(keep, "label int, terms array<int>").toArrow()  # about max_rows rows
    lists = [sorted(x) for x in kept.column("terms").to_pylist()]
    labels_kept = [int(x > 0) for x in kept.column("label").to_pylist()]
    terms = np.array(sorted(set(alone) | telling_pairs(np.array(paired, np.int64), lists, labels_kept)), np.int64)
    wanted = set(terms.tolist())
    lists = [[t for t in x if t in wanted] for x in lists]
    order = sorted(range(len(lists)), key=lambda i: (lists[i], labels_kept[i]))  # independent of task order
    return FactorizationMachine.fit(terms, [lists[i] for i in order], [labels_kept[i] for i in order])


def telling_pairs(terms: np.ndarray, lists, labels) -> set[int]:
    """Terms of the pairs that tell the label by more than PAIR_GAIN above what their members tell
    alone, of PAIRS pairs at most. ``terms`` are sorted."""
    k, y = len(terms), np.asarray(labels, float)
    if k < 2 or not len(y) or y.min() == y.max():
        return set()
    both = np.zeros((2, k, k), np.float32)
    for start in range(0, len(y), 1024):
        flat, row = _segments(lists[start : start + 1024])
        at = np.searchsorted(terms, flat)
        inside = np.minimum(at, k - 1)
        known = terms[inside] == flat
        x = np.zeros((len(lists[start : start + 1024]), k), np.float32)
        x[row[known], inside[known]] = 1
        both[0] += x.T @ x
        both[1] += x.T @ (x * y[start : start + 1024, None].astype(np.float32))
    rows, toxic = len(y), y.sum()
    n, a = both[0].diagonal().astype(float), both[1].diagonal().astype(float)

    def tells(seen, positive):
        """Log-likelihood of the labels of ``seen`` rows against the share of all."""
        def part(c, share):
            return np.where(c > 0, c * np.log(np.maximum(c, 1e-9) / np.maximum(seen * share, 1e-9)), 0.0)

        return part(positive, toxic / rows) + part(seen - positive, 1 - toxic / rows)

    single = tells(n, a) + tells(rows - n, toxic - a)
    found = []
    for i in range(k - 1):
        n11, a11 = both[0, i, i + 1 :].astype(float), both[1, i, i + 1 :].astype(float)
        n2, a2 = n[i + 1 :], a[i + 1 :]
        joint = tells(n11, a11) + tells(n[i] - n11, a[i] - a11) + tells(n2 - n11, a2 - a11)
        joint += tells(rows - n[i] - n2 + n11, toxic - a[i] - a2 + a11)
        gain = joint - single[i] - single[i + 1 :]
        for j in np.flatnonzero(gain >= PAIR_GAIN):
            found.append((-float(gain[j]), int(terms[i]), int(terms[i + 1 + j])))
    return {t for _, *pair in sorted(found)[:PAIRS] for t in pair}


def score_toxicity(docs: DataFrame, machine: FactorizationMachine, key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, score of each row; with ``keep`` also all columns of ``docs`` in a struct ``row``."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    row = [F.struct(*[F.col(c) for c in docs.columns]).alias("row")] if keep else []
    frame = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), *row)
    carried = ["doc_id", *(["row"] if keep else [])]
    schema = T.StructType([*[frame.schema[c] for c in carried], T.StructField("score", T.DoubleType())])

    def score(batches):
        machine = shared.value
        terms = Terms(frozenset(machine.terms.tolist()))
        for whole in batches:
            for batch in slices(whole, "text"):
                values = machine.score([terms.of(t) for t in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in carried], pa.array(values)], [*carried, "score"]
                )

    return frame.mapInArrow(score, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document; rows with crc32(doc_id) mod 5 = 0 are held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = fit_toxicity(docs, labels.filter(key_crc("doc_id") % 5 != 0))
    return score_toxicity(docs, machine).select(
        "doc_id",
        (key_crc("doc_id") % 5 == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
