"""Quality by histogram gradient-boosted trees over document statistics.

Each text becomes the numbers of ``STATISTICS``. Trees are grown level by level from histograms
of at most BINS quantile bins per statistic, and then flattened: every tree is a complete binary
tree in arrays of columns, thresholds and leaf values, and a batch of texts goes through all
trees with one array step per level.

Fitting takes the labelled rows, sampled by a hash of their key down to about ``max_rows`` (the
documented bound); only their statistics reach the driver. Scoring reads whole texts and needs
no shuffle.

Cases: null and empty texts have zeros for all statistics and are scored like any other;
unlabelled rows and null labels are not learned from; a key that is labelled more than once takes
its largest label; with one class of labels only, or none, the score is constant; keys may be
null or repeat, rows stay as they are; empty tables give empty results. Columns other than key
and text are ignored.
"""

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotspark.llm.common import key_crc, slices, table
from shotspark.llm.toxicity import sampled

MAX_ROWS = 20_000  # labelled rows that a fit takes, on average
BINS = 64
TREES = 120
DEPTH = 4
RATE = 0.1
SMOOTHING = 1.0  # added to the second derivatives of a leaf

STATISTICS = (
    "log_chars", "log_words", "log_lines", "word_length", "long_words", "short_words", "distinct_words",
    "top_word", "repeated_pairs", "upper", "capitalised", "all_caps", "digits", "spaces", "punctuation",
    "symbols", "letters", "beyond_ascii", "line_length", "repeated_lines", "repeated_line_chars", "short_lines",
    "ended_lines", "bulleted_lines", "marked_words", "ended_words", "lone_marks", "sentence_words",
    "repeated_runs", "vowels", "entropy", "links",
)

SYMBOL = set("#$%&*+/<=>@\\^_`{|}~[]")
POINT = set(".,;:!?'\"()-")
LINK = re.compile(r"https?:|www\.|@\w+\.|</?\w")


def statistics(text: str | None) -> list[float]:
    """The values of STATISTICS for one whole text."""
    if not text:
        return [0.0] * len(STATISTICS)
    n = len(text)
    words = text.split()
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    chars = Counter(text)
    counted = Counter(words)
    m, k = max(1, len(words)), max(1, len(lines))
    upper = letters = digits = spaces = points = symbols = beyond = vowels = 0
    spread = 0.0
    for c, x in chars.items():
        spread -= x / n * math.log2(x / n)
        if ord(c) > 127:
            beyond += x
        if c.isalpha():
            letters += x
            if c.isupper():
                upper += x
            if c in "aeiouAEIOU":
                vowels += x
        elif c.isdigit():
            digits += x
        elif c.isspace():
            spaces += x
        elif c in SYMBOL:
            symbols += x
        else:
            points += x
    length = long = short = capital = caps = marked = ended = lone = 0
    for w, x in counted.items():
        size = len(w)
        length += x * size
        long += x * (size > 12)
        short += x * (size <= 3)
        if w[0].isupper():
            capital += x
            caps += x * (size > 1 and w.isupper())
        if not w[-1].isalnum():
            ended += x * (w[-1] in ".!?")
            marked += x * (w[-1] in SYMBOL or (size > 1 and w[-1] == w[-2]))
            lone += x * (not any(map(str.isalnum, w)))
    pairs = Counter(zip(words, words[1:]))
    runs = Counter(zip(words, words[1:], words[2:], words[3:], words[4:]))
    seen = Counter(lines)
    again = [(x, v) for x, v in seen.items() if v > 1]
    sentences = max(1, sum(text.count(c) for c in ".!?"))
    return [
        math.log1p(n), math.log1p(len(words)), math.log1p(len(lines)), length / m, long / m, short / m,
        len(counted) / m, max(counted.values(), default=0) / m, 1 - len(pairs) / max(1, len(words) - 1),
        upper / max(1, letters), capital / m, caps / m, digits / n, spaces / n, points / n, symbols / n, letters / n,
        beyond / n, math.log1p(n / k), sum(v - 1 for _, v in again) / k, sum((v - 1) * len(x) for x, v in again) / n,
        sum(len(x) < 30 for x in lines) / k, sum(x[-1] in ".!?" for x in lines) / k,
        sum(not x[0].isalnum() for x in lines) / k, marked / m, ended / m, lone / m, math.log1p(len(words) / sentences),
        1 - len(runs) / max(1, len(words) - 4), vowels / max(1, letters), spread, len(LINK.findall(text)) / m,
    ]


@dataclass
class Trees:
    """Complete trees of one depth. ``column`` and ``limit`` have a row per tree with the inner
    nodes in level order (a value above the limit goes right), ``leaf`` the leaves from left to
    right. Unsplit nodes have an infinite limit."""

    bias: float
    depth: int
    column: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray

    def score(self, values: np.ndarray) -> np.ndarray:
        """Probability for each row of ``values``; all trees go down one level at a time."""
        rows, trees = np.arange(len(values))[:, None], np.arange(len(self.column))[None, :]
        node = np.zeros((len(values), len(self.column)), np.int64)
        for _ in range(self.depth):
            right = values[rows, self.column[trees, node]] > self.limit[trees, node]
            node = 2 * node + 1 + right
        out = self.bias + self.leaf[trees, node - (2**self.depth - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))

    @staticmethod
    def fit(values, labels, n_trees=TREES, depth=DEPTH, rate=RATE, bins=BINS, smoothing=SMOOTHING, least=8):
        values, y = np.asarray(values, float), np.asarray(labels, float)
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
        inner = 2**depth - 1
        if len(y) == 0 or y.min() == y.max():
            n_trees = 0
        model = Trees(
            math.log(share / (1 - share)), depth, np.zeros((n_trees, inner), np.int64),
            np.full((n_trees, inner), np.inf), np.zeros((n_trees, inner + 1)),
        )
        if not n_trees:
            return model
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in values.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, values.T)], axis=1)
        width, n_cols = bins + 1, values.shape[1]
        offset = np.arange(n_cols) * width
        out = np.full(len(y), model.bias)
        for t in range(n_trees):
            p = 1 / (1 + np.exp(-out))
            grad, hess = p - y, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for level in range(depth):
                first, size = 2**level - 1, 2**level
                slot = ((node - first)[:, None] * n_cols * width + offset + binned).ravel()
                shape = (size, n_cols, width)
                g, h, c = (
                    np.bincount(slot, np.repeat(x, n_cols), size * n_cols * width).reshape(shape).cumsum(axis=2)
                    for x in (grad, hess, np.ones(len(y)))
                )
                total_g, total_h, total_c = (x[:, :, -1:] for x in (g, h, c))

                def worth(a, b):
                    return a * a / (b + smoothing)

                gain = worth(g, h) + worth(total_g - g, total_h - h) - worth(total_g, total_h)
                gain[(c < least) | (total_c - c < least)] = 0
                flat = gain.reshape(size, -1)
                best = flat.argmax(axis=1)
                for k in np.flatnonzero(flat.max(axis=1) > 1e-9):
                    col, cut = divmod(int(best[k]), width)
                    if cut < len(edges[col]):
                        model.column[t, first + k], model.limit[t, first + k] = col, edges[col][cut]
                right = values[np.arange(len(y)), model.column[t, node]] > model.limit[t, node]
                node = 2 * node + 1 + right
            leaf = node - inner
            g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
            model.leaf[t] = -rate * g / (h + smoothing)
            out += model.leaf[t][leaf]
        return model


def _statistics_of(batch) -> np.ndarray:
    texts = batch.column("text").to_pylist()
    return np.array([statistics(t) for t in texts]).reshape(len(texts), len(STATISTICS))


def fit_quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, key: str = "doc_id", text: str = "text",
) -> Trees:
    """Fit trees to the labels of ``labels`` (key and label) that belong to rows of ``docs``."""

    def measure(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = _statistics_of(batch)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label"), pa.array(list(rows), pa.list_(pa.float64()))], ["label", "v"]
                )

    sample = sampled(docs, labels, label, max_rows, key, text).select("label", "text")
    found = sample.mapInArrow(measure, "label int, v array<double>").toArrow()  # about max_rows rows
    values = np.array(found.column("v").to_pylist()).reshape(-1, len(STATISTICS))
    y = np.array([int(x > 0) for x in found.column("label").to_pylist()])
    order = np.lexsort([y, *values.T[::-1]]) if len(y) else np.arange(0)  # independent of task order
    return Trees.fit(values[order], y[order])


def score_quality(docs: DataFrame, trees: Trees, key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, score of each row; with ``keep`` also all columns of ``docs`` in a struct ``row``."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    row = [F.struct(*[F.col(c) for c in docs.columns]).alias("row")] if keep else []
    frame = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), *row)
    carried = ["doc_id", *(["row"] if keep else [])]
    schema = T.StructType([*[frame.schema[c] for c in carried], T.StructField("score", T.DoubleType())])

    def score(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                values = shared.value.score(_statistics_of(batch))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in carried], pa.array(values)], [*carried, "score"]
                )

    return frame.mapInArrow(score, schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document; rows with crc32(doc_id) mod 3 = 1 are held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    trees = fit_quality(docs, labels.filter(key_crc("doc_id") % 3 != 1))
    return score_quality(docs, trees).select(
        "doc_id",
        (key_crc("doc_id") % 3 == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
