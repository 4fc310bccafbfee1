"""Embedding whitening by spectrum slicing.

Entries become integers, floor(64 * c) + 1000000. The fit list holds each distinct vector once.
Its sums S and, around the rounded mean, its sums of products are exact integers, so the
covariance V is rounded only once and does not depend on how Spark deals out the rows.

The eigenpairs of V are found on the driver, from dim x dim numbers:

1. The signs of the pivots of an LDL' factorization of V - s tell how many eigenvalues lie above s
   (Sylvester). Bisection by these counts isolates each of the leading eigenvalues.
2. Rayleigh quotient iteration converges cubically from inside the isolating interval. A result
   outside of it is refused, and bisection goes on.
3. Counts on both sides of the result certify its number. Eigenvalues that no interval can tell
   apart form a group; its vectors are made orthogonal to each other.

All rows are then projected in one pass. The covariance of the whitened fit list is measured from
the data for ``identity_error``.

Cases: rows whose vector is null or holds null, NaN or infinite entries are dropped; of the
others, those of the commonest length stay (ties: the longer one), empty vectors do not; repeated
rows stay and count once in the fit; keys may be null or repeat; a component whose eigenvalue is
zero to double precision has no whitened values and is left out, so one distinct vector or an empty
table give an empty result; sums that leave 64 bits are added in Python integers, and a deviation that
does not fit a long is null; a scaled entry beyond 2**52 raises, since a double does not hold it
exactly. Only key and vector are read, so further columns cannot clash.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotspark.llm.common import stored, table

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
ROWS = 4096  # vectors multiplied together; products of entries below 2**20 are exact in doubles
LIMIT = 1 << 52
_LONG = (1 << 63) - 1


# --- spectrum slicing -----------------------------------------------------------------------


def count_above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric matrix exceed ``shift``: the positive pivots of an
    LDL' factorization with pivots of one or two rows (Bunch and Parlett's rule)."""
    a = v - shift * np.eye(len(v))
    alpha, above = (1 + math.sqrt(17)) / 8, 0
    while len(a):
        size = np.abs(a)
        d = int(size.diagonal().argmax())
        i, j = divmod(int(size.argmax()), len(a))
        if size[i, j] == 0:
            break
        if size[d, d] >= alpha * size[i, j]:
            above += a[d, d] > 0
            rest = np.delete(np.arange(len(a)), d)
            col = a[rest, d]
            a = a[np.ix_(rest, rest)] - np.outer(col, col) / a[d, d]
        else:  # a block of two rows has one eigenvalue of each sign
            above += 1
            rest = np.delete(np.arange(len(a)), [i, j])
            cols = a[np.ix_(rest, [i, j])]
            a = a[np.ix_(rest, rest)] - cols @ np.linalg.solve(a[np.ix_([i, j], [i, j])], cols.T)
        a = (a + a.T) / 2
    return int(above)


def _solve(v: np.ndarray, shift: float, x: np.ndarray, tiny: float) -> np.ndarray:
    for s in (shift, shift + tiny, shift - 3 * tiny):
        try:
            y = np.linalg.solve(v - s * np.eye(len(v)), x)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(y).all() and y.any():
            return y / np.linalg.norm(y)
    return x


def _apart(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for o in others:
            x = x - (o @ x) * o
    return x / np.linalg.norm(x)


def leading_pairs(v: np.ndarray, n: int) -> list[tuple[float, np.ndarray]]:
    """The ``n`` largest eigenvalues above zero, falling, with unit vectors; fewer where the
    matrix has fewer."""
    dim, top = len(v), float(np.abs(v).sum(axis=1).max(initial=0.0))
    if top == 0:
        return []
    tiny = dim * np.finfo(float).eps * top  # what doubles tell apart
    counts: dict[float, int] = {}

    def above(s):
        if s not in counts:
            counts[s] = count_above(v, s)
        return counts[s]

    n, pairs = min(n, above(tiny)), []
    while len(pairs) < n:
        k = len(pairs)  # eigenvalues known to lie above
        low = max((s for s, c in counts.items() if c > k), default=tiny)
        high = min((s for s, c in counts.items() if c <= k), default=top + tiny)
        # bisection: the next eigenvalue alone between low and high, or a group that stays together
        while above(low) > k + 1 and high - low > 2 * tiny:
            middle = (low + high) / 2
            low, high = (middle, high) if above(middle) > k else (low, middle)
        pair = None
        while above(low) == k + 1 and pair is None:
            pair = _quotients(v, low, high, [x for _, x in pairs], tiny)
            # the counts certify the number: k eigenvalues above it, k + 1 with it
            if pair and (above(pair[0] + 2 * tiny) > k or above(pair[0] - 2 * tiny) < k + 1):
                pair = None
            if pair is None and high - low <= 2 * tiny:
                break
            if pair is None:
                middle = (low + high) / 2
                low, high = (middle, high) if above(middle) > k else (low, middle)
        if pair is not None:
            pairs.append(pair)
        else:
            for x in _group(v, (low + high) / 2, max(above(low) - k, 1), [x for _, x in pairs], tiny):
                pairs.append((float(x @ v @ x), x))
    # values of a group may come in any order
    return sorted(pairs[:n], key=lambda p: -p[0])


def _quotients(v, low, high, others, tiny):
    """Rayleigh quotient iteration from the middle of an interval that holds one eigenvalue; None
    where it leaves the interval."""
    x = _apart(np.cos(np.arange(1, len(v) + 1) * 1.7), others)
    for _ in range(3):
        x = _apart(_solve(v, (low + high) / 2, x, tiny), others)
    for _ in range(12):
        value = float(x @ v @ x)
        if not low < value <= high:
            return None
        if np.linalg.norm(v @ x - value * x) <= tiny:
            return value, x
        x = _solve(v, value, x, tiny)
        x = _apart(x, others)
    return None


def _group(v, shift, n, others, tiny):
    """An orthonormal basis for ``n`` eigenvalues that cannot be told apart."""
    found = []
    for i in range(n):
        x = _apart(np.cos(np.arange(1, len(v) + 1) * (1.7 + i)), others + found)
        for _ in range(6):
            x = _apart(_solve(v, shift, x, tiny), others + found)
        found.append(x)
    return found


# --- tables ---------------------------------------------------------------------------------


def integers(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, x (array of long) of the rows without missing or non-finite entries."""
    v = F.col(vector)
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    wide = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)
    bound = F.forall(v, lambda c: F.abs(c.cast("double")) < LIMIT / SCALE - SHIFT)
    whole = F.when(bound, wide).otherwise(F.raise_error(F.lit("a vector entry is too large for exact sums")))
    return rows.filter(v.isNotNull() & (F.size(v) > 0) & sound).select(F.col(key).alias("key"), whole.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), -1)


def _pieces(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, _matrix(part.column("x"))


def _products(fit: DataFrame, center: list[int]) -> tuple[list, list]:
    """Exact sums of y and of y y', with y = x - center, over all rows of ``fit``."""
    dim, mean = len(center), np.array(center, np.int64)

    def compute(batches):
        first, second = np.zeros(dim, object), np.zeros((dim, dim), object)
        for _, x in _pieces(batches):
            y = x - mean
            if np.abs(y).max() < 1 << 20:
                wide = y.astype(float)
                first += y.sum(axis=0).astype(object)
                second += (wide.T @ wide).astype(np.int64).astype(object)
            else:
                big = y.astype(object)
                first += big.sum(axis=0)
                second += big.T @ big
        i, j = np.triu_indices(dim)
        at = np.concatenate([np.arange(dim), i]).astype(np.int32), np.concatenate([np.full(dim, -1), j]).astype(np.int32)
        values = [str(a) for a in [*first, *second[i, j]]]
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(values)], ["i", "j", "value"])

    parts = fit.select("x").mapInArrow(compute, "i int, j int, value string")
    rows = parts.groupBy("i", "j").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()  # dim**2 rows
    first, second = [0] * dim, [[0] * dim for _ in range(dim)]
    for r in rows:
        if r["j"] < 0:
            first[r["i"]] = int(r["value"])
        else:
            second[r["i"]][r["j"]] = second[r["j"]][r["i"]] = int(r["value"])
    return first, second


class Whitening:
    """The fitted projection: ``n``, ``sums`` (exact), ``pairs`` and the trace of the covariance."""

    def __init__(self, fit: DataFrame, components: int = COMPONENTS):
        facts = fit.agg(F.count("*").alias("n"), F.first(F.size("x")).alias("dim")).first()
        self.n, self.dim = facts["n"], facts["dim"] or 0
        self.sums, self.pairs, self.trace = [], [], 0.0
        if not self.n:
            return
        row = fit.agg(*[F.sum(F.col("x")[i].cast("decimal(38,0)")) for i in range(self.dim)]).first()
        self.sums = [int(s) for s in row]
        center = [s // self.n for s in self.sums]
        first, second = _products(fit, center)
        n = self.n
        v = [[(n * second[i][j] - first[i] * first[j]) / (n * n) for j in range(self.dim)] for i in range(self.dim)]
        self.trace = sum(n * second[i][i] - first[i] ** 2 for i in range(self.dim)) / (n * n)
        self.pairs = leading_pairs(np.array(v, float), components)

    def weights(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Integer part of the mean, its fraction, and one scaled vector per component."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([(s % self.n) / self.n for s in self.sums])
        return whole, part, np.array([x / math.sqrt(e) for e, x in self.pairs]).reshape(-1, self.dim)

    def identity_error(self, fit: DataFrame) -> float:
        """Largest entry of the covariance of the whitened fit list minus the identity."""
        whole, part, scaled = self.weights()
        k = len(scaled)

        def compute(batches):
            total, mean = np.zeros((k, k)), np.zeros(k)
            for _, x in _pieces(batches):
                w = ((x - whole) - part) @ scaled.T
                total += w.T @ w
                mean += w.sum(axis=0)
            flat = np.concatenate([total.ravel(), mean])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["at", "value"])

        parts = fit.select("x").mapInArrow(compute, "at int, value double")
        rows = dict(parts.groupBy("at").agg(F.sum("value")).collect())  # k**2 + k rows
        flat = np.array([rows[i] for i in range(k * k + k)]) / self.n
        mean = flat[k * k :]
        return float(np.abs(flat[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list:
    """Exact sums of (n * x - S)**2 over the dimensions; None where 64 bits do not hold one."""
    center = np.array([s // n for s in sums], np.int64)
    rest = [s % n for s in sums]
    widest = int(np.abs(x - center).max(initial=0)) + 1
    if (n * widest) ** 2 * x.shape[1] <= _LONG:
        d = (x - center) * n - np.array(rest, np.int64)
        return np.einsum("ij,ij->i", d, d).tolist()
    d = (x - center).astype(object) * n - np.array(rest, object)
    return [s if s <= _LONG else None for s in (d * d).sum(axis=1).tolist()]


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: one row for each row that
    stays and each component."""
    spark = rows.sparkSession
    kept, _ = stored(integers(rows, key, vector), "vectors")
    lengths = kept.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    kept = kept.filter(F.size("x") == (lengths[0]["d"] if lengths else 0))
    # equal vectors meet in partial aggregations first, so a hot vector is one row per task
    fit, _ = stored(kept.select("x").distinct(), "fit-list")
    fitted = Whitening(fit, components)
    key_type = kept.schema["key"].dataType.simpleString()
    schema = (
        f"key {key_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    if not fitted.pairs:
        return spark.createDataFrame([], schema)
    whole, part, scaled = fitted.weights()
    n, sums, k = fitted.n, fitted.sums, len(fitted.pairs)
    explained, error = np.array([e / fitted.trace for e, _ in fitted.pairs]), fitted.identity_error(fit)

    def project(batches):
        for batch, x in _pieces(batches):
            w = ((x - whole) - part) @ scaled.T
            rows_of = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(pa.array(rows_of)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(rows_of), n)), pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(rows_of)),
                    pa.array(w.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(rows_of), error)),
                ],
                ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return kept.mapInArrow(project, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 16 leading components of each vector."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("key", "vec_id")
