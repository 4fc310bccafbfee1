"""Linear fits of many candidates and folds from the same scans.

A random search with 100 draws and 5 folds has 500 fits. Here a scan gives every fit that has not
converged its gradient and curvature (logistic), or all fits at once their Gram matrices (least
squares): tasks add up arrays, Spark adds up the tasks, and the driver solves problems as wide as the
features. A fold's fit leaves out the rows of the fold; encoders are fitted without them too, so a
row holds one feature vector per fold.
"""

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotspark.scale import materialize, prefix_sums

STEPS = 200  # scans of a logistic fit; more is an error, never a silent end
NUMBERS = 4_000_000  # sums that a task holds in one scan; more candidates take several scans


def fold_rows(df: DataFrame, prep, folds: int, fold, key, label: str = "label", stored: bool = False) -> tuple[DataFrame, list]:
    """label, fold, h (a hash of the key), x0, x1, ...: the features of a row as encoders fitted
    without each fold give them, and these encoders. A fold that no row is in leaves out nothing.
    Rows that are not ``stored`` are written first, as every encoder reads them."""
    rows = (df if stored else materialize(df, "training")).withColumns({"fold": fold.cast("int"), "h": F.xxhash64(*key)})
    out, preps = rows, []
    for k in range(folds):
        preps.append(prep.fit(rows.filter(F.col("fold") != k).drop("fold", "h")))
        out = preps[-1].transform(out).select(*out.columns, vector_to_array("features").alias(f"x{k}"))
    own = [f"x{k}" for k in range(folds)]
    return materialize(out.select(F.col(label).cast("double").alias("label"), "fold", "h", *own), "fold-rows"), preps


def widths(rows: DataFrame, folds: int) -> list[int]:
    first = rows.select(*[F.size(f"x{k}") for k in range(folds)]).first()
    if first is None:
        raise ValueError("no rows to fit")
    return list(first)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def packed(cells: np.ndarray) -> pa.Array:
    """Each row of a matrix as bytes."""
    n, size = len(cells), cells.itemsize * cells.shape[1]
    ends = pa.py_buffer(np.arange(0, (n + 1) * size, size, dtype=np.int32)[: n + 1])
    return pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(np.ascontiguousarray(cells))])


def unpacked(column: pa.Array, kind, width: int) -> np.ndarray:
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros((0, width), kind)
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(-1, width)


def with_ones(x: np.ndarray, columns: int) -> np.ndarray:
    return np.column_stack([np.ones((len(x), columns)), x]) if columns else x


def _added(parts: DataFrame, size: int) -> np.ndarray:
    """Sums of (at, value) over all tasks."""
    total = np.zeros(size)
    for r in parts.groupBy("at").agg(F.sum("value").alias("value")).collect():
        total[r["at"]] = r["value"]
    return total


def _emit(total: np.ndarray):
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "value"])


def added_arrays(parts: DataFrame) -> DataFrame:
    """node, sums: arrays of doubles added up by node. A node has one row per task of the scan."""

    def add(batches):
        added = {}
        for batch in batches:
            for node, blob in zip(batch.column("node").to_pylist(), batch.column("sums").to_pylist()):
                part = np.frombuffer(blob)
                added[node] = added[node] + part if node in added else part
        at = sorted(added)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([added[i].tobytes() for i in at], pa.binary())], ["node", "sums"])

    return parts.repartition("node").mapInArrow(add, "node long, sums binary")


# --- least squares ------------------------------------------------------------------------


def gram_matrices(rows: DataFrame, folds: int) -> list[list[np.ndarray]]:
    """For the features of each fold, the Gram matrix of (1, x, y) over the rows of each fold."""
    wide = widths(rows, folds)
    shapes = [(w + 2) ** 2 for w in wide]
    starts = np.concatenate([[0], np.cumsum([s * folds for s in shapes])])

    def compute(batches):
        total = np.zeros(starts[-1])
        for batch in batches:
            y, fold = batch.column("label").to_numpy(), batch.column("fold").to_numpy()
            for k, w in enumerate(wide):
                z = np.column_stack([np.ones(len(y)), _matrix(batch.column(f"x{k}"), w), y])
                for f in range(folds):
                    part = z[fold == f]
                    at = starts[k] + f * shapes[k]
                    total[at : at + shapes[k]] += (part.T @ part).ravel()
        yield _emit(total)

    total = _added(rows.mapInArrow(compute, "at long, value double"), starts[-1])
    return [
        [total[starts[k] + f * s : starts[k] + (f + 1) * s].reshape(w + 2, w + 2) for f in range(folds)]
        for k, (w, s) in enumerate(zip(wide, shapes))
    ]


def elastic_descent(a: np.ndarray, b: np.ndarray, l1: float, l2: float, free: int = 0, start=None) -> np.ndarray:
    """Minimum of x'Ax/2 - b'x + l1 |x| + l2 x^2/2 by coordinate descent; the first ``free``
    coordinates bear no penalty, and one without curvature stays as it is. It ends when a whole round
    gains less than 1e-12 of what the fit has gained."""
    first, second = np.full(len(b), float(l1)), np.full(len(b), float(l2))
    first[:free] = second[:free] = 0.0
    if not l1:
        return np.linalg.lstsq(a + np.diag(second), b, rcond=None)[0]
    x = np.zeros(len(b)) if start is None else start.copy()
    rest = b - a @ x
    curve = a.diagonal() + second
    for _ in range(1_000_000):
        gain = 0.0
        for j in range(len(b)):
            if curve[j] <= 0:
                continue
            at = rest[j] + a[j, j] * x[j]
            new = np.sign(at) * max(abs(at) - first[j], 0.0) / curve[j]
            if new != x[j]:
                rest -= a[:, j] * (new - x[j])
                gain += curve[j] * (new - x[j]) ** 2
                x[j] = new
        if gain <= 1e-12 * abs(b @ x):
            return x
    raise ArithmeticError("coordinate descent has not converged")


def least_squares(gram: np.ndarray, alpha: float, l1: bool) -> np.ndarray:
    """Intercept and weights that minimise the mean squared error / 2 plus alpha times the penalty
    (|w| or |w|^2 / 2; none on the intercept)."""
    n = gram[0, 0]
    return elastic_descent(gram[:-1, :-1] / n, gram[:-1, -1] / n, alpha if l1 else 0.0, 0.0 if l1 else alpha, 1)


def squared_error(gram: np.ndarray, weights: np.ndarray) -> float:
    """Mean squared error over the rows of a Gram matrix."""
    full = np.append(weights, -1.0)
    return float(max(full @ gram @ full, 0.0) / gram[0, 0])


# --- logistic -----------------------------------------------------------------------------


class LogisticFits:
    """Fits for (fold, penalty, strength, balanced) candidates: the sum of weighted log losses plus
    strength times |w|^2 / 2 or |w|. ``weights[i]`` is the result; with ``intercept`` its first number
    is the intercept, which bears no penalty."""

    def __init__(self, rows: DataFrame, folds: int, candidates: list[tuple[int, str, float, bool]], intercept: bool = False):
        self.rows, self.folds, self.candidates, self.free = rows, folds, candidates, int(intercept)
        self.wide = [w + self.free for w in widths(rows, folds)]
        counts = {(r["fold"], r["label"]): r["n"] for r in rows.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}
        self.class_weights = [self._balance(counts, f) for f in range(folds)]
        self.weights = [np.zeros(self.wide[f]) for f, *_ in candidates]
        self._fit()

    def _balance(self, counts, fold):
        per = {}
        for (f, y), n in counts.items():
            if f != fold:
                per[y] = per.get(y, 0) + n
        return {y: sum(per.values()) / (len(per) * n) for y, n in per.items()}

    def _scan(self, active: list[int], points: dict[int, np.ndarray]) -> dict:
        """(loss, gradient, curvature) of the active candidates at their points."""
        out, part, size = {}, [], 0
        for i in active:
            d = self.wide[self.candidates[i][0]]
            if part and size + 1 + d + d * d > NUMBERS:
                out |= self._scan_part(part, points)
                part, size = [], 0
            part.append(i)
            size += 1 + d + d * d
        return out | self._scan_part(part, points)

    def _scan_part(self, active, points):
        groups = {}  # by fold, so that the features are read once
        for i in active:
            groups.setdefault(self.candidates[i][0], []).append(i)
        plan, at = [], 0
        for f, members in groups.items():
            d, m = self.wide[f], len(members)
            w = np.array([points[i] for i in members]).T
            balanced = np.array([self.candidates[i][3] for i in members])
            plan.append((f, members, d, w, balanced, at))
            at += m * (1 + d + d * d)
        size, weights, free = at, self.class_weights, self.free

        def compute(batches):
            total = np.zeros(size)
            for whole in batches:
                for cut in range(0, whole.num_rows, 2048):
                    batch = whole.slice(cut, 2048)
                    label, fold = batch.column("label").to_numpy(), batch.column("fold").to_numpy()
                    for f, members, d, w, balanced, at in plan:
                        keep = fold != f
                        x, y = with_ones(_matrix(batch.column(f"x{f}"), d - free)[keep], free), label[keep]
                        if not len(y):
                            continue
                        z = x @ w
                        p = 1 / (1 + np.exp(-z))
                        own = np.array([weights[f][v] for v in y])[:, None]
                        own = np.where(balanced[None, :], own, 1.0)
                        m = len(members)
                        total[at : at + m] += (own * (np.logaddexp(0, z) - y[:, None] * z)).sum(axis=0)
                        at += m
                        total[at : at + m * d] += (x.T @ (own * (p - y[:, None]))).T.ravel()
                        at += m * d
                        pairs = (x[:, :, None] * x[:, None, :]).reshape(len(x), d * d)
                        total[at : at + m * d * d] += ((own * p * (1 - p)).T @ pairs).ravel()
            yield _emit(total)

        total = _added(self.rows.mapInArrow(compute, "at long, value double"), size)
        out = {}
        for _, members, d, _, _, at in plan:
            m = len(members)
            loss, gradient = total[at : at + m], total[at + m : at + m + m * d].reshape(m, d)
            curve = total[at + m + m * d : at + m + m * d + m * d * d].reshape(m, d, d)
            out |= {i: (loss[k], gradient[k], curve[k]) for k, i in enumerate(members)}
        return out

    def _fit(self):
        """Newton steps, for l1 on the penalised quadratic model, halved until the objective falls."""
        step = {i: None for i in range(len(self.candidates))}  # direction that is being tried
        best = {i: np.inf for i in step}
        share = {i: 1.0 for i in step}
        for _ in range(STEPS):
            if not step:
                return
            points = {i: self.weights[i] if s is None else self.weights[i] + share[i] * s for i, s in step.items()}
            found = self._scan(sorted(step), points)
            for i, (loss, gradient, curve) in found.items():
                f, penalty, strength, _ = self.candidates[i]
                w = points[i]
                held = w[self.free :]
                value = loss + strength * (np.abs(held).sum() if penalty == "l1" else held @ held / 2)
                if value > best[i] * (1 + 1e-12) and share[i] > 1e-9:
                    share[i] /= 2
                    continue
                self.weights[i], best[i], share[i] = w, min(value, best[i]), 1.0
                l1, l2 = (strength, 0.0) if penalty == "l1" else (0.0, strength)
                # the quadratic model of the loss around w, written for the new point
                new = elastic_descent(curve, curve @ w - gradient, l1, l2, self.free, w)
                s, after = new - w, new[self.free :]
                gain = -(gradient @ s + s @ curve @ s / 2)
                gain -= l1 * (np.abs(after).sum() - np.abs(held).sum()) + l2 * (after @ after - held @ held) / 2
                step[i] = s
                if gain <= (1e-11 if l1 else 1e-14) * max(value, 1e-300):
                    self.weights[i] = new  # the last step needs no scan to be trusted
                    del step[i]
        raise ArithmeticError(f"{len(step)} logistic fits have not converged")


def scores(rows: DataFrame, fits: LogisticFits) -> DataFrame:
    """model, label, p of every row of a candidate's own fold."""
    groups = {}
    for i, (f, *_) in enumerate(fits.candidates):
        groups.setdefault(f, []).append(i)
    plan = {f: (np.array(m, np.int32), np.array([fits.weights[i] for i in m]).T, fits.wide[f]) for f, m in groups.items()}
    free = fits.free

    def compute(batches):
        for batch in batches:
            label, fold = batch.column("label").to_numpy(), batch.column("fold").to_numpy()
            for f, (members, w, d) in plan.items():
                mine = fold == f
                p = 1 / (1 + np.exp(-(with_ones(_matrix(batch.column(f"x{f}"), d - free)[mine], free) @ w)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(members, len(p))), pa.array(np.repeat(label[mine], len(members))), pa.array(p.ravel())],
                    ["model", "label", "p"],
                )

    return rows.mapInArrow(compute, "model int, label double, p double")


def brier_scores(scored: DataFrame) -> dict[int, float]:
    found = scored.groupBy("model").agg(F.avg((F.col("p") - F.col("label")) ** 2).alias("s"))
    return {r["model"]: r["s"] for r in found.collect()}


def rmse_scores(scored: DataFrame) -> dict[int, float]:
    return {i: s**0.5 for i, s in brier_scores(scored).items()}


def auc_scores(scored: DataFrame) -> dict[int, float]:
    """Area under the ROC curve of each model, ties half. All models are ranked by one running total
    over the whole table, from which the total at a model's start is taken off."""
    y = F.col("label")
    counted = scored.groupBy("model", "p").agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    ranked = materialize(prefix_sums(counted, ["model", "p"], {"before": "neg"}), "ranked")
    found = ranked.groupBy("model").agg(
        F.sum(F.col("pos") * (F.col("before") + F.col("neg") / 2)).alias("wins"), F.min("before").alias("start"),
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
    )
    return {
        r["model"]: (r["wins"] - r["pos"] * r["start"]) / (r["pos"] * r["neg"]) if r["pos"] and r["neg"] else float("nan")
        for r in found.collect()
    }


# --- one estimator, all folds ---------------------------------------------------------------


class LinearScorer(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``rawPrediction`` and ``probability`` of a logistic regression on ``features``, as column
    expressions; its weights are stored with the stage."""

    weights = Param(Params._dummy(), "weights", "a weight for each feature", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "the intercept", TypeConverters.toFloat)

    def __init__(self):
        super().__init__()

    @classmethod
    def of(cls, weights, intercept: float) -> "LinearScorer":
        out = cls()
        out.set(out.weights, [float(w) for w in weights])
        out.set(out.intercept, float(intercept))
        return out

    def _transform(self, df: DataFrame) -> DataFrame:
        own = F.array(*[F.lit(w) for w in self.getOrDefault("weights")])
        terms = F.zip_with(vector_to_array("features"), own, lambda x, w: x * w)
        z = F.aggregate(terms, F.lit(self.getOrDefault("intercept")), lambda s, t: s + t)
        p = 1 / (1 + F.exp(-F.col("_z")))
        scored = df.withColumn("_z", z)
        return scored.withColumns(
            {"rawPrediction": array_to_vector(F.array(-F.col("_z"), F.col("_z"))), "probability": array_to_vector(F.array(1 - p, p))}
        ).drop("_z")


def _linear_parts(estimator):
    """Encoders and logistic regression of a pipeline that is nothing else, or None."""
    from shotspark.plans.models import SkLogistic

    stages = estimator.getStages() if isinstance(estimator, Pipeline) else []
    if len(stages) != 2 or type(stages[1]) is not SkLogistic:
        return None
    plain = {"labelCol": "label", "featuresCol": "features", "weightCol": ""}
    return stages if all(stages[1].getOrDefault(k) == v for k, v in plain.items()) else None


def leave_one_out(df: DataFrame, estimator, folds: int, fold, key, whole: bool = False) -> list:
    """A model for each fold, fitted on the rows of all others, and with ``whole`` one fitted on all
    rows. Logistic pipelines are fitted together, any other estimator one fold after the other."""
    parts = _linear_parts(estimator)
    if parts is None:
        df = materialize(df.withColumn("_fold", fold.cast("int")), "training")
        models = [estimator.fit(df.filter(F.col("_fold") != k).drop("_fold")) for k in range(folds)]
        return models + ([estimator.fit(df.drop("_fold"))] if whole else [])
    prep, logistic = parts
    n = folds + int(whole)
    rows, preps = fold_rows(df, prep, n, fold, key)
    sizes = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    get, intercept = logistic.getOrDefault, logistic.getOrDefault("fitIntercept")
    candidates = [
        (
            f, get("penalty"), get("alpha") * (total - sizes.get(f, 0)) if logistic.isSet("alpha") else 1 / get("C"),
            get("classWeight") == "balanced",
        )
        for f in range(n)
    ]
    fits = LogisticFits(rows, n, candidates, intercept)
    return [PipelineModel([p, LinearScorer.of(w[fits.free :], w[0] if intercept else 0.0)]) for p, w in zip(preps, fits.weights)]
