"""Perceptrons of many layouts and folds, trained in the same scans.

Rows are dealt by their hash to slices of about SLICE rows. A scan is one epoch: in every slice each
network goes through its mini-batches from the weights that all slices start with, and the weights
it ends with are averaged over the slices by their rows. Slices and the order of rows in them follow
from hashes, so the result depends neither on the number of tasks nor on lost executors. Slices do not
wait for one another, so a task takes the same mini-batch of many slices in one step.

The loss is the mean log loss (or half the mean squared error) of a mini-batch plus alpha times half
the squared weights, without biases, by its rows. Steps have momentum. With the schedule "adaptive"
the step size is divided by five when the loss of two epochs in a row has not fallen by TOLERANCE.
"""

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotspark.plans import shared
from shotspark.scale import materialize

SLICE = 512  # rows of a slice, on average
BLOCK = 1 << 16  # rows that a task holds at once
SIDE = 2048  # rows of mini-batches, side by side, that a step computes
MOMENTUM = 0.9
TOLERANCE = 1e-4


@dataclass(frozen=True)
class Layout:
    hidden: tuple = (24,)
    activation: str = "relu"
    batch_size: int = 128
    alpha: float = 1e-4
    schedule: str = "constant"
    step_size: float = 0.08


def shapes(width: int, hidden) -> list[tuple[int, int]]:
    sizes = [width, *hidden, 1]
    return list(zip(sizes[:-1], sizes[1:]))


def unpack(flat: np.ndarray, width: int, hidden) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights and biases of each layer from numbers in the last axis, one row per network."""
    out, at = [], 0
    for a, b in shapes(width, hidden):
        w, bias = flat[..., at : at + a * b], flat[..., at + a * b : at + a * b + b]
        out.append((w.reshape(*flat.shape[:-1], a, b), bias[..., None, :]))
        at += a * b + b
    return out


def first_weights(width: int, layout: Layout, rng) -> np.ndarray:
    parts = []
    for a, b in shapes(width, layout.hidden):
        bound = ((2.0 if layout.activation == "logistic" else 6.0) / (a + b)) ** 0.5
        parts += [rng.uniform(-bound, bound, a * b), rng.uniform(-bound, bound, b)]
    return np.concatenate(parts)


def _logistic(z: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-z)) in place."""
    z *= 0.5
    np.tanh(z, out=z)
    z += 1.0
    z *= 0.5
    return z


def _logistic_slope(a: np.ndarray) -> np.ndarray:
    rest = 1 - a
    a *= rest
    return a


def _tanh_slope(a: np.ndarray) -> np.ndarray:
    a *= a
    return np.subtract(1, a, out=a)


# activations and their slopes by their values, in place as far as can be
_ACTIVE = {
    "relu": (lambda z: np.maximum(z, 0.0, out=z), lambda a: a > 0),
    "logistic": (_logistic, _logistic_slope),
    "tanh": (lambda z: np.tanh(z, out=z), _tanh_slope),
}


def forward(flat: np.ndarray, x: np.ndarray, hidden, activation: str) -> list[np.ndarray]:
    """Outputs of each layer for networks of one layout; the last one without activation. ``x`` is
    rows x features, after axes that fit those of the networks."""
    act, layers = _ACTIVE[activation][0], unpack(flat, x.shape[-1], hidden)
    outputs = [x]
    for k, (w, b) in enumerate(layers):
        z = outputs[-1] @ w
        z += b
        outputs.append(z if k == len(layers) - 1 else act(z))
    return outputs


def loss_and_gradient(
    flat: np.ndarray, x: np.ndarray, y: np.ndarray, hidden, activation: str, alpha: np.ndarray, logistic: bool, held: np.ndarray | None = None
):
    """Loss and gradient of each network over the rows of a mini-batch; ``held`` is 0 for rows that only
    fill it up."""
    layers = unpack(flat, x.shape[-1], hidden)
    n = x.shape[-2] if held is None else held.sum(axis=-1)
    outputs = forward(flat, x, hidden, activation)
    z = outputs[-1][..., 0]
    if logistic:
        loss, delta = np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z))) - y * z, _logistic(z.copy()) - y
    else:
        delta = z - y
        loss = delta * delta / 2
    if held is not None:
        loss, delta = loss * held, delta * held
    loss = loss.sum(axis=-1) / n + alpha / (2 * n) * sum((w * w).sum(axis=(-2, -1)) for w, _ in layers)
    delta, slope, share = (delta / np.expand_dims(n, -1))[..., None], _ACTIVE[activation][1], alpha / n
    gradient, end, ones = np.empty(flat.shape), flat.shape[-1], np.ones((1, x.shape[-2]))
    for k in range(len(layers) - 1, -1, -1):
        w, bias = layers[k]
        a, b = w.shape[-2:]
        at = end - b - a * b
        dw = np.swapaxes(outputs[k], -1, -2) @ delta
        dw += share[..., None, None] * w
        gradient[..., at : end - b] = dw.reshape(*dw.shape[:-2], a * b)
        gradient[..., end - b : end] = (ones @ delta)[..., 0, :]  # far faster than a sum over this axis
        end = at
        if k:
            back = np.swapaxes(w, -1, -2)
            delta = delta * back if b == 1 and a >= 16 else delta @ back  # each is the faster one there
            delta *= slope(outputs[k])
    return loss, gradient


def _orders(perm: np.ndarray, part: np.ndarray, slices: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each slice in their order, one slice after the other in ``perm``, as a matrix whose ends
    are filled up, and their numbers. Slices with most rows come first."""
    counts = np.bincount(part, minlength=slices)
    first = np.argsort(-counts, kind="stable")
    place = np.empty(slices, np.int64)
    place[first] = np.arange(slices)
    rank = np.arange(len(perm)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = np.full((slices, int(counts.max(initial=0))), size, np.int64)
    out[place[part], rank] = perm
    return out, counts[first]


class Networks:
    """Networks of all ``models`` (fold, layout), trained together on the rows of
    ``shared.fold_rows``. ``weights[i]`` is the result; with ``all_rows`` no fold is left out."""

    def __init__(self, rows: DataFrame, folds: int, models, epochs: int, logistic: bool = True, seed: int = 7, all_rows: bool = False):
        self.models, self.folds, self.logistic, self.seed, self.all_rows = list(models), folds, logistic, seed, all_rows
        self.wide = shared.widths(rows, folds)
        self.weights = [first_weights(self.wide[f], m, np.random.default_rng([seed, i])) for i, (f, m) in enumerate(self.models)]
        self.steps = np.array([m.step_size for _, m in self.models])
        self.losses = np.full(len(self.models), np.inf)
        flat = np.zeros(len(self.models), np.int64)  # epochs in a row without a fall
        slices = rows.count() // SLICE + 1
        self.rows = rows
        # files of so few rows are read whole, so that no slice is cut
        files = max(slices * SLICE // (4 * BLOCK), min(slices, 2 * rows.sparkSession.sparkContext.defaultParallelism))
        dealt = self._packed().withColumn("slice", F.pmod("h", F.lit(slices))).repartition(files, "slice").sortWithinPartitions("slice", "h")
        self.dealt = materialize(dealt.drop("h"), "slices")
        for epoch in range(epochs):
            losses = self._epoch(epoch)
            flat = np.where(losses > self.losses - TOLERANCE, flat + 1, 0)
            slower = (flat >= 2) & np.array([m.schedule == "adaptive" for _, m in self.models])
            self.steps[slower] /= 5
            flat[slower] = 0
            self.losses = np.minimum(self.losses, losses)

    def _packed(self) -> DataFrame:
        """label, fold, h, x: the features of all folds as bytes."""
        wide = self.wide

        def compute(batches):
            for batch in batches:
                x = np.column_stack([shared._matrix(batch.column(f"x{k}"), w) for k, w in enumerate(wide)]).astype(float)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("label", "fold", "h")), shared.packed(x)], ["label", "fold", "h", "x"])

        return self.rows.mapInArrow(compute, "label double, fold int, h long, x binary")

    def _groups(self) -> list:
        """Networks that can be computed side by side."""
        groups: dict = {}
        for i, (f, m) in enumerate(self.models):
            groups.setdefault((f, m.hidden, m.activation, m.batch_size), []).append(i)
        return list(groups.items())

    def _epoch(self, epoch: int) -> np.ndarray:
        plan = [
            (key, np.array(own), np.stack([self.weights[i] for i in own]), self.steps[own], np.array([self.models[i][1].alpha for i in own]))
            for key, own in self._groups()
        ]
        wide, seed, logistic, all_rows = self.wide, self.seed, self.logistic, self.all_rows

        columns = np.concatenate([[0], np.cumsum(wide)])

        def train(numbers, x, y, fold):
            """(network, rows, sum of weights * rows and of loss * rows) of the slices of a block."""
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(numbers)) + 1, [len(y)]])
            sizes = np.diff(cuts)
            perm = np.concatenate(
                [at + np.random.default_rng([seed, epoch, int(numbers[at])]).permutation(n) for at, n in zip(cuts, sizes)]
            )
            part, padded = np.repeat(np.arange(len(sizes)), sizes), np.append(y, 0.0)
            ready: dict = {}
            for (f, hidden, activation, size), own, start, steps, alpha in plan:
                if f not in ready:
                    seen = np.ones(len(perm), bool) if all_rows else fold[perm] != f
                    features = np.concatenate([x[:, columns[f] : columns[f + 1]], np.zeros((1, wide[f]))])
                    ready = {f: (features, *_orders(perm[seen], part[seen], len(sizes), len(y)))}
                features, orders, counts = ready[f]
                total, rows = np.zeros((len(own), start.shape[1] + 1)), 0
                side = max(1, SIDE // (size * len(own)))
                for c in range(0, int((counts > 0).sum()), side):
                    order, n = orders[c : c + side], counts[c : c + side]
                    n = n[n > 0]
                    flat = np.repeat(start[None], len(n), axis=0)
                    speed, loss_sum = np.zeros_like(flat), np.zeros(flat.shape[:2])
                    for at in range(0, int(n[0]), size):
                        live = int((n > at).sum())
                        some = np.minimum(n[:live] - at, size)
                        batch = order[:live, at : at + some[0]]
                        held = None if some[-1] == some[0] else (batch < len(y)).astype(float)[:, None]
                        loss, gradient = loss_and_gradient(
                            flat[:live], features[batch][:, None], padded[batch][:, None], hidden, activation, alpha, logistic, held
                        )
                        loss_sum[:live] += loss * some[:, None]
                        # a step is no longer than the unit of the weights, so that steep batches cannot run away
                        norm = np.maximum(np.sqrt(np.einsum("smp,smp->sm", gradient, gradient)), 1.0)
                        gradient *= (steps / norm)[..., None]
                        speed[:live] *= MOMENTUM
                        speed[:live] -= gradient
                        flat[:live] += speed[:live]
                    total[:, :-1] += np.einsum("smp,s->mp", flat, n.astype(float))
                    total[:, -1] += loss_sum.sum(axis=0)
                    rows += int(n.sum())
                if rows:
                    yield own, rows, total

        def compute(batches):
            added: dict = {}
            for numbers, x, y, fold in _slices(batches, columns[-1]):
                for own, n, found in train(numbers, x, y, fold):
                    for i, row in zip(own.tolist(), found):
                        one = np.append(row, n)
                        added[i] = added[i] + one if i in added else one
            at = sorted(added)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([added[i].tobytes() for i in at], pa.binary())], ["node", "sums"])

        losses = np.full(len(self.models), np.inf)
        for r in shared.added_arrays(self.dealt.mapInArrow(compute, "node long, sums binary")).collect():  # one row per network
            total = np.frombuffer(r["sums"])
            self.weights[r["node"]], losses[r["node"]] = total[:-2] / total[-1], total[-2] / total[-1]
        return losses

    def scores(self) -> DataFrame:
        """model, label, p (the value itself for a numeric target) of the rows of each model's fold."""
        plan = [(key, np.array(own, np.int32), np.stack([self.weights[i] for i in own])) for key, own in self._groups()]
        wide, logistic = self.wide, self.logistic

        def compute(batches):
            for batch in batches:
                label, fold = batch.column("label").to_numpy(), batch.column("fold").to_numpy()
                for (f, hidden, activation, _), own, flat in plan:
                    mine = fold == f
                    x = shared._matrix(batch.column(f"x{f}"), wide[f])[mine]
                    z = forward(flat, x, hidden, activation)[-1][:, :, 0]
                    p = _logistic(z) if logistic else z
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(own, len(x))), pa.array(np.tile(label[mine], len(own))), pa.array(p.ravel())],
                        ["model", "label", "p"],
                    )

        return self.rows.mapInArrow(compute, "model int, label double, p double")

    def export(self, model: int) -> dict:
        return {"weights": self.weights[model].tolist(), "logistic": self.logistic, "layout": asdict(self.models[model][1])}


def _slices(batches, width):
    """(slices, features of all folds, labels, folds) of about BLOCK rows; the rows of a slice stand together."""
    kept, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append((
            batch.column("slice").to_numpy(), shared.unpacked(batch.column("x"), float, width),
            batch.column("label").to_numpy(), batch.column("fold").to_numpy(),
        ))
        rows += batch.num_rows
        if rows >= BLOCK:
            whole = [np.concatenate(c) for c in zip(*kept)]
            cut = int(np.searchsorted(whole[0], whole[0][-1]))  # the last slice may go on
            if cut:
                yield [c[:cut] for c in whole]
            kept, rows = [tuple(c[cut:] for c in whole)], len(whole[0]) - cut
    if kept:
        yield [np.concatenate(c) for c in zip(*kept)]


class PerceptronModel(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``probability`` (or ``prediction`` for a numeric target); stored with its weights as text."""

    network = Param(Params._dummy(), "network", "the fitted network as JSON text", TypeConverters.toString)

    def __init__(self):
        super().__init__()

    def _transform(self, df: DataFrame) -> DataFrame:
        import pandas as pd

        model = json.loads(self.getOrDefault("network"))
        flat, layout, logistic = np.array(model["weights"])[None, :], model["layout"], model["logistic"]

        def outputs(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in batches:
                rows = np.stack(x.to_numpy()) if len(x) else None
                yield pd.Series(forward(flat, rows, layout["hidden"], layout["activation"])[-1][0, :, 0] if len(x) else np.zeros(0))

        z = F.pandas_udf(outputs, T.DoubleType())(vector_to_array("features"))
        if not logistic:
            return df.withColumn("prediction", z)
        p = 1 / (1 + F.exp(-F.col("_z")))
        return df.withColumn("_z", z).withColumn("probability", array_to_vector(F.array(1 - p, p))).drop("_z")


class Perceptron(Estimator):
    """One network on the columns ``features`` and ``label``."""

    def __init__(self, layout: Layout = Layout(), epochs: int = 200, logistic: bool = True, seed: int = 7):
        super().__init__()
        self.layout, self.epochs, self.logistic, self.seed = layout, epochs, logistic, seed

    def _fit(self, df: DataFrame) -> PerceptronModel:
        rows = df.select(
            F.col("label").cast("double").alias("label"), F.lit(0).alias("fold"), F.xxhash64("features", "label").alias("h"),
            vector_to_array("features").alias("x0"),
        )
        fitted = Networks(materialize(rows, "training"), 1, [(0, self.layout)], self.epochs, self.logistic, self.seed, all_rows=True)
        model = PerceptronModel()
        model.set(model.network, json.dumps(fitted.export(0)))
        return model
