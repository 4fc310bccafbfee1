"""Gradient-boosted trees over histograms, for many candidates and folds in the same scans.

Features become at most ``bins`` numbered bins, by quantiles of the rows that a fold's models may see.
Rows of equal bins share their score whatever the trees, so their gradients follow from the number and
the label sum of those that a tree draws. Where a fold has at most GROUPS different rows of bins (three
features never have more than 32 x 32 x 32, and features that depend on one another have few), one scan
gives these two sums for all trees and models, and each model grows its trees from its own sums in one task.

With more, a scan gives the sums of gradients and curvatures by node, feature and bin for all candidates
and all nodes of a level; a second, small stage adds them up by node and picks the best splits, of which
only the winners reach the driver. A model's score of each row is stored with the rows and renewed every
few trees, so that a scan walks few trees. Both ways, sums that one task cannot hold at once take several
scans, and a loss of executors costs the running scan only.

Split gains, leaf values and parameters are those of regularised boosting (Chen, Guestrin, KDD 2016):
l1 and l2 penalties of leaf values, a least gain, a least sum of curvatures in a child, a base score,
shares of the rows per tree and of the columns per tree and level, and a weight of the positive
class. A split must gain more than ``gamma`` when it is made; there is no later pruning.
"""

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Pipeline, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotspark.plans import shared
from shotspark.scale import materialize

BINS = 32
CELLS = 2_000_000  # sums of gradients that a task holds in one scan
GROUPS = 1 << 17  # different rows of bins of a fold that are summed instead of the rows
BLOCK = 1 << 18  # rows that a task sums at once
RENEW = 8  # trees after which stored scores are renewed


@dataclass(frozen=True)
class Settings:
    max_depth: int = 6
    min_child_weight: float = 1.0
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    colsample_bylevel: float = 1.0
    gamma: float = 0.0
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0
    base_score: float = 0.5
    scale_pos_weight: float = 1.0
    learning_rate: float = 0.08


class Forest:
    """Trees of several models side by side: one row per model in each array, children of a node at
    ``left`` and ``left + 1``, feature -1 for a leaf."""

    def __init__(self, models: int):
        self.feature = np.full((models, 1), -1, np.int16)
        self.split = np.zeros((models, 1), np.int16)
        self.left = np.zeros((models, 1), np.int32)
        self.value = np.zeros((models, 1))
        self.size = np.ones(models, np.int64)
        self.depth = 0

    def _widen(self, more: int):
        for name, fill in (("feature", -1), ("split", 0), ("left", 0), ("value", 0)):
            old = getattr(self, name)
            setattr(self, name, np.concatenate([old, np.full((len(old), more), fill, old.dtype)], axis=1))

    def grow(self, model: int, node: int, feature: int, split: int) -> int:
        """Split a node; the number of its left child."""
        at = int(self.size[model])
        while at + 2 > self.feature.shape[1]:
            self._widen(self.feature.shape[1])
        self.feature[model, node], self.split[model, node], self.left[model, node] = feature, split, at
        self.size[model] = at + 2
        return at

    def put(self, model: int, feature, split, left, value, depth: int):
        """Set the tree of a model."""
        n = len(feature)
        if n > self.feature.shape[1]:
            self._widen(n - self.feature.shape[1])
        for name, found in (("feature", feature), ("split", split), ("left", left), ("value", value)):
            getattr(self, name)[model, :n] = found
        self.size[model], self.depth = n, max(self.depth, depth)

    def add_level(self, model: int, nodes, found, level: int, s: "Settings") -> list:
        """Split the nodes whose best split gains enough; the children that may be split again."""
        following = []
        for node, (feature, split, gain, gl, hl, g, h) in zip(nodes, found):
            if level == 0:
                self.value[model, 0] = leaf_value(g, h, s)
            if level < s.max_depth and gain > s.gamma and gain > 1e-12:
                at = self.grow(model, node, int(feature), int(split))
                self.value[model, at], self.value[model, at + 1] = leaf_value(gl, hl, s), leaf_value(g - gl, h - hl, s)
                if level + 1 < s.max_depth:
                    following += [at, at + 1]
        return following

    def walk(self, bins: np.ndarray, models: np.ndarray) -> np.ndarray:
        """Node of each row in the tree of each of the ``models``."""
        node = np.zeros((len(bins), len(models)), np.int64)
        rows = np.arange(len(bins))[:, None]
        for _ in range(self.depth):
            feature = self.feature[models, node]
            right = bins[rows, np.maximum(feature, 0)] > self.split[models, node]
            node = np.where(feature >= 0, self.left[models, node] + right, node)
        return node


def threshold(g, alpha):
    """Sums of gradients after the l1 penalty."""
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def leaf_value(g: float, h: float, s: Settings) -> float:
    return float(-s.learning_rate * threshold(g, s.reg_alpha) / (h + s.reg_lambda)) if h + s.reg_lambda > 0 else 0.0


def best_splits(sums: np.ndarray, alpha, lamda, least, allowed) -> tuple:
    """Best split of each node: feature, bin (rows up to it go left), gain, and g and h of the left
    side and of the node. ``sums`` is node x (g, h) x feature x bin."""
    below = np.cumsum(sums, axis=3)
    total = below[:, :, :1, -1:]
    left, right = below[..., :-1], total - below[..., :-1]

    def part(x):
        h = x[:, 1] + lamda[:, None, None]
        return np.where(h > 0, threshold(x[:, 0], alpha[:, None, None]) ** 2 / np.where(h > 0, h, 1.0), 0.0)

    whole = part(total)
    gain = (part(left) + part(right) - whole) / 2
    fine = (left[:, 1] >= least[:, None, None]) & (right[:, 1] >= least[:, None, None]) & allowed[:, :, None]
    gain = np.where(fine, gain, -np.inf).reshape(len(sums), -1)
    # of equally good splits the first, whatever order the sums were added in
    top = gain.max(axis=1)
    at = (gain >= (top - 1e-9 * np.abs(top) - 1e-12 * whole[:, 0, 0])[:, None]).argmax(axis=1)
    feature, split = np.divmod(at, left.shape[3])
    node = np.arange(len(sums))
    chosen = left[node, :, feature, split]
    return feature, split, gain[node, at], chosen[:, 0], chosen[:, 1], total[:, 0, 0, 0], total[:, 1, 0, 0]


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x >> np.uint64(11)


def _drawn(hashes: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Numbers from 0 to 1 for each row and each model."""
    return _mixed(hashes.astype(np.uint64)[:, None] ^ salt[None, :]) / float(1 << 53)


def _salt(seed: int, tree: int, model: int) -> np.uint64:
    return np.uint64(np.random.default_rng([seed, tree, model, 1]).integers(0, 1 << 63))


def _columns(rng, mask: np.ndarray, share: float) -> np.ndarray:
    """A share of the columns of ``mask``."""
    own = np.flatnonzero(mask)
    chosen = np.zeros(len(mask), bool)
    chosen[rng.choice(own, max(1, int(share * len(own))), replace=False)] = True
    return chosen


def _blocks(batches):
    """Batches put together to about BLOCK rows."""
    kept, rows = [], 0
    for batch in batches:
        kept.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK:
            yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            kept, rows = [], 0
    if rows:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


def grow_trees(cells: np.ndarray, sums, settings: Settings, start: float, logistic: bool, seed: int, model: int, bins: int) -> list:
    """Trees (feature, split, left, value, depth) of one model over groups of equal bins. ``cells`` has
    the bins of each group; ``sums[t]`` the drawn rows of tree t by group: weights, and labels times weights."""
    s, z, trees = settings, np.full(len(cells), start), []
    rows, wide = np.arange(len(cells)), cells.shape[1]
    for tree, (weight, label) in enumerate(sums):
        if logistic:
            p = 1 / (1 + np.exp(-z))
            g, h = weight * p - label, weight * np.maximum(p * (1 - p), 1e-16)
        else:
            g, h = weight * z - label, weight
        rng = np.random.default_rng([seed, tree, model])
        mask = _columns(rng, np.ones(wide, bool), s.colsample_bytree)
        forest, node, open_nodes, level = Forest(1), np.zeros(len(cells), np.int64), [0], 0
        while open_nodes:
            chosen = _columns(rng, mask, s.colsample_bylevel)
            step, found = max(1, CELLS // (wide * bins * 2)), []
            for at in range(0, len(open_nodes), step):
                part = open_nodes[at : at + step]
                slot = np.full(forest.feature.shape[1], -1, np.int64)
                slot[part] = np.arange(len(part))
                own = slot[node]
                inside = own >= 0
                own, some, gi, hi = own[inside], cells[inside], g[inside], h[inside]
                total = np.empty((len(part), 2, wide, bins))
                for j in range(wide):
                    cell = own * bins + some[:, j]
                    for q, values in enumerate((gi, hi)):
                        total[:, q, j] = np.bincount(cell, values, len(part) * bins).reshape(len(part), bins)
                same = [np.full(len(part), v, float) for v in (s.reg_alpha, s.reg_lambda, s.min_child_weight)]
                found += zip(*best_splits(total, *same, np.tile(chosen, (len(part), 1))))
            following = forest.add_level(0, open_nodes, found, level, s)
            forest.depth += 1
            feature = forest.feature[0, node]
            right = cells[rows, np.maximum(feature, 0)] > forest.split[0, node]
            node = np.where(feature >= 0, forest.left[0, node] + right, node)
            open_nodes, level = following, level + 1
        z = z + forest.value[0, node]
        n = int(forest.size[0])
        trees.append((*(getattr(forest, name)[0, :n] for name in ("feature", "split", "left", "value")), forest.depth))
    return trees


class Boosting:
    """Trees of all ``models`` (fold, settings), grown together on the rows of ``shared.fold_rows``.
    A model does not see the rows of its fold; with ``all_rows`` it sees all."""

    def __init__(self, rows: DataFrame, folds: int, models, trees: int, logistic: bool = True, seed: int = 7,
                 bins: int = BINS, all_rows: bool = False):
        self.folds, self.models, self.logistic, self.seed, self.bins, self.all_rows = folds, list(models), logistic, seed, bins, all_rows
        self.wide = shared.widths(rows, folds)
        self.edges = self._edges(rows)
        self.members = [np.array([i for i, (f, _) in enumerate(self.models) if f == k], np.int64) for k in range(folds)]
        self.rows = self._binned(rows)
        self.forests: list[Forest] = []
        self.stored = 0  # trees whose scores are stored with the rows
        self.groups = self._groups()
        if self.groups is not None:
            self._grow_by_groups(trees)
            return
        start = np.array([self._start(s) for _, s in self.models])
        self.rows = self.rows.withColumn("score", F.lit(start.tobytes()))
        for t in range(trees):
            self._grow(t)
            if t + 1 - self.stored >= RENEW or t + 1 == trees:
                self._renew()

    # -- rows

    def _edges(self, rows):
        probs = [i / self.bins for i in range(1, self.bins)]
        names, cells = [], []
        for k, w in enumerate(self.wide):
            for j in range(w):
                value = F.col(f"x{k}")[j]
                seen = value if self.all_rows else F.when(F.col("fold") != k, value)
                names.append((k, j))
                cells.append(F.percentile_approx(seen, probs, 10_000).alias(f"e{k}_{j}"))
        found = rows.agg(*cells).first()
        out = [[None] * w for w in self.wide]
        for (k, j), edges in zip(names, found):
            out[k][j] = np.unique(np.array(edges or [], float))
        return out

    def _start(self, s: Settings) -> float:
        return float(np.log(s.base_score / (1 - s.base_score))) if self.logistic else s.base_score

    def _binned(self, rows):
        edges, wide, folds = self.edges, self.wide, self.folds

        def compute(batches):
            for batch in batches:
                columns = [batch.column("label"), batch.column("fold"), batch.column("h")]
                for k in range(folds):
                    x = shared._matrix(batch.column(f"x{k}"), wide[k])
                    b = np.column_stack([np.searchsorted(edges[k][j], x[:, j], side="right") for j in range(wide[k])]).astype(np.uint8)
                    columns.append(shared.packed(b))
                yield pa.RecordBatch.from_arrays(columns, names)

        names = ["label", "fold", "h", *[f"b{k}" for k in range(folds)]]
        schema = "label double, fold int, h long, " + ", ".join(f"b{k} binary" for k in range(folds))
        return materialize(rows.mapInArrow(compute, schema), "binned")

    # -- groups of equal bins

    def _groups(self) -> list | None:
        """The different rows of bins of each fold, or None if a fold has more than GROUPS."""
        out = []
        for k in range(self.folds):
            found = self.rows.select(f"b{k}").distinct().limit(GROUPS + 1).collect() if len(self.members[k]) else []
            if len(found) > GROUPS:
                return None
            cells = sorted(bytes(r[0]) for r in found)
            out.append(np.frombuffer(b"".join(cells), np.uint8).reshape(-1, self.wide[k]))
        return out

    def _grow_by_groups(self, trees: int):
        pairs = [(t, i) for i in range(len(self.models)) for t in range(trees)]
        parts, part, size = [], [], 0
        for n in sorted(range(len(pairs)), key=lambda n: (self.models[pairs[n][1]][0], n)):  # a scan reads few folds
            own = 2 * len(self.groups[self.models[pairs[n][1]][0]])
            if part and size + own > 4 * CELLS:
                parts.append(part)
                part, size = [], 0
            part.append(n)
            size += own
        parts.append(part)
        drawn = [materialize(shared.added_arrays(self._group_sums(pairs, p)), "drawn") for p in parts if p]
        if not drawn:
            return
        added = drawn[0]
        for more in drawn[1:]:
            added = added.unionByName(more)
        models, groups, logistic, seed, bins = self.models, self.groups, self.logistic, self.seed, self.bins
        starts = [self._start(s) for _, s in models]

        def grow(table):
            at = np.argsort(table.column("node").to_numpy())
            i = pairs[table.column("node")[0].as_py()][1]
            cells = groups[models[i][0]]
            blobs = table.column("sums")
            sums = (np.frombuffer(blobs[int(k)].as_buffer()).reshape(2, len(cells)) for k in at)
            found = grow_trees(cells, sums, models[i][1], starts[i], logistic, seed, i, bins)
            columns = [[np.asarray(a, kind).tobytes() for a in c] for c, kind in zip(list(zip(*found))[:4], (np.int16, np.int16, np.int32, float))]
            return pa.table(
                [
                    pa.array([i] * len(found), pa.int32()), pa.array(range(len(found)), pa.int32()), pa.array([f[4] for f in found], pa.int32()),
                    *[pa.array(c, pa.binary()) for c in columns],
                ],
                names=["model", "tree", "depth", "feature", "split", "left", "value"],
            )

        by_model = added.withColumn("model", F.floor(F.col("node") / F.lit(trees)).cast("int")).groupBy("model")
        schema = "model int, tree int, depth int, feature binary, split binary, left binary, value binary"
        self.forests = [Forest(len(models)) for _ in range(trees)]
        for r in by_model.applyInArrow(grow, schema).toLocalIterator():  # one row per tree
            arrays = [np.frombuffer(r[name], kind) for name, kind in (("feature", np.int16), ("split", np.int16), ("left", np.int32), ("value", float))]
            self.forests[r["tree"]].put(r["model"], *arrays, r["depth"])

    def _group_sums(self, pairs, part) -> DataFrame:
        """node, sums: for the (tree, model) pairs of ``part`` the drawn rows of each group, as weights
        and as labels times weights."""
        groups, logistic, all_rows, folds = self.groups, self.logistic, self.all_rows, self.folds
        plan = [[] for _ in range(folds)]
        for n in part:
            t, i = pairs[n]
            f, s = self.models[i]
            limit = np.uint64(int(np.ceil(s.subsample * float(1 << 53)))) if s.subsample < 1 else None
            plan[f].append((n, _salt(self.seed, t, i), limit, s.scale_pos_weight))

        def compute(batches):
            total = {n: np.zeros((2, len(groups[k]))) for k, own in enumerate(plan) for n, *_ in own}
            numbers = [{r.tobytes(): i for i, r in enumerate(groups[k])} if own else {} for k, own in enumerate(plan)]
            for block in _blocks(batches):
                label, fold, h = (block.column(c).to_numpy() for c in ("label", "fold", "h"))
                h = h.astype(np.uint64)
                for k, own in enumerate(plan):
                    if not own:
                        continue
                    coded = block.column(f"b{k}").dictionary_encode()
                    group = np.array([numbers[k][v] for v in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
                    y, hk = label, h
                    if not all_rows:
                        seen = fold != k
                        group, y, hk = group[seen], y[seen], hk[seen]
                    positive = y > 0
                    for n, salt, limit, weight in own:
                        w = np.where(positive, weight, 1.0) if logistic else np.ones(len(y))
                        if limit is not None:
                            for at in range(0, len(hk), 8192):  # stays in the processor's cache
                                w[at : at + 8192] *= _mixed(hk[at : at + 8192] ^ salt) < limit
                        total[n][0] += np.bincount(group, w, len(groups[k]))
                        total[n][1] += np.bincount(group, w * y, len(groups[k]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["node", "sums"]
            )

        read = self.rows.select("label", "fold", "h", *[f"b{k}" for k, own in enumerate(plan) if own])
        # a task's sums are as long however many rows it reads
        tasks = read.sparkSession.sparkContext.defaultParallelism
        return read.coalesce(tasks).mapInArrow(compute, "node long, sums binary")

    # -- rows

    def _pieces(self):
        """A function for tasks that gives, per batch and fold: models, bins, labels, hashes, rows that
        the models may see, and scores."""
        folds, wide, members, n, all_rows = self.folds, self.wide, self.members, len(self.models), self.all_rows
        recent = self.forests[self.stored :]

        def pieces(batches):
            for whole in batches:
                for cut in range(0, whole.num_rows, 1024):
                    batch = whole.slice(cut, 1024)
                    label, fold, h = (batch.column(c).to_numpy() for c in ("label", "fold", "h"))
                    score = shared.unpacked(batch.column("score"), float, n)
                    parts = []
                    for k in range(folds):
                        if len(members[k]):
                            b = shared.unpacked(batch.column(f"b{k}"), np.uint8, wide[k])
                            own = score[:, members[k]].copy()
                            for forest in recent:
                                own += forest.value[members[k], forest.walk(b, members[k])]
                            seen = np.ones(len(fold), bool) if all_rows else fold != k
                            parts.append((members[k], b, label, h, seen, own))
                    yield batch, parts

        return pieces

    def _renew(self):
        """Store the scores by all trees so far."""
        pieces, n = self._pieces(), len(self.models)

        def compute(batches):
            for batch, parts in pieces(batches):
                score = np.zeros((batch.num_rows, n))
                for models, _, _, _, _, own in parts:
                    score[:, models] = own
                at = batch.schema.get_field_index("score")
                yield batch.set_column(at, "score", shared.packed(score))

        self.rows = materialize(self.rows.mapInArrow(compute, self.rows.schema), "boosted")
        self.stored = len(self.forests)

    # -- trees

    def _grow(self, tree: int):
        forest = Forest(len(self.models))
        rngs = [np.random.default_rng([self.seed, tree, i]) for i in range(len(self.models))]
        masks = [_columns(rng, np.ones(self.wide[f], bool), s.colsample_bytree) for rng, (f, s) in zip(rngs, self.models)]
        salts = np.array([_salt(self.seed, tree, i) for i in range(len(self.models))], np.uint64)
        open_nodes = [(i, 0) for i in range(len(self.models))]
        level = 0
        while open_nodes:
            level_masks = [_columns(rng, mask, s.colsample_bylevel) for rng, mask, (_, s) in zip(rngs, masks, self.models)]
            found = self._level(forest, open_nodes, level_masks, salts)
            following = []
            for (i, node), split in zip(open_nodes, found):
                following += [(i, at) for at in forest.add_level(i, [node], [split], level, self.models[i][1])]
            forest.depth += 1
            open_nodes, level = following, level + 1
        self.forests.append(forest)

    def _level(self, forest: Forest, nodes, masks, salts) -> list:
        cells = max(self.wide) * self.bins * 2
        step = max(1, CELLS // cells)
        out = []
        for at in range(0, len(nodes), step):
            out += self._scan(forest, nodes[at : at + step], masks, salts)
        return out

    def _scan(self, forest: Forest, nodes, masks, salts) -> list:
        """(feature, bin, gain, g and h of the left side, g and h) of each node."""
        slot = np.full(forest.feature.shape, -1, np.int64)
        for k, (i, node) in enumerate(nodes):
            slot[i, node] = k
        pieces, bins, logistic = self._pieces(), self.bins, self.logistic
        wide = max(self.wide)
        shares = np.array([s.subsample for _, s in self.models])
        weights = np.array([s.scale_pos_weight for _, s in self.models])

        def sums(batches):
            total = np.zeros((len(nodes), 2, wide, bins))
            flat = total.reshape(-1)
            hit = np.zeros(len(nodes), bool)
            for _, parts in pieces(batches):
                for models, b, label, h, seen, score in parts:
                    where = slot[models, forest.walk(b, models)]
                    where[~seen] = -1
                    if (shares[models] < 1).any():
                        where[_drawn(h, salts[models]) >= shares[models][None, :]] = -1
                    row, col = np.nonzero(where >= 0)
                    if not len(row):
                        continue
                    y, z = label[row], score[row, col]
                    if logistic:
                        p = 1 / (1 + np.exp(-z))
                        w = np.where(y > 0, weights[models[col]], 1.0)
                        g, c = w * (p - y), w * np.maximum(p * (1 - p), 1e-16)
                    else:
                        g, c = z - y, np.ones(len(z))
                    node = where[row, col]
                    hit[node] = True
                    for j in range(b.shape[1]):
                        cell = (node * 2 * wide + j) * bins + b[row, j]
                        np.add.at(flat, cell, g)
                        np.add.at(flat, cell + wide * bins, c)
            at = np.flatnonzero(hit)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([total[i].tobytes() for i in at], pa.binary())], ["node", "sums"])

        own = [self.models[i][1] for i, _ in nodes]
        alpha, lamda, least = (np.array([getattr(s, n) for s in own], float) for n in ("reg_alpha", "reg_lambda", "min_child_weight"))
        allowed = np.zeros((len(nodes), wide), bool)
        for k, (i, _) in enumerate(nodes):
            allowed[k, : len(masks[i])] = masks[i]

        def choose(batches):
            for batch in batches:
                at = batch.column("node").to_numpy()
                if len(at):
                    total = np.frombuffer(b"".join(batch.column("sums").to_pylist())).reshape(-1, 2, wide, bins)
                    found = best_splits(total, alpha[at], lamda[at], least[at], allowed[at])
                    yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(np.asarray(f, float)) for f in found]], names)

        names = ["node", "feature", "split", "gain", "gl", "hl", "g", "h"]
        added = shared.added_arrays(self.rows.mapInArrow(sums, "node long, sums binary"))
        found = added.mapInArrow(choose, "node long, " + ", ".join(f"{n} double" for n in names[1:])).collect()  # one row per node
        by_node = {r["node"]: tuple(r)[1:] for r in found}
        return [by_node.get(k, (0, 0, -np.inf, 0.0, 0.0, 0.0, 0.0)) for k in range(len(nodes))]

    # -- results

    def scores(self) -> DataFrame:
        """model, label, p (the value itself without a logistic loss) of the rows of each model's fold."""
        members, n, logistic, wide, grouped = self.members, len(self.models), self.logistic, self.wide, self.groups is not None
        starts, forests = np.array([self._start(s) for _, s in self.models]), self.forests

        def summed(bins, k):
            """Scores of the models of a fold; rows of equal bins walk the trees once."""
            coded = bins.dictionary_encode()
            b = shared.unpacked(coded.dictionary, np.uint8, wide[k])
            z = np.tile(starts[members[k]], (len(b), 1))
            for forest in forests:
                z += forest.value[members[k], forest.walk(b, members[k])]
            return z[coded.indices.to_numpy()]

        def compute(batches):
            for batch in _blocks(batches) if grouped else batches:
                label, fold = batch.column("label").to_numpy(), batch.column("fold").to_numpy()
                for k, own in enumerate(members):
                    if not len(own) or not (fold == k).any():
                        continue
                    if grouped:
                        mine = summed(batch.column(f"b{k}").filter(pa.array(fold == k)), k)
                    else:
                        mine = shared.unpacked(batch.column("score"), float, n)[fold == k][:, own]
                    p = 1 / (1 + np.exp(-mine)) if logistic else mine
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.tile(own.astype(np.int32), len(mine))),
                            pa.array(np.repeat(label[fold == k], len(own))), pa.array(p.ravel()),
                        ],
                        ["model", "label", "p"],
                    )

        return self.rows.mapInArrow(compute, "model int, label double, p double")

    def export(self, model: int) -> dict:
        """A model as plain lists, with thresholds in place of bins."""
        fold, settings = self.models[model]
        trees = []
        for f in self.forests:
            n = int(f.size[model])
            feature, split = f.feature[model, :n].tolist(), f.split[model, :n].tolist()
            # a value goes left if it is below the threshold
            limits = [float(self.edges[fold][j][b]) if j >= 0 else 0.0 for j, b in zip(feature, split)]
            trees.append({"feature": feature, "threshold": limits, "left": f.left[model, :n].tolist(), "value": f.value[model, :n].tolist()})
        return {"start": self._start(settings), "logistic": self.logistic, "trees": trees, "settings": asdict(settings)}


def evaluate(model: dict, x: np.ndarray) -> np.ndarray:
    """Sum of the leaf values of each row."""
    out, rows = np.full(len(x), model["start"]), np.arange(len(x))
    for t in model["trees"]:
        feature, limit, left, value = (np.array(t[k]) for k in ("feature", "threshold", "left", "value"))
        node = np.zeros(len(x), np.int64)
        while True:
            f = feature[node]
            if (f < 0).all():
                break
            node = np.where(f >= 0, left[node] + (x[rows, np.maximum(f, 0)] >= limit[node]), node)
        out += value[node]
    return out


class BoostedModel(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``probability`` (or ``prediction`` for a numeric target). It is stored with its trees as
    text, so a fitted pipeline saves and loads like any other."""

    trees = Param(Params._dummy(), "trees", "the fitted trees as JSON text", TypeConverters.toString)

    def __init__(self):
        super().__init__()

    def _transform(self, df: DataFrame) -> DataFrame:
        import pandas as pd

        model = json.loads(self.getOrDefault("trees"))
        logistic = model["logistic"]

        def margins(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in batches:
                yield pd.Series(evaluate(model, np.stack(x.to_numpy())) if len(x) else np.zeros(0))

        margin = F.pandas_udf(margins, T.DoubleType())(vector_to_array("features"))
        if not logistic:
            return df.withColumn("prediction", margin)
        scored = df.withColumn("_margin", margin)
        p = 1 / (1 + F.exp(-F.col("_margin")))
        return scored.withColumn("probability", array_to_vector(F.array(1 - p, p))).drop("_margin")


class BoostedTrees(Estimator):
    """One boosted model on the columns ``features`` and ``label``."""

    def __init__(self, settings: Settings = Settings(), trees: int = 100, logistic: bool = True, seed: int = 7):
        super().__init__()
        self.settings, self.trees, self.logistic, self.seed = settings, trees, logistic, seed

    def _fit(self, df: DataFrame) -> BoostedModel:
        rows = df.select(
            F.col("label").cast("double").alias("label"), F.lit(0).alias("fold"), F.xxhash64("features", "label").alias("h"),
            vector_to_array("features").alias("x0"),
        )
        rows = materialize(rows, "training")
        fitted = Boosting(rows, 1, [(0, self.settings)], self.trees, self.logistic, self.seed, all_rows=True)
        model = BoostedModel()
        model.set(model.trees, json.dumps(fitted.export(0)))
        return model


def pipeline(prep: Pipeline, settings: Settings, trees: int, logistic: bool) -> Pipeline:
    return Pipeline(stages=[prep, BoostedTrees(settings, trees, logistic)])
