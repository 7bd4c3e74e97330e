"""Random forests whose work follows the rows in the nodes, not the number of nodes.

A forest that is grown out has nodes in proportion to its rows, and MLlib counts every node of a level in a dense table of all
bins in every task. Here only nodes of many rows are split that way, level by level, from counts that the tasks add up. A node
of at most ``TOGETHER`` rows goes with its rows to one task, which grows the rest of that tree; trees are a table and never
meet on the driver. Bins, bootstrap, number of features tried at a node, gini gain, depth and votes are those of MLlib.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.session import materialise

#: Rows of a node that one task grows to the end.
TOGETHER = 50_000
#: Rows that one task deals to their trees, while there are fewer tasks than a few per core.
DEALT = 4096
#: Memory of the counts that a task holds while it splits nodes of many rows.
COUNT_BYTES = 1 << 27
#: As many as MLlib finds in the labels by itself.
MOST_CLASSES = 100
LEAF, BELOW = -1, -2
#: One tree, or the part of it below the node ``root`` (numbered as in a heap). Where ``feature`` is ``BELOW``, ``left`` is such a root.
#: The right child follows the left one.
TREES = "tree int, root bigint, feature array<int>, split array<int>, left array<bigint>, votes array<double>, gains array<double>"
_BINS = 256


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tried(seed: int, tree: int, nodes: np.ndarray, n_features: int, n_tried: int) -> np.ndarray:
    """Features tried at each node; they depend on the seed, the tree and the node alone."""
    if n_tried == n_features:
        return np.tile(np.arange(n_features), (len(nodes), 1))
    start = _mixed(np.array([(seed << 32) + tree + 1], dtype=np.uint64))
    at = _mixed(nodes.astype(np.uint64) + start)
    order = _mixed(at[:, None] + np.arange(1, n_features + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.sort(np.argpartition(order, n_tried - 1, axis=1)[:, :n_tried], axis=1)


def _sum(counts: np.ndarray) -> np.ndarray:
    return counts @ np.ones(counts.shape[1])


def _squares(counts: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", counts, counts)


def _best(cells: np.ndarray, hist: np.ndarray, totals: np.ndarray, n_tried: int):
    """Best split of each node: whether there is one, feature tried, bin, gain and class counts of the left child.

    ``cells`` ascend and name node, feature tried and bin of a row of ``hist``; every node has one at least.
    """
    node, run = cells // (n_tried * _BINS), cells // _BINS
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    summed = np.cumsum(hist, axis=0)
    left = summed - np.repeat(summed[first] - hist[first], np.diff(np.r_[first, len(cells)]), axis=0)
    right = totals[node] - left
    n_right = _sum(right)
    score = _squares(left) / _sum(left) + _squares(right) / np.maximum(n_right, 1)
    score[n_right == 0] = -np.inf
    highest = np.maximum.reduceat(score, np.flatnonzero(np.r_[True, node[1:] != node[:-1]]))
    size = _sum(totals)
    gain = highest - _squares(totals) / size
    at = np.flatnonzero(score == highest[node])
    at = at[np.unique(node[at], return_index=True)[1]]
    return gain > 1e-9 * size, run[at] % n_tried, cells[at] % _BINS, gain, left[at]


def _cells(key: np.ndarray, size: int, y: np.ndarray, w: np.ndarray, classes: int):
    """Keys that occur, ascending, and their weights by class."""
    if size <= 4 * len(key):
        hist = np.bincount(key * classes + y, w, size * classes).reshape(size, classes)
        cells = np.flatnonzero(_sum(hist))
        return cells, hist[cells]
    cells, at = np.unique(key, return_inverse=True)
    return cells, np.bincount(at * classes + y, w, len(cells) * classes).reshape(-1, classes)


def grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, tree: int, root: int, classes: int, seed: int, n_tried: int, max_depth: int):
    """The tree below one node: feature, split, left and votes of its nodes, gain of each feature."""
    n_features = bins.shape[1]
    rows, at, nodes = np.arange(len(y)), np.zeros(len(y), dtype=np.int64), np.array([root], dtype=np.int64)
    depth, done, gains, levels = int(root).bit_length() - 1, 0, np.zeros(n_features), []
    while len(nodes):
        counts = np.bincount(at * classes + y[rows], w[rows], len(nodes) * classes).reshape(-1, classes)
        size = counts.sum(1)
        feature, split, left = np.full(len(nodes), LEAF), np.zeros(len(nodes), dtype=np.int64), np.zeros(len(nodes), dtype=np.int64)
        mixed = np.flatnonzero((counts.max(1) < size) & (depth < max_depth))
        children = np.zeros(0, dtype=np.int64)
        if len(mixed):
            place = np.full(len(nodes), -1)
            place[mixed] = np.arange(len(mixed))
            kept = place[at] >= 0
            rows, at = rows[kept], place[at[kept]]
            tried = _tried(seed, tree, nodes[mixed], n_features, n_tried)
            values = bins[rows[:, None], tried[at]]
            key = (at[:, None] * n_tried + np.arange(n_tried)) * _BINS + values
            cells, hist = _cells(key.ravel(), len(mixed) * n_tried * _BINS, np.repeat(y[rows], n_tried), np.repeat(w[rows], n_tried), classes)
            good, slot, cut, gain, _ = _best(cells, hist, counts[mixed], n_tried)
            rank = np.cumsum(good) - 1
            chosen = mixed[good]
            feature[chosen], split[chosen] = tried[good, slot[good]], cut[good]
            left[chosen] = done + len(nodes) + 2 * rank[good]
            np.add.at(gains, feature[chosen], gain[good])
            kept = good[at]
            rows, at, values = rows[kept], at[kept], values[kept]
            at = 2 * rank[at] + (values[np.arange(len(rows)), slot[at]] > cut[at])
            children = (2 * nodes[chosen][:, None] + np.arange(2)).ravel()
        levels.append((feature, split, left, counts / size[:, None]))
        done, nodes, depth = done + len(nodes), children, depth + 1
    return *(np.concatenate(parts) for parts in zip(*levels)), gains


def _route(bins: np.ndarray, feature: np.ndarray, split: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Last node of each row in a tree."""
    at = np.zeros(len(bins), dtype=np.int64)
    on = np.flatnonzero(feature[at] >= 0)
    while len(on):
        here = at[on]
        at[on] = left[here] + (bins[on, feature[here]] > split[here])
        on = on[feature[at[on]] >= 0]
    return at


def _matrix(column, kind, width: int) -> np.ndarray:
    """Rows of a binary column of equal lengths as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)


def _binary(matrix: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in matrix], pa.binary())


def _lists(matrix: np.ndarray) -> list:
    return [row.tolist() for row in matrix]


def _binned(x: np.ndarray, splits: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(s, x[:, i], "left") for i, s in enumerate(splits)], axis=1).astype(np.uint8)


def _vectors(column) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64)


def _split_points(rows: DataFrame, n_features: int, n_rows: int, max_bins: int) -> list[list[float]]:
    """Upper ends of all bins but the last: between all values of a feature where they are few, else at its quantiles."""
    bins = min(max_bins, n_rows)
    shares = [i / bins for i in range(1, bins)] or [0.5]
    each = rows.select(F.posexplode("x").alias("i", "v"))
    figures = each.groupBy("i").agg(F.approx_count_distinct("v").alias("distinct"), F.percentile_approx("v", shares).alias("cuts")).collect()
    values: dict[int, list[float]] = {r["i"]: [] for r in figures if r["distinct"] < 2 * bins}
    if values:
        for r in each.where(F.col("i").isin(*values)).distinct().collect():
            values[r["i"]].append(r["v"])
    found: list[list[float]] = [[] for _ in range(n_features)]
    for r in figures:
        seen = sorted(values.get(r["i"], []))
        exact = r["i"] in values and len(seen) <= bins
        found[r["i"]] = [(a + b) / 2 for a, b in zip(seen, seen[1:])] if exact else sorted(set(r["cuts"]))
    return found


class Forest(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed):
    """Random forest classifier over numeric features; labels are 0, 1, 2, ..."""

    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of the deepest node", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature, 256 at most", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol=None, labelCol=None, predictionCol=None, numTrees=None, maxDepth=None, maxBins=None, seed=None):
        super().__init__()
        self._setDefault(numTrees=100, maxDepth=30, maxBins=_BINS, seed=30)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> ForestModel:
        n_trees, max_depth, seed = (self.getOrDefault(p) for p in (self.numTrees, self.maxDepth, self.seed))
        label = F.col(f"`{self.getLabelCol()}`").cast("double")
        bad = label.isNull() | F.isnan(label) | (label < 0) | (label >= MOST_CLASSES) | (label != F.floor(label))
        y = F.when(bad, F.raise_error(F.lit(f"labels must be 0, 1, 2, ... below {MOST_CLASSES}"))).otherwise(label).cast("int")
        rows = materialise(dataset.select(vector_to_array(F.col(f"`{self.getFeaturesCol()}`")).alias("x"), y.alias("y")), "forest-rows")
        seen = rows.agg(F.count("*").alias("n"), F.max("y").alias("y"), F.max(F.size("x")).alias("width")).first()
        if not seen["n"]:
            raise ValueError("a forest needs training rows")
        width, classes = seen["width"], seen["y"] + 1
        splits = _split_points(rows, width, seen["n"], self.getOrDefault(self.maxBins))
        n_tried = width if n_trees == 1 else math.ceil(math.sqrt(width))
        cores = dataset.sparkSession.sparkContext.defaultParallelism
        bagged = rows.mapInArrow(_bag([np.array(s) for s in splits], n_trees, seed), "bins binary, y int, weights binary")
        bagged = materialise(bagged.repartition(max(1, min(-(-seen["n"] // DEALT), 4 * cores))), "forest-bagged")
        shape = (width, n_trees, classes, seed, n_tried, max_depth)
        top = _grow_top(bagged, bagged.count(), *shape)
        trees = _grow_below(bagged, top, 4 * cores, *shape).unionByName(_top_rows(dataset.sparkSession, top, width))
        model = ForestModel(splits, classes, materialise(trees, "forest-trees"))
        return model._set(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol())


def _bag(splits: list[np.ndarray], n_trees: int, seed: int):
    """Rows by bins, equal ones of a batch as one, with the number of times each tree draws them."""
    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, y = _binned(_vectors(batch["x"]), splits), batch["y"].to_numpy()
            drawn = rng.poisson(1.0, (len(y), n_trees)) if n_trees > 1 else np.ones((len(y), 1), dtype=np.int64)
            at, _ = pd.factorize(np.array([a.tobytes() + bytes([b]) for a, b in zip(bins, y.tolist())], dtype=object))
            _, first = np.unique(at, return_index=True)
            if len(first) < len(y):
                order = np.argsort(at, kind="stable")
                drawn = np.add.reduceat(drawn[order], np.r_[0, np.cumsum(np.bincount(at))[:-1]], axis=0)
                bins, y = bins[first], y[first]
            yield pa.record_batch([_binary(bins), pa.array(y, pa.int32()), _binary(drawn.astype(np.uint32))], names=["bins", "y", "weights"])

    return bag


def _bagged(batch, width: int, n_trees: int):
    return _matrix(batch["bins"], np.uint8, width), batch["y"].to_numpy().astype(np.int64), _matrix(batch["weights"], np.uint32, n_trees)


class _Top:
    """The nodes of one tree that have, or had, many rows: lists that grow; open ones are ``BELOW`` with their number as ``left``."""

    def __init__(self):
        self.feature, self.split, self.left, self.votes, self.gains = [BELOW], [0], [1], [None], {}

    def arrays(self):
        return np.array(self.feature), np.array(self.split), np.array(self.left)

    def divide(self, at: int, feature: int, split: int, gain: float, sides: list[np.ndarray], max_depth: int) -> list[int]:
        """Splits a node; returns the places of children with many rows."""
        heap, place = self.left[at], len(self.feature)
        self.feature[at], self.split[at], self.left[at] = feature, split, place
        self.gains[feature] = self.gains.get(feature, 0.0) + gain
        for side, counts in enumerate(sides):
            self.feature.append(BELOW), self.split.append(0), self.left.append(2 * heap + side), self.votes.append(None)
            if counts.max() == counts.sum() or (2 * heap).bit_length() - 1 >= max_depth:
                self.close(place + side, counts)
        return [place + side for side in (0, 1) if self.feature[place + side] == BELOW and sides[side].sum() > TOGETHER]

    def close(self, at: int, counts: np.ndarray) -> None:
        self.feature[at], self.left[at], self.votes[at] = LEAF, 0, (counts / counts.sum()).tolist()


def _grow_top(bagged: DataFrame, n_rows: int, width: int, n_trees: int, classes: int, seed: int, n_tried: int, max_depth: int) -> list[_Top]:
    """Trees down to nodes of at most ``TOGETHER`` rows; the driver holds these few nodes."""
    top = [_Top() for _ in range(n_trees)]
    waiting = [(t, 0) for t in range(n_trees)] if n_rows > TOGETHER else []
    cells = n_tried * _BINS * classes
    at_once = max(1, COUNT_BYTES // (8 * cells))
    while waiting:
        now, waiting = sorted(waiting[:at_once]), waiting[at_once:]
        of = {t: [(k, at) for k, (tree, at) in enumerate(now) if tree == t] for t in {t for t, _ in now}}
        shape = {t: top[t].arrays() for t in of}
        tried = {t: _tried(seed, t, np.array([top[t].left[at] for _, at in of[t]]), width, n_tried) for t in of}

        def count(batches, now=now, of=of, shape=shape, tried=tried):
            total = np.zeros((len(now), cells))
            for batch in batches:
                bins, y, weights = _bagged(batch, width, n_trees)
                for t, places in of.items():
                    number = np.full(len(shape[t][0]), -1)
                    number[[at for _, at in places]] = np.arange(len(places))
                    drawn = np.flatnonzero(weights[:, t])
                    at = number[_route(bins[drawn], *shape[t])]
                    drawn, at = drawn[at >= 0], at[at >= 0]
                    key = (at[:, None] * n_tried + np.arange(n_tried)) * _BINS + bins[drawn[:, None], tried[t][at]]
                    key = key * classes + y[drawn][:, None]
                    found = np.bincount(key.ravel(), np.repeat(weights[drawn, t], n_tried), len(places) * cells)
                    total[places[0][0] : places[-1][0] + 1] += found.reshape(-1, cells)
            used = np.flatnonzero(total.any(1))
            for part in np.array_split(used, -(-len(used) // 256) or 1):
                yield pa.record_batch([pa.array(part, pa.int32()), _binary(total[part])], names=["k", "counts"])

        def choose(key, table):
            hist = _matrix(table["counts"], np.float64, cells).sum(0).reshape(-1, classes)
            total = hist[:_BINS].sum(0)
            filled = np.flatnonzero(hist.any(1))
            good, slot, cut, gain, left = _best(filled, hist[filled], total[None], n_tried)
            return pa.table({
                "k": pa.array([key[0].as_py()], pa.int32()), "good": [bool(good[0])], "slot": pa.array([int(slot[0])], pa.int32()),
                "cut": pa.array([int(cut[0])], pa.int32()), "gain": [float(gain[0])], "lefts": [left[0].tolist()], "total": [total.tolist()],
            })

        counted = bagged.mapInArrow(count, "k int, counts binary").groupBy("k")
        outcome = "k int, good boolean, slot int, cut int, gain double, lefts array<double>, total array<double>"
        for r in counted.applyInArrow(choose, outcome).collect():
            t, at = now[r["k"]]
            left, total = np.array(r["lefts"]), np.array(r["total"])
            if r["good"] and total.max() < total.sum():
                feature = int(tried[t][r["k"] - of[t][0][0], r["slot"]])
                waiting += [(t, child) for child in top[t].divide(at, feature, r["cut"], r["gain"], [left, total - left], max_depth)]
            else:
                top[t].close(at, total)
    return top


def _grow_below(
    bagged: DataFrame, top: list[_Top], tasks: int, width: int, n_trees: int, classes: int, seed: int, n_tried: int, max_depth: int
) -> DataFrame:
    """The rest of each tree, by the task that has the node's rows."""
    shape = [t.arrays() for t in top]
    groups = sum(int((feature == BELOW).sum()) for feature, _, _ in shape)

    def deal(batches):
        for batch in batches:
            bins, y, weights = _bagged(batch, width, n_trees)
            for t, (feature, split, left) in enumerate(shape):
                drawn = np.flatnonzero(weights[:, t])
                at = _route(bins[drawn], feature, split, left)
                drawn, at = drawn[feature[at] == BELOW], at[feature[at] == BELOW]
                yield pa.record_batch([
                    pa.array(np.full(len(drawn), t), pa.int32()), pa.array(left[at], pa.int64()), batch["bins"].take(pa.array(drawn)),
                    pa.array(y[drawn], pa.int32()), pa.array(weights[drawn, t], pa.int64()),
                ], names=["tree", "root", "bins", "y", "w"])

    def finish(key, table):
        tree, root = (k.as_py() for k in key)
        bins, y, w = _matrix(table["bins"], np.uint8, width), table["y"].to_numpy().astype(np.int64), table["w"].to_numpy().astype(np.float64)
        feature, split, left, votes, gains = grow(bins, y, w, tree, root, classes, seed, n_tried, max_depth)
        return pa.table({
            "tree": pa.array([tree], pa.int32()), "root": pa.array([root], pa.int64()), "feature": pa.array([feature], pa.list_(pa.int32())),
            "split": pa.array([split], pa.list_(pa.int32())), "left": pa.array([left], pa.list_(pa.int64())),
            "votes": pa.array([votes.ravel()], pa.list_(pa.float64())), "gains": pa.array([gains], pa.list_(pa.float64())),
        })

    dealt = bagged.mapInArrow(deal, "tree int, root bigint, bins binary, y int, w bigint")
    return dealt.repartition(max(1, min(groups, tasks)), "tree", "root").groupBy("tree", "root").applyInArrow(finish, TREES)


def _top_rows(spark, top: list[_Top], width: int) -> DataFrame:
    none: list[float] = []
    rows = [
        (i, 0, t.feature, t.split, [int(v) for v in t.left], [p for v in t.votes for p in (v or none)], [float(t.gains.get(f, 0.0)) for f in range(width)])
        for i, t in enumerate(top)
    ]
    return spark.createDataFrame(rows, TREES)


class ForestModel(Model, HasFeaturesCol, HasPredictionCol, MLWritable, MLReadable):
    """Trees as a table, with the split points of the features."""

    def __init__(self, splits: list[list[float]] | None = None, classes: int = 0, trees: DataFrame | None = None):
        super().__init__()
        self.splits, self.classes, self.trees = splits, classes, trees

    @property
    def featureImportances(self) -> DenseVector:
        """Gain by feature, as a share of each tree, then of all trees."""
        each = self.trees.select("tree", F.posexplode("gains")).groupBy("tree", "pos").agg(F.sum("col").alias("gain"))
        found = np.zeros((self.trees.agg(F.max("tree")).first()[0] + 1, len(self.splits)))
        for r in each.collect():
            found[r["tree"], r["pos"]] = r["gain"]
        found /= np.maximum(found.sum(1, keepdims=True), 1e-300)
        return DenseVector(found.sum(0) / max(found.sum(), 1e-300))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """A prediction for each row; rows of the same bins are answered together and rows go to the trees' parts by shuffle."""
        splits, classes, width = [np.array(s) for s in self.splits], self.classes, len(self.splits)

        @F.pandas_udf("binary")
        def binned(x):
            return x.__class__([row.tobytes() for row in _binned(np.array(x.tolist(), dtype=np.float64).reshape(-1, width), splits)])

        rows = dataset.withColumn("_bins", binned(vector_to_array(F.col(f"`{self.getFeaturesCol()}`"))))
        cells = materialise(rows.select("_bins").distinct().select(F.monotonically_increasing_id().alias("cell"), F.col("_bins").alias("bins")), "forest-cells")
        n_cells, cores = cells.count(), dataset.sparkSession.sparkContext.defaultParallelism
        top = [
            (r["tree"], np.array(r["feature"]), np.array(r["split"]), np.array(r["left"]), r["votes"])
            for r in self.trees.where("root = 0").collect()
        ]

        def place(batches):
            for batch in batches:
                bins = _matrix(batch["bins"], np.uint8, width)
                sums = np.zeros((len(bins), classes))
                for tree, feature, split, left, votes in top:
                    at = _route(bins, feature, split, left)
                    below = feature[at] == BELOW
                    leaves = np.zeros((len(feature), classes))
                    leaves[feature == LEAF] = np.array(votes).reshape(-1, classes)
                    sums += leaves[at]
                    on = pa.array(np.flatnonzero(below))
                    yield pa.record_batch([
                        pa.array(np.full(len(on), tree), pa.int32()), pa.array(left[at[below]], pa.int64()), batch["cell"].take(on), batch["bins"].take(on),
                        pa.nulls(len(on), pa.list_(pa.float64())),
                    ], names=["tree", "root", "cell", "bins", "votes"])
                none = pa.nulls(len(bins), pa.int64())
                yield pa.record_batch(
                    [none.cast(pa.int32()), none, batch["cell"], pa.nulls(len(bins), pa.binary()), pa.array(_lists(sums), pa.list_(pa.float64()))],
                    names=["tree", "root", "cell", "bins", "votes"],
                )

        def vote(key, cells, trees):
            if not cells.num_rows:
                return pa.table({"cell": pa.array([], pa.int64()), "votes": pa.array([], pa.list_(pa.float64()))})
            feature, split, left = (np.array(trees[c][0].as_py()) for c in ("feature", "split", "left"))
            at = _route(_matrix(cells["bins"], np.uint8, width), feature, split, left)
            votes = np.array(trees["votes"][0].as_py()).reshape(-1, classes)[at]
            return pa.table({"cell": cells["cell"], "votes": pa.array(_lists(votes), pa.list_(pa.float64()))})

        dealt = cells.repartition(max(1, min(-(-n_cells // DEALT), 4 * cores)))
        placed = materialise(dealt.mapInArrow(place, "tree int, root bigint, cell bigint, bins binary, votes array<double>"), "forest-placed")
        # A part of a tree is given out once for about as many rows as one task takes.
        blocks = 1 + n_cells // (2 * TOGETHER)
        keys = ["tree", "root", "block"]
        below = placed.where("votes IS NULL").withColumn("block", F.pmod(F.col("cell"), F.lit(blocks))).select(*keys, "cell", "bins")
        parts = self.trees.where("root > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
        answered = below.groupBy(*keys).cogroup(parts.select(*keys, "feature", "split", "left", "votes").groupBy(*keys)).applyInArrow(vote, "cell bigint, votes array<double>")
        votes = placed.where("votes IS NOT NULL").select("cell", "votes").unionByName(answered)
        # Rounded, so that the order of the sum decides no tie; the least class wins one.
        sums = votes.groupBy("cell").agg(F.array(*[F.round(F.sum(F.col("votes")[c]), 9) for c in range(classes)]).alias("_sums"))
        best = (F.array_position("_sums", F.array_max("_sums")) - 1).cast("double")
        found = cells.join(sums.select("cell", best.alias(self.getPredictionCol())), "cell").select(F.col("bins").alias("_bins"), self.getPredictionCol())
        return rows.join(found, "_bins").drop("_bins")

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()


class _ForestWriter(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        facts = {"splits": [list(map(float, s)) for s in self.model.splits], "classes": int(self.model.classes)}
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata=facts)
        self.model.trees.write.parquet(f"{path}/trees")


class _ForestReader(MLReader):
    def load(self, path: str) -> ForestModel:
        facts = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = ForestModel(facts["splits"], facts["classes"], self.sparkSession.read.schema(TREES).parquet(f"{path}/trees"))
        model._resetUid(facts["uid"])
        DefaultParamsReader.getAndSetParams(model, facts)
        return model
