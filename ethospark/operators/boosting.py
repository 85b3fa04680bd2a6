"""Gradient-boosted trees whose splits send missing values to a learnt side.

Features are binned once: the edges are approximate quantiles of each feature over all rows, a row
becomes one byte per feature, and missing values have a code of their own. A level of all trees of a
round is one job: tasks add up gradients by (tree, node, feature, bin), Spark sums these tables, and the
best split of a node follows from running sums over the bins of a feature, with the missing
values tried on both sides. Two classes are one tree a round (logistic loss), more are one tree
per class (softmax).

Scale: the table of codes is written once, and again every ``REFRESH`` rounds with the scores of the trees
so far, so a pass evaluates at most ``REFRESH`` rounds of trees. A task holds one table of sums (trees x
nodes x features x bins); the driver receives one row per node. Gradients are summed as integers, so trees
do not depend on the partitioning. Features are split over the rows of the sums, never over columns of a plan.

Defined cases: a feature that is always missing or has one value can only split missing from present, or not
at all; labels are 0, 1, …; a class without rows is never predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ethospark.session import scratch_folder

BINS = 64  # bins of present values; code BINS is "missing"
REFRESH = 10
UNIT = float(1 << 20)  # gradients and curvatures are summed in these units
_FLOOR = 1e-6


@dataclass
class Tree:
    """Nodes in heap order: node ``i`` has children ``2 i + 1`` and ``2 i + 2``; leaves have feature -1."""

    depth: int
    feature: np.ndarray = field(init=False)
    bin: np.ndarray = field(init=False)
    missing_left: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)
    gain: np.ndarray = field(init=False)

    def __post_init__(self):
        nodes = (1 << (self.depth + 1)) - 1
        self.feature, self.bin = np.full(nodes, -1), np.zeros(nodes, np.int64)
        self.missing_left = np.zeros(nodes, bool)
        self.value, self.gain = np.zeros(nodes), np.zeros(nodes)

    def leaves(self, codes: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The node of every row of codes after ``levels`` levels."""
        at, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
        for _ in range(self.depth if levels is None else levels):
            feature = self.feature[at]
            code = codes[rows, np.maximum(feature, 0)]
            left = np.where(code == BINS, self.missing_left[at], code <= self.bin[at])
            at = np.where(feature < 0, at, 2 * at + np.where(left, 1, 2))
        return at


def _codes(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bytes (rows, features): number of edges below the value, or ``BINS`` where it is missing."""
    codes = np.empty(values.shape, np.uint8)
    for k, own in enumerate(edges):
        column = values[:, k]
        codes[:, k] = np.where(np.isnan(column), BINS, np.searchsorted(own, column, "left"))
    return codes


def _matrix(features: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column of doubles; nulls are NaN."""
    return features.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(features), width)


def _scores(margins: np.ndarray) -> np.ndarray:
    """Probabilities of the classes; one margin is that of class 1 of two."""
    if margins.shape[1] == 1:
        p = 1 / (1 + np.exp(-margins))
        return np.concatenate([1 - p, p], axis=1)
    grown = np.exp(margins - margins.max(axis=1, keepdims=True))
    return grown / grown.sum(axis=1, keepdims=True)


@dataclass
class BoostedTrees:
    edges: list[np.ndarray]
    start: np.ndarray  # margins before any tree: one, or one per class
    rounds: list[list[Tree]]
    classes: int

    def added(self, codes: np.ndarray, since: int = 0) -> np.ndarray:
        """What the trees from round ``since`` on add to the margins of rows of codes."""
        total = np.zeros((len(codes), len(self.start)))
        for trees in self.rounds[since:]:
            for k, tree in enumerate(trees):
                total[:, k] += tree.value[tree.leaves(codes)]
        return total

    def probabilities(self, features: Column) -> Column:
        """Class probabilities of an array of doubles, in the order of the fit, null where missing."""
        model, width = self, len(self.edges)

        @F.arrow_udf("array<double>")
        def score(column: pa.Array) -> pa.Array:
            probs = _scores(model.start + model.added(_codes(_matrix(column, width), model.edges)))
            offsets = np.arange(0, probs.size + 1, model.classes, dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(probs[:, : model.classes].ravel()))

        return score(features)

    def importance(self) -> np.ndarray:
        """Share of each feature in the gain of all splits."""
        total = np.zeros(len(self.edges))
        for trees in self.rounds:
            for tree in trees:
                split = tree.feature >= 0
                np.add.at(total, tree.feature[split], tree.gain[split])
        return total / total.sum() if total.sum() else total


def feature_edges(rows: DataFrame, width: int) -> list[np.ndarray]:
    """Up to ``BINS`` - 1 approximate quantiles of each feature, without the missing values."""
    shares = [k / BINS for k in range(1, BINS)]
    values = rows.select(F.posexplode("features").alias("feature", "value")).filter(F.col("value").isNotNull())
    found = values.groupBy("feature").agg(F.percentile_approx("value", shares, 50 * BINS).alias("edges"))
    by_feature = {r["feature"]: np.unique(r["edges"]) for r in found.collect()}  # a row per feature
    return [by_feature.get(k, np.zeros(0)) for k in range(width)]


def _stored_codes(rows: DataFrame, model: BoostedTrees) -> DataFrame:
    width = len(model.edges)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _codes(_matrix(batch.column("features"), width), model.edges)
            yield _code_batch(batch.column("label"), codes, np.tile(model.start, (len(codes), 1)))

    coded = rows.select(F.col("label").cast("int").alias("label"), "features").mapInArrow(task, _CODED)
    return _written(coded)


_CODED = "label int, codes binary, margins array<double>"


def _code_batch(labels: pa.Array, codes: np.ndarray, margins: np.ndarray) -> pa.RecordBatch:
    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes))])
    offsets = np.arange(0, margins.size + 1, margins.shape[1], dtype=np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(margins.ravel()))
    return pa.record_batch([labels, raw.cast(pa.binary()), lists], ["label", "codes", "margins"])


def _coded(batch: pa.RecordBatch, width: int, margins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = batch.column("codes").cast(pa.binary(width)).buffers()[1]
    begin = batch.column("codes").offset * width
    codes = np.frombuffer(raw, np.uint8, batch.num_rows * width, begin).reshape(batch.num_rows, width)
    return batch.column("label").to_numpy(zero_copy_only=False), codes, _matrix(batch.column("margins"), margins)


def _written(df: DataFrame) -> DataFrame:
    path = scratch_folder(df.sparkSession, "boosting")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _level_sums(rows: DataFrame, model: BoostedTrees, since: int, growing: list[Tree], level: int) -> DataFrame:
    """Sums of gradients and curvatures by (tree, node, feature, bin) over the rows at a level's open nodes."""
    width, outputs, bins = len(model.edges), len(model.start), BINS + 1
    first = (1 << level) - 1  # the level's first node
    columns = ["tree", "node", "feature", "bin", "g", "h"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, outputs, width, (1 << level) * bins))
        for batch in batches:
            labels, codes, margins = _coded(batch, width, outputs)
            probs = _scores(margins + model.added(codes, since))
            for k, tree in enumerate(growing):
                p = probs[:, k + 1] if outputs == 1 else probs[:, k]
                truth = labels == (1 if outputs == 1 else k)
                gradient, curvature = np.rint((p - truth) * UNIT), np.rint(np.maximum(p * (1 - p), _FLOOR) * UNIT)
                node = tree.leaves(codes, level) - first
                open_ = node >= 0  # rows in leaves above stay there
                cell, g, h = node[open_] * bins, gradient[open_], curvature[open_]
                for f in range(width):
                    here = cell + codes[open_, f]
                    sums[0, k, f] += np.bincount(here, g, (1 << level) * bins)
                    sums[1, k, f] += np.bincount(here, h, (1 << level) * bins)
        tree, feature, cell = np.nonzero(sums[1])
        for begin in range(0, len(tree), 1 << 17):
            t, f, c = (x[begin : begin + (1 << 17)] for x in (tree, feature, cell))
            g, h = (sums[i, t, f, c].astype(np.int64) for i in range(2))
            yield pa.record_batch([pa.array(x) for x in (t, c // bins + first, f, c % bins, g, h)], columns)

    partial = rows.mapInArrow(task, ", ".join(f"{c} long" for c in columns))
    return partial.groupBy("tree", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def _best_splits(sums: DataFrame, l2: float, least: float) -> DataFrame:
    """One row per (tree, node): sums of the node, and its best split where one gains."""
    here = Window.partitionBy("tree", "node", "feature")
    so_far = here.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    unit = F.lit(UNIT)
    gaps = {c: F.coalesce(F.max(F.when(F.col("bin") == BINS, F.col(c))).over(here), F.lit(0)) for c in "gh"}
    rows = sums.select(
        "tree", "node", "feature", "bin",
        *[(F.sum(c).over(here) / unit).alias(f"{c}_all") for c in "gh"],
        *[(F.sum(c).over(so_far) / unit).alias(f"{c}_left") for c in "gh"],
        *[(gaps[c] / unit).alias(f"{c}_gap") for c in "gh"],
    )
    sides = F.when(F.col("h_gap") > 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    tried = rows.filter(F.col("bin") < BINS).withColumn("missing_left", F.explode(sides))
    taken = tried.withColumns({f"{c}_left": F.col(f"{c}_left") + F.when(F.col("missing_left"), F.col(f"{c}_gap")).otherwise(0) for c in "gh"})
    part = lambda g, h: g * g / (h + l2)
    g, h, g_left, h_left = (F.col(c) for c in ("g_all", "h_all", "g_left", "h_left"))
    gain = (part(g_left, h_left) + part(g - g_left, h - h_left) - part(g, h)) / 2
    allowed = (h_left >= least) & (h - h_left >= least)
    found = taken.withColumn("gain", F.when(allowed, F.round(gain, 9)).otherwise(0.0))
    split = F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), (~F.col("missing_left")).alias("right"), "g_left", "h_left")
    best = found.groupBy("tree", "node").agg(F.max(split).alias("best"))
    totals = rows.groupBy("tree", "node").agg(F.max("g_all").alias("g"), F.max("h_all").alias("h"))
    return totals.join(best, ["tree", "node"], "left")


def _grow(rows: DataFrame, model: BoostedTrees, since: int, depth: int, rate: float, l2: float, least: float) -> list[Tree]:
    growing = [Tree(depth) for _ in model.start]

    def leaf(tree: Tree, node: int, g: float, h: float) -> None:
        tree.value[node] = -rate * g / (h + l2)

    for level in range(depth):
        grown = False
        splits = _best_splits(_level_sums(rows, model, since, growing, level), l2, least).collect()  # a row per node
        for row in splits:
            tree, node, best = growing[row.tree], row.node, row.best
            if best is None or best.gain <= 0:
                leaf(tree, node, row.g, row.h)
                continue
            grown = True
            tree.feature[node], tree.bin[node] = -best.f, -best.b
            tree.missing_left[node], tree.gain[node] = not best.right, best.gain
            leaf(tree, 2 * node + 1, best.g_left, best.h_left)
            leaf(tree, 2 * node + 2, row.g - best.g_left, row.h - best.h_left)
        if not grown:
            break
    return growing


def fit(
    rows: DataFrame, width: int, classes: int, max_iter: int = 20, max_depth: int = 5, rate: float = 0.3, l2: float = 1.0, least: float = 1.0,
) -> BoostedTrees:
    """Trees from rows of ``label`` (0, 1, …) and ``features`` (array of ``width`` doubles, null where missing).

    ``rate`` shrinks every tree, ``l2`` smooths leaf values, ``least`` is the curvature that a side must have."""
    counts = {int(r["label"]): r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    shares = np.array([counts.get(k, 0) for k in range(max(classes, 2))]) / max(1, sum(counts.values()))
    shares = np.clip(shares, _FLOOR, 1 - _FLOOR)
    start = np.log(shares) if classes > 2 else np.array([np.log(shares[1] / shares[0])])
    model = BoostedTrees(feature_edges(rows, width), start, [], max(classes, 2))
    coded, since = _stored_codes(rows, model), 0
    for done in range(max_iter):
        if done and done % REFRESH == 0:
            coded, since = _with_margins(coded, model, since), done
        model.rounds.append(_grow(coded, model, since, max_depth, rate, l2, least))
    return model


def _with_margins(rows: DataFrame, model: BoostedTrees, since: int) -> DataFrame:
    width, outputs = len(model.edges), len(model.start)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, codes, margins = _coded(batch, width, outputs)
            yield _code_batch(batch.column("label"), codes, margins + model.added(codes, since))

    return _written(rows.mapInArrow(task, _CODED))
