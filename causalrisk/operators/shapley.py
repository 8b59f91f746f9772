"""Exact Shapley values of boosted trees against all rows of a background table.

The value of a set of features is the mean score of the background rows after
these features took the explained row's values. In a tree, a leaf sees a row
only through one bit per feature on its path: does the row satisfy all the
path's conditions on it? So of the background a leaf needs just the number of
rows per pattern of bits, which one pass over any number of rows adds up; and an
explained row's contributions at the leaf depend only on its own pattern. Each
of the other patterns counts with the weights of the subsets that reach the
leaf: with p features that only the explained row satisfies and q that only the
background row does, (p-1)! q! / (p+q)! for each of the former and minus
p! (q-1)! / (p+q)! for each of the latter.

The base value is the mean margin of the background, and base plus contributions
is the row's margin. Time grows with the leaves, not with the background.

Defined results: trees without a split contribute to the base only; features on
no path get zero; an empty background is refused, as it has no mean.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from causalrisk.operators.explain import tree_reasons
from causalrisk.operators.trees import compact_trees, matrix_of, tree_nodes, with_contributions

#: Features on a path up to which the contributions of all patterns of a leaf are held as a table.
TABLE_FEATURES = 8

Tree = dict[str, np.ndarray]


@dataclass
class Leaf:
    """A leaf's value and the different features on its path, whose bits make up a pattern, lowest first."""

    value: float
    features: list[int]


def _goes_left(tree: Tree, node: int, seen: np.ndarray) -> np.ndarray:
    members = tree["sets"].get(node)
    return seen <= tree["number"][node] if members is None else np.isin(seen, members)


def _walk(tree: Tree, x: np.ndarray, node: int, met: dict[int, np.ndarray]) -> Iterator[tuple[float, dict[int, np.ndarray]]]:
    """Each leaf's value and, per feature of its path, which rows satisfy the conditions; left before right."""
    if tree["left"][node] < 0:
        yield float(tree["value"][node]), met
        return
    f = int(tree["feature"][node])
    left = _goes_left(tree, node, x[:, f])
    for child, side in ((tree["left"][node], left), (tree["right"][node], ~left)):
        yield from _walk(tree, x, int(child), {**met, f: met[f] & side if f in met else side})


def leaf_patterns(trees: list[Tree], x: np.ndarray) -> Iterator[tuple[Leaf, np.ndarray]]:
    """Every leaf of every tree, in a fixed order, with the pattern of each row."""
    for tree in trees:
        for value, met in _walk(tree, x, 0, {}):
            pattern = np.zeros(len(x), dtype=np.int64)
            for bit, ok in enumerate(met.values()):
                pattern |= ok.astype(np.int64) << bit
            yield Leaf(value, list(met)), pattern


def pattern_counts(pattern: np.ndarray, k: int) -> list[tuple[int, int]]:
    """How many rows have each pattern of `k` bits that occurs; patterns of few bits are counted without a sort."""
    if k <= TABLE_FEATURES:
        counts = np.bincount(pattern, minlength=1)
        seen = np.flatnonzero(counts)
        return [*zip(seen.tolist(), counts[seen].tolist(), strict=True)]
    seen, counts = np.unique(pattern, return_counts=True)
    return [*zip(seen.tolist(), counts.tolist(), strict=True)]


def subset_weights(own: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
    """Contribution per (own pattern, background pattern, feature) to a leaf of value 1 with k features."""
    only_own, only_other = own[:, None] & ~other[None, :], other[None, :] & ~own[:, None]
    reached = (own[:, None] | other[None, :]) == (1 << k) - 1
    p, q = (np.bitwise_count(m.astype(np.uint64)).astype(int) for m in (only_own, only_other))
    gain, loss = np.zeros((k + 1, k + 1)), np.zeros((k + 1, k + 1))
    for a in range(k + 1):
        for b in range(k + 1 - a):
            gain[a, b] = factorial(a - 1) * factorial(b) / factorial(a + b) if a else 0.0
            loss[a, b] = factorial(a) * factorial(b - 1) / factorial(a + b) if b else 0.0
    bits = np.arange(k)
    has = lambda m: (m[..., None] >> bits) & 1
    return reached[..., None] * (gain[p, q][..., None] * has(only_own) - loss[p, q][..., None] * has(only_other))


class Explainer:
    """Contributions of rows from the trees and the counts (leaf, pattern) -> rows of the background."""

    def __init__(self, trees: list[Tree], counts: dict[int, tuple[np.ndarray, np.ndarray]], n: int) -> None:
        self.trees, self.counts, self.n = trees, counts, n
        self.tables: dict[int, np.ndarray] = {}
        self.units: dict[int, np.ndarray] = {}

    def _table(self, at: int, k: int) -> np.ndarray:
        """Contribution per own pattern and feature to leaf number `at`, of value 1."""
        if at not in self.tables:
            if k not in self.units:
                every = np.arange(1 << k)
                self.units[k] = subset_weights(every, every, k)
            pattern, share = self.counts[at]
            self.tables[at] = np.einsum("xzf,z->xf", self.units[k][:, pattern], share)
        return self.tables[at]

    def contributions(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape)
        for at, (leaf, pattern) in enumerate(leaf_patterns(self.trees, x)):
            k = len(leaf.features)
            if 0 < k <= TABLE_FEATURES:
                out[:, leaf.features] += leaf.value * self._table(at, k)[pattern]
            elif k:
                own, where = np.unique(pattern, return_inverse=True)
                other, share = self.counts[at]
                for a in range(0, len(own), 64):
                    part = np.einsum("xzf,z->xf", subset_weights(own[a : a + 64], other, k), share)
                    rows = (where >= a) & (where < a + 64)
                    out[np.ix_(rows, leaf.features)] += leaf.value * part[where[rows] - a]
        return out

    def base(self) -> float:
        """Mean margin of the background: each leaf's value times the share of rows that satisfy its whole path."""
        total = 0.0
        for at, (leaf, _) in enumerate(leaf_patterns(self.trees, np.zeros((0, 1 << 16)))):
            pattern, share = self.counts[at]
            total += leaf.value * float(share[pattern == (1 << len(leaf.features)) - 1].sum())
        return total


def _by_leaf(counts: pd.DataFrame, n: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    return {int(at): (part.pattern.to_numpy(dtype=np.int64), part.n.to_numpy(dtype=float) / n) for at, part in counts.groupby("leaf")}


class TreeShapley:
    """Exact reasons of a fitted boosted-trees pipeline; `counts` (leaf, pattern, n) are all it keeps of the background."""

    def __init__(self, model: PipelineModel, counts: DataFrame) -> None:
        self.spark = counts.sparkSession
        self.counts = counts
        self.trees = compact_trees(tree_nodes(model, self.spark), list(model.stages[-1].treeWeights))
        # As many rows as leaves times patterns of their few features, whatever the background's size.
        local = counts.toPandas()
        n = int(local[local.leaf == 0].n.sum()) if len(local) else 0
        if not n:
            raise ValueError("the background has no rows")
        self.explainer = Explainer(self.trees, _by_leaf(local, n), n)
        self.base = self.explainer.base()

    @staticmethod
    def fit(model: PipelineModel, background: DataFrame) -> TreeShapley:
        """Count the patterns of all rows of `background`, raw rows as the model was fitted on."""
        spark = background.sparkSession
        trees = spark.sparkContext.broadcast(compact_trees(tree_nodes(model, spark), list(model.stages[-1].treeWeights)))
        vectors = model.transform(background).select(vector_to_array("features").alias("x"))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], int] = {}
            for batch in batches:
                if batch.num_rows:
                    for at, (leaf, pattern) in enumerate(leaf_patterns(trees.value, matrix_of(batch.column(0)))):
                        for p, c in pattern_counts(pattern, len(leaf.features)):
                            total[at, p] = total.get((at, p), 0) + c
            made = [*zip(*[(at, p, c) for (at, p), c in total.items()], strict=True)] or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in made], names=["leaf", "pattern", "n"])

        counts = vectors.mapInArrow(count, "leaf long, pattern long, n long").groupBy("leaf", "pattern").agg(F.sum("n").alias("n"))
        return TreeShapley(model, spark.createDataFrame(counts.toArrow()))

    def explain(self, scored: DataFrame, names: list[str], show: Collection[str] | None = None) -> DataFrame:
        """`scored` (with `features` and the raw columns behind `names`) and its `reasons`; base + reasons = log-odds.

        With `show` only the values of these columns are put into words.
        """
        shared = self.spark.sparkContext.broadcast(self.explainer)
        rows = with_contributions(scored, lambda x: shared.value.contributions(x))
        return rows.withColumn("reasons", tree_reasons(rows, names, show)).drop("_c")

    def save(self, path: str) -> None:
        self.counts.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, model: PipelineModel) -> TreeShapley:
        return TreeShapley(model, spark.read.parquet(path))
