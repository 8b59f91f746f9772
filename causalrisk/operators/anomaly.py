"""Isolation forest: random trees grown one per task, applied to all rows in parallel."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from causalrisk.operators.models import ABSENT_NUMBER
from causalrisk.operators.trees import matrix_of

TREES = 200
SAMPLE = 256_000
BROADCAST_NODES = 8_000_000
NODE = "tree int, node int, feature int, cut double, left int, right int, depth double, used long"


def mean_path(n: float) -> float:
    """Mean path length of an unsuccessful search among `n` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def grow_tree(x: np.ndarray, rng: np.random.Generator) -> list[tuple[int, float, int, int, float]]:
    """(feature, cut, left, right, depth) per node; a leaf has feature -1 and its expected depth."""
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes: list[tuple[int, float, int, int, float]] = []
    waiting = [(np.arange(len(x)), 0, -1, 0)]
    while waiting:
        rows, depth, parent, side = waiting.pop()
        here = len(nodes)
        if parent >= 0:
            f, c, l, r, d = nodes[parent]
            nodes[parent] = (f, c, here, r, d) if side == 0 else (f, c, l, here, d)
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        varied = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(varied):
            nodes.append((-1, 0.0, -1, -1, depth + mean_path(len(rows))))
            continue
        feature = int(rng.choice(varied))
        cut = float(rng.uniform(low[feature], high[feature]))
        nodes.append((feature, cut, -1, -1, 0.0))
        goes_left = part[:, feature] <= cut
        waiting.append((rows[~goes_left], depth + 1, here, 1))
        waiting.append((rows[goes_left], depth + 1, here, 0))
    return nodes


def _draw(df: DataFrame, id: str, values: Column, trees: int, share: float, seed: int) -> DataFrame:
    """(tree, _id, x): the sample of every tree, drawn for each tree on its own at any size."""
    span = 1 << 31

    def draw(*salt: Column) -> Column:
        return F.pmod(F.xxhash64("_id", *salt), F.lit(span))

    chosen = df.select(F.col(id).alias("_id"), values.alias("x"))
    limit = int(share * span)
    if share < 0.5 / trees:
        # Most rows are in no sample, which compiled hashes tell faster than a function of every tree number.
        chosen = chosen.where(F.least(*[draw(F.lit(t), F.lit(seed)) for t in range(trees)], F.lit(span)) < limit)
    number = F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t, F.lit(seed)) < limit))
    return chosen.select(number.alias("tree"), "_id", "x")


@dataclass
class IsolationForest:
    columns: list[str]
    nodes: DataFrame
    trees: int

    @staticmethod
    def fit(df: DataFrame, columns: list[str], id: str, trees: int = TREES, sample: int = SAMPLE,
            seed: int = 42) -> IsolationForest:
        """Grow `trees` trees, each on about `sample` rows drawn by a hash of the id.

        The draw depends on row and tree only, so a repeated task draws the same
        rows. The sample size bounds what one task receives.
        """
        total = df.count()
        share = min(1.0, sample / max(total, 1))
        values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(ABSENT_NUMBER)) for c in columns])
        drawn = _draw(df, id, values, trees, share, seed)

        def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            tree = int(key[0])
            pdf = pdf.sort_values("_id")
            nodes = grow_tree(np.stack(pdf["x"].to_numpy()), np.random.default_rng([seed, tree]))
            out = pd.DataFrame(nodes, columns=["feature", "cut", "left", "right", "depth"])
            return out.assign(tree=tree, node=range(len(out)), used=len(pdf))[
                ["tree", "node", "feature", "cut", "left", "right", "depth", "used"]]

        from causalrisk.session import materialise

        return IsolationForest(columns, materialise(drawn.groupBy("tree").applyInPandas(grow, NODE), "forest"), trees)

    @staticmethod
    def load(spark: SparkSession, path: str, columns: list[str]) -> IsolationForest:
        nodes = spark.read.parquet(path)
        return IsolationForest(columns, nodes, nodes.select("tree").distinct().count())

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(path)

    def score(self, df: DataFrame, output: str = "anomaly") -> DataFrame:
        """Add the anomaly score in (0, 1]; higher is more anomalous.

        Trees are sent to the executors in groups of bounded size; each group
        adds its path lengths to a running sum.
        """
        spark = df.sparkSession
        values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(ABSENT_NUMBER)) for c in self.columns])
        sizes = self.nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n"), F.max("used").alias("used")).orderBy("tree").collect()
        groups: list[list[int]] = [[]]
        held = 0
        for r in sizes:
            if groups[-1] and held + r.n > BROADCAST_NODES:
                groups.append([])
                held = 0
            groups[-1].append(r.tree)
            held += r.n
        usual = mean_path(sum(r.used for r in sizes) / max(len(sizes), 1)) or 1.0
        out = df.withColumns({"_x": values, "_path": F.lit(0.0)})
        schema = out.schema
        for trees in groups:
            part = self.nodes.filter(F.col("tree").isin(trees)).orderBy("tree", "node").toPandas()
            shared = spark.sparkContext.broadcast([
                {c: g[c].to_numpy() for c in ("feature", "cut", "left", "right", "depth")}
                for _, g in part.groupby("tree", sort=True)
            ])
            out = out.mapInArrow(_path_adder(shared, out.columns), schema)
        return out.withColumn(output, F.pow(F.lit(2.0), -F.col("_path") / (len(sizes) * usual))).drop("_x", "_path")


def _path_adder(shared, names: list[str]):
    def add_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [walkable(t) for t in shared.value]
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch.column(names.index("_x")))
                total = batch.column(names.index("_path")).to_numpy().copy()
                for t in trees:
                    total += walk(t, x)
                yield pa.RecordBatch.from_arrays([pa.array(total) if c == "_path" else v for c, v in zip(names, batch.columns, strict=True)], names=names)

    return add_paths


def walkable(tree: dict[str, np.ndarray]) -> dict[str, np.ndarray | int]:
    """A tree in which every row takes as many steps as the longest path: leaves lead to themselves."""
    here = np.arange(len(tree["feature"]))
    leaf = tree["feature"] < 0
    sides = np.stack([np.where(leaf, here, tree["right"]), np.where(leaf, here, tree["left"])], axis=1)
    steps, level = 0, here[:1][~leaf[:1]]
    while len(level):
        steps += 1
        level = sides[level].ravel()
        level = level[~leaf[level]]
    return {"feature": np.where(leaf, 0, tree["feature"]).astype(np.intp), "cut": tree["cut"], "next": sides.ravel().astype(np.intp), "depth": tree["depth"], "steps": steps}


def walk(tree: dict[str, np.ndarray | int], x: np.ndarray) -> np.ndarray:
    """`path_lengths` by a `walkable` tree."""
    flat, start = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
    node = np.zeros(len(x), dtype=np.intp)
    for _ in range(tree["steps"]):
        left = flat.take(start + tree["feature"].take(node)) <= tree["cut"].take(node)
        node = tree["next"].take(2 * node + left)
    return tree["depth"].take(node)


def path_lengths(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Expected path length of each row."""
    return walk(walkable(tree), x)


def evaluate_anomalies(df: DataFrame, target: str, score: str) -> DataFrame:
    """Average precision, ROC area and lift of an unsupervised score."""
    from causalrisk.operators.evaluate import ranking_metrics, score_curve

    return ranking_metrics(score_curve(df, target, score), score).select(
        "pr_auc", "roc_auc", F.col("pr_auc_lift").alias("lift_over_random")
    )
