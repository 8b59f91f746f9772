"""The nodes of fitted boosted trees as arrays, and functions of arrays applied to rows in tasks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T

from causalrisk.session import shared_folder


def tree_nodes(model: PipelineModel, spark) -> pd.DataFrame:
    """The nodes of a fitted boosted-trees model, read from its saved form."""
    boosted = model.stages[-1]
    path = f"{shared_folder(spark).rstrip('/')}/trees-{uuid.uuid4().hex}"
    boosted.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild",
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.col("nodeData.split.leftCategoriesOrThreshold").alias("left"),
        F.col("nodeData.split.numCategories").alias("categories"),
    )
    # A model has maxIter * 2^(maxDepth + 1) nodes at most, whatever the data size.
    return nodes.orderBy("treeID", "id").toPandas()


def compact_trees(nodes: pd.DataFrame, weights: list[float]) -> list[dict[str, np.ndarray]]:
    trees = []
    for tree, part in nodes.groupby("treeID", sort=True):
        part = part.set_index("id").sort_index()
        trees.append({
            # In log-odds the margin counts twice.
            "value": part.prediction.to_numpy() * weights[tree] * 2.0,
            "left": part.leftChild.to_numpy(),
            "right": part.rightChild.to_numpy(),
            "feature": part.feature.to_numpy(),
            "number": np.array([v[0] if len(v) else np.nan for v in part.left]),
            "sets": {i: np.asarray(v) for i, (v, c) in enumerate(zip(part.left, part.categories)) if c >= 0 and len(v)},
        })
    return trees


def matrix_of(column: pa.Array) -> np.ndarray:
    """An Arrow column of equally long lists of numbers as a matrix, one row each."""
    return np.asarray(column.flatten()).reshape(len(column), -1)


def with_contributions(scored: DataFrame, contributions: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """`scored` with `_c`, the numbers that `contributions` gives for the matrix of `features`, in place of these."""
    keep = [c for c in scored.columns if c != "features"]
    schema = T.StructType([*[scored.schema[c] for c in keep], T.StructField("_c", T.ArrayType(T.DoubleType()))])

    def attribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = contributions(matrix_of(batch.column(len(keep))))
                offsets = pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1])
                lists = pa.ListArray.from_arrays(offsets, pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], lists], names=[*keep, "_c"])

    return scored.select(*keep, vector_to_array("features").alias("_x")).mapInArrow(attribute, schema)
