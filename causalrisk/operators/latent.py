"""Text vectors by meaning: a truncated singular value decomposition of the weighted term matrix.

Words that occur in the same texts get near vectors, so a question can find a
passage that shares few of its words. The matrix A (texts by hashed terms, term
frequency times inverse document frequency) is only read row by row. A random
subspace of `dimensions` + EXTRA directions is turned towards the leading one by
a few passes Q <- orth(A'A Q): tasks multiply their rows and add up blocks of
terms, blocks are summed in two steps, and the next Q follows from the small
matrix Z'Z. The last pass gives (AQ)'(AQ), whose eigenvectors turn Q into the
right singular vectors. What reaches the driver has terms x dimensions numbers,
both parameters (10 MB by default), and never grows with the texts.

Defined results: a text without a known word has the zero vector, similar to
nothing; null texts count as empty; directions beyond the rank of the matrix are
zero; equal texts have equal vectors; an empty corpus gives zero vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from causalrisk.session import discard, materialise

TERMS, DIMENSIONS, EXTRA, PASSES = 1 << 14, 64, 16, 4
#: Terms of one block of sums, and partial sums that are added in one task before the last step.
BLOCK, SPREAD = 1024, 32
#: Texts whose products are held at once, and texts that share one dense matrix of their terms.
SLICE, DENSE = 256, 32


def _product(indices, values, q: np.ndarray) -> np.ndarray:
    """Products of a batch of sparse rows with q."""
    sizes = np.array([len(i) for i in indices])
    out = np.zeros((len(sizes), q.shape[1]))
    some = np.flatnonzero(sizes)
    if len(some):
        terms = np.concatenate([np.asarray(i, dtype=np.int64) for i in indices])
        flat = np.concatenate([np.asarray(v, dtype=float) for v in values])
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1][some]
        out[some] = np.add.reduceat(q[terms] * flat[:, None], starts, axis=0)
    return out


def _dense(batches: Iterator[pa.RecordBatch], terms: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A few sparse rows at a time as a dense matrix of the terms they have, and the numbers of these terms.

    Its products with a basis cost less than those of single terms, which would each copy a row of the basis.
    """
    place = np.zeros(terms, dtype=np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, DENSE):
            i, x = (batch.column(c).slice(at, DENSE) for c in (0, 1))
            sizes = i.value_lengths().to_numpy(zero_copy_only=False)
            flat = i.flatten().to_numpy(zero_copy_only=False)
            known = np.unique(flat)
            place[known] = np.arange(len(known))
            rows = np.zeros((len(sizes), len(known)))
            rows[np.repeat(np.arange(len(sizes)), sizes), place[flat]] = x.flatten().to_numpy(zero_copy_only=False)
            yield rows, known


def _orthonormal(z: np.ndarray) -> np.ndarray:
    """A basis of the columns' span; directions that are nothing but rounding are left out as zeros."""
    values, vectors = np.linalg.eigh(z.T @ z)
    keep = values > max(values.max(initial=0.0), 0.0) * 1e-14
    out = np.zeros_like(z)
    out[:, keep] = z @ (vectors[:, keep] / np.sqrt(values[keep]))
    return np.linalg.qr(out)[0] * keep[None, :] if keep.all() else out


class LatentVectors:
    """`basis`: terms x dimensions, the leading right singular vectors; `strengths`: the singular values."""

    def __init__(self, weights: PipelineModel, basis: np.ndarray, strengths: np.ndarray) -> None:
        self.weights, self.basis, self.strengths = weights, basis, strengths

    @staticmethod
    def fit(corpus: DataFrame, text: str, dimensions: int = DIMENSIONS, terms: int = TERMS, passes: int = PASSES, seed: int = 11) -> LatentVectors:
        spark = corpus.sparkSession
        plain = corpus.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
        if plain.isEmpty():
            plain = spark.createDataFrame([("",)], "_text string")
        words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern="[^\\p{L}\\p{N}]+", toLowercase=True)
        counting = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=terms)
        # The texts are cut into words once for the weights and the matrix.
        counts = materialise(counting.transform(words.transform(plain)).select("_counts"), "counts")
        weighing = IDF(inputCol="_counts", outputCol="_weighted").fit(counts)
        weights = PipelineModel(stages=[words, counting, weighing])
        rows = materialise(LatentVectors._sparse(weighing, counts, []), "terms")
        discard(counts)
        width = min(dimensions + EXTRA, terms)
        q = np.linalg.qr(np.random.default_rng(seed).normal(size=(terms, width)))[0]
        for _ in range(passes):
            q = _orthonormal(LatentVectors._pass(spark, rows, q))
        values, vectors = np.linalg.eigh(LatentVectors._gram(spark, rows, q))
        order = np.argsort(-values)[:dimensions]
        return LatentVectors(weights, q @ vectors[:, order], np.sqrt(np.maximum(values[order], 0.0)))

    @staticmethod
    def _sparse(weights: Transformer, df: DataFrame, keep: list[str]) -> DataFrame:
        # The terms of the text alone: an array of all terms would cost the same for every text.
        made = weights.transform(df).select(*keep, F.unwrap_udt("_weighted").alias("_w"))
        pairs = F.filter(F.arrays_zip(F.col("_w.indices").alias("i"), F.col("_w.values").alias("x")), lambda p: p["x"] != 0)
        return made.select(*keep, pairs.alias("_p")).select(*keep, F.col("_p.i").alias("i"), F.col("_p.x").alias("x"))

    @staticmethod
    def _pass(spark: SparkSession, rows: DataFrame, q: np.ndarray) -> np.ndarray:
        """A'A q, added up by blocks of terms."""
        sent, width = spark.sparkContext.broadcast(q), q.shape[1]

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(sent.value)
            for part, known in _dense(batches, len(total)):
                total[known] += part.T @ (part @ sent.value[known])
            starts = range(0, len(total), BLOCK)
            yield pa.RecordBatch.from_arrays([
                pa.array([*starts], pa.int32()), pa.array([TaskContext.get().partitionId() % SPREAD] * len(starts), pa.int32()),
                pa.array([total[k : k + BLOCK].tobytes() for k in starts], pa.binary()),
            ], names=["block", "part", "sums"])

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[tuple[int, int], np.ndarray] = {}
            for pdf in batches:
                for block, part, sums in pdf.itertuples(index=False):
                    values = np.frombuffer(sums)
                    held[block, part] = held[block, part] + values if (block, part) in held else values
            for (block, part), values in held.items():
                yield pd.DataFrame({"block": [block], "part": [part], "sums": [values.tobytes()]})

        schema = "block int, part int, sums binary"
        partial = rows.select("i", "x").mapInArrow(multiply, schema).repartition("block", "part").mapInPandas(add, schema)
        summed = partial.withColumn("part", F.lit(0)).repartition("block").mapInPandas(add, schema)
        # As many numbers as q has.
        found = {r.block: np.frombuffer(r.sums).reshape(-1, width) for r in summed.collect()}
        return np.concatenate([found.get(k, np.zeros((min(BLOCK, len(q) - k), width))) for k in range(0, len(q), BLOCK)])

    @staticmethod
    def _gram(spark: SparkSession, rows: DataFrame, q: np.ndarray) -> np.ndarray:
        """(A q)'(A q), one small matrix per task."""
        sent, width = spark.sparkContext.broadcast(q), q.shape[1]

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((width, width))
            for part, known in _dense(batches, len(sent.value)):
                out = part @ sent.value[known]
                total += out.T @ out
            yield pa.RecordBatch.from_arrays([pa.array(range(width * width), pa.int32()), pa.array(total.ravel())], names=["at", "value"])

        sums = rows.select("i", "x").mapInArrow(multiply, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
        out = np.zeros(width * width)
        for r in sums:
            out[r.at] = r.value
        return out.reshape(width, width)

    def transform(self, df: DataFrame, text: str, output: str = "vector") -> DataFrame:
        """`df` with the text's vector of unit length."""
        sent = df.sparkSession.sparkContext.broadcast(self.basis)
        keep = df.columns
        named = df.withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
        sparse = self._sparse(self.weights, named, keep)

        def project(indices: pd.Series, values: pd.Series) -> pd.Series:
            # A row's sum does not depend on the rows beside it, so equal texts have equal vectors.
            made = []
            for a in range(0, len(indices), SLICE):
                out = _product(indices.iloc[a : a + SLICE], values.iloc[a : a + SLICE], sent.value)
                norm = np.linalg.norm(out, axis=1, keepdims=True)
                made.extend(np.divide(out, norm, out=np.zeros_like(out), where=norm > 0))
            return pd.Series(made)

        # Beside the terms no column goes through Python.
        return sparse.select(*keep, F.pandas_udf(project, "array<double>")("i", "x").alias(output))

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.weights.write().overwrite().save(f"{path}/weights")
        rows = [(i, v.tolist()) for i, v in enumerate(self.basis)]
        spark.createDataFrame(rows, "term int, vector array<double>").write.mode("overwrite").parquet(f"{path}/basis")
        spark.createDataFrame([(self.strengths.tolist(),)], "strengths array<double>").write.mode("overwrite").parquet(f"{path}/strengths")

    @staticmethod
    def load(spark: SparkSession, path: str) -> LatentVectors:
        basis = np.array([r.vector for r in spark.read.parquet(f"{path}/basis").orderBy("term").collect()])
        strengths = np.array(spark.read.parquet(f"{path}/strengths").first().strengths)
        return LatentVectors(PipelineModel.load(f"{path}/weights"), basis, strengths)
