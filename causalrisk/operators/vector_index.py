"""An inverted file for cosine search: vectors stored by cell, a query reads the cells nearest to it.

The centres of the cells come from k-means over at most SAMPLE_ROWS vectors;
every vector is then assigned to its nearest centre and stored in blocks of one
cell, sorted by cell, so that a search skips the row groups of other cells. A
cell may hold any share of the vectors, as it is as many blocks as it needs.
Similarities inside the probed cells are exact, so a hit that is found has its
right value; what may be missing are hits in cells that were not probed.
`probes_for` measures that on asked queries and picks the fewest cells that reach
a wanted recall. With all cells probed the result is the exact one.

Vectors without a direction in common have no good cells: half of them must be
read to find nine of ten neighbours. The gain comes with clustered vectors.

Defined results: a null vector is in no cell and is never a hit, a null query has
none; a vector of zeros is similar to nothing (0) and lies in the first cell;
equal similarities (ten digits) go by the smaller id; repeated rows are hits of
their own; an index over no vectors finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from causalrisk.operators.retrieve import _unit_rows, best_products, cosine_top_k, unit_length
from causalrisk.session import materialise

#: Vectors that the centres are fitted on, whatever the corpus size.
SAMPLE_ROWS = 50_000
#: Vectors in a stored block, and queries that are packed together.
BLOCK_ROWS, QUERY_ROWS = 2048, 512
#: Vectors that one task takes of either side at a time.
SHELF_ROWS = 16_384
#: Queries on which the number of probes is measured.
TRIAL_QUERIES = 500


def _nearest_cells(centres: np.ndarray, vectors: np.ndarray, n: int) -> np.ndarray:
    """Per vector the n nearest cells, nearest first, equal ones by number."""
    return np.argsort(-np.round(vectors @ centres.T, 10), axis=1, kind="stable")[:, :n]


def _probed(centres: np.ndarray, vectors: np.ndarray, n: int) -> np.ndarray:
    """Per vector and cell whether it is one of the n nearest."""
    out = np.zeros((len(vectors), len(centres)), dtype=bool)
    near = _nearest_cells(centres, vectors, n) if len(centres) > 1 else np.zeros((len(vectors), 1), dtype=int)
    np.put_along_axis(out, near, True, axis=1)
    return out


def _packs(rows: pd.DataFrame, size: int) -> Iterator[dict]:
    """Rows (cell, id, unit vectors in `v`) of one batch as blocks of a cell."""
    for cell, part in rows.groupby("cell", sort=True):
        for a in range(0, len(part), size):
            some = part.iloc[a : a + size]
            matrix = np.stack(some["v"].to_numpy())
            yield {"cell": int(cell), "ids": some["id"].to_numpy(), "width": matrix.shape[1], "matrix": matrix.astype("<f8").tobytes()}


class VectorIndex:
    def __init__(self, blocks: DataFrame, centres: np.ndarray) -> None:
        self.blocks, self.centres = blocks, centres

    @staticmethod
    def fit(corpus: DataFrame, id: str, vector: str, cells: int | None = None, seed: int = 7, path: str | None = None) -> VectorIndex:
        """`cells` defaults to the square root of the number of vectors in the sample."""
        spark = corpus.sparkSession
        rows = corpus.select(F.col(id).alias("id"), F.col(vector).alias("v")).where("v is not null")
        unit = F.transform(unit_length(F.col("v")), lambda x: F.coalesce(x, F.lit(0.0)))
        # The hash orders the rows the same way in every run; ties don't matter for centres.
        sample = materialise(rows.orderBy(F.xxhash64("id", F.lit(seed))).limit(SAMPLE_ROWS).select(array_to_vector(unit).alias("features")), "sample")
        size = sample.count()
        k = min(max(1, cells or round(size**0.5)), max(size, 1))
        if size > 1 and k > 1:
            centres = _unit_rows(KMeans(k=k, seed=seed, maxIter=20).fit(sample).clusterCenters())
        else:
            centres = np.zeros((1, 1))
        sent = spark.sparkContext.broadcast(centres)

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    unit = _unit_rows(pdf["v"])
                    cell = _nearest_cells(sent.value, unit, 1)[:, 0] if len(sent.value) > 1 else np.zeros(len(unit), dtype=int)
                    yield pd.DataFrame({"id": pdf["id"], "cell": cell, "v": list(unit)})

        kind = rows.schema["id"].dataType
        flat = T.StructType([T.StructField("id", kind), T.StructField("cell", T.IntegerType()), T.StructField("v", T.ArrayType(T.DoubleType()))])
        placed = rows.mapInPandas(assign, flat).repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("cell", "id")

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield pd.DataFrame(list(_packs(pdf, BLOCK_ROWS)))

        packed = placed.mapInPandas(pack, VectorIndex._schema(kind))
        if path is None:
            return VectorIndex(materialise(packed, "vector-index"), centres)
        packed.write.mode("overwrite").parquet(f"{path}/blocks")
        spark.createDataFrame(enumerate(centres.tolist()), "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        return VectorIndex.load(spark, path)

    @staticmethod
    def _schema(kind: T.DataType) -> T.StructType:
        return T.StructType([
            T.StructField("cell", T.IntegerType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("width", T.IntegerType()),
            T.StructField("matrix", T.BinaryType()),
        ])

    @staticmethod
    def load(spark: SparkSession, path: str) -> VectorIndex:
        centres = np.array([r.centre for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()])
        return VectorIndex(spark.read.parquet(f"{path}/blocks"), centres)

    @property
    def cells(self) -> int:
        return len(self.centres)

    def sizes(self) -> DataFrame:
        """(cell, n): stored vectors per cell."""
        return self.blocks.groupBy("cell").agg(F.sum(F.size("ids")).alias("n"))

    def _near(self, queries: DataFrame, vector: str, probes: int) -> DataFrame:
        """(cell, q): queries that probe a cell, a few rows per task."""
        sent = queries.sparkSession.sparkContext.broadcast(self.centres)

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            asked = np.zeros(len(sent.value), dtype=np.int64)
            for pdf in batches:
                if len(pdf):
                    asked += _probed(sent.value, _unit_rows(pdf["v"]), probes).sum(axis=0)
            yield pd.DataFrame({"cell": np.flatnonzero(asked), "q": asked[asked > 0]})

        rows = queries.select(F.col(vector).alias("v")).where("v is not null")
        return rows.mapInPandas(count, "cell int, q long").groupBy("cell").agg(F.sum("q").alias("q"))

    def _shelves(self, wanted: set[int]) -> list[tuple[int, int, int, int]]:
        """(first cell, end, first shelf, shelves): neighbouring cells up to SHELF_ROWS vectors share a shelf, a larger cell has several.

        As many numbers as cells, at most.
        """
        sizes = {r.cell: r.n for r in self.sizes().collect() if r.cell in wanted}
        out: list[tuple[int, int, int, int]] = []
        held = SHELF_ROWS
        for cell in sorted(sizes):
            n = sizes[cell]
            if held + n <= SHELF_ROWS:
                out[-1] = (out[-1][0], cell + 1, *out[-1][2:])
                held += n
            else:
                out.append((cell, cell + 1, out[-1][2] + out[-1][3] if out else 0, -(-n // SHELF_ROWS)))
                held = n
        return out

    def _asked(self, queries: DataFrame, id: str, vector: str, probes: int, shelves: list[tuple[int, int, int, int]]) -> DataFrame:
        """Queries packed once for every shelf with a cell they probe, and which of its cells each one probes."""
        sent = queries.sparkSession.sparkContext.broadcast(self.centres)
        rows = queries.select(F.col(id).alias("id"), F.col(vector).alias("v")).where("v is not null")

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for a in range(0, len(pdf), QUERY_ROWS):
                    part = pdf.iloc[a : a + QUERY_ROWS]
                    ids, unit = part["id"].to_numpy(), _unit_rows(part["v"])
                    probed = _probed(sent.value, unit, probes)
                    for first, end, shelf, pieces in shelves:
                        here = np.flatnonzero(probed[:, first:end].any(axis=1))
                        if len(here):
                            yield pd.DataFrame([{
                                "shelf": shelf + piece, "first_cell": first, "asked": ids[here], "asked_width": unit.shape[1],
                                "asked_matrix": unit[here].astype("<f8").tobytes(), "probed": probed[here, first:end].tobytes(),
                            } for piece in range(pieces)])

        return rows.mapInPandas(pack, T.StructType([
            T.StructField("shelf", T.IntegerType()), T.StructField("first_cell", T.IntegerType()),
            T.StructField("asked", T.ArrayType(rows.schema["id"].dataType)), T.StructField("asked_width", T.IntegerType()),
            T.StructField("asked_matrix", T.BinaryType()), T.StructField("probed", T.BinaryType()),
        ]))

    def search(self, queries: DataFrame, query_id: str, query_vector: str, k: int, probes: int) -> DataFrame:
        """(query_id, corpus_id, similarity, rank): the k nearest of every query in its `probes` nearest cells.

        A shelf meets a part of the queries in one task, each with at most about
        SHELF_ROWS vectors. A query is sent once per shelf, not once per cell.
        """
        spark = queries.sparkSession
        # As many numbers as cells at most; they let the reader skip row groups.
        wanted = set(range(self.cells)) if probes >= self.cells else {r.cell for r in self._near(queries, query_vector, probes).collect()}
        shelves = self._shelves(wanted)
        n_shelves = shelves[-1][2] + shelves[-1][3] if shelves else 1
        n = queries.where(F.col(query_vector).isNotNull()).count()
        # As few parts as keep every core busy and every part small: each reads the shelf again.
        parts = max(-(-n // SHELF_ROWS), min(-(-n // QUERY_ROWS), -(-4 * spark.sparkContext.defaultParallelism // n_shelves)), 1)
        placed = [(cell, shelf, pieces) for first, end, shelf, pieces in shelves for cell in range(first, end)]
        listed = F.broadcast(spark.createDataFrame(placed, "cell int, first int, pieces int"))
        stored = self.blocks.where(F.col("cell").isin(sorted(wanted))).join(listed, "cell")
        right = stored.select(
            (F.col("first") + F.pmod(F.xxhash64("ids"), F.col("pieces"))).cast("int").alias("shelf"),
            F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "cell", "ids", "width", "matrix",
        )
        asked = self._asked(queries, query_id, query_vector, probes, shelves)
        left = asked.withColumn("part", F.pmod(F.xxhash64("asked"), F.lit(parts)).cast("int"))
        schema = T.StructType([
            T.StructField("query_id", asked.schema["asked"].dataType.elementType), T.StructField("corpus_id", self.blocks.schema["ids"].dataType.elementType),
            T.StructField("similarity", T.DoubleType()),
        ])

        def best(packs: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
            out = pd.DataFrame({"query_id": [], "corpus_id": [], "similarity": []})
            if not len(packs) or not len(blocks):
                return out
            left = np.concatenate([np.frombuffer(r.asked_matrix, dtype="<f8").reshape(-1, r.asked_width) for r in packs.itertuples()])
            names = np.concatenate([np.asarray(x) for x in packs["asked"]])
            probed = np.concatenate([np.frombuffer(r.probed, dtype=bool).reshape(len(r.asked), -1) for r in packs.itertuples()])
            first = int(packs["first_cell"].iloc[0])
            rows, ids, values = [], [], []
            for cell, some in blocks.groupby("cell"):
                at = np.flatnonzero(probed[:, int(cell) - first])
                known = np.concatenate([np.asarray(x) for x in some["ids"]])
                right = np.concatenate([np.frombuffer(r.matrix, dtype="<f8").reshape(-1, r.width) for r in some.itertuples()])
                order = np.argsort(known, kind="stable")
                row, near, similar = best_products(left[at], right[order], k)
                rows.append(at[row])
                ids.append(known[order][near])
                values.append(similar)
            row, known, similar = np.concatenate(rows), np.concatenate(ids), np.concatenate(values)
            place = np.argsort(np.argsort(known, kind="stable"), kind="stable") if known.dtype == object else known
            order = np.lexsort((place, -similar, row))
            row = row[order]
            top = np.arange(len(row)) - np.searchsorted(row, row) < k
            return pd.DataFrame({"query_id": names[row[top]], "corpus_id": known[order][top], "similarity": similar[order][top]})

        found = left.groupBy("shelf", "part").cogroup(right.groupBy("shelf", "part")).applyInPandas(best, schema)
        ranked = W.partitionBy("query_id").orderBy(F.desc("similarity"), "corpus_id")
        # At most k rows per query and shelf are left here.
        return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)

    def rows_read(self, queries: DataFrame, query_id: str, query_vector: str, probes: int) -> DataFrame:
        """(queries, mean_rows): stored vectors in the probed cells of a query, on average."""
        total = self._near(queries, query_vector, probes).join(F.broadcast(self.sizes()), "cell").agg(F.sum(F.col("q") * F.col("n")).alias("rows"))
        n = queries.where(F.col(query_vector).isNotNull()).agg(F.count(F.lit(1)).alias("queries"))
        return n.withColumn("mean_rows", F.try_divide(total.scalar(), F.col("queries")))

    def recall(self, exact: DataFrame, queries: DataFrame, query_id: str, query_vector: str, k: int, probes: int) -> float:
        """Share of the exact hits (query_id, corpus_id) that a search finds."""
        found = self.search(queries, query_id, query_vector, k, probes).select("query_id", "corpus_id")
        hit = exact.select("query_id", "corpus_id").join(found.withColumn("hit", F.lit(1)), ["query_id", "corpus_id"], "left")
        return hit.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 0.0

    def probes_for(self, corpus: DataFrame, id: str, vector: str, queries: DataFrame, query_id: str, query_vector: str, k: int,
                   wanted: float = 0.9) -> int:
        """The fewest probes with the wanted recall on at most TRIAL_QUERIES queries, by bisection; all cells always have it."""
        trial = materialise(queries.where(F.col(query_vector).isNotNull()).orderBy(F.xxhash64(query_id)).limit(TRIAL_QUERIES), "trial")
        exact = materialise(cosine_top_k(trial, corpus, query_id, id, k, query_vector, vector), "trial-hits")
        low, high = 1, self.cells
        while low < high:
            middle = (low + high) // 2
            if self.recall(exact, trial, query_id, query_vector, k, middle) >= wanted:
                high = middle
            else:
                low = middle + 1
        return low
