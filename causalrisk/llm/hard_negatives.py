"""Hard negatives by exact integer scores: residue matrices multiplied in float32, put together by Chinese remainders.

Components become whole numbers, floor(scale * x). Rows are packed into blocks
of at most BLOCK_BYTES, anchors too. A tile is a block of anchors with a block
of rows. In it both matrices are taken modulo several small primes, multiplied
in float32 (residues are centred and below 256, so every partial sum of up to
DEPTH products is a whole number below 2**24 and exact), and the scores are
rebuilt from their residues. The number of primes follows from the longest
vectors of the two blocks, by Cauchy and Schwarz.

A first pass over all tiles finds each anchor's positives, a second one its
negatives inside the window that each positive's score sets. A tile passes on
the best k per anchor (and positive), windows over all tiles choose among them.
Blocks of anchors meet blocks of rows by an equal join on the anchors' block
number. Spark broadcasts the anchors' blocks where their size allows it and
shuffles both sides elsewhere; a row is then moved once per block of anchors,
while the products per moved byte grow with the block.

Defined results: rows with a null label, a null vector, or a null, NaN or
infinite component take no part, nor do rows whose squared length after scaling
is above LONGEST, whose scores might not fit a long. Vectors of different
lengths: the shorter one is filled up with zeros. An empty vector scores zero.
Ties go to the smaller id, a null id comes last. Repeated rows are rows of their
own; rows with the anchor's id are no positives of it; an anchor that repeats
has its result once for each time. Fewer rows than asked for: all. Empty tables
and tables without anchors give no rows. Only the three named columns are read,
so others may have any name; texts are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from causalrisk.llm.common import bounded_batches, stored

#: The largest primes below 512.
PRIMES = (509, 503, 499, 491, 487, 479, 467)
#: Products of two centred residues that float32 adds without rounding.
DEPTH = 2**24 // 254**2
#: Squared length up to which all scores lie in the range of all primes.
LONGEST = (prod(PRIMES) - 1) // 2
#: Bytes of a block's matrix of 4-byte components, and scores of a tile held at once.
BLOCK_BYTES, SCORES = 2_000_000, 2_000_000

_BLOCK = "ids array<bigint>, labels array<bigint>, width int, longest double, matrix binary"
_NO_ID = np.iinfo(np.int64).max


def _centred(values: np.ndarray, p: int) -> np.ndarray:
    """Residues from -(p - 1) / 2 to (p - 1) / 2, as float32."""
    rest = np.mod(values, p)
    rest[rest > p // 2] -= p
    return rest.astype(np.float32)


def _product_modulo(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """Products of all rows of a with all rows of b modulo p, from 0 to p - 1."""
    a, b = _centred(a, p), _centred(b, p)
    total = np.zeros((len(a), len(b)), dtype=np.int64)
    for k in range(0, max(a.shape[1], 1), DEPTH):
        total += (a[:, k : k + DEPTH] @ b[:, k : k + DEPTH].T).astype(np.int64)
    return np.mod(total, p)


def exact_scores(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Inner products of all rows of two integer matrices, exact if none is beyond `bound` in size.

    Mixed radix digits of the remainders: each prime adds the digit that its
    residue still lacks; values in the upper half of the range are negative.
    """
    scores, radix = np.zeros((len(a), len(b)), dtype=np.int64), 1
    for p in PRIMES:
        digit = _product_modulo(a, b, p) - np.mod(scores, p)
        scores += np.mod(digit * pow(radix, -1, p), p) * radix
        radix *= p
        if radix > 2.001 * bound + 2:
            break
    scores[scores > radix // 2] -= radix
    return scores


def _whole(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """floor(scale * x) of lists of numbers as a matrix filled up with zeros, each squared length, and which rows stay in range."""
    width = np.diff(column.offsets.to_numpy())
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    out = np.zeros((len(width), int(width.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < width[:, None]] = values
    with np.errstate(over="ignore"):
        squared = (out * out).sum(axis=1)
    fits = squared <= LONGEST * 0.999999
    out[~fits] = 0
    return out.astype(np.int32), squared, fits


def _pack(scale: int):
    """Blocks of rows in the order of their ids from rows (id, label, vector)."""

    def block(parts: list[tuple]) -> pa.RecordBatch:
        width = max(p[2].shape[1] for p in parts)
        ids, labels, squared = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 3))
        order = np.argsort(ids, kind="stable")
        matrix = np.concatenate([np.pad(p[2], ((0, 0), (0, width - p[2].shape[1]))) for p in parts])[order]
        named = pa.array(ids[order], mask=ids[order] == _NO_ID)
        columns = [pa.array([named], pa.list_(pa.int64())), pa.array([labels[order]], pa.list_(pa.int64()))]
        columns += [pa.array([width], pa.int32()), pa.array([float(squared.max())]), pa.array([matrix.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["ids", "labels", "width", "longest", "matrix"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            vectors = batch.column("vector")
            step = max(1, BLOCK_BYTES // 4 // max(1, int(np.diff(vectors.offsets.to_numpy()).max(initial=1))))
            for k in range(0, len(vectors), step):
                matrix, squared, fits = _whole(vectors.slice(k, step), scale)
                ids = batch.column("id").slice(k, step).fill_null(_NO_ID).to_numpy()
                if held and held + matrix.nbytes > BLOCK_BYTES:
                    yield block(parts)
                    parts, held = [], 0
                if fits.any():
                    parts.append((ids[fits], batch.column("label").slice(k, step).to_numpy()[fits], matrix[fits], squared[fits]))
                    held += matrix.nbytes
        if parts:
            yield block(parts)

    return run


class _Side:
    """One block of a tile: ids (null as the largest), labels and the matrix."""

    def __init__(self, row: dict, name: str):
        self.ids = np.array([_NO_ID if i is None else i for i in row[f"{name}ids"]], dtype=np.int64)
        self.labels = np.array(row[f"{name}labels"], dtype=np.int64)
        self.matrix = np.frombuffer(row[f"{name}matrix"], dtype=np.int32).reshape(len(self.ids), row[f"{name}width"])
        self.longest = row[f"{name}longest"]


def _slices(row: dict) -> Iterator[tuple[_Side, _Side, int, np.ndarray]]:
    """The anchors' side, the rows' side, and scores of all anchors with a run of rows from a place on."""
    a, b = _Side(row, "a_"), _Side(row, "")
    width = max(a.matrix.shape[1], b.matrix.shape[1])
    left, right = (np.pad(s.matrix, ((0, 0), (0, width - s.matrix.shape[1]))) for s in (a, b))
    step = max(1, SCORES // len(left))
    for k in range(0, len(right), step):
        yield a, b, k, exact_scores(left, right[k : k + step], (a.longest * b.longest) ** 0.5)


def _best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the places of the k highest allowed scores; of equal ones the first places."""
    if scores.shape[1] > k:
        masked = np.where(allowed, scores, np.iinfo(np.int64).min)
        allowed = allowed & (scores >= np.partition(masked, -k, axis=1)[:, -k][:, None])
    row, place = np.nonzero(allowed)
    order = np.lexsort((place, -scores[row, place], row))
    row, place = row[order], place[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], place[rank < k]


def _ids(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values == _NO_ID)


def _positives(k: int):
    """(block, place, anchor_id, positive_id, positive_score): the best k rows of the anchor's label, per anchor and tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for a, b, at, scores in _slices(row):
                    ids = b.ids[at : at + scores.shape[1]]
                    allowed = (a.labels[:, None] == b.labels[None, at : at + len(ids)]) & (a.ids[:, None] != ids[None, :])
                    i, j = _best(scores, allowed, k)
                    columns = [pa.array(np.full(len(i), row["block"])), pa.array(i, pa.int32()), _ids(a.ids[i]), _ids(ids[j]), pa.array(scores[i, j])]
                    yield pa.RecordBatch.from_arrays(columns, names=["block", "place", "anchor_id", "positive_id", "positive_score"])

    return run


def _share(score: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """score * percent / 100 rounded up or down, without leaving 64 bits."""
    whole, rest = np.divmod(score, 100)
    part = rest * percent
    return whole * percent + (-(-part // 100) if up else part // 100)


def _negatives(k: int, low: int, high: int):
    """(block, place, nth, anchor_id, positive_id, positive_score, negative_id, negative_score): the best k rows of other labels in each positive's window, per tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                wanted = row["wanted"]
                place, nth = (np.array([w[c] for w in wanted], dtype=np.int64) for c in ("place", "nth"))
                score = np.array([w["positive_score"] for w in wanted], dtype=np.int64)
                positive = np.array([_NO_ID if w["positive_id"] is None else w["positive_id"] for w in wanted], dtype=np.int64)
                least, most = _share(score, low, True), _share(score, high, False)
                for a, b, at, scores in _slices(row):
                    ids = b.ids[at : at + scores.shape[1]]
                    other = a.labels[:, None] != b.labels[None, at : at + len(ids)]
                    for n in np.unique(nth):
                        of = np.flatnonzero(nth == n)
                        own = scores[place[of]]
                        i, j = _best(own, other[place[of]] & (own >= least[of, None]) & (own <= most[of, None]), k)
                        w = of[i]
                        columns = [pa.array(np.full(len(i), row["block"])), pa.array(place[w], pa.int32()), pa.array(nth[w], pa.int32()), _ids(a.ids[place[w]])]
                        columns += [_ids(positive[w]), pa.array(score[w]), _ids(ids[j]), pa.array(own[i, j])]
                        names = ["block", "place", "nth", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
                        yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _ranked(df: DataFrame, by: list[str], score: str, name: str, rank: str, k: int) -> DataFrame:
    """The k first rows of each group by score, higher ones first, then by id."""
    order = W.partitionBy(*by).orderBy(F.col(score).desc(), F.col(name).asc_nulls_last())
    return df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def mine_negatives(
    rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
    names: tuple[str, str, str] = ("vec_id", "label", "embedding"),
) -> DataFrame:
    """Per anchor and positive the first rows of other labels that score `low` to `high` percent of the positive.

    rows: id, label (whole numbers) and vector, named by `names`; `is_anchor` is
    a condition on them. Returns anchor_id, positive_id, positive_score,
    negative_id, negative_score and rank (from 1).
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    vector = F.col(names[2])
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    whole = rows.where(F.col(names[1]).isNotNull() & vector.isNotNull() & finite)

    def blocks(df: DataFrame) -> DataFrame:
        plain = df.select(F.col(names[0]).cast("long").alias("id"), F.col(names[1]).cast("long").alias("label"), vector.alias("vector"))
        return plain.mapInArrow(_pack(scale), _BLOCK)

    anchors = blocks(whole.where(is_anchor)).select(*[F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "width", "longest", "matrix")])
    anchors = stored(anchors.withColumn("block", F.monotonically_increasing_id()), "anchor_blocks")
    # one number per block of anchors, of which each holds BLOCK_BYTES or ends its partition
    numbers = sorted(r.block for r in anchors.select("block").collect())
    tiles = blocks(whole).withColumn("block", F.explode(F.lit(numbers).cast("array<bigint>")))
    found = tiles.join(anchors, "block").mapInArrow(
        _positives(n_positives), "block bigint, place int, anchor_id bigint, positive_id bigint, positive_score bigint"
    )
    positives = _ranked(found, ["block", "place"], "positive_score", "positive_id", "nth", n_positives)
    wanted = positives.groupBy("block").agg(F.collect_list(F.struct("place", "nth", "positive_id", "positive_score")).alias("wanted"))
    asked = stored(anchors.join(wanted, "block"), "asked_blocks")
    found = tiles.join(asked, "block").mapInArrow(
        _negatives(n_negatives, low, high),
        "block bigint, place int, nth int, anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint",
    )
    return _ranked(found, ["block", "place", "nth"], "negative_score", "negative_id", "rank", n_negatives).drop("block", "place", "nth")
