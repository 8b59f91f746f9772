"""Sharding by a k-d tree: nodes split at weighted medians along their widest metadata dimension.

The rows are read once into a narrow table (id, size, coordinates, hashes).
A level of the tree is a few aggregations over that table, for all its nodes at
once: one for the widths, then histograms of at most BINS bins per node that
close in on the weighted median. Only one row per node reaches the driver, and
the number of nodes is bounded by MAX_SHARDS, so the split points can be
broadcast. A split orders rows by coordinate, then text hash, then id hash: any
run of equal coordinates can be cut, and equal texts with equal metadata stay
together unless a cut must pass through them. A hot value or a hot text is
therefore no obstacle to even shards.

Defined results: null texts have no bytes; null metadata have coordinate 0.
Rows that agree in text, metadata and id can't be told apart and share a
shard. An empty table has no shards. Shards may be empty only if there are
fewer distinct rows than shards. Dimensions of equal width: the first one is cut.
A text of any length counts with all its bytes; one that outweighs a shard makes
its shard as heavy as itself. `kd_shards` reads the named columns only;
`shard_documents` keeps columns of any name but that of its label.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from causalrisk.llm.common import stored

#: Bins of a histogram, bound of the number of shards, share of a shard's bytes by which a cut may be off.
BINS, MAX_SHARDS, TOLERANCE = 4096, 100_000, 0.0005
#: Rows of a shard that are numbered in one task, on average.
SLOT_ROWS = 8192

DIMENSIONS = ("lang", "source", "size")


def name_coordinate(value: Column) -> Column:
    """16 bits of a hash: equal names are neighbours, and any number of names has a place."""
    return F.coalesce(F.shiftright(F.crc32(value.cast("string").cast("binary")), 16), F.lit(0)).cast("long")


def size_coordinate(size: Column) -> Column:
    """16 bits of the logarithm."""
    return F.least(F.floor(F.log2(size.cast("double")) * 1024), F.lit(65535)).cast("long")


@dataclass
class Node:
    number: int
    leaves: int
    first: int  # number of the first leaf below
    dimension: int = 0
    cut1: int = 0
    cut2: int = 0


def placed(docs: DataFrame, names: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Adds `_size`, `_crc`, `_c` (coordinates), `_h` (47 bits of the text's hash) and `_id` (hash of the id)."""
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 8).cast("long")
    return docs.withColumns({
        "_size": size, "_crc": F.crc32(text.cast("binary")),
        "_c": F.array(*[name_coordinate(F.col(f"`{c}`")) for c in names], size_coordinate(size)),
        "_h": F.shiftrightunsigned(F.xxhash64(text), 17), "_id": F.xxhash64("doc_id"),
    })


def _params(spark, nodes: list[Node]) -> DataFrame:
    return F.broadcast(spark.createDataFrame(
        [(n.number, n.leaves == 1, n.dimension, n.cut1, n.cut2, n.first) for n in nodes],
        "_node long, _leaf boolean, _dim int, _cut1 long, _cut2 long, _shard int",
    ))


def _key(dim: str = "_dim") -> Column:
    return F.shiftleft(F.get(F.col("_c"), F.col(dim)), 47).bitwiseOR(F.col("_h"))


def one_step(rows: DataFrame, nodes: list[Node]) -> DataFrame:
    """`_node` one level further down, unless it is a leaf."""
    down = (_key() > F.col("_cut1")) | ((_key() == F.col("_cut1")) & (F.col("_id") > F.col("_cut2")))
    rows = rows.join(_params(rows.sparkSession, nodes), "_node")
    rows = rows.withColumn("_node", F.when(F.col("_leaf"), F.col("_node")).otherwise(F.col("_node") * 2 + down.cast("long")))
    return rows.drop("_leaf", "_dim", "_cut1", "_cut2", "_shard")


def assigned(rows: DataFrame, levels: list[list[Node]]) -> DataFrame:
    """Adds `_node`: each level sends a row down one step, until it is in a leaf."""
    rows = rows.withColumn("_node", F.lit(1).cast("long"))
    for nodes in levels:
        rows = one_step(rows, nodes)
    return rows


def _widths(rows: DataFrame, dims: int) -> dict[int, tuple]:
    ends = [f(F.get(F.col("_c"), F.lit(d))).alias(f"{name}{d}") for d in range(dims) for name, f in (("a", F.min), ("b", F.max))]
    return {r._node: r for r in rows.groupBy("_node").agg(F.sum("_size").alias("bytes"), *ends).collect()}


def _crossing(rows: DataFrame, search: dict[int, tuple[int, int, float, float]]) -> dict[int, tuple]:
    """Per node: the bin of `_k` between low and high in which the running bytes reach the target."""
    spark = rows.sparkSession
    table = F.broadcast(spark.createDataFrame(
        [(node, low, high, float(base), float(target)) for node, (low, high, base, target) in search.items()],
        "_node long, _low long, _high long, _base double, _target double",
    ))
    inside = rows.join(table, "_node").where("_k between _low and _high")
    share = (F.col("_k").cast("decimal(20,0)") - F.col("_low")) * BINS / (F.col("_high").cast("decimal(20,0)") - F.col("_low") + 1)
    bins = inside.groupBy("_node", F.floor(share).cast("int").alias("_bin"), "_base", "_target").agg(
        F.sum("_size").alias("bytes"), F.min("_k").alias("low"), F.max("_k").alias("high"),
    )
    after = F.col("_base") + F.sum("bytes").over(W.partitionBy("_node").orderBy("_bin"))
    reached = bins.withColumn("after", after).where("after >= _target")
    first = reached.groupBy("_node").agg(F.min_by(F.struct("low", "high", "bytes", "after"), "_bin").alias("bin")).select("_node", "bin.*")
    return {r._node: (r.low, r.high, r.after - r.bytes, float(r.bytes)) for r in first.collect()}


def _split(rows: DataFrame, nodes: list[Node], goals: dict[int, float], slack: float) -> None:
    """Set the cuts: rows whose (key, id hash) is at most (cut1, cut2) go left."""
    spark = rows.sparkSession
    dims = F.broadcast(spark.createDataFrame([(n.number, n.dimension) for n in nodes], "_node long, _dim int"))
    keyed = rows.join(dims, "_node").withColumn("_k", _key())
    low, high = -(1 << 63), (1 << 63) - 1
    by = {n.number: n for n in nodes}
    search = {n.number: (0, high, 0.0, goals[n.number]) for n in nodes}
    final: dict[int, tuple[int, int, float, float]] = {}
    same: dict[int, tuple[int, float]] = {}
    while search:
        found, search = _crossing(keyed, search), {}
        for node, (a, b, base, size) in found.items():
            if size <= slack:
                final[node] = (a, b, base, size)
            elif a == b:
                same[node] = (a, base)
            else:
                search[node] = (a, b, base, goals[node])
    for node, (a, b, base, size) in final.items():
        take = base + size - goals[node] <= goals[node] - base
        by[node].cut1, by[node].cut2 = (b, high) if take else (a - 1, high)
    if same:
        one = F.broadcast(spark.createDataFrame([(k, v[0]) for k, v in same.items()], "_node long, _only long"))
        equal = keyed.join(one, "_node").where("_k = _only").drop("_k", "_only").withColumn("_k", F.col("_id"))
        search = {k: (low, high, v[1], goals[k]) for k, v in same.items()}
        while search:
            found, search = _crossing(equal, search), {}
            for node, (a, b, base, size) in found.items():
                if size <= slack or a == b:
                    take = base + size - goals[node] <= goals[node] - base
                    by[node].cut1 = same[node][0]
                    by[node].cut2 = b if take else max(a - 1, low)
                else:
                    search[node] = (a, b, base, goals[node])


def tree(rows: DataFrame, shards: int | None = None, target_bytes: int | None = None, dims: int = 3) -> list[list[Node]]:
    """Levels of the tree over a stored table of `placed` rows; give the number of shards or their bytes."""
    total = rows.agg(F.sum("_size")).first()[0] or 0
    shards = shards or max(1, -(-total // target_bytes))
    if shards > MAX_SHARDS:
        raise ValueError(f"{shards} shards are more than {MAX_SHARDS}")
    levels: list[list[Node]] = []
    nodes = [Node(1, shards, 0)] if total else []
    now = rows.withColumn("_node", F.lit(1).cast("long"))
    while any(n.leaves > 1 for n in nodes):
        if levels:
            # each level is read by several searches; written, it doesn't repeat the steps that lead to it
            now = stored(one_step(now, levels[-1]), "level")
        ends = _widths(now, dims)
        open_nodes = [n for n in nodes if n.leaves > 1 and n.number in ends]
        goals = {}
        for n in open_nodes:
            r = ends[n.number]
            n.dimension = max(range(dims), key=lambda d: (r[f"b{d}"] - r[f"a{d}"], -d))
            goals[n.number] = r.bytes * (n.leaves // 2) / n.leaves
        if open_nodes:
            _split(now, open_nodes, goals, TOLERANCE * total / shards)
        levels.append(nodes)
        below = []
        for n in nodes:
            if n.leaves == 1:
                below.append(n)
            else:
                half = n.leaves // 2
                below += [Node(2 * n.number, half, n.first), Node(2 * n.number + 1, n.leaves - half, n.first + half)]
        nodes = below
    return [*levels, nodes] if nodes else []


def with_shard(rows: DataFrame, levels: list[list[Node]]) -> DataFrame:
    """Adds `_shard` to `placed` rows; the leaves are numbered from the left."""
    if not levels:
        return rows.withColumn("_shard", F.lit(0))
    leaf = _params(rows.sparkSession, levels[-1]).select("_node", "_shard")
    return assigned(rows, levels[:-1]).join(leaf, "_node").drop("_node")


def with_slot(rows: DataFrame) -> DataFrame:
    """Adds `_slot`, the place in the shard from 0, by runs of the id hash that are numbered on their own."""
    per_shard = rows.groupBy("_shard").count().agg(F.max("count")).first()[0] or 0
    bits = max(0, int(per_shard // SLOT_ROWS).bit_length())
    run = F.shiftrightunsigned(F.col("_id"), 64 - bits) if bits else F.lit(0).cast("long")
    rows = rows.withColumn("_run", run)
    sizes = rows.groupBy("_shard", "_run").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_shard").orderBy("_run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_shard", "_run", before.alias("_before"))
    place = F.row_number().over(W.partitionBy("_shard", "_run").orderBy("_id", "doc_id", "_h"))
    return rows.withColumn("_place", place).join(starts, ["_shard", "_run"]).withColumn("_slot", F.col("_before") + F.col("_place") - 1)


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """Per document (`doc_id`, `text`, `lang`, `source`): doc_id, size, text_crc32, shard and slot."""
    rows = stored(placed(docs.select("doc_id", "text", "lang", "source")).select("doc_id", "_size", "_crc", "_c", "_h", "_id"), "placed")
    cut = with_slot(with_shard(rows, tree(rows, shards, target_bytes)))
    return cut.select(
        "doc_id", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.col("_shard").cast("int").alias("shard"),
        F.col("_slot").cast("long").alias("slot"),
    )


def shard_documents(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, label: str = "shard") -> DataFrame:
    """The documents with their shard as column `label`; texts are neither shuffled nor stored."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text", "lang", "source")
    narrow = stored(placed(rows).select("doc_id", "_size", "_c", "_h", "_id"), "placed")
    return with_shard(placed(rows), tree(narrow, shards, target_bytes)).select("_row.*", F.col("_shard").cast("int").alias(label))
