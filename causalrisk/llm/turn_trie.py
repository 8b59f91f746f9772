"""Prefix trie of conversations by burst tries.

A turn is known by the digest of role and text, so that texts are read once and
never shuffled. Equal conversations are one sequence with a number of copies. A
container holds the suffixes below one trie head. At first all sequences lie in
the container of the root. A container of more than `burst` turns in more than
one sequence bursts by the next turn: its head becomes a node of the spine and
each next turn the head of a smaller container. What remains is dealt to shards
by head, sorted, and swept once per shard: neighbours share their common prefix,
the rest of a suffix opens new nodes. A container with a single sequence of more
than `burst` turns is a chain; its rows are nodes as they are, and the sums along
it are running totals by segments. Totals of the spine are added up from the
deepest level to the root.

So a shard holds at most `burst` turns of one container at a time, and a first
turn shared by any part of all conversations costs one row per sequence and
round. There are as many rounds as turns in the longest prefix that more than
`burst` turns of different sequences share.

The digest of the conversations that end in a node is a SHA-256 over all their
ids and as such sequential; the ids are joined to pieces in many tasks first, and
only the pieces of one node meet in one task, one after the other.

Defined results: turns without a conversation id are left out. Turns are ordered
by number, a null one first, equal numbers by their digest. A null role or text
is an empty one. Repeated rows are turns of their own. Texts of any length count
with all their bytes. A conversation of any length is dealt with by rows. An
empty table has no nodes, not even a root. Only the four named columns are read,
so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from causalrisk.llm.common import bounded_batches, stored
from causalrisk.operators.ordered import SEGMENT, in_segments, running_totals, segment_offsets

#: Turns below one head that a shard may hold at once.
BURST = 10_000

NODES = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends bigint"
_TOP = "above binary"


def _digest(role: Column, text: Column) -> Column:
    """16 bytes that tell a turn by role and text; the length of the role keeps the two apart."""
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


def turn_steps(turns: DataFrame) -> DataFrame:
    """conv_id, depth (from 1 on), turn (its digest) and size (bytes of the text) of every turn in order.

    Depths are counted inside segments of the whole order; a conversation that
    reaches over segments gets the number of its earlier turns added.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    plain = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("at"), _digest(role, text).alias("turn"), F.octet_length(text).cast("long").alias("size"),
    )
    order = [F.col("at").asc_nulls_first(), F.col("turn")]
    segments = in_segments(plain, [F.col("conv_id"), *order])
    earlier = segment_offsets(segments.withColumn("n", F.lit(1).cast("long")), ["conv_id"], ["n"]).where("before_n > 0")
    # one row for each conversation that is cut, so at most one per segment and one per segment of a long one
    inside = W.partitionBy("conv_id", SEGMENT).orderBy(*order)
    numbered = segments.withColumn("depth", F.row_number().over(inside).cast("long")).join(
        F.broadcast(earlier.select("conv_id", SEGMENT, "before_n")), ["conv_id", SEGMENT], "left"
    )
    return stored(numbered.select("conv_id", (F.col("depth") + F.coalesce("before_n", F.lit(0))).alias("depth"), "turn", "size"), "turn_steps")


def with_shared_starts(steps: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Steps in which each conversation takes its first turns from the first one of its group, and all conversations.

    h = crc32 of the decimal id, modulo `most`: the first h turns are those of the
    conversation with the id c - c % group, then follow c's own after its first h.
    """
    c = F.col("conv_id")
    sizes = steps.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = sizes.select("conv_id", (c - c % group).alias("first_id"), (F.crc32(c.cast("string").cast("binary")) % most).alias("h"))
    known = convs.join(sizes.select(c.alias("first_id"), "n"), "first_id", "left")
    convs = stored(known.select("conv_id", "first_id", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("taken")), "conversations")
    firsts = steps.where(F.col("depth") < most).withColumnRenamed("conv_id", "first_id").join(convs.select("conv_id", "first_id", "h"), "first_id")
    firsts = firsts.where("depth <= h").select("conv_id", "depth", "turn", "size")
    own = steps.join(convs.select("conv_id", "h", "taken"), "conv_id").where("depth > h")
    own = own.select("conv_id", (F.col("depth") - F.col("h") + F.col("taken")).alias("depth"), "turn", "size")
    return stored(firsts.unionByName(own), "rebuilt_steps"), convs.select("conv_id")


def _sequences(steps: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Different sequences (conv_id of the first one, n_turns, copies), and (rep, conv_id) of those with copies.

    A sequence is told by its length and two sums of hashes of (depth, turn), which need no order and no gathering.
    """
    marks = steps.groupBy("conv_id").agg(
        F.bit_xor(F.xxhash64("depth", "turn")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "depth", "turn")).alias("b"), F.count("*").alias("n_turns")
    )
    whole = convs.distinct().join(marks, "conv_id", "left").na.fill(0, ["a", "b", "n_turns"])
    whole = stored(whole, "marks")
    sequences = stored(whole.groupBy("a", "b", "n_turns").agg(F.min("conv_id").alias("rep"), F.count("*").alias("copies")), "sequences")
    copied = whole.join(sequences.where("copies > 1"), ["a", "b", "n_turns"]).select("rep", "conv_id")
    return sequences.select(F.col("rep").alias("conv_id"), "n_turns", "copies"), copied


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, first, ids): sorted ids of one sequence joined by commas, one row per run and batch."""
    for batch in batches:
        rep, ids = batch.column("rep").to_numpy(), batch.column("conv_id").to_pylist()
        cut = [0, *(np.flatnonzero(rep[1:] != rep[:-1]) + 1).tolist(), len(rep)] if len(rep) else [0]
        runs = list(zip(cut, cut[1:], strict=False))
        columns = [pa.array([int(rep[a]) for a, _ in runs], pa.int64()), pa.array([ids[a] for a, _ in runs], pa.int64())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([",".join(map(str, ids[a:b])) for a, b in runs], pa.string())], names=["rep", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, ends_sha256) from sorted pieces, which go through the hash one after the other."""
    now, state = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["rep", "ends_sha256"])

    for batch in batches:
        for rep, ids in zip(batch.column("rep").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if rep != now:
                if state is not None:
                    yield out()
                now, state = rep, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
    if state is not None:
        yield out()


def _ends(copied: DataFrame) -> DataFrame:
    """(rep, ends_sha256) of the sequences with copies."""
    pieces = copied.repartitionByRange("rep", "conv_id").sortWithinPartitions("rep", "conv_id").mapInArrow(_pieces, "rep bigint, first bigint, ids string")
    return pieces.repartition("rep").sortWithinPartitions("rep", "first").mapInArrow(_hashed, "rep bigint, ends_sha256 string")


def _burst(sequences: DataFrame, steps: DataFrame, burst: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """The spine's levels from the root on, and the sequences of the containers that stay, by round.

    A sequence carries its head, the head's depth, the bytes of the head's last
    turn, and the head above with its smallest conversation.
    """
    root = sequences.withColumns({
        "head": F.lit(b"").cast("binary"), "depth": F.lit(0).cast("long"), "size": F.lit(0).cast("long"),
        "above": F.lit(None).cast("binary"), "above_conv": F.lit(None).cast("long"),
    })
    inside, spine, kept, depth = root, [], [], 0
    while True:
        here = inside.groupBy("head").agg(
            F.sum(F.col("n_turns") - depth).alias("turns"), F.count("*").alias("sequences"), F.min("conv_id").alias("conv"), F.sum("copies").alias("n_convs"),
            F.min("size").alias("size"), F.min("above").alias("above"), F.min("above_conv").alias("above_conv"),
            F.min(F.when(F.col("n_turns") == depth, F.col("conv_id"))).alias("ends"),
        )
        over = stored(here.where((F.col("turns") > burst) & (F.col("sequences") > 1)).withColumn("depth", F.lit(depth).cast("long")), "spine")
        kept.append(inside.join(over.select("head"), "head", "left_anti"))
        if over.isEmpty():
            return spine, kept
        spine.append(over)
        down = inside.where(F.col("n_turns") > depth).join(over.select("head", "conv"), "head")
        down = down.select("conv_id", "n_turns", "copies", F.col("head").alias("above"), F.col("conv").alias("above_conv"))
        depth += 1
        down = down.join(steps.where(F.col("depth") == depth).select("conv_id", "turn", "size"), "conv_id")
        inside = stored(down.select(
            "conv_id", "n_turns", "copies", F.unhex(F.md5(F.concat("above", "turn"))).alias("head"), F.lit(depth).cast("long").alias("depth"), "size", "above", "above_conv",
        ), "containers")


def _swept(rows: list[dict]) -> list[tuple]:
    """Nodes of one container from its sorted suffixes, as rows of NODES and _TOP."""
    first = rows[0]
    # per node: depth, parent's place, bytes of the last turn, smallest conversation, conversations, children, leaves, saved, sequence that ends here
    nodes = [[first["depth"], None, first["size"], first["conv_id"], 0, 0, 0, 0, None]]
    path, before = [0], []
    for r in rows:
        turns, conv, copies = r["turns"], r["conv_id"], r["copies"]
        k = 0
        while k < len(before) and k < len(turns) and before[k] == turns[k]:
            k += 1
        del path[k + 1 :]
        for size in r["sizes"][k:]:
            nodes[path[-1]][5] += 1
            nodes.append([nodes[path[-1]][0] + 1, path[-1], size, conv, 0, 0, 0, 0, None])
            path.append(len(nodes) - 1)
        for at in path:
            node = nodes[at]
            node[3] = min(node[3], conv)
            node[4] += copies
        nodes[path[-1]][8] = conv
        before = turns
    out = []
    for node in reversed(nodes):
        depth, parent, size, conv, n, children, _, _, ends = node
        node[6] += not children
        node[7] += (n - 1) * size
        if parent is not None:
            nodes[parent][6] += node[6]
            nodes[parent][7] += node[7]
        above = first["above_conv"] if parent is None else nodes[parent][3]
        out.append((conv, depth, above, n, children, node[6], node[7], ends, first["above"] if parent is None else None))
    return out


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of all containers of a shard; a container is held until its last suffix."""
    kinds = [pa.int64()] * 8 + [pa.binary()]
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "above"]

    def table(nodes: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*nodes, strict=True), kinds, strict=True)], names=names)

    held: list[dict] = []
    for batch in batches:
        done: list[tuple] = []
        for row in batch.to_pylist():
            if held and row["head"] != held[0]["head"]:
                done += _swept(held)
                held = []
            held.append(row)
        if done:
            yield table(done)
    if held:
        yield table(_swept(held))


def _containers(kept: list[DataFrame], steps: DataFrame, burst: int) -> tuple[DataFrame, DataFrame]:
    """Rows of all sequences outside the spine: short ones with their suffix (turns and sizes), long ones alone in their container as they are."""
    members = kept[0]
    for more in kept[1:]:
        members = members.unionByName(more)
    members = stored(members, "kept_containers")
    rest = F.col("n_turns") - F.col("depth")
    short = members.where(rest <= burst)
    rows = short.join(steps.select("conv_id", F.struct(F.col("depth").alias("d"), "turn", F.col("size").alias("s")).alias("step")), "conv_id", "left")
    # a row with nothing below its head stays, with an empty suffix
    below = F.when(F.col("step.d") > F.col("depth"), F.col("step"))
    suffix = F.array_sort(F.collect_list(below))
    rows = rows.groupBy(*short.columns).agg(suffix.alias("suffix"))
    rows = rows.withColumns({"turns": F.col("suffix.turn"), "sizes": F.col("suffix.s")}).drop("suffix", "n_turns")
    return rows, members.where(rest > burst)


def _chains(chains: DataFrame, steps: DataFrame) -> DataFrame:
    """Nodes of long sequences that are alone in their container: one per turn, and the head."""
    rows = chains.select("conv_id", "copies", "n_turns", F.col("depth").alias("top"), F.col("size").alias("top_size"), "above", "above_conv")
    below = steps.join(rows.select("conv_id", "top"), "conv_id").where("depth > top")
    sums = running_totals(below, "depth", {"size": F.col("size")}, by=("conv_id",), descending=True)
    nodes = sums.join(rows, "conv_id").select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.col("copies").alias("n_convs"), (F.col("depth") < F.col("n_turns")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), ((F.col("copies") - 1) * F.col("cum_size")).alias("saved_tokens"),
        F.when(F.col("depth") == F.col("n_turns"), F.col("conv_id")).alias("ends"), F.lit(None).cast("binary").alias("above"),
    )
    total = sums.groupBy("conv_id").agg(F.max("tot_size").alias("total"))
    heads = rows.join(total, "conv_id").select(
        "conv_id", F.col("top").alias("depth"), F.col("above_conv").alias("parent_conv_id"), F.col("copies").alias("n_convs"), F.lit(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), ((F.col("copies") - 1) * (F.col("total") + F.col("top_size"))).alias("saved_tokens"), F.lit(None).cast("long").alias("ends"), "above",
    )
    return nodes.unionByName(heads)


def trie_nodes(steps: DataFrame, convs: DataFrame, burst: int = BURST) -> DataFrame:
    """All nodes of the trie of the sequences in `steps` (conv_id, depth, turn, size); `convs` also names conversations without turns.

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (bytes that members share with the first one, over the
    subtree) and ends_sha256 (of the ids of the members that end in the node).
    """
    bounded_batches(steps.sparkSession)
    sequences, copied = _sequences(steps, convs)
    spine, kept = _burst(sequences, steps, burst)
    rows, chains = _containers(kept, steps, burst)
    shards = rows.repartition("head").sortWithinPartitions("head", "turns")
    nodes = shards.mapInArrow(_sweep, f"{NODES}, {_TOP}")
    if not chains.isEmpty():
        nodes = nodes.unionByName(_chains(chains, steps))
    nodes = stored(nodes, "trie_nodes")
    sums = [F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens", "n_children")]
    below = nodes.where("above is not null").select("above", "n_leaves", "saved_tokens", F.lit(1).cast("long").alias("n_children"))
    parts, lower = [nodes.drop("above")], None
    for level in reversed(spine):
        under = below if lower is None else below.unionByName(lower.select("above", "n_leaves", "saved_tokens", F.lit(1).cast("long").alias("n_children")))
        under = under.groupBy(F.col("above").alias("head")).agg(*sums)
        own = (F.col("n_convs") - 1) * F.col("size")
        lower = stored(level.join(under, "head").select(
            F.col("conv").alias("conv_id"), "depth", F.col("above_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
            (F.col("saved_tokens") + own).alias("saved_tokens"), "ends", "above",
        ), "spine_totals")
        parts.append(lower.drop("above"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    hashed = out.join(_ends(copied).withColumnRenamed("rep", "ends"), "ends", "left")
    own = F.sha2(F.coalesce(F.col("ends").cast("string"), F.lit("")), 256)
    return hashed.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", own).alias("ends_sha256"),
    )


def conversation_trie(turns: DataFrame, burst: int = BURST) -> DataFrame:
    """The trie of a table of turns (conv_id, turn, role, text) as it is."""
    steps = turn_steps(turns)
    return trie_nodes(steps, steps.select("conv_id"), burst)
