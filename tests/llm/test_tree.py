"""The k-d tree against a plain walk: every node is split along its widest dimension, in order, at the weighted median."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from causalrisk.llm.shards import TOLERANCE, placed, tree, with_shard
from tests.llm.cases import prose


@pytest.mark.parametrize("shards", [2, 7, 24])
def test_nodes_are_split_at_the_weighted_median_of_the_widest_dimension(spark, shards):
    draw = random.Random(shards)
    rows = [(i, prose(i, draw.choice([3, 20, 200])) if i % 4 else "hot text " * 9, draw.choice(["en", "de", "fr", None]), f"src{min(i % 9, 4)}") for i in range(2500)]
    rows += [(5000 + i, "same " * 30, "en", "src0") for i in range(400)] + [(9000, prose(1, 5000), "es", None), (9001, None, None, None)]
    df = placed(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)).select("doc_id", "_size", "_c", "_h", "_id").cache()
    levels = tree(df, shards)
    nodes = {n.number: n for level in levels for n in level}
    held = defaultdict(list)
    held[1] = [(r["_size"], list(r["_c"]), r["_h"], r["_id"], r.doc_id) for r in df.collect()]
    total = sum(r[0] for r in held[1])
    leaves = {}
    for number in sorted(nodes):
        node, own = nodes[number], held[number]
        if node.leaves == 1:
            leaves |= {r[4]: node.first for r in own}
            continue
        width = [max(r[1][d] for r in own) - min(r[1][d] for r in own) for d in range(3)]
        assert node.dimension == width.index(max(width))
        key = lambda r: ((r[1][node.dimension] << 47) | r[2], r[3])  # noqa: E731, B023
        left = [r for r in own if key(r) <= (node.cut1, node.cut2)]
        right = [r for r in own if key(r) > (node.cut1, node.cut2)]
        goal = sum(r[0] for r in own) * (node.leaves // 2) / node.leaves
        steps = defaultdict(int)
        for r in own:
            steps[key(r)] += r[0]
        # no other cut between different rows is nearer by more than the tolerance
        off, running, nearest = abs(sum(r[0] for r in left) - goal), 0, goal
        for k in sorted(steps):
            running += steps[k]
            nearest = min(nearest, abs(running - goal))
        assert off <= nearest + TOLERANCE * total / shards + 1e-6
        held[2 * number], held[2 * number + 1] = left, right
    assert {r.doc_id: r["_shard"] for r in with_shard(df, levels).collect()} == leaves and set(leaves.values()) == set(range(shards))
