"""The printed order of a cluster tree against a recursive walk."""

from __future__ import annotations

import random

import pytest

from scholarium.operators import hierarchy as hi

TREE = "trial_id int, parent_cluster_id long, child_cluster_id long, lambda_val double, child_size int"


def walked(edges: list[tuple]) -> list[tuple]:
    """(cluster, place, depth, clusters below and itself), node by node."""
    below: dict[int, list] = {}
    for p, c, size in edges:
        below.setdefault(p, []).append((-(size or 0), c))
    tops = sorted(set(below) - {c for _, c, _ in edges})
    out, stack = [], [(0, t) for t in reversed(tops)]
    while stack:
        depth, node = stack.pop()
        out.append([node, len(out) + 1, depth, 1])
        stack += [(depth + 1, c) for _, c in sorted(below.get(node, []), reverse=True)]
    for i, row in enumerate(out):
        row[3] = next((j for j in range(i + 1, len(out)) if out[j][2] <= row[2]), len(out)) - i
    return [tuple(r) for r in out]


def run(spark, edges) -> list[tuple]:
    rows = [(1, p, c, 0.5, s) for p, c, s in edges] + [(2, 7, 8, 0.1, 3)]
    return [tuple(r) for r in hi.preorder(spark.createDataFrame(rows, TREE), 1).orderBy("place").collect()]


def test_preorder_of_a_random_forest(spark):
    rng = random.Random(3)
    edges = [(rng.choice([*range(i), 1000, 1001]) if i else 1000, i, rng.choice([None, 1, 2, 5])) for i in range(60)]
    edges += [(5, 200 + i, 1) for i in range(60)] + edges[:4]
    assert run(spark, edges) == walked(list(dict.fromkeys(edges)))


def test_preorder_of_a_chain_and_of_nothing(spark):
    chain = [(i, i + 1, 90 - i) for i in range(70)]
    assert run(spark, chain) == walked(chain)
    assert run(spark, []) == []


def test_what_is_no_tree_is_an_error(spark):
    with pytest.raises(ValueError, match="several parents"):
        run(spark, [(0, 1, 2), (2, 3, 2), (3, 2, 2), (1, 2, 1)])
    with pytest.raises(ValueError, match="below itself"):
        run(spark, [(0, 1, 2), (0, 6, 2), (2, 3, 2), (3, 2, 2)])


def test_printed_tree(spark):
    tree = spark.createDataFrame([(1, 0, 2, 0.1, 4), (1, 0, 1, 0.1, 9), (1, 1, 5, 0.2, 3)], TREE)
    sizes = spark.createDataFrame([(1, 9), (5, 3)], "cluster_id long, size long")
    words = spark.createDataFrame([(1, "a, b")], "cluster_id long, keywords string")
    rows = hi.printed_tree(tree, 1, sizes, words, max_depth=2).orderBy("place").collect()
    assert [(r["line"], r["keywords"]) for r in rows] == [
        ("Cluster 0 (0 papers)", None), ("  Cluster 1 (9 papers)", "  Keywords: a, b"), ("  Cluster 2 (0 papers)", None)
    ]
    nodes = spark.createDataFrame([(1, 9), (2, 0), (5, 3), (6, 8)], "cluster_id long, size long")
    assert {r["cluster_id"]: r["text"] for r in hi.network_labels(nodes, words).collect()} == {1: "a, b", 2: "", 5: None, 6: None}
