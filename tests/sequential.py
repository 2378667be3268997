"""Condensed tree and leaf selection, one edge after the other: what the distributed steps are held against."""

from __future__ import annotations

import numpy as np
import pandas as pd


class Sets:
    """Union-find with sizes."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        root = x
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root


def condense_task(batches, min_size):
    """Condensed tree of a spanning tree that fits one task: point rows (kind 0) and node rows (kind 1)."""
    parts = list(batches)
    if not any(map(len, parts)):
        return
    pdf = pd.concat(parts, ignore_index=True).sort_values(["w", "a", "b"], ignore_index=True)
    ids, inv = np.unique(np.concatenate([pdf["a"], pdf["b"]]), return_inverse=True)
    n, m = len(ids), len(pdf)
    sets = Sets(n)
    small: dict[int, list[int]] = {i: [i] for i in range(n)}
    size = [1] * n
    node_of: dict[int, int] = {i: i for i in range(n)} if min_size <= 1 else {}
    point_node = np.full(n, -1, dtype=np.int64)
    point_w = np.zeros(n)
    parent: list[int] = []
    death: list[float] = []
    sizes: list[int] = []

    def new_node(rows: int) -> int:
        parent.append(-1)
        death.append(np.inf)
        sizes.append(rows)
        return len(parent) - 1

    for u, v, w in zip(inv[:m].tolist(), inv[m:].tolist(), pdf["w"].tolist()):
        x, y = sets.find(u), sets.find(v)
        if x == y:
            continue
        nx, ny = node_of.pop(x, None), node_of.pop(y, None)
        total = size[x] + size[y]
        sets.parent[y] = x
        size[x] = total
        if nx is None and ny is None:
            rows = small.pop(x) + small.pop(y)
            if total >= min_size:
                node = new_node(total)
                point_node[rows], point_w[rows] = node, w
                node_of[x] = node
            else:
                small[x] = rows
        elif nx is not None and ny is not None:
            node = new_node(total)
            for child in (nx, ny):
                parent[child], death[child] = node, w
            node_of[x] = node
        else:
            node = nx if nx is not None else ny
            rows = small.pop(y) if nx is not None else small.pop(x)
            point_node[rows], point_w[rows] = node, w
            node_of[x] = node
            sizes[node] = total
    yield pd.DataFrame({"kind": 0, "id": ids, "node": point_node, "parent": -1, "w": point_w, "size": 1})
    yield pd.DataFrame({
        "kind": 1, "id": -1, "node": np.arange(len(parent)), "parent": np.array(parent, dtype=np.int64),
        "w": np.array(death, dtype=float), "size": np.array(sizes, dtype=np.int64),
    })


def select_clusters_task(batches, epsilon):
    """Leaf selection on the node table: the cluster each node belongs to, and per cluster its persistence.

    Input rows carry (node, parent, death, size, first_w, own, own_lambda, first_id): what leaves a
    node on its own. Output (node, cluster, top_lambda, persistence, death, first_id).
    """
    parts = list(batches)
    cols = ["node", "cluster", "top_lambda", "persistence", "selected"]
    if not any(map(len, parts)):
        return
    pdf = pd.concat(parts, ignore_index=True)
    pdf = pdf.sort_values("node", ignore_index=True)
    parent = pdf["parent"].to_numpy()
    death = pdf["death"].to_numpy()
    size = pdf["size"].to_numpy().astype(float)
    n = len(pdf)
    root = int(np.flatnonzero(parent < 0)[-1])
    children: dict[int, list[int]] = {}
    for i, p in enumerate(parent.tolist()):
        if p >= 0:
            children.setdefault(p, []).append(i)
    with np.errstate(divide="ignore", invalid="ignore"):
        birth_lambda = np.where(np.isinf(death), 0.0, 1.0 / death)
        split = np.array([1.0 / death[children[i][0]] if i in children else 0.0 for i in range(n)])
        first = pdf["first_w"].to_numpy(dtype=float)
        own_top = np.where(np.isnan(first), 0.0, 1.0 / first)
    top = np.maximum(split, own_top)
    tree_top = top.max()
    own = pdf["own"].fillna(0).to_numpy(dtype=float)
    own_lambda = pdf["own_lambda"].fillna(0).to_numpy(dtype=float)
    from_children = np.array([split[i] * sum(size[c] for c in children.get(i, [])) for i in range(n)])
    with np.errstate(invalid="ignore"):
        stability = own_lambda + from_children - birth_lambda * size
        persistence = np.where(np.isfinite(tree_top) & (tree_top > 0), stability / (size * tree_top), 1.0)
    leaves = [i for i in range(n) if i not in children and i != root]
    cluster = np.full(n, -1, dtype=np.int64)
    selected: set[int] = set()

    def below(i: int) -> list[int]:
        out, stack = [], [i]
        while stack:
            x = stack.pop()
            out.append(x)
            stack.extend(children.get(x, []))
        return out

    for leaf in leaves:
        if cluster[leaf] >= 0:
            continue
        pick = leaf
        if death[leaf] < epsilon:
            while parent[pick] != root:
                pick = int(parent[pick])
                if death[pick] > epsilon:
                    break
        selected.add(pick)
        cluster[below(pick)] = pick
    yield pd.DataFrame({
        "node": pdf["node"].to_numpy(), "cluster": cluster, "top_lambda": top, "persistence": persistence,
        "selected": [i in selected for i in range(n)],
    })
