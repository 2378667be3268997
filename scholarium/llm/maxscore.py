"""Exact top-k search by inner product with MaxScore.

Vectors are dealt to shards. In a shard every dimension is a posting list of the vectors that are not zero there, with
its largest and smallest weight. For a query the terms are ordered by the most they can add; those whose sum stays
below the k-th best score so far are non-essential. Essential lists are traversed; what they collect is completed by
probing the other lists, largest bound first, as long as a candidate can still compete. Shards are merged at the end.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholarium.llm.common import column, step

SHARD_ROWS = 2048
QUERY_ROWS = 1024
#: Components of a shard, blocks of queries that meet a shard in one task, and shards that a task reads one after the other.
SHARD_CELLS = 1 << 20
BLOCKS_AT_ONCE = 8
STRIP_SHARDS = 64
#: Tasks per core, where there are shards enough.
TASKS_PER_CORE = 4


class Shard:
    """Posting lists over the rows of one shard. ``weights``: rows x dimensions, whole numbers."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, numbers: np.ndarray):
        """``numbers`` tells rows apart, also those that repeat an id."""
        order = np.argsort(ids, kind="stable")
        self.ids, self.weights = ids[order], weights[order]
        self.numbers = numbers[order]
        self.postings = []
        for j in range(self.weights.shape[1]):
            rows = np.flatnonzero(self.weights[:, j])
            self.postings.append((rows, self.weights[rows, j]))
        # A dimension at a time, for lists that most rows are on and for probing.
        self.columns = np.ascontiguousarray(self.weights.T)
        zero = np.zeros(self.weights.shape[1], np.int64)
        self.most = self.weights.max(axis=0, initial=0) if len(ids) else zero
        self.least = self.weights.min(axis=0, initial=0) if len(ids) else zero
        # Heads of the lists, sorted by weight: where high scores are likely.
        self.order = [rows[np.argsort(w, kind="stable")] for rows, w in self.postings]

    def top(self, own: int, query: np.ndarray, k: int, least: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id), ties to the smaller id, without the row of number ``own``; scores below ``least`` may be left out."""
        n = len(self.ids)
        q = query[: len(self.most)]
        if len(q) < len(self.most):
            q = np.pad(q, (0, len(self.most) - len(q)))
        bound = np.maximum(q * self.most, q * self.least)
        terms = np.argsort(bound, kind="stable")
        # A first threshold from the heads of the strongest lists.
        heads = [self.order[j][-2 * k :] if q[j] > 0 else self.order[j][: 2 * k] for j in terms[-4:]]
        head = np.unique(np.concatenate(heads)) if heads else np.zeros(0, np.int64)
        head = head[self.numbers[head] != own]
        scores = self.weights[head] @ q
        threshold = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else None
        if least is not None and (threshold is None or threshold < least):
            threshold = least
        # Terms in rising order of bound; a prefix that cannot reach the threshold alone is non-essential.
        reach = np.cumsum(bound[terms])
        split = 0 if threshold is None else int(np.searchsorted(reach, threshold, side="left"))
        partial = np.zeros(n, np.int64)
        seen, all_seen = np.zeros(n, bool) if split else np.ones(n, bool), not split
        for j in terms[split:]:
            rows, w = self.postings[j]
            if not q[j]:
                continue
            # A list that most rows are on is added as a whole: the others have weight zero.
            if 2 * len(rows) > n:
                partial += q[j] * self.columns[j]
            else:
                partial[rows] += q[j] * w
            if not all_seen:
                seen[rows] = True
                all_seen = bool(seen.all())
        live = np.flatnonzero(seen & (self.numbers != own))
        score = partial[live]
        for place in range(split - 1, -1, -1):
            keep = score + reach[place] >= threshold
            live, score = live[keep], score[keep]
            j = terms[place]
            score = score + q[j] * self.columns[j][live]
        if len(score) > k:
            keep = score >= np.partition(score, len(score) - k)[len(score) - k]
            live, score = live[keep], score[keep]
        # Rows are in order of id, so a stable sort settles ties.
        best = np.argsort(-score, kind="stable")[:k]
        return list(zip(score[best].tolist(), self.ids[live[best]].tolist(), strict=True))


def _matrix(vectors: list[list[float]], scale: float) -> np.ndarray:
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.floor(out * scale).astype(np.int64)


def _packed(w: np.ndarray) -> tuple[bytes, int]:
    """Whole numbers as bytes, each in as few bytes as the largest needs (2, 4 or 8)."""
    top = max(int(w.max(initial=0)), -int(w.min(initial=0)))
    size = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    return w.astype(f"<i{size}").tobytes(), size


def _blocks(rows: DataFrame, n: int, size: int, name: str, scale: float) -> tuple[DataFrame, int]:
    """Pack the ``n`` rows (row, id, v) into blocks of about ``size``: (name, rows, ids, cell, weights)."""
    count = max(1, -(-n // size))
    dealt = rows.withColumn(name, F.pmod(F.xxhash64("row", F.lit(7)), F.lit(count)))

    def pack(group: pa.Table) -> pa.Table:
        numbers = [group.column(c).to_numpy().astype("<i8").tobytes() for c in ("row", "id")]
        data, cell = _packed(_matrix(group.column("v").to_pylist(), scale))
        return pa.table({
            name: group.column(name)[:1], "rows": pa.array(numbers[:1]), "ids": pa.array(numbers[1:]),
            "cell": pa.array([cell], pa.int32()), "weights": pa.array([data]),
        })

    packed = dealt.groupBy(name).applyInArrow(pack, f"{name} long, rows binary, ids binary, cell int, weights binary")
    return step(packed), count


def _unpacked(rows, ids, cell, weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, "<i8")
    w = np.frombuffer(weights, f"<i{cell}").reshape(len(ids), -1)
    return np.frombuffer(rows, "<i8"), ids, w.astype(np.int64)


def top_k(
    vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """For each vector whose id is divisible by ``every``: (query_id, rank, vec_id, score) of the k best others.

    Components become floor(scale * x). Rows with a null id, a null vector or a null or non-finite component take no part.
    Rows that repeat an id are rows of their own: each is a candidate for the other, and each that asks has its own ranks.
    Equal scores go by id, equal ids by no further rule. Shorter vectors count as filled with zeros. Scores are
    exact below 2^63. An empty table gives an empty result; further columns, whatever their names, are not read.
    """
    v = column(vectors, vector).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(
        F.monotonically_increasing_id().alias("row"), column(vectors, key).cast("long").alias("id"), v.alias("v")
    ).where(F.col("id").isNotNull() & F.col("v").isNotNull() & good)
    # Written, so that a row keeps its number.
    rows = step(rows)
    asking = F.col("id") % every == 0
    n, n_asking, width = rows.agg(F.count("*"), F.count_if(asking), F.max(F.size("v"))).first()
    # A shard is a bounded number of components, however wide the vectors are.
    size = max(SHARD_ROWS // 16, min(SHARD_ROWS, SHARD_CELLS // max(1, width or 1)))
    shards, n_shards = _blocks(rows, n, size, "shard", scale)
    asked, n_blocks = _blocks(rows.where(asking), n_asking, min(QUERY_ROWS, size), "block", scale)
    # Every block of queries meets every shard once. A task holds a few blocks of queries and reads a strip of shards, one after
    # the other: queries are copied once per strip and shards once per group of blocks. Nothing is joined, so that no copies
    # are broadcast, and no task holds more than its blocks and one shard.
    groups = max(1, -(-n_blocks // BLOCKS_AT_ONCE))
    wanted = TASKS_PER_CORE * vectors.sparkSession.sparkContext.defaultParallelism
    strips = max(-(-n_shards // STRIP_SHARDS), min(n_shards, -(-wanted // groups)))
    tasks = strips * groups
    strip, group = F.pmod(F.col("shard"), F.lit(strips)), F.floor(F.col("block") / BLOCKS_AT_ONCE)
    asking_rows = asked.withColumn("strip", F.explode(F.sequence(F.lit(0), F.lit(strips - 1)).cast("array<bigint>"))).select(
        (F.col("strip") * groups + group).alias("task"), F.lit(0).alias("turn"), "rows", "ids", "cell", "weights"
    )
    shard_rows = shards.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>"))).select(
        (strip * groups + F.col("group")).alias("task"), F.lit(1).alias("turn"), "rows", "ids", "cell", "weights"
    )
    ordered = asking_rows.unionByName(shard_rows).repartitionById(tasks, F.col("task").cast("int")).sortWithinPartitions("task", "turn")

    def search(batches):
        for _, part in groupby(_meetings(batches), key=lambda r: r[0]):
            blocks, best = [], {}
            for _, turn, block in part:
                if not turn:
                    blocks.append(block)
                    continue
                row, ids, weights = block
                shard = Shard(ids, weights, row)
                for q_row, _, asked_ in blocks:
                    for own, query in zip(q_row.tolist(), asked_, strict=True):
                        # What a shard has to beat is the last place that the shards before it have left.
                        so_far = best.get(own, [])
                        found = shard.top(own, query, k, so_far[-1][0] if len(so_far) == k else None)
                        if found:
                            best[own] = sorted(so_far + found, key=lambda x: (-x[0], x[1]))[:k]
            for q_row, q_ids, _ in blocks:
                out = [(own, id_, i, s) for own, id_ in zip(q_row.tolist(), q_ids.tolist(), strict=True) for s, i in best.get(own, [])]
                table = np.array(out, np.int64).reshape(-1, 4).T
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in table], names=["row", "query_id", "vec_id", "score"])

    found = ordered.mapInArrow(search, "row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _meetings(batches):
    """Rows of packed blocks, unpacked one at a time: (task, turn, block)."""
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            yield r["task"], r["turn"], _unpacked(r["rows"], r["ids"], r["cell"], r["weights"])
