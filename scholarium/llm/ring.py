"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Keys hash to a fixed number of arcs of the ring. An arc's rows go to the shard of the next virtual node
clockwise; once a shard is full, its rows continue clockwise to the next shard with room. The walk needs
only the number of rows of each arc, a table of fixed size, so it runs once on the driver; the rows look up
their piece of an arc by their rank in it.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholarium.llm.common import column, step

ARC_BITS = 14
VIRTUAL_NODES = 128


def _point(*what: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr(what).encode(), digest_size=8).digest(), "big")


def walk(counts: dict[int, int], shards: int, virtual_nodes: int = VIRTUAL_NODES, slack: float = 0.0) -> list[tuple[int, int, int, int, int]]:
    """Place arcs on shards: pieces (arc, first rank, end rank, shard, position of the first rank in the shard).

    With ``slack`` 0 the capacities add up to the number of rows and differ by one at most, so the loads do
    too. With more slack every shard may hold (1 + slack) times the mean, and fewer rows leave their arc's own shard.
    """
    rows = sum(counts.values())
    if slack > 0:
        room = [-int(-rows * (1 + slack) // shards)] * shards
    else:
        first = sorted(range(shards), key=lambda s: _point("spare", s))
        room = [rows // shards] * shards
        for s in first[: rows % shards]:
            room[s] += 1
    ring = sorted((_point("node", s, v), s) for s in range(shards) for v in range(virtual_nodes))
    spots = [p for p, _ in ring]
    held, pieces = [0] * shards, []
    # Arcs come in a fixed scrambled order, so that no side of the ring is filled first.
    for arc in sorted(counts, key=lambda a: _point("arc", a)):
        done, node = 0, bisect.bisect_left(spots, arc << (64 - ARC_BITS))
        while done < counts[arc]:
            shard = ring[node % len(ring)][1]
            n = min(counts[arc] - done, room[shard] - held[shard])
            if n:
                pieces.append((arc, done, done + n, shard, held[shard]))
                held[shard] += n
                done += n
            node += 1
    return pieces


def shard_rows(
    docs: DataFrame, shards: int = 40, slack: float = 0.0, virtual_nodes: int = VIRTUAL_NODES, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every row; slots of a shard count from 0 without gaps.

    Size is the UTF-8 length plus 16, null texts count as empty, and a null id is a key like any other, told apart by text.
    Repeated rows are placed one by one. The law is ``rows``: with ``slack`` 0 numbers of rows differ by one at most.
    """
    t = F.coalesce(column(docs, text), F.lit("")).cast("binary")
    k = column(docs, key)
    rows = docs.select(k.alias("k"), (F.octet_length(t) + 16).cast("long").alias("size"), F.crc32(t).alias("crc"))
    place = F.when(F.col("k").isNull(), F.xxhash64("crc", "size")).otherwise(F.xxhash64("k"))
    rows = rows.withColumn("h", place).withColumn("arc", F.shiftrightunsigned("h", 64 - ARC_BITS).cast("int"))
    rows = step(rows)
    # At most 2^ARC_BITS counts, however many rows there are.
    counts = {r.arc: r.n for r in rows.groupBy("arc").agg(F.count("*").alias("n")).collect()}
    pieces = rows.sparkSession.createDataFrame(
        walk(counts, shards, virtual_nodes, slack), "arc int, lo long, hi long, shard int, base long"
    )
    order = Window.partitionBy("arc").orderBy("h", "k", "size", "crc")
    ranked = rows.withColumn("rank", F.row_number().over(order) - 1)
    return (
        ranked.join(F.broadcast(pieces), "arc")
        .where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        .select(
            F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard",
            (F.col("base") + F.col("rank") - F.col("lo")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
