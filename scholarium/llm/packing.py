"""Mixture-controlled packing: deficit round-robin over one token queue per source.

Every window gets each source's share of its tokens. The part of a token that a source is owed is carried
to the next window, so after i windows a source has given its share of i * window tokens, rounded. That makes
the state of all deficits at any window a formula of the queue totals: tasks pack their own documents
without waiting for one another, and deficits pass from window to window and from partition to partition.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarium.llm.common import column, small, step
from scholarium.llm.tokens import encode, forget, id_type

#: First level of the running sum over sources.
SOURCE_BUCKETS = 1024
#: Rows of the plan that are shared with all tasks (some 60 bytes each); a longer plan is joined.
PLAN_ROWS = 1_000_000


def tokenised(docs: DataFrame, tokenizer: str, end_id: int | None, key: str, text: str, source: str) -> DataFrame:
    """(id, source, part, before, n, ids): ids of each text, and the tokens of its source earlier in its partition."""
    rows = docs.select(
        column(docs, key).alias("id"), column(docs, source).cast("string").alias("source"), column(docs, text).alias("text")
    )
    schema = T.StructType([
        rows.schema["id"], T.StructField("source", T.StringType()), T.StructField("part", T.LongType()),
        T.StructField("before", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])

    def run(batches):
        part, given = TaskContext.get().partitionId(), {}
        for batch in batches:
            ids = encode(tokenizer, batch.column("text").to_pylist(), end_id)
            before = []
            for s, x in zip(batch.column("source").to_pylist(), ids, strict=True):
                before.append(given.get(s, 0))
                given[s] = before[-1] + len(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("source"), pa.array([part] * len(ids), pa.int64()), pa.array(before, pa.int64()),
                 pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                names=schema.names,
            )
        forget(tokenizer)

    return rows.mapInArrow(run, schema)


def queues(tokens: DataFrame) -> DataFrame:
    """(part, source, base, lo, hi, total): where a partition's part of each queue begins, and the queue's span of all tokens."""
    pieces = step(tokens.groupBy("source", "part").agg(F.sum("n").alias("n")))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    bucket = F.pmod(F.xxhash64("source"), F.lit(SOURCE_BUCKETS))
    sources = pieces.groupBy("source").agg(F.sum("n").alias("size")).withColumn("bucket", bucket)
    # Two levels, so that any number of sources is summed in parallel; the upper one has a fixed number of rows.
    upper = sources.groupBy("bucket").agg(F.sum("size").alias("b_size"))
    run = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    upper = upper.select(
        F.col("bucket").alias("b"), F.coalesce(F.sum("b_size").over(run), F.lit(0)).alias("b_before"),
        F.sum("b_size").over(Window.partitionBy(F.lit(0))).alias("total"),
    )
    inner = Window.partitionBy("bucket").orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    spans = sources.join(upper, F.col("bucket") == F.col("b")).select(
        F.col("source").alias("s"), (F.col("b_before") + F.coalesce(F.sum("size").over(inner), F.lit(0))).alias("lo"), "size", "total"
    )
    return pieces.join(spans, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("q_source"), F.col("part").alias("q_part"), "base", "lo", (F.col("lo") + F.col("size")).alias("hi"), "total"
    )


class Queue:
    """One source's place in the windows. All arithmetic is on integers."""

    def __init__(self, lo: int, hi: int, total: int, window: int):
        self.lo, self.hi, self.total, self.window = lo, hi, total, window

    def _due(self, i: int, upto: int) -> int:
        """Tokens that the sources before ``upto`` have given once i windows are full."""
        return min(i * self.window, self.total) * upto // self.total

    def given(self, i: int) -> int:
        return self._due(i, self.hi) - self._due(i, self.lo)

    def cut(self, start: int, n: int):
        """Pieces (start in the document, length, window, offset in the window) of tokens start..start+n of the queue."""
        at, end = start, start + n
        i = at * self.total // ((self.hi - self.lo) * self.window)
        while i and self.given(i) > at:
            i -= 1
        while at < end:
            while self.given(i + 1) <= at:
                i += 1
            stop = min(end, self.given(i + 1))
            offset = self._due(i + 1, self.lo) - self._due(i, self.lo) + at - self.given(i)
            yield at - start, stop - at, i, offset
            at = stop


def pack(
    docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int | None = 1, with_ids: bool = True,
    key: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """Pieces of all documents: (key, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    Each window of ``window`` tokens holds every source's share of all tokens, to the token; only the last window may
    be short. Queues run in the order of the stored rows. Null and empty texts give the end id alone; a null source is a
    queue of its own; repeated rows are packed one by one. An empty table gives no piece.
    """
    tokens = step(tokenised(docs, tokenizer, end_id, key, text, source))
    # A row for each source in each partition: ids need not move to meet it.
    plan = small(step(queues(tokens)), PLAN_ROWS)
    joined = tokens.join(
        plan, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("part") == F.col("q_part"))
    ).select("id", (F.col("base") + F.col("before")).alias("at"), "n", "lo", "hi", "total", "ids")
    dtype = id_type(tokenizer)
    fields = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([T.StructField(key, tokens.schema["id"].dataType), *[T.StructField(f, T.LongType()) for f in fields]])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches):
        for batch in batches:
            rows, out, kept = [], [], []
            cols = [batch.column(c).to_pylist() for c in ("at", "n", "lo", "hi", "total", "ids")]
            for r, (at, n, lo, hi, total, ids) in enumerate(zip(*cols, strict=True)):
                ids = np.frombuffer(ids, dtype).astype("<u4")
                for start, length, seq, offset in Queue(lo, hi, total, window).cut(at, n):
                    piece = ids[start : start + length]
                    rows.append(r)
                    out.append((start, length, zlib.crc32(piece.tobytes()), n, seq, offset))
                    if with_ids:
                        kept.append(piece.astype(np.int32))
            if not rows:
                continue
            numbers = np.array(out, np.int64).T
            arrays = [batch.column("id").take(pa.array(rows)), *[pa.array(x) for x in numbers]]
            if with_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return joined.mapInArrow(run, schema)


def sequences(pieces: DataFrame, window: int = 2048, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids): the windows themselves. A window that is short is padded, unless its length is a power of two."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.flatten(F.transform(parts, lambda p: p["ids"]))
    whole = pieces.groupBy("sequence_id").agg(ids.alias("ids"))
    n = F.size("ids")
    exact = n.bitwiseAND(n - 1) == 0
    return whole.withColumn("ids", F.when(exact, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id), window - n))))
