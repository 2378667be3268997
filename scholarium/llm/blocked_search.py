"""Ranked lexical search with per-term geometric blocking.

Documents are dealt to shards. In a shard the posting list of a term is cut into blocks of similar documents: some of
the list's own documents stand for directions, and each of the others joins the one it is most similar to. A block keeps the
largest weight that any of its documents has for every term. The product of an item with this summary is an upper bound
for all documents of the block, so a block is skipped only if its bound stays below the score of the item's last place so far;
the documents of all other blocks are scored in full. The result is that of scoring every document.

Items are worked off in passes of bounded size, so that what tasks share does not grow with their number.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarium.llm.common import column, slices, step

#: Bytes of item texts that are searched in one pass over the documents.
PASS_BYTES = 1 << 20
#: Terms of items that are searched together in a shard; a longer item is alone.
BLOCK_TERMS = 4096
#: Documents of a shard, at most, and its cells (documents x terms).
SHARD_ROWS, SHARD_CELLS = 2048, 1 << 23
#: Documents that a block is meant to hold.
BLOCK_DOCS = 64
#: Directions that stand for the terms when documents are compared.
DIRECTIONS = 32
#: Weights are below 10^6; summaries hold them in steps of this size, rounded up.
STEP = 4096

# Bytes of UTF-8 that belong to a term: digits, letters of ASCII in lower case, all others beyond ASCII. The rest becomes a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class Items:
    """The items of a pass: per item its terms (numbers) and how often it has them, and blocks of items with few terms."""

    def __init__(self, texts: list[bytes]):
        self.vocabulary: dict[bytes, int] = {}
        self.terms, self.times = [], []
        for text in texts:
            found = Counter(self.vocabulary.setdefault(t, len(self.vocabulary)) for t in terms(text))
            self.terms.append(np.fromiter(found.keys(), np.int64, len(found)))
            self.times.append(np.fromiter(found.values(), np.int64, len(found)))
        self.blocks: list[list[int]] = []
        held: set[int] = set()
        for i, own in enumerate(self.terms):
            if not len(own):
                continue
            if not self.blocks or len(held | set(own.tolist())) > BLOCK_TERMS:
                self.blocks.append([])
                held = set()
            self.blocks[-1].append(i)
            held |= set(own.tolist())

    def widest(self) -> int:
        return max((len(np.unique(np.concatenate([self.terms[i] for i in b]))) for b in self.blocks), default=1)


class Shard:
    """Blocked posting lists over some documents. ``weights``: documents x terms; ``scale``: what a term counts in an item."""

    def __init__(self, weights: np.ndarray, scale: np.ndarray):
        self.weights = weights
        n_docs, n_terms = weights.shape
        upper = (-(-weights // STEP)).astype(np.uint8)
        rng = np.random.default_rng(1)
        where = (weights * scale.astype(np.float32)) @ rng.choice(np.float32([-1, 1]), (n_terms, DIRECTIONS))
        where /= np.maximum(np.linalg.norm(where, axis=1, keepdims=True), 1e-9)
        term, doc = np.nonzero(weights.T)
        edges = np.searchsorted(term, np.arange(n_terms + 1))
        #: Documents of each block, and the first block of each term.
        self.members: list[np.ndarray] = []
        self.first = np.zeros(n_terms + 1, np.int64)
        for j, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            if b - a > BLOCK_DOCS:
                self.members += similar(doc[a:b], where)
            elif b > a:
                self.members.append(doc[a:b])
            self.first[j + 1] = len(self.members)
        self.summaries = np.empty((len(self.members), n_terms), np.uint8)
        for i, docs in enumerate(self.members):
            upper[docs].max(axis=0, out=self.summaries[i])

    def search(self, cols: np.ndarray, value: np.ndarray, k: int, least: int, opened: list | None = None):
        """(documents, scores) of all that may be among the k best with a score of at least ``least``.

        ``value`` is what each column counts. Best bounds come first, and ``least`` rises with what they hold.
        """
        lists = [np.arange(self.first[c], self.first[c + 1]) for c in cols.tolist()]
        blocks = np.concatenate(lists)
        bounds = self.summaries[np.ix_(blocks, cols)].astype(np.int64) @ (value * STEP)
        order = np.argsort(-bounds, kind="stable")
        blocks, bounds = blocks[order].tolist(), bounds[order]
        seen = np.zeros(len(self.weights), bool)
        found, scores, at, take = [], np.zeros(0, np.int64), 0, 2
        while at < len(blocks):
            end = min(at + take, int(np.searchsorted(-bounds, -least, side="right")))
            if end <= at:
                break
            docs = np.unique(np.concatenate([self.members[b] for b in blocks[at:end]]))
            docs = docs[~seen[docs]]
            seen[docs] = True
            found.append(docs)
            scores = np.concatenate([scores, self.weights[np.ix_(docs, cols)].astype(np.int64) @ value])
            if len(scores) >= k:
                least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
            at, take = end, 2 * take
        if opened is not None:
            opened.append((at, len(blocks)))
        keep = scores >= least
        return (np.concatenate(found)[keep] if found else np.zeros(0, np.int64)), scores[keep]


def similar(docs: np.ndarray, where: np.ndarray) -> list[np.ndarray]:
    """``docs`` in groups of those that lie in like directions."""
    n = -(-len(docs) // BLOCK_DOCS)
    heads = docs[np.linspace(0, len(docs) - 1, n).astype(np.int64)]
    nearest = (where[docs] @ where[heads].T).argmax(axis=1)
    order = np.argsort(nearest, kind="stable")
    return np.split(docs[order], np.flatnonzero(np.diff(nearest[order])) + 1)


class Search:
    """The best of all shards of a task, per item."""

    def __init__(self, items: Items, weights: np.ndarray, n_docs: int, n_terms: int, k: int):
        self.items, self.weights, self.n_docs, self.n_terms, self.k = items, weights, n_docs, n_terms, k
        self.best: list[list] = [[] for _ in items.terms]
        self.rows = max(64, min(SHARD_ROWS, SHARD_CELLS // items.widest()))

    def add(self, ids: list, rows: np.ndarray, lengths: np.ndarray, doc: np.ndarray, term: np.ndarray, times: np.ndarray) -> None:
        """Search one shard: keys, row numbers and lengths of its documents, and its postings (place of the document, term, times)."""
        m = np.array([75 + 25 * int(n) * self.n_docs // self.n_terms for n in lengths], np.int64)
        weight = (1_000_000_000 * times) // (1000 * times + 12 * m[doc])
        for block in self.items.blocks:
            own = np.unique(np.concatenate([self.items.terms[i] for i in block]))
            place = np.searchsorted(own, term)
            hit = own[np.minimum(place, len(own) - 1)] == term
            cells = np.zeros((len(ids), len(own)), np.int32)
            cells[doc[hit], place[hit]] = weight[hit]
            shard = Shard(cells, self.weights[own])
            for i in block:
                value = self.items.times[i] * self.weights[self.items.terms[i]]
                best = self.best[i]
                least = -best[-1][0] if len(best) == self.k else 1
                docs, scores = shard.search(np.searchsorted(own, self.items.terms[i]), value, self.k, least)
                more = [(-s, ids[d] is None, ids[d], int(rows[d])) for d, s in zip(docs.tolist(), scores.tolist(), strict=True)]
                if more:
                    self.best[i] = heapq.nsmallest(self.k, [*best, *more])


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(id, row, n, terms, times) of every document of ``docs(id, text)`` with a term: its length, and the terms of ``vocabulary``."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select("id", F.monotonically_increasing_id().alias("row"), "text")
    numbers = T.ArrayType(T.IntegerType())
    schema = T.StructType([
        rows.schema["id"], T.StructField("row", T.LongType()), T.StructField("n", T.LongType()), T.StructField("terms", numbers),
        T.StructField("times", numbers),
    ])

    def run(batches):
        number = shared.value.get
        for batch in slices(batches):
            at, n, known, times = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = terms(text or b"")
                if found:
                    c = Counter(map(number, found))
                    c.pop(None, 0)
                    at.append(i)
                    n.append(len(found))
                    known.append(list(c.keys()))
                    times.append(list(c.values()))
            kept = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(kept), batch.column("row").take(kept), pa.array(n, pa.int64()),
                 pa.array(known, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))], names=schema.names,
            )

    return rows.mapInArrow(run, schema)


def _pass(docs: DataFrame, asked: list, k: int) -> DataFrame:
    """(item, score, id, row): the k best documents of ``docs(id, text)`` for the item texts ``asked``, from every task."""
    items = Items([bytes(r.text) for r in asked])
    numbers = [r.number for r in asked]
    postings = step(counted(docs, items.vocabulary))
    n_docs, n_terms = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # One number for each term of the pass.
    held = dict(postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    df = [held.get(t, 0) for t in range(len(items.vocabulary))]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((items, weights))
    id_type = postings.schema["id"].dataType
    schema = T.StructType([
        T.StructField("item", T.LongType()), T.StructField("score", T.LongType()), T.StructField("id", id_type), T.StructField("row", T.LongType())
    ])

    def run(batches):
        search = Search(*shared.value, n_docs, n_terms, k)
        waiting: list[pa.RecordBatch] = []

        def shard():
            both = pa.Table.from_batches(waiting).combine_chunks()
            lengths = both.column("terms").combine_chunks().value_lengths().to_numpy()
            flat = [both.column(c).combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("terms", "times")]
            search.add(
                both.column("id").to_pylist(), both.column("row").to_numpy(), both.column("n").to_numpy(), np.repeat(np.arange(len(both)), lengths), *flat
            )
            waiting.clear()

        for batch in slices(batches, search.rows):
            if sum(b.num_rows for b in waiting) + batch.num_rows > search.rows:
                shard()
            waiting.append(batch)
        if waiting:
            shard()
        out = [(numbers[i], -s, id_, row) for i, best in enumerate(search.best) for s, _, id_, row in best]
        if out:
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), id_arrow, pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    id_arrow = to_arrow_type(id_type)
    return postings.mapInArrow(run, schema)


def ranked(
    docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(item, rank, key, score) of the ``k`` highest-scoring documents of every item, all if fewer have a score above 0.

    A score sums, over the terms of the item with repeats, the term's weight floor(1000 ln((2N + 2) / (2 df + 1))) times
    10^9 tf div (1000 tf + 12 m), where m = 75 + 25 n N div L. N documents have a term at all, with L terms together; n is the
    document's number of terms. Whole texts count; postings are kept of the terms that items ask for.

    Null and empty texts have no term: such an item has no row, and such a document is in none. Equal scores go by the smaller key,
    null keys last; rows that repeat are documents, or items, of their own. More columns are ignored, and an empty table on
    either side gives an empty result.
    """
    spark = docs.sparkSession
    body = lambda df, name: column(df, name).cast("string").cast("binary").alias("text")
    texts = docs.select(column(docs, key).alias("id"), body(docs, text))
    asked = items.select(column(items, item).alias("item_id"), body(items, item_text), F.monotonically_increasing_id().alias("number"))
    asked = step(asked.where("text IS NOT NULL"))
    total = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = -(-total // PASS_BYTES)
    found = None
    for i in range(passes):
        # Hash-dealt, so that a pass holds about PASS_BYTES.
        part = asked.where(F.pmod(F.xxhash64("number"), F.lit(passes)) == i).select("number", "text").collect()
        if part:
            best = _pass(texts, part, k)
            found = best if found is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], "item long, score long, row long").withColumn("id", F.lit(None).cast(texts.schema["id"].dataType))
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = asked.select("number", "item_id")
    return top.join(named, F.col("item") == F.col("number")).select(F.col("item_id").alias(item), "rank", F.col("id").alias(key), "score")
