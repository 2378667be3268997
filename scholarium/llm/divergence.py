"""How far the sources of a language differ, from word counts by single-pass in-memory indexing.

Every task builds block postings (language, source, term) -> occurrences and documents in memory until they are many, and then
spills a run: the postings in the order of their terms, cut into chunks, for each hash shard of the terms. A shard
heap-merges its runs into frequencies: Spark sorts the chunks by their first posting, and a task holds just those
chunks that reach over the place of the merge. Runs are rows of a shuffle and nothing is kept on a machine.

The difference of two sources is a sum over all terms. Nearly all of it follows from each source's own histogram of
frequencies, as if the other source lacked the term; only terms that both sources have need a correction, and these
are streamed term by term.
"""

from __future__ import annotations

import heapq
import pickle
import zlib
from bisect import bisect_left
from collections import Counter
from itertools import batched, chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarium.llm.common import column, parts, slices, step

#: Postings that a task holds before it spills a run.
BLOCK_POSTINGS = 600_000
#: Postings in a chunk of a run, and those that are summed at once.
CHUNK, MERGE_POSTINGS = 4096, 1 << 16
SCALE = 1_000_000_000
MIN_DOCS = 3
#: Terms that a report lists for each source.
REPORT = 200
#: Sources of a language whose pair sums a task holds as one matrix.
MATRIX = 1024
#: Terms x sources x sources that are worked on at once.
CELLS = 1 << 18

# Bytes of UTF-8 that belong to a term: letters of ASCII, in lower case, and all others beyond ASCII. The rest becomes a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Block:
    """Postings in memory: per (language, source) the occurrences and the documents of each term, in the same order."""

    def __init__(self):
        self.groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        self.size = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        terms = text.translate(TABLE).split()
        held = self.groups.get((lang, source))
        if held is None:
            held = self.groups[lang, source] = (Counter(), Counter())
        before = len(held[0])
        held[0].update(terms)
        held[1].update(list(dict.fromkeys(terms)))
        self.size += len(held[0]) - before

    def run(self, shards: int):
        """Chunks (shard, first key, body) of all postings in the order of their keys, which leave the block empty.

        A key is the language in hexadecimal digits, a space and the term: no term has a space.
        """
        held = [(lang.encode().hex().encode(), source, n, docs) for (lang, source), (n, docs) in self.groups.items() if n]
        self.__init__()
        if not held:
            return
        keys = pa.concat_arrays([pc.binary_join_element_wise(pa.scalar(x), pa.array(list(n), pa.binary()), pa.scalar(b" ")) for x, _, n, _ in held])
        hashes = [np.fromiter(map(zlib.crc32, n), np.uint32, len(n)) ^ np.uint32(zlib.crc32(x)) for x, _, n, _ in held]
        names = [source for _, source, _, _ in held]
        codes = np.repeat(np.arange(len(held)), [len(n) for *_, n, _ in held])
        counts = [np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in own]) for own in zip(*(x[2:] for x in held), strict=True)]
        order = pc.sort_indices(keys).to_numpy()
        shard = (np.concatenate(hashes) % np.uint32(shards)).astype(np.int64)[order]
        by_shard = np.argsort(shard, kind="stable")
        order, shard = order[by_shard], shard[by_shard]
        keys, codes, (n, docs) = keys.take(pa.array(order)), codes[order], (c[order] for c in counts)
        edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]).tolist()
        for a, b in zip(edges, edges[1:], strict=False):
            for x in range(a, b, CHUNK):
                y = min(x + CHUNK, b)
                yield int(shard[x]), keys[x].as_py(), packed(keys[x:y], codes[x:y], names, n[x:y], docs[x:y])


def packed(keys: pa.Array, codes: np.ndarray, names: list[str], n: np.ndarray, docs: np.ndarray) -> bytes:
    """A chunk as bytes; its sources are numbered anew."""
    used, own = np.unique(codes, return_inverse=True)
    offsets = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys) + 1]
    data = keys.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes()
    numbers = [x.tobytes() for x in (offsets - offsets[0], own.astype(np.int32), n, docs)]
    return pickle.dumps((data, [names[i] for i in used.tolist()], *numbers), 5)


class Chunk:
    """Postings in the order of their keys: a key, the number of a source, occurrences and documents."""

    def __init__(self, body: bytes, known: dict[str, int]):
        data, names, offsets, codes, n, docs = pickle.loads(body)
        size = len(offsets) // 4 - 1
        self.keys = pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        numbers = np.array([known.setdefault(s, len(known)) for s in names])
        self.columns = [numbers[np.frombuffer(codes, np.int32)], np.frombuffer(n, np.int64), np.frombuffer(docs, np.int64)]

    def key(self, i: int) -> bytes:
        return self.keys[i].as_py()

    def cut(self, a: int, limit: bytes | None) -> tuple[int, list]:
        """The end of the postings from ``a`` with a key below ``limit``, and these."""
        b = len(self.keys) if limit is None else bisect_left(range(len(self.keys)), limit, lo=a, key=self.key)
        return b, [self.keys[a:b], *[c[a:b] for c in self.columns]]


def runs(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, first, body): chunks of sorted runs, named by their first key, from ``docs(lang, source, text)``."""

    def spill(batches):
        block = Block()

        def emit():
            for some in batched(block.run(shards), 64):
                shard, first, body = zip(*some, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard, pa.int32()), pa.array(first, pa.binary()), pa.array(body, pa.binary())], names=["shard", "first", "body"]
                )

        for batch in slices(batches):
            for row in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                block.add(*row)
                if block.size >= BLOCK_POSTINGS:
                    yield from emit()
        yield from emit()

    return docs.mapInArrow(spill, "shard int, first binary, body binary")


def merged(chunks, known: dict[str, int]):
    """Lists of cuts, each list with all postings of the keys it holds, from chunks (first key, body) in the order of their keys.

    A heap has the open chunks by their next key. When a chunk comes in, what lies before it is complete and leaves.
    """
    heap: list[tuple[bytes, int, Chunk, int]] = []
    cuts, size = [], 0
    for number, (first, body) in enumerate(chain(chunks, [(None, b"")])):
        while heap and (first is None or heap[0][0] < first):
            _, k, chunk, a = heapq.heappop(heap)
            b, cut = chunk.cut(a, first)
            cuts.append(cut)
            size += b - a
            if b < len(chunk.keys):
                heapq.heappush(heap, (chunk.key(b), k, chunk, b))
        if size >= MERGE_POSTINGS or first is None and size:
            yield cuts
            cuts, size = [], 0
        if first is not None:
            heapq.heappush(heap, (first, number, Chunk(body, known), 0))


def summed(cuts: list, names: list[str], min_docs: int) -> pa.RecordBatch:
    """Frequencies of the keys in ``cuts`` that ``min_docs`` documents hold."""
    keys = pa.concat_arrays([c[0] for c in cuts])
    source, n, docs = (np.concatenate(x) for x in list(zip(*cuts, strict=True))[1:])
    order = pc.sort_indices(keys)
    keys, at = keys.take(order), order.to_numpy()
    new = np.r_[True, pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)]
    starts, group = np.flatnonzero(new), np.cumsum(new) - 1
    enough = np.add.reduceat(docs[at], starts) >= min_docs
    stay = enough[group]
    term = (np.cumsum(enough) - 1)[group[stay]]
    pair, inverse = np.unique(term * len(names) + source[at][stay], return_inverse=True)
    count, total = np.zeros(len(pair), np.int64), np.zeros(int(enough.sum()), np.int64)
    np.add.at(count, inverse, n[at][stay])
    np.add.at(total, term, n[at][stay])
    term, source = np.divmod(pair, len(names))
    parts_ = [k.split(b" ", 1) for k in keys.take(pa.array(starts[enough])).to_pylist()]
    lang = pa.array([bytes.fromhex(x.decode()) for x, _ in parts_], pa.binary())
    word = pa.array([x for _, x in parts_], pa.binary())
    first = np.r_[True, term[1:] != term[:-1]][: len(term)]
    return pa.RecordBatch.from_arrays(
        [lang.take(pa.array(term)), word.take(pa.array(term)), pa.array(names, pa.string()).take(pa.array(source)), pa.array(count),
         pa.array(total[term]), pa.array(first)], names=["lang", "term", "source", "n", "total", "first"],
    )


def frequencies(docs: DataFrame, shards: int | None = None, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, source, n, total, first) of the terms that ``min_docs`` documents of their language hold.

    ``n`` counts the occurrences in the source, ``total`` those in the language; ``first`` marks one row of each term.
    ``docs(lang, source, text)`` has no null, and the text as bytes.
    """
    shards = shards or 4 * parts(docs.sparkSession)
    # The chunks of a shard are sorted by Spark, on disk where they are many.
    sorted_ = runs(docs, shards).repartition("shard").sortWithinPartitions("shard", "first")

    def merge(batches):
        def chunks():
            for batch in slices(batches):
                yield from zip(*(batch.column(c).to_pylist() for c in ("shard", "first", "body")), strict=True)

        for _, own in groupby(chunks(), itemgetter(0)):
            known: dict[str, int] = {}
            for cuts in merged((c[1:] for c in own), known):
                yield summed(cuts, list(known), min_docs)

    found = sorted_.mapInArrow(merge, "lang binary, term binary, source string, n long, total long, first boolean")
    return found.select(F.col("lang").cast("string"), F.col("term").cast("string"), "source", "n", "total", "first")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 * (count + 1) / (n + v)), in decimals so that no count is too large."""
    top = (count + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return _div(top, (n + v).cast("decimal(20,0)")) + 1


def _gap(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def corrections(found: DataFrame) -> DataFrame:
    """(lang, source, item, value): what terms that two sources share add to the sum of their histograms.

    ``found(lang, term, source, p, zero)``: share of the term, and of a term that the source lacks.
    """
    sorted_ = found.repartition("lang", "term").sortWithinPartitions("lang", "term")

    def gap(p, q):
        return (p - q) * (p - q) // q

    def extra(p, z, a=slice(None)):
        """terms x sources (of them a) x sources: the gap of each pair less what the histograms have put there."""
        x, y, pa_, za = p[:, None, :], z[:, None, :], p[:, a, None], z[:, a, None]
        return gap(pa_, x) - gap(pa_, y) - gap(za, x) + gap(za, y)

    def rows_of(lang, a, b, values):
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(values, pa.int64())],
            names=["lang", "source", "item", "value"],
        )

    def terms(batches):
        """Tables of whole terms of one language, and where each term begins."""
        held = None
        for batch in chain(batches, [None]):
            if batch is not None:
                own = pa.Table.from_batches([batch])
                held = own if held is None else pa.concat_tables([held, own])
            if held is None or not len(held):
                continue
            held = held.combine_chunks()
            lang, term = (held.column(c).combine_chunks() for c in ("lang", "term"))
            other = pc.not_equal(lang[1:], lang[:-1]).to_numpy(zero_copy_only=False)
            new = np.flatnonzero(np.r_[True, other | pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)])
            # The last term may go on in the next batch.
            end = len(held) if batch is None else int(new[-1])
            edges = [0, *(np.flatnonzero(other) + 1).tolist(), len(held)]
            for a, b in zip(edges, edges[1:], strict=False):
                b = min(b, end)
                if a < b:
                    yield lang[a].as_py(), held[a:b], np.append(new[(new >= a) & (new < b)] - a, b - a)
            held = held[end:]

    def run(batches):
        now, codes, sums = None, {}, None

        def flush():
            known = list(codes)
            for i, name in enumerate(known):
                at = np.flatnonzero(sums[i, : len(known)])
                if len(at):
                    yield rows_of(now, [name] * len(at), [known[j] for j in at.tolist()], sums[i, at])

        for lang, own, starts in terms(batches):
            source = own.column("source").combine_chunks().dictionary_encode()
            names = source.dictionary.to_pylist()
            p, z = (own.column(c).to_numpy() for c in ("p", "zero"))
            if len(names) > MATRIX:
                # Too many sources for a matrix: term by term, and row by row.
                which = source.indices.to_numpy()
                for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    here = [names[i] for i in which[a:b].tolist()]
                    for i, name in enumerate(here if b - a > 1 else []):
                        yield rows_of(lang, [name] * (b - a), here, extra(p[a:b][None], z[a:b][None], slice(i, i + 1))[0, 0])
                continue
            if lang != now or len(codes.keys() | set(names)) > MATRIX:
                yield from flush()
                now, codes, sums = lang, {}, np.zeros((0, 0), np.int64)
            at = np.array([codes.setdefault(s, len(codes)) for s in names])[source.indices.to_numpy()]
            if len(codes) > len(sums):
                wider = np.zeros((min(MATRIX, 2 * len(codes)),) * 2, np.int64)
                wider[: len(sums), : len(sums)] = sums
                sums = wider
            size = np.diff(starts)
            for k in np.unique(size[size > 1]).tolist():
                places = starts[:-1][size == k][:, None] + np.arange(k)
                some = max(1, CELLS // (k * k))
                for x in range(0, len(places), some):
                    here = places[x : x + some]
                    pair = at[here][:, :, None] * len(sums) + at[here][:, None, :]
                    np.add.at(sums.reshape(-1), pair.ravel(), extra(p[here], z[here]).ravel())
        yield from flush()

    sums = sorted_.mapInArrow(run, "lang string, source string, item string, value long")
    return sums.where(F.col("source") != F.col("item")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(
    docs: DataFrame, report: int = REPORT, text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from the others and from the language.

    Part ``pair``: the distance to every other source of the language; part ``term``: the ``report`` terms that a source
    uses more than its language does, by what each adds. Every sum and share is of whole numbers and exact.

    Null texts, languages and sources count as empty; a source without terms takes part, one of a language without kept
    terms has distance 0 from all others. Repeated rows count each time, more columns are ignored, ties go by the item's bytes, and
    an empty table gives an empty result.
    """
    given = [F.coalesce(column(docs, c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]
    body = F.coalesce(column(docs, text).cast("string"), F.lit("")).cast("binary").alias("text")
    counts = step(frequencies(docs.select(*given, body)))

    kept = counts.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("v"), F.sum("n").alias("all_n"))
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    groups = docs.select(*given).distinct().join(own, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("v", "all_n", "own_n")])
    zero = F.when(F.col("v") > 0, _share(F.lit(0), F.col("own_n"), F.col("v")))
    groups = step(groups.withColumn("zero", zero))

    shares = counts.join(groups, ["lang", "source"]).select(
        "lang", "term", "source", "zero",
        _share(F.col("n"), F.col("own_n"), F.col("v")).alias("p"), _share(F.col("total"), F.col("all_n"), F.col("v")).alias("q"),
    )
    shares = step(shares)

    # As if the other source had no term that this one has: one sum over the histogram of its shares.
    histogram = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("c"))
    histogram = histogram.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "c")).alias("bars"))
    mine = groups.where("v > 0").join(histogram, ["lang", "source"], "left")
    others = groups.where("v > 0").select("lang", F.col("source").alias("other"), F.col("zero").alias("z"))
    met = mine.join(others, "lang").where(F.col("source") != F.col("other"))
    base = F.col("v") * _gap(F.col("zero"), F.col("z"))

    def over(bars, value):
        bars = F.coalesce(bars, F.array().cast("array<struct<p:bigint,c:bigint>>"))
        return F.aggregate(bars, F.lit(0).cast("long"), lambda s, b: s + b["c"] * value(b["p"]))

    forth = base + over(F.col("bars"), lambda p: _gap(p, F.col("z")) - _gap(F.col("zero"), F.col("z")))
    back = over(F.col("bars"), lambda p: _gap(F.col("z"), p) - _gap(F.col("z"), F.col("zero")))
    both = F.explode(F.array(
        F.struct(F.col("source"), F.col("other").alias("item"), forth.alias("value")),
        F.struct(F.col("other").alias("source"), F.col("source").alias("item"), back.alias("value")),
    )).alias("sum")
    sums = met.select("lang", both).select("lang", "sum.*")
    bare = groups.where("v = 0").select("lang", "source").join(
        groups.where("v = 0").select("lang", F.col("source").alias("item")), "lang"
    ).where(F.col("source") != F.col("item"))
    pairs = sums.unionByName(corrections(shares)).unionByName(bare.withColumn("value", F.lit(0).cast("long")))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))

    terms = shares.where("p > q").select(
        "lang", "source", F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"), F.lit("term").alias("part")
    )
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    out = [pairs.withColumn("rank", F.row_number().over(order))]
    out.append(terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= report))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return out[0].select(*columns).unionByName(out[1].select(*columns))
