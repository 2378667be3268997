"""Near-duplicates by order MinHash, verified by banded alignment.

A sketch takes the few smallest of a text's five-word shingles under one hash, each shingle labelled by its occurrence,
and keeps them in the order of the text: it agrees for two texts only if they share those shingles in that
order, which follows edit similarity more closely than sets do. Texts that share two sketches close in number are
candidates. The members of such a band are aligned with a leader rather than with each other. Where all of a band are linked by
then it is done. In the other bands members that are not linked are compared by all their sketches, in blocks of bounded
size, and those that agree in a few more are aligned.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarium.llm import bloom
from scholarium.llm.alignment import distance
from scholarium.llm.common import column, free_names, release, step, steps
from scholarium.llm.components import components

WORD = re.compile(r"\w+")
SHINGLE = 5
#: Shingles in a sketch, and sketches. Texts of shingle similarity s agree in a sketch with probability about s to the power of KEPT.
KEPT, SKETCHES = 2, 32
#: A band is a sketch and one of the next few.
STEPS = 3
#: Sketches, and smallest shingles alone, that members of an unfinished band must share to be aligned.
AGREE, AGREE_FIRST = 4, 10
#: Members of a band that are compared with as many others at once.
BLOCK_ROWS = 500
#: 1 - edits / words of the longer text.
SIMILARITY = 0.8
#: Ranks that are computed at once, to stay in the processor's cache.
CELLS = 1 << 15
CACHE_WORDS = 200_000

HIGH = np.uint64(0xFFFFFFFF00000000)

_rng = np.random.default_rng(20)
SEEDS = _rng.integers(0, 1 << 63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Numbers(dict):
    """Words as numbers, remembered."""

    def __missing__(self, word: str) -> int:
        n = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return n


def word_ids(text: str | None, known: Numbers) -> np.ndarray:
    """Lower-case words as numbers; the characters of a text that has no word."""
    words = WORD.findall((text or "").lower()) or "".join((text or "").split())
    return np.array([known[w] for w in words], np.uint32)


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the runs of five words, each labelled with how often it has occurred before; one hash for a shorter text."""
    k = min(SHINGLE, len(words))
    x, h = words.astype(np.uint64), np.zeros(max(1, len(words) - k + 1), np.uint64)
    for j in range(k):
        h = _mix(h + x[j : len(x) - k + 1 + j])
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.r_[True, s[1:] != s[:-1]]
    if not new.all():
        start = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
        seen = np.empty(len(s), np.uint64)
        seen[order] = (np.arange(len(s)) - start).astype(np.uint64)
        h = np.where(seen > 0, _mix(h + seen), h)
    return h


def sketches(words: np.ndarray) -> np.ndarray:
    """The sketches of a text, a number each, and after them the smallest shingle of each and its place (32 bits each)."""
    h = shingles(words)
    out, first = np.zeros(len(SEEDS), np.uint64), np.zeros(len(SEEDS), np.uint64)
    step_ = max(1, CELLS // len(h))
    kept = min(KEPT, len(h))
    for a in range(0, len(SEEDS), step_):
        seeds = SEEDS[a : a + step_]
        rank = h[None, :] * seeds[:, None]
        rows, picks = np.arange(len(seeds)), []
        for _ in range(kept):
            i = rank.argmin(axis=1)
            picks.append(i)
            rank[rows, i] = np.uint64(0xFFFFFFFFFFFFFFFF)
        sketch = seeds.copy()
        for i in np.sort(np.stack(picks), axis=0):
            sketch = _mix(sketch + h[i])
        out[a : a + step_] = sketch
        first[a : a + step_] = (h[picks[0]] & HIGH) | picks[0].astype(np.uint64)
    return np.concatenate([out, first]).view(np.int64)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """Numbers of all bands of some texts: texts x sketches x steps, from texts x sketches."""
    x = sketch.astype(np.int64).view(np.uint64)
    return np.stack([_mix(_mix(x + np.uint64(j)) + np.roll(x, -j, axis=1)) for j in range(1, STEPS + 1)], axis=2)


def sketched(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, row, seq, n, words, sketch) of every row; seq names the word sequence, and a text without words has no sketch."""
    rows = docs.select(column(docs, key).alias("id"), F.monotonically_increasing_id().alias("row"), column(docs, text).alias("text"))
    schema = T.StructType([
        rows.schema["id"], T.StructField("row", T.LongType()), T.StructField("seq", T.BinaryType()), T.StructField("n", T.IntegerType()),
        T.StructField("words", T.BinaryType()), T.StructField("sketch", T.ArrayType(T.LongType())),
    ])

    def run(batches):
        known = Numbers()
        with np.errstate(over="ignore"):
            for batch in batches:
                if len(known) > CACHE_WORDS:
                    known.clear()
                ids = [word_ids(t, known) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("row"),
                     pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in ids], pa.binary()),
                     pa.array([len(x) for x in ids], pa.int32()), pa.array([x.tobytes() for x in ids], pa.binary()),
                     pa.array([sketches(x) if len(x) else None for x in ids], pa.list_(pa.int64()))],
                    names=schema.names,
                )

    return rows.mapInArrow(run, schema)


def _limit(n: Column, m: Column) -> Column:
    return F.floor(F.greatest(n, m) * (1 - SIMILARITY) + 1e-9).cast("int")


def _among(named: DataFrame) -> Callable[[str], Column]:
    """Whether a row is in ``named(row)``, as a column; a filter of bounded size, which may be wrong only where it says yes."""
    known = bloom.build(named, bloom.size_for(named.count()), twice=False)
    shared = named.sparkSession.sparkContext.broadcast(known)

    @F.arrow_udf("boolean")
    def among(rows: pa.Array) -> pa.Array:
        return pa.array(shared.value.has(rows.to_numpy(zero_copy_only=False).view(np.uint64)), pa.bool_())

    return among


def _only(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """The texts that ``pairs`` mention, and few others: the rest is kept out of the shuffle."""
    named = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct()
    return words.where(_among(named)("row"))


def _one_of_each(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """(row, n, sketch) of the first row of every word sequence. Only rows that may be a later one are shuffled."""
    repeated = firsts.where("copies > 1").select("seq", "first")
    later = step(rows.select("seq", "row").join(repeated, "seq").where(F.col("row") != F.col("first")).select("row"))
    marked = rows.select("row", "n", "sketch", _among(later)("row").alias("unsure"))
    unsure = marked.where("unsure").drop("unsure").join(later, "row", "left_anti")
    return marked.where(~F.col("unsure")).drop("unsure").unionByName(unsure)


def near(x: bytes, y: bytes) -> bool:
    """Whether the edit similarity of two texts, as stored words, reaches the threshold."""
    x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
    limit = int(max(len(x), len(y)) * (1 - SIMILARITY) + 1e-9)
    return distance(x, y, limit) <= limit


def near_pairs(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """``pairs(a, b)`` of rows, with near: whether their edit similarity reaches the threshold."""
    words = _only(words, pairs)
    left = words.select(F.col("row").alias("a"), F.col("words").alias("wa"))
    right = words.select(F.col("row").alias("b"), F.col("words").alias("wb"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "wa", "wb")

    def run(batches):
        for batch in batches:
            found = []
            for x, y in zip(batch.column("wa").to_pylist(), batch.column("wb").to_pylist(), strict=True):
                found.append(near(x, y))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.bool_())], names=["a", "b", "near"])

    return both.mapInArrow(run, "a long, b long, near boolean")


def _matrix(batch) -> np.ndarray:
    return batch.column("sketch").flatten().to_numpy(zero_copy_only=False).reshape(-1, 2 * SKETCHES)


def _keys(batch) -> np.ndarray:
    with np.errstate(over="ignore"):
        return band_keys(_matrix(batch)[:, :SKETCHES]).ravel()


def _members(texts: DataFrame) -> DataFrame:
    """(band, row) where the band may have another member; a filter of bounded size keeps out the others."""
    with_sketch = texts.where("sketch IS NOT NULL")
    size = bloom.size_for(with_sketch.count() * SKETCHES * STEPS)
    known = bloom.build(with_sketch.select("sketch"), size, twice=True, keys_of=_keys)
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                keys = band_keys(_matrix(batch)[:, :SKETCHES]).reshape(batch.num_rows, -1)
                hit = np.flatnonzero(shared.value.has(keys.ravel()))
                rows = batch.column("row").take(pa.array(hit // keys.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()[hit].view(np.int64)), rows], names=["band", "row"])

    return with_sketch.select("row", "sketch").mapInArrow(run, "band long, row long")


def _renamed(state: DataFrame, roots: DataFrame) -> DataFrame:
    """``state`` with its components renamed by ``roots(node, root)`` where these name them."""
    joined = state.join(roots, F.col("comp") == F.col("node"), "left")
    return joined.withColumn("comp", F.coalesce("root", "comp")).drop("node", "root")


def _late_links(state: DataFrame) -> DataFrame:
    """Near pairs (a, b) of ``state(bands, row, n, comp, sketch, words)``: rows of a band and of different components.

    Pairs of like lengths that agree in more sketches are aligned on the spot, each in the first band that it shares.
    A band is cut into blocks; each pair of blocks is one piece of work of bounded size, whatever the size of the band.
    """
    listed = state.select(F.explode("bands").alias("band"), "row")
    sizes = step(listed.groupBy("band").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks")))
    # A row has few bands and is sent along once with all of them; only the explosion below repeats it.
    placed = listed.join(sizes, "band").groupBy("row").agg(F.collect_list(F.struct("band", "blocks")).alias("placed"))
    cut = state.drop("bands").join(placed, "row").withColumn("p", F.explode("placed")).select("*", "p.*")
    cut = cut.withColumn("own", F.pmod(F.xxhash64("row", "band"), F.col("blocks")))
    # The rows of block x go to the pairs (x, y) and (y, x) of blocks, the smaller number first.
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select(
        "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "row", "n", "comp", "sketch", "words"
    ).repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "row")

    def pairs(band, i, j, own, row, n, comp, sketch, words):
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        for at in left.tolist():
            others = right[row[right] > row[at]] if i == j else right
            longer = np.maximum(n[others], n[at])
            others = others[(comp[others] != comp[at]) & (np.abs(n[others] - n[at]) <= longer * (1 - SIMILARITY) + 1e-9)]
            if not len(others):
                continue
            same = sketch[others, :SKETCHES] == sketch[at, :SKETCHES]
            one, two = sketch[others, SKETCHES:], sketch[at, SKETCHES:]
            # What two near texts share stands at places that differ by the edits at most.
            longer = np.maximum(n[others], n[at])[:, None]
            moved = np.abs((one & 0xFFFFFFFF) - (two & 0xFFFFFFFF)) <= longer * (1 - SIMILARITY) + 1
            first = ((one >> 32) == (two >> 32)) & moved
            agree = (same.sum(axis=1) >= AGREE) & (first.sum(axis=1) >= AGREE_FIRST)
            hit, same = others[agree], same[agree]
            if len(hit):
                shared = np.stack([same & np.roll(same, -k, axis=1) for k in range(1, STEPS + 1)], axis=2).reshape(len(hit), -1)
                keys = band_keys(sketch[at : at + 1, :SKETCHES]).ravel().view(np.int64)
                hit = hit[keys[shared.argmax(axis=1)] == band]
                hit = hit[[near(words[at], words[x]) for x in hit.tolist()]] if len(hit) else hit
                yield np.full(len(hit), row[at]), row[hit]

    def run(batches):
        held = None
        names = ["band", "i", "j", "own", "row", "n", "comp"]

        def found(group):
            band, i, j, *rest = group
            with np.errstate(over="ignore"):
                yield from pairs(band[0], i[0], j[0], *rest)

        def emit(parts):
            a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names] + [_matrix(batch)]
            cols.append(batch.column("words").to_numpy(zero_copy_only=False))
            if held is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            new = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
            edges = [0, *new.tolist()]
            parts = [p for x, y in zip(edges, edges[1:], strict=False) for p in found([c[x:y] for c in cols])]
            held = [c[edges[-1] :] for c in cols]
            if parts:
                yield emit(parts)
        if held is not None and len(held[0]):
            parts = list(found(held))
            if parts:
                yield emit(parts)

    return met.mapInArrow(run, "a long, b long")


def near_components(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(node, root) of the rows of ``texts(row, n, sketch)`` that are linked to another one; their word sequences all differ."""
    members = step(_members(texts))
    leaders = step(members.groupBy("band").agg(F.min("row").alias("a"), F.count("*").alias("c")).where("c > 1").select("band", "a"))
    met = members.join(leaders, "band").where(F.col("row") != F.col("a"))
    tried = step(near_pairs(step(met.select("a", F.col("row").alias("b")).distinct()), words))
    before = len(steps())
    roots = step(components(tried.where("near").select("a", "b")))
    release(tried.sparkSession, steps()[before:-1])
    # Bands whose leader is far from a member, and not linked with it by others, are not finished.
    sides = tried.where(~F.col("near")).select("a", "b", F.col("a").alias("comp"))
    sides = _renamed(sides, roots).select("a", "b", F.col("comp").alias("left"), F.col("b").alias("comp"))
    apart = step(_renamed(sides, roots).where(F.col("left") != F.col("comp")).select("a", F.col("b").alias("row")))
    rest = step(met.join(apart, ["a", "row"]).select("band").distinct())
    # One record for each row, with its at most SKETCHES * STEPS bands, meets the sketches and the words.
    state = members.join(rest, "band").groupBy("row").agg(F.collect_list("band").alias("bands"))
    state = _renamed(state.withColumn("comp", F.col("row")), roots).join(texts, "row")
    state = step(state.select("bands", "row", "n", "comp", "sketch"))
    named = state.select(F.col("row").alias("a"), F.col("row").alias("b"))
    more = step(_late_links(state.join(_only(words, named), "row")))
    if more.isEmpty():
        return roots
    before = len(steps())
    roots = step(components(tried.where("near").select("a", "b").unionByName(more)))
    release(tried.sparkSession, steps()[before:-1])
    return roots


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (key, class_id, class_size, kept), and the row's own number and word sequence.

    Documents are in one class if links of edit similarity 0.8 or more over words connect them; the class is named by its
    smallest id and the row of that id stays (null ids come last; of repeated rows the first). Texts without words
    compare by their characters; null and empty texts are equal to each other.
    """
    before = len(steps())
    rows = step(sketched(docs, key, text))
    firsts = step(rows.groupBy("seq").agg(F.min("row").alias("first"), F.count("*").alias("copies")))
    texts = step(_one_of_each(rows, firsts))
    roots = near_components(texts, rows.select("row", "words")).select(F.col("node").alias("first"), "root")
    named = step(
        rows.select("id", "row", "seq").join(firsts, "seq").join(roots, "first", "left")
        .select("id", "row", "seq", F.coalesce("root", "first").alias("root"))
    )
    release(docs.sparkSession, steps()[before:-1])
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    # Written, so that the join below meets two plain tables and a large class can be split.
    classes = step(named.groupBy("root").agg(F.min(order).alias("w"), F.count("*").alias("class_size")))
    return named.join(classes, "root").select(
        F.col("id").alias(key), F.col("w.id").alias("class_id"), "class_size", (F.col("row") == F.col("w.row")).alias("kept"),
    )


def without_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with their columns unchanged."""
    tag, again = free_names(docs, "mark", "again")
    # A row is recognised by all its columns; rows that agree in all of them are one document.
    names = [column(docs, c) for c in docs.columns]
    own = F.concat_ws("-", F.xxhash64(*names), F.xxhash64(F.lit(1), *names))
    marked = docs.withColumn(tag, own)
    classes = step(near_classes(marked.select(F.struct(column(docs, key).alias("k"), F.col(tag).alias("m")).alias("id"), column(docs, text).alias("text")), "id", "text"))
    keep = step(classes.where("kept").select(F.col("id.m").alias(tag)))
    repeated = classes.groupBy(F.col("id.m").alias(again)).agg(F.count("*").alias("c")).where("c > 1").select(again)
    out = marked.join(keep, tag, "left_semi")
    if not repeated.isEmpty():
        twins = out.join(repeated, F.col(tag) == F.col(again), "left_semi").dropDuplicates([tag])
        out = out.join(repeated, F.col(tag) == F.col(again), "left_anti").unionByName(twins)
    return out.select(*docs.columns)
