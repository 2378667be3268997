"""Removal of long repeated strings, a suffix-array dedup by distributed prefix doubling.

A position stands for the string of ``length`` bytes that starts there. Ranks of positions are refined at growing
lengths: the rank of a longer prefix is the pair of the ranks of two shorter ones at an offset, Spark sorts the
pairs, and positions whose rank is unique leave, until the threshold is reached. Two things keep that small:

* A rank is a fingerprint of the prefix, which every task computes by itself, in place of its place in the sorted order.
* Positions enter in runs. The run of a position is set by the smallest of the ``SEED``-byte prefixes inside its string, so equal
  strings lie at equal places of runs with an equal seed. Ranks at the length of the seed decide about whole runs; runs that
  are left are cut into blocks, ranked at nearly the full length, and only blocks left over are looked at position by position.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarium.llm import bloom
from scholarium.llm.common import column, step

LENGTH = 400
SEED = 128
BLOCK = 16
#: Starts that are worked on at once in a long text.
CHUNK = 1 << 19

_rng = np.random.default_rng(4)
_U = np.uint64
_BYTES = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_BASE = [int(x) * 8 + 5 for x in _rng.integers(1, 1 << 59, 2)]
_TAIL = _U((1 << 20) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of both bases and of their inverses, made once per worker."""

    up: list[np.ndarray] = []
    down: list[np.ndarray] = []

    @classmethod
    def get(cls):
        if not cls.up:
            n = CHUNK + 4 * LENGTH
            cls.up = [_powers(b, n) for b in _BASE]
            cls.down = [_powers(pow(b, -1, 1 << 64), n) for b in _BASE]
        return cls.up, cls.down


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    return (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)


class Ranks:
    """Fingerprints of any strings of a piece of text; equal strings have equal ones, in whatever text they stand."""

    def __init__(self, data: np.ndarray, both: bool = True):
        up, self.down = Powers.get()
        self.sums = []
        for t in range(2 if both else 1):
            s = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_BYTES[t][data] * up[t][: len(data)], out=s[1:])
            self.sums.append(s)

    def of(self, start: np.ndarray, end: np.ndarray, t: int = 0) -> np.ndarray:
        return _mix((self.sums[t][end] - self.sums[t][start]) * self.down[t][start])


def _windows(n: int, length: int):
    """Chunks (first start, number of starts) of a text of n bytes."""
    for a in range(0, n - length + 1, CHUNK):
        yield a, min(CHUNK, n - length + 1 - a)


def runs(data: np.ndarray, length: int, both: bool = True):
    """Runs of a text: (rank of the seed, start, end, place of the seed, ranks of the whole run); start and end inclusive."""
    width = length - SEED + 1
    for a, n in _windows(len(data), length):
        piece = data[a : a + n + length - 1]
        ranks = Ranks(piece, both)
        at = np.arange(len(piece) - SEED + 1)
        seeds = ranks.of(at, at + SEED)
        # The low bits carry the place, so the smallest value also says where it stands.
        marked = (seeds & ~_TAIL) | at.astype(np.uint64)
        pad = np.full(-len(marked) % width, ~_U(0))
        rows = np.concatenate([marked, pad]).reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & _TAIL).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:], n] - 1
        place = place[first]
        yield seeds[place], first + a, last + a, place + a, ranks.of(first, last + length), (
            ranks.of(first, last + length, 1) ^ _mix((place - first).astype(np.uint64)) if both else None
        )


def _texts(batch, length: int):
    for i, t in enumerate(batch.column("text").to_pylist()):
        if t and len(data := np.frombuffer(t.encode(), np.uint8)) >= length:
            yield i, data


def _seed_keys(length: int):
    def keys(batch) -> np.ndarray:
        with np.errstate(over="ignore"):
            found = [r[0] for _, data in _texts(batch, length) for r in runs(data, length, both=False)]
        return np.concatenate(found) if found else np.zeros(0, np.uint64)

    return keys


PIECE = "t1 long, t2 long, s long, e long, m long, key long, c1 long, c2 long, weight long"


def _batch(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=names)


def _run_rows(docs: DataFrame, known: bloom.Filter, length: int) -> DataFrame:
    """Runs whose seed may occur more than once."""
    shared = docs.sparkSession.sparkContext.broadcast(known)
    names = [x.split()[0] for x in PIECE.split(", ")]

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                own = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("t1", "t2")]
                parts = []
                for i, data in _texts(batch, length):
                    for seeds, s, e, m, c1, c2 in runs(data, length):
                        ok = shared.value.has(seeds)
                        k = int(ok.sum())
                        parts.append([np.full(k, own[0][i]), np.full(k, own[1][i]), s[ok], e[ok], m[ok],
                                      seeds[ok].view(np.int64), c1[ok].view(np.int64), c2[ok].view(np.int64), np.ones(k, np.int64)])
                if parts:
                    yield _batch([np.concatenate(x) for x in zip(*parts, strict=True)], names)

    return docs.mapInArrow(run, PIECE)


def _ranked(pieces: DataFrame, more: list[str]) -> tuple[DataFrame, DataFrame]:
    """Split ranked pieces: those that occur again as they are, as spans, and one of each kind that may still in part.

    Kinds are (c1, c2). A kind is open if its key, a rank at a smaller length, also belongs to another kind.
    """
    kept = ["t1", "t2", "s", "e", "m", "key", *more]
    kinds = step(pieces.groupBy("c1", "c2").agg(F.sum("weight").alias("weight"), F.min(F.struct(*kept)).alias("one")))
    again = kinds.where("weight > 1").select("c1", "c2")
    spans = pieces.join(again, ["c1", "c2"]).select("t1", "t2", "s", "e")
    several = kinds.groupBy(F.col("one.key").alias("key")).agg(F.count("*").alias("n")).where("n > 1").select("key")
    rest = kinds.select("c1", "c2", F.when(F.col("weight") > 1, 2).otherwise(1).alias("weight"), "one.*").join(several, "key")
    return spans, rest


def _spot(t1: np.ndarray, t2: np.ndarray, s: np.ndarray) -> np.ndarray:
    """A number for a place in a text."""
    t1, t2, s = (np.asarray(x, np.int64).view(np.uint64) for x in (t1, t2, s))
    return _mix(t1 * _U(3) + t2) + _mix(s + _U(1))


def _spots(batch) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _spot(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("t1", "t2", "s")))


def _with_bytes(docs: DataFrame, rest: DataFrame, length: int) -> DataFrame:
    """Add the bytes of the open runs, in one pass over the texts; a filter of bounded size picks the runs."""
    known = bloom.build(rest.select("t1", "t2", "s"), bloom.size_for(rest.count()), twice=False, keys_of=_spots)
    shared = docs.sparkSession.sparkContext.broadcast(known)
    spots = docs.select("t1", "t2", "text")

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                t1, t2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("t1", "t2"))
                rows = []
                for i, data in _texts(batch, length):
                    for _, s, e, *_ in runs(data, length, both=False):
                        ok = np.flatnonzero(shared.value.has(_spot(t1[i], t2[i], s)))
                        rows += [(t1[i], t2[i], int(s[k]), data[s[k] : e[k] + length].tobytes()) for k in ok]
                if rows:
                    a, b, s, raw = zip(*rows, strict=True)
                    yield _batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.int64()), pa.array(raw, pa.binary())], ["t1", "t2", "s", "raw"])

    found = spots.mapInArrow(run, "t1 long, t2 long, s long, raw binary")
    # Copies of a text hand in the same runs; one of each stays.
    return rest.join(found.dropDuplicates(["t1", "t2", "s"]), ["t1", "t2", "s"])


def _block_rows(open_runs: DataFrame, length: int) -> DataFrame:
    """Cut open runs into blocks of starts at fixed places from the seed.

    The key is the pair of the ranks of the two halves of what all strings of a whole block share.
    """
    names = [x.split()[0] for x in PIECE.split(", ")] + ["run"]

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                rows = []
                cols = [batch.column(c).to_pylist() for c in ("t1", "t2", "s", "e", "m", "weight", "key", "raw")]
                for t1, t2, s, e, m, weight, key, raw in zip(*cols, strict=True):
                    ranks = Ranks(np.frombuffer(raw, np.uint8))
                    block = np.arange((s - m) // BLOCK, (e - m) // BLOCK + 1)
                    lo, hi = np.maximum(s, m + block * BLOCK), np.minimum(e, m + block * BLOCK + BLOCK - 1)
                    core = m + block * BLOCK + BLOCK - 1 - s, m + block * BLOCK + length - s
                    half = (core[1] - core[0] + 1) // 2
                    pair = _mix(ranks.of(core[0], core[0] + half)) + ranks.of(core[1] - half, core[1])
                    pair = _mix(pair ^ _mix((block + (1 << 20)).astype(np.uint64) + _U(key & (1 << 64) - 1)))
                    place = _mix((lo - m + (1 << 20)).astype(np.uint64))
                    c1 = ranks.of(lo - s, hi + length - s) + place
                    c2 = ranks.of(lo - s, hi + length - s, 1) ^ place
                    for k in range(len(block)):
                        rows.append((t1, t2, int(lo[k]), int(hi[k]), m, pair[k], c1[k], c2[k], weight, s))
                if rows:
                    t = list(zip(*rows, strict=True))
                    ints = [pa.array(x, pa.int64()) for x in t[:5]]
                    hashes = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in t[5:8]]
                    yield _batch([*ints, *hashes, pa.array(t[8], pa.int64()), pa.array(t[9], pa.int64())], names)

    return open_runs.mapInArrow(run, f"{PIECE}, run long")


def _position_rows(open_blocks: DataFrame, open_runs: DataFrame, length: int) -> DataFrame:
    """Every start of the open blocks, ranked at the full length as the pair of its halves' ranks."""
    raw_runs = open_runs.select("t1", "t2", F.col("s").alias("run"), "raw")
    rows = open_blocks.join(raw_runs, ["t1", "t2", "run"]).select("t1", "t2", "run", "s", "e", "weight", "raw")
    names = [x.split()[0] for x in PIECE.split(", ")]

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                parts = []
                cols = [batch.column(c).to_pylist() for c in ("t1", "t2", "run", "s", "e", "weight", "raw")]
                for t1, t2, start, s, e, weight, raw in zip(*cols, strict=True):
                    raw = raw[s - start : e + length - start]
                    ranks, at = Ranks(np.frombuffer(raw, np.uint8)), np.arange(e - s + 1)
                    half = length // 2
                    ends = [_mix(ranks.of(at, at + half, t)) + ranks.of(at + length - half, at + length, t) for t in (0, 1)]
                    n = len(at)
                    parts.append([np.full(n, t1), np.full(n, t2), at + s, at + s, at + s, ends[0].view(np.int64),
                                  ends[0].view(np.int64), ends[1].view(np.int64), np.full(n, weight)])
                if parts:
                    yield _batch([np.concatenate(x) for x in zip(*parts, strict=True)], names)

    return rows.mapInArrow(run, PIECE)


def repeated_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(t1, t2, s, e): starts s..e of strings in ``texts(t1, t2, text)`` that start elsewhere too; (t1, t2) names a text."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    seeds = bloom.build(texts.select("text"), bloom.size_for(2 * size // (length - SEED)), twice=True, keys_of=_seed_keys(length))
    whole, rest = _ranked(step(_run_rows(texts, seeds, length)), [])
    open_runs = step(_with_bytes(texts, step(rest), length))
    by_block, left = _ranked(step(_block_rows(open_runs, length)), ["run"])
    by_position, _ = _ranked(step(_position_rows(left, open_runs, length)), [])
    return whole.unionByName(by_block).unionByName(by_position)


def _cover(spans: list[dict], length: int) -> list[tuple[int, int]]:
    """Disjoint byte ranges, from overlapping ranges of starts."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e + length)
        else:
            out.append([s, e + length])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept): each text without the bytes that a repeated string covers; kept is binary.

    Strings are judged on the texts as they come in; overlapping occurrences count, within a text as well. Null texts
    are empty. Every row is judged, so rows that repeat lose all strings of ``length`` bytes. An empty table gives no row.
    """
    t = F.coalesce(column(docs, text), F.lit(""))
    rows = docs.select(column(docs, key).alias("id"), t.alias("text"))
    rows = rows.withColumn("t1", F.xxhash64("text")).withColumn("t2", F.xxhash64(F.lit(7), "text"))
    spans = repeated_spans(rows.select("t1", "t2", "text"), length)
    lists = spans.distinct().groupBy("t1", "t2").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    lists = step(lists).select(F.col("t1").alias("x1"), F.col("t2").alias("x2"), "spans")
    joined = rows.join(lists, (F.col("t1") == F.col("x1")) & (F.col("t2") == F.col("x2")), "left").select("id", "text", "spans")
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for t, spans_ in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw, at, kept = t.encode(), 0, []
                cuts = _cover(spans_ or [], length)
                for a, b in cuts:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                kept = b"".join(kept)
                out.append((len(raw), len(raw) - len(kept), len(cuts), kept))
            n, gone, count, kept = zip(*out, strict=True) if out else ((), (), (), ())
            longs = [pa.array(x, pa.int64()) for x in (n, gone, count)]
            yield _batch([batch.column("id"), *longs, pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    done = joined.mapInArrow(run, f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.withColumnRenamed("id", key)
