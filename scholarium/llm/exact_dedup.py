"""Exact dedup with two passes over a Bloom filter of text hashes.

Pass one counts, per bit of a filter, whether one or several rows hit it. Pass two asks for each row
whether all its bits were hit more than once: only such rows can have a copy, only they shuffle, and
the rest pass straight through. The filter has 16 bits a row up to ``max_bits``; beyond that more rows
shuffle than need to, and the result stays the same.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarium.llm import bloom
from scholarium.llm.common import WHITE, column, free_names, step

PRINT = T.StructType([T.StructField("sha", T.BinaryType()), T.StructField("points", T.LongType())])


def _shas(texts: pa.Array) -> pa.Array:
    """SHA-256 of the texts without white space."""
    drop = WHITE.encode()
    return pa.array([hashlib.sha256((x or b"").translate(None, drop)).digest() for x in texts.cast(pa.binary()).to_pylist()], pa.binary())


def _points(texts: pa.Array) -> pa.Array:
    """Code points of the texts as they are."""
    return pc.utf8_length(pc.fill_null(texts, "")).cast(pa.int64())


@F.arrow_udf(PRINT)
def fingerprint(texts: pa.Array) -> pa.Array:
    """SHA-256 of the text without white space, and the code points of the text as it is."""
    return pa.StructArray.from_arrays([_shas(texts), _points(texts)], names=["sha", "points"])


def _keys(shas: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join([x[:8] for x in shas.to_pylist()]), "<u8")


def _repeated(rows: DataFrame, max_bits: int, shas):
    """The broadcast filter of what several of ``rows`` may have in common; ``shas`` makes hashes of its only column."""
    size = bloom.size_for(rows.count(), max_bits)
    found = bloom.build(rows, size, twice=True, keys_of=lambda batch: _keys(shas(batch.column(0))))
    return rows.sparkSession.sparkContext.broadcast(found)


def maybe_repeated(hashes: DataFrame, max_bits: int = bloom.MAX_BITS):
    """A function from a hash column to a flag: false is certain, true may be wrong. ``hashes`` has the column sha."""
    shared = _repeated(hashes.select("sha"), max_bits, lambda shas: shas)

    @F.arrow_udf("boolean")
    def flag(shas: pa.Array) -> pa.Array:
        return pa.array(shared.value.has(_keys(shas)), pa.bool_())

    return flag


def _order(points: Column, key: Column, *rest: Column) -> Column:
    """Longest original first, then the smallest id; rows without an id come last."""
    return F.struct((-points).alias("a"), key.isNull().alias("b"), key.alias("c"), *rest)


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = bloom.MAX_BITS) -> DataFrame:
    """One row per document: (key, keep_id, group_size, kept, text_sha256).

    Texts are equal when they agree without white space; null counts as empty. The longest original
    stays, then the smallest id (null ids last). Of rows that repeat with the same id exactly one is kept. An
    empty table gives an empty result.
    """
    doc = docs.select(column(docs, key).alias("id"), fingerprint(column(docs, text)).alias("f"))
    prints = step(doc.select("id", "f.sha", "f.points", F.monotonically_increasing_id().alias("row")))
    flagged = prints.withColumn("maybe", maybe_repeated(prints, max_bits)("sha"))
    some = flagged.where("maybe").drop("maybe")
    # Written, so that the join below meets two plain tables and a large group can be split.
    groups = step(some.groupBy("sha").agg(
        F.min(_order(F.col("points"), F.col("id"), F.col("row"))).alias("w"), F.count("*").alias("group_size")
    ))
    found = some.join(groups, "sha").select(
        "id", F.col("w.c").alias("keep_id"), "group_size", (F.col("row") == F.col("w.row")).alias("kept"), "sha"
    )
    alone = flagged.where(~F.col("maybe")).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    return found.unionByName(alone).select(
        F.col("id").alias(key), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = bloom.MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, all their columns unchanged.

    Rows that cannot have a copy go straight to the output. Possible copies are reduced to the best row of
    each hash before and after the shuffle, so a text that a third of all rows share is combined in every task.
    """
    (f,) = free_names(docs, "f")
    shared = _repeated(docs.select(column(docs, text).alias("text")), max_bits, _shas)

    @F.arrow_udf(T.StructType([*PRINT, T.StructField("maybe", T.BooleanType())]))
    def marked(texts: pa.Array) -> pa.Array:
        shas = _shas(texts)
        maybe = pa.array(shared.value.has(_keys(shas)), pa.bool_())
        return pa.StructArray.from_arrays([shas, _points(texts), maybe], names=["sha", "points", "maybe"])

    # Hash and flag in one call, which the filters below must not repeat: every call in a plan takes a worker of its own per task.
    tagged = docs.withColumn(f, marked.asNondeterministic()(column(docs, text)))
    maybe = F.col(f"{f}.maybe")
    row = F.struct(*[column(docs, c) for c in docs.columns])
    order = _order(F.col(f"{f}.points"), column(docs, key), F.xxhash64(*[column(docs, c) for c in docs.columns]).alias("h"))
    best = tagged.where(maybe).groupBy(F.col(f"{f}.sha")).agg(F.min_by(row, order).alias("row"))
    return tagged.where(~maybe).select(*docs.columns).unionByName(best.select("row.*"))
