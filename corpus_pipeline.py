"""A training corpus from raw documents: toxic texts out, copies out, near copies out, sources mixed, windows packed.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns rows with the columns of
``documents``; the last one returns the pieces of the packed windows. A stage's rows are written and read again before the
next one begins, which therefore first removes what its predecessors have left in the working folder.

Null and empty texts are documents like others (one of them stays, with the first row of their class); repeated rows are copies,
null ids and sources take part, more columns travel along, and an empty table gives an empty result in every stage.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scholarium.llm.common import kept_step, release, short_batches, steps, table
from scholarium.llm.exact_dedup import without_copies
from scholarium.llm.mixing import mixed_rows, quality_weights
from scholarium.llm.near_dedup import without_near_copies
from scholarium.llm.packing import pack
from scholarium.llm.toxicity import clean_rows

#: Steps that the last stage has left; its rows read them until they are written.
_left: list[str] = []


def stage(first: bool = False):
    """A stage that begins by removing what its predecessor has left."""

    def wrap(fn: Callable) -> Callable:
        @functools.wraps(fn)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            if not first:
                release(spark, [p for p in _left if p in steps()])
            before = len(steps())
            out = fn(spark, docs, sf_dir)
            _left[:] = steps()[before:]
            return out

        return run_stage

    return wrap


TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@stage(first=True)
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    return clean_rows(docs, table(spark, sf_dir, "labels"))


@stage()
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    short_batches(spark)
    return without_copies(docs)


@stage()
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    short_batches(spark)
    return without_near_copies(docs)


@stage()
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of the sources takes it."""
    return mixed_rows(docs, quality=quality_weights(table(spark, sf_dir, "labels")))


@stage()
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents, each with its place in a window and its token ids."""
    short_batches(spark)
    return pack(docs, TOKENIZER)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: The classifier and the tokenizer have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = kept_step(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
