"""Prompt texts for a labelling model, and its answers: build, parse, check, zip back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANSWER = "label string, safety_relevance double"


def _joined(block: Column, order: str) -> Column:
    # Groups are bounded: one batch, or the few representatives of one cluster.
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b"))))
    return F.array_join(F.transform(ordered, lambda x: x["b"]), "\n\n")


def cluster_prompts(ranked: DataFrame, instructions: str, abstract_chars: int | None = None, n: int = 10) -> DataFrame:
    """One prompt per cluster from its first ``n`` rows by ``rank``.

    With ``abstract_chars``, rows are list items with a cut abstract, otherwise titled blocks.
    """
    if abstract_chars is None:
        block = F.concat(F.lit("Title: "), "title", F.lit("\nAbstract: "), "abstract", F.lit("..."))
    else:
        block = F.concat(F.lit("- "), "title", F.lit(": "), F.left("abstract", F.lit(abstract_chars)), F.lit("..."))
    head = F.lit(instructions + "\n\n")
    return (
        ranked.where(F.col("rank") <= n)
        .groupBy("cluster_id")
        .agg(F.concat(head, _joined(block, "rank")).alias("prompt"))
    )


def batch_prompts(batched: DataFrame, instructions: str) -> DataFrame:
    """One prompt per fixed-size batch of papers (columns ``batch``, ``position``)."""
    block = F.concat(F.lit("Title: "), "title", F.lit("\nAbstract: "), "abstract")
    return batched.groupBy("batch").agg(
        F.count("*").alias("n_items"),
        F.concat(F.lit(instructions + "\n\n"), _joined(block, "position")).alias("prompt"),
    )


def parse_cluster_answers(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Parse ``{label, safety_relevance}``; what does not fit gets a reason instead of values."""
    p = F.from_json(F.col(column), ANSWER)
    parsed = answers.withColumn("_p", p)
    score = F.col("_p.safety_relevance")
    reason = (
        F.when(F.col("_p").isNull() | (F.col("_p.label").isNull() & score.isNull()), F.lit("unreadable"))
        .when(F.col("_p.label").isNull(), F.lit("no label"))
        .when(score.isNull(), F.lit("no relevance"))
        .when((score < 0) | (score > 1), F.lit("relevance out of range"))
    )
    ok = reason.isNull()
    return parsed.select(
        *answers.columns,
        F.when(ok, F.col("_p.label")).alias("label"),
        F.when(ok, score).alias("safety_relevance"),
        reason.alias("rejected"),
    )


def parse_batch_answers(answers: DataFrame, column: str = "answer", expected: str = "n_items") -> DataFrame:
    """Parse an array of labels and check its length against the batch size."""
    parsed = answers.withColumn("labels", F.from_json(F.col(column), "array<string>"))
    reason = F.when(F.col("labels").isNull(), F.lit("unreadable")).when(
        F.size("labels") != F.col(expected), F.lit("wrong length")
    )
    return parsed.withColumn("rejected", reason)


def zip_answers(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Pair items (batch, pos, item) with an answer array per batch; the longer side is cut."""
    listed = answers.select("batch", F.posexplode("answers").alias("pos", "answer"))
    return items.join(listed, ["batch", "pos"]).select("batch", "pos", "item", "answer")
