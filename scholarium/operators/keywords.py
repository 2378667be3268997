"""TF-IDF keywords of every cluster in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholarium.functions.text import STOP_WORDS, words, words_and_pairs
from scholarium.session import cut_lineage


#: Characters of text whose terms one task counts.
TEXT_PER_TASK = 2 << 20


def term_counts(members: DataFrame, stop_words: Sequence[str] = STOP_WORDS, text_per_task: int = TEXT_PER_TASK) -> DataFrame:
    """How often each member has each word and word pair: (cluster_id, paper_id, term, tf).

    Nearly every (member, term) is distinct, so sums before a shuffle would hold all terms of a task at once and save nothing.
    Members are dealt out by their key first, into as many parts as their text needs; a part counts its own terms.
    """
    text = F.concat(F.coalesce("title", F.lit("None")), F.lit(" "), F.coalesce("abstract", F.lit("None")))
    texts = members.select("cluster_id", "paper_id", text.alias("text"))
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    dealt = texts.repartition(int(size // text_per_task) + 1, "cluster_id", "paper_id")
    terms = dealt.select("cluster_id", "paper_id", F.explode(words_and_pairs(words(F.col("text"), stop_words))).alias("term"))
    return terms.groupBy("cluster_id", "paper_id", "term").agg(F.count("*").alias("tf"))


def cluster_keywords(
    members: DataFrame, n_keywords: int = 10, min_docs: int = 3, max_share: float = 0.7,
    stop_words: Sequence[str] = STOP_WORDS,
) -> DataFrame:
    """Top terms (words and word pairs) per cluster as (cluster_id, rank, term, score).

    ``members`` has (cluster_id, paper_id, title, abstract). Terms must occur in ``min_docs`` members
    and at most ``max_share`` of them. Members are weighted by raw counts times smoothed idf, scaled to
    length one; a term's score is its sum over the members. Counting happens per (cluster, term), so
    the size of a cluster does not matter.
    """
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("n_docs"))
    # Read twice below; texts are cut into terms once.
    tf = cut_lineage(term_counts(members, stop_words))
    df = (
        tf.groupBy("cluster_id", "term")
        .agg(F.count("*").alias("df"))
        .where(F.col("df") >= min_docs)
        .join(sizes, "cluster_id")
        .where(F.col("df") <= F.col("n_docs") * max_share)
    )
    weighted = tf.join(df, ["cluster_id", "term"]).select(
        "cluster_id",
        "paper_id",
        "term",
        (F.col("tf") * (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1)).alias("w"),
    )
    # The terms of one member are bounded by its text.
    scaled = weighted.groupBy("cluster_id", "paper_id").agg(
        F.collect_list(F.struct("term", "w")).alias("ts"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length")
    )
    scores = (
        scaled.select("cluster_id", "length", F.explode("ts").alias("t"))
        .groupBy("cluster_id", F.col("t.term").alias("term"))
        .agg(F.round(F.sum(F.col("t.w") / F.col("length")), 6).alias("score"))
    )
    w = Window.partitionBy("cluster_id").orderBy(F.desc("score"), "term")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n_keywords).select(
        "cluster_id", "rank", "term", "score"
    )


def keyword_lines(keywords: DataFrame, n: int = 3, separator: str = ", ") -> DataFrame:
    """First ``n`` keywords of each cluster as one text."""
    first = keywords.where(F.col("rank") <= n)
    listed = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return first.groupBy("cluster_id").agg(
        F.array_join(F.transform(listed, lambda x: x["term"]), separator).alias("keywords")
    )
