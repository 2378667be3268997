"""Clusters as tables: members, sizes, labels, pairs, top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholarium.functions.text import cluster_display

NOISE = -1


def clustered(artifacts: DataFrame, trial_id: int) -> DataFrame:
    """Rows of one trial that belong to a cluster."""
    return artifacts.where((F.col("trial_id") == trial_id) & (F.col("cluster_id") != NOISE))


def members_with_text(artifacts: DataFrame, papers: DataFrame, trial_id: int) -> DataFrame:
    """Cluster members with the columns of their paper."""
    p = papers.withColumnRenamed("id", "paper_id")
    return clustered(artifacts, trial_id).join(p, "paper_id")


def top_members(members: DataFrame, n: int) -> DataFrame:
    """The ``n`` most probable members per cluster, with their rank.

    The rank filter is applied before the shuffle as well, so a huge cluster ships ``n`` rows per task.
    """
    w = Window.partitionBy("cluster_id").orderBy(F.desc("cluster_prob"), "paper_id")
    return members.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def cluster_sizes(artifacts: DataFrame, trial_id: int, at_least: int = 1) -> DataFrame:
    """Rows per cluster, noise left out."""
    sizes = clustered(artifacts, trial_id).groupBy("cluster_id").agg(F.count("*").alias("size"))
    return sizes if at_least <= 1 else sizes.where(F.col("size") >= at_least)


def largest_clusters(artifacts: DataFrame, trial_id: int, n: int = 10) -> DataFrame:
    """The ``n`` largest clusters; equal sizes go to the higher id."""
    return cluster_sizes(artifacts, trial_id).orderBy(F.desc("size"), F.desc("cluster_id")).limit(n)


def most_relevant_clusters(labels: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` clusters of highest relevance; clusters without a score are left out."""
    return (
        labels.where(F.col("safety_relevance").isNotNull())
        .orderBy(F.desc("safety_relevance"), "cluster_id")
        .select("cluster_id", "safety_relevance")
        .limit(n)
    )


def flag_members(rows: DataFrame, chosen: DataFrame, flag: str) -> DataFrame:
    """Mark the rows whose cluster is among ``chosen``."""
    c = chosen.select("cluster_id").distinct().withColumn(flag, F.lit(True))
    return rows.join(c, "cluster_id", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Add the label, if any, and the text to display for it."""
    named = labels.select("cluster_id", "label")
    return rows.join(named, "cluster_id", "left").withColumn("display", cluster_display("label", "cluster_id"))


def labelled_sizes(artifacts: DataFrame, labels: DataFrame, trial_id: int) -> DataFrame:
    """Size, label and relevance per cluster; ``No label`` and 0 for clusters without an entry."""
    known = labels.select("cluster_id", F.col("label").alias("_label"), "safety_relevance", F.lit(True).alias("_hit"))
    return (
        cluster_sizes(artifacts, trial_id)
        .join(known, "cluster_id", "left")
        .select(
            "cluster_id",
            "size",
            F.when(F.col("_hit").isNull(), F.lit("No label")).otherwise(F.col("_label")).alias("label"),
            F.coalesce(F.col("safety_relevance").cast("double"), F.lit(0.0)).alias("relevance"),
        )
    )


def clusters_needing_labels(metrics: DataFrame, artifacts: DataFrame, strict: bool = True) -> DataFrame:
    """Clusters with a metric row, members and no label.

    ``strict`` matches trial and cluster and leaves noise out; otherwise the cluster id alone counts.
    """
    open_rows = metrics.where(F.col("llm_label").isNull())
    if not strict:
        return open_rows.select("cluster_id").distinct().join(artifacts.select("cluster_id"), "cluster_id", "left_semi")
    keys = ["trial_id", "cluster_id"]
    return (
        open_rows.where(F.col("cluster_id") != NOISE)
        .select(*keys)
        .distinct()
        .join(artifacts.select(*keys), keys, "left_semi")
    )


def cluster_pairs(artifacts: DataFrame, trial_id: int) -> DataFrame:
    """Every unordered pair of clusters of a trial: the pairs are the result that is asked for.

    Clusters are ranked, each rank lists the ranks after it, and an equi-join finds the partners, so
    the work is spread over the shuffle instead of a nested loop.
    """
    ids = clustered(artifacts, trial_id).select("cluster_id").distinct()
    total = ids.agg(F.count("*")).scalar()
    ranked = ids.select(
        "cluster_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("cluster_id")).alias("r")
    )
    left = ranked.where(F.col("r") < total).select(
        F.col("cluster_id").alias("left_id"), F.explode(F.sequence(F.col("r") + 1, total.cast("int"))).alias("r")
    )
    return left.join(ranked.withColumnRenamed("cluster_id", "right_id"), "r").select("left_id", "right_id")


def label_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges with the cluster label of both ends."""
    a = labels.select(F.col("id").alias("src"), F.col("label").alias("src_label"))
    b = labels.select(F.col("id").alias("dst"), F.col("label").alias("dst_label"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", "distance", "src_label", "dst_label")
