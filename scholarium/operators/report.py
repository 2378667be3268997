"""Report tables and the data sets behind the plots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarium.functions.text import fixed_decimals
from scholarium.operators.clusters import (
    NOISE, clustered, flag_members, labelled_sizes, largest_clusters, members_with_text, most_relevant_clusters,
    with_labels,
)
from scholarium.operators.hierarchy import children_at, clusters_at_lambda


def cluster_report(artifacts: DataFrame, labels: DataFrame, trial_id: int) -> DataFrame:
    """Size, label and printed relevance per cluster. Order by size or relevance descending, then cluster id."""
    rows = labelled_sizes(artifacts, labels, trial_id)
    return rows.withColumn("relevance_text", fixed_decimals("relevance"))


def report_by_size(report: DataFrame) -> DataFrame:
    return report.orderBy(F.desc("size"), "cluster_id").select("size", "label", "relevance_text")


def report_by_relevance(report: DataFrame) -> DataFrame:
    return report.orderBy(F.desc("relevance"), "cluster_id").select("relevance_text", "size", "label")


def scatter(artifacts: DataFrame, labels: DataFrame, trial_id: int) -> DataFrame:
    """Points with label and opacity: faint for noise, the membership probability otherwise."""
    noise = F.col("cluster_id") == NOISE
    shown = with_labels(artifacts.where(F.col("trial_id") == trial_id), labels)
    return shown.select(
        "paper_id", "cluster_id", "x", "y",
        F.when(noise, F.lit(0.1)).otherwise(F.col("cluster_prob")).alias("alpha"),
        F.when(noise, F.lit("Noise")).otherwise(F.col("display")).alias("series"),
    )


def scatter_noise(artifacts: DataFrame, trial_id: int) -> DataFrame:
    """Points as clusters against noise."""
    return artifacts.where(F.col("trial_id") == trial_id).select(
        "paper_id", "x", "y", F.when(F.col("cluster_id") == NOISE, F.lit("Noise")).otherwise(F.lit("Clusters")).alias("series")
    )


def _scatter_top(artifacts: DataFrame, labels: DataFrame, trial_id: int, chosen: DataFrame) -> DataFrame:
    shown = flag_members(with_labels(clustered(artifacts, trial_id), labels), chosen, "is_top")
    return shown.select(
        "paper_id", "cluster_id", "x", "y",
        F.when(F.col("is_top"), F.col("display")).otherwise(F.lit("Other Clusters")).alias("series"),
    )


def scatter_largest(artifacts: DataFrame, labels: DataFrame, trial_id: int, n: int = 10) -> DataFrame:
    """The ``n`` largest clusters by name, all others as one series."""
    return _scatter_top(artifacts, labels, trial_id, largest_clusters(artifacts, trial_id, n))


def scatter_most_relevant(artifacts: DataFrame, labels: DataFrame, trial_id: int, n: int = 10) -> DataFrame:
    """The ``n`` most relevant clusters by name, all others as one series."""
    return _scatter_top(artifacts, labels, trial_id, most_relevant_clusters(labels, n))


def relevance_heat(artifacts: DataFrame, labels: DataFrame, trial_id: int) -> DataFrame:
    """Points with the relevance of their cluster, 0 where it is unknown."""
    scores = labels.select("cluster_id", "safety_relevance")
    return clustered(artifacts, trial_id).join(scores, "cluster_id", "left").select(
        "paper_id", "cluster_id", "x", "y", F.coalesce("safety_relevance", F.lit(0.0)).alias("relevance")
    )


def scatter_at_level(artifacts: DataFrame, trees: DataFrame, trial_id: int, level: float) -> DataFrame:
    """Points of the clusters that exist at a level; everything else is noise there."""
    at = clusters_at_lambda(trees, trial_id, level)
    shown = flag_members(artifacts.where(F.col("trial_id") == trial_id), at, "present")
    return shown.select(
        "paper_id", "cluster_id", "cluster_prob",
        F.when(F.col("present"), F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string"))).otherwise(F.lit("Noise")).alias("series"),
    )


def cluster_analysis(artifacts: DataFrame, trees: DataFrame, trial_id: int, level: float, keywords: DataFrame) -> DataFrame:
    """Every cluster of the tree at a level: member count, child count, keywords."""
    sizes = artifacts.where(F.col("trial_id") == trial_id).groupBy("cluster_id").agg(F.count("*").alias("size"))
    kids = children_at(trees, trial_id, level).groupBy(F.col("parent_cluster_id").alias("cluster_id")).agg(
        F.count("*").alias("n_children"), F.max("child_size").alias("largest_child")
    )
    return (
        sizes.join(kids, "cluster_id", "full")
        .join(keywords, "cluster_id", "left")
        .select(
            "cluster_id", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("n_children", F.lit(0)).alias("n_children"),
            "largest_child", F.coalesce("keywords", F.lit("")).alias("keywords"),
        )
    )


def papers_in_cluster(artifacts: DataFrame, papers: DataFrame, trial_id: int, cluster_id: int) -> DataFrame:
    """Members of one cluster, most probable first."""
    rows = members_with_text(artifacts, papers, trial_id).where(F.col("cluster_id") == cluster_id)
    return rows.select("paper_id", "title", "abstract", "cluster_prob").orderBy(F.desc("cluster_prob"), "paper_id")


def persistence_listing(metrics: DataFrame, trial_id: int) -> DataFrame:
    """Validity per cluster of a trial, lowest first."""
    return (
        metrics.where(F.col("trial_id") == trial_id)
        .select("cluster_id", F.col("validity_index").alias("persistence"))
        .orderBy("persistence", "cluster_id")
    )
