"""Citation counts from an edge table of (citing, cited)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarium.functions.text import preprint_doi


def citation_counts(edges: DataFrame) -> DataFrame:
    """Distinct citing papers per cited paper. Repeated edges are dropped before they are counted."""
    return edges.groupBy("cited").agg(F.countDistinct("citing").alias("citation_count"))


def attach_citations(papers: DataFrame, edges: DataFrame, only_pending: bool = False) -> DataFrame:
    """Papers with DOI and citation count; a paper nobody cites has 0.

    With ``only_pending``, papers that carry a count already keep it.
    """
    counts = citation_counts(edges).select(F.col("cited").alias("id"), F.col("citation_count").alias("_n"))
    joined = papers.join(counts, "id", "left").withColumn("doi", preprint_doi("id"))
    found = F.coalesce("_n", F.lit(0))
    if only_pending and "citation_count" in papers.columns:
        found = F.coalesce(F.col("citation_count"), found)
    return joined.withColumn("citation_count", found).drop("_n")


def citation_statistics(papers: DataFrame) -> DataFrame:
    """Processed and pending papers, and the distribution of their counts."""
    c = F.col("citation_count")
    return papers.agg(
        F.count("citation_count").alias("processed"),
        F.count_if(c.isNull()).alias("unprocessed"),
        F.round(F.avg(c), 6).alias("mean"),
        F.round(F.stddev_samp(c), 6).alias("stddev"),
        F.min(c).alias("minimum"),
        F.max(c).alias("maximum"),
        F.round(F.try_divide(F.count_if(c > 0), F.count("citation_count")), 6).alias("cited_share"),
    )
