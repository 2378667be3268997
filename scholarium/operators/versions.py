"""What the version list says about a paper: first and last date, withdrawal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_withdrawn(source_type: Column, size: Column) -> Column:
    """A latest version that is an internal marker, or empty, means the paper was withdrawn."""
    return (source_type == "I") | (size == "0kb")


def version_summary(versions: DataFrame) -> DataFrame:
    """Per paper: dates of the first and last version by number, and the withdrawn flag.

    Plain aggregates over (version, …): combined before the shuffle, so a paper with very many
    versions costs one row per task.
    """
    latest = F.max_by(F.struct("date", "source_type", "size"), "version")
    agg = versions.groupBy("paper_id").agg(
        F.min_by("date", "version").alias("created"),
        latest.alias("_last"),
        F.count("*").alias("n_versions"),
        F.min("version").alias("first_version"),
        F.max("version").alias("last_version"),
    )
    return agg.select(
        "paper_id",
        "created",
        F.col("_last.date").alias("updated"),
        F.coalesce(is_withdrawn(F.col("_last.source_type"), F.col("_last.size")), F.lit(False)).alias("withdrawn"),
        "n_versions",
        "first_version",
        "last_version",
    )


def apply_version_summary(papers: DataFrame, versions: DataFrame, key: str = "id") -> DataFrame:
    """Papers with dates and flag from their versions; papers without versions keep theirs."""
    s = version_summary(versions).select(
        F.col("paper_id").alias("_pid"),
        F.col("created").alias("_created"),
        F.col("updated").alias("_updated"),
        F.col("withdrawn").alias("_withdrawn"),
    )
    joined = papers.join(s, F.col(key) == F.col("_pid"), "left")
    have = set(papers.columns)
    out = [c for c in papers.columns if c not in {"created", "updated", "withdrawn"}]
    return joined.select(
        *out,
        (F.coalesce("_created", "created") if "created" in have else F.col("_created")).alias("created"),
        (F.coalesce("_updated", "updated") if "updated" in have else F.col("_updated")).alias("updated"),
        F.coalesce(F.col("_withdrawn"), F.col("withdrawn") if "withdrawn" in have else F.lit(False)).alias("withdrawn"),
    )
