"""Whole-store changes: clean-up by category, filtered stores, orphan removal, record ingest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarium.functions.text import TARGET_CATEGORIES, overlaps_categories
from scholarium.operators.authors import find_or_create, sighted_authors
from scholarium.operators.tables import insert_ignore, new_rows, orphans, related_subset, without_orphans
from scholarium.operators.versions import apply_version_summary
from scholarium.session import cut_lineage

STORE_FIELDS = ["title", "abstract", "categories", "msc_class", "acm_class", "doi", "license", "comments"]


def category_keep_set(papers: DataFrame, wanted: Sequence[str] = TARGET_CATEGORIES) -> DataFrame:
    """Ids to keep: papers of a wanted category that are not withdrawn.

    Unknown categories do not condemn a paper on their own, only together with withdrawal.
    """
    condemned = ~overlaps_categories("arxiv_categories", wanted) | F.col("withdrawn")
    return papers.where(~F.coalesce(condemned, F.lit(False))).select("id")


def clean_by_category(
    papers: DataFrame, versions: DataFrame, links: DataFrame, authors: DataFrame, wanted: Sequence[str] = TARGET_CATEGORIES
) -> dict[str, DataFrame]:
    """All four tables without the condemned papers, their dependants and authors left without a paper."""
    keep = cut_lineage(category_keep_set(papers, wanted))
    return related_subset(papers, versions, links, authors, keep, known=True)


def filtered_store(
    papers: DataFrame, versions: DataFrame, links: DataFrame, authors: DataFrame, artifacts: DataFrame,
    trees: DataFrame, trial_id: int,
) -> dict[str, DataFrame]:
    """Subset for one trial: active papers with a vector, what hangs on them, and the trial's results."""
    # Five tables are cut by these ids.
    keep = cut_lineage(papers.where(F.col("embedding").isNotNull() & ~F.col("withdrawn")).select("id"))
    out = related_subset(papers, versions, links, authors, keep, known=True)
    out["artifacts"] = without_orphans(artifacts.where(F.col("trial_id") == trial_id), keep, "paper_id", "id")
    out["cluster_trees"] = trees.where(F.col("trial_id") == trial_id)
    return out


def remove_orphan_versions(versions: DataFrame, papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Versions that have a paper, and the number that had none."""
    lost = orphans(versions, papers, "paper_id", "id").agg(F.count("*").alias("removed"))
    return without_orphans(versions, papers, "paper_id", "id"), lost


def core_additions(
    records: DataFrame, papers: DataFrame, authors: DataFrame, links: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows that core records add to the stored tables: new papers, new authors, new links. Known keys stay as they are."""
    sighted = sighted_authors(records.select(F.col("id").alias("paper_id"), "authors"))
    added, resolved = find_or_create(authors, sighted)
    # Dates come from the versions; a new paper starts as not withdrawn.
    fresh = records.select("id", *STORE_FIELDS, F.lit(False).alias("withdrawn"))
    tied = resolved.select("paper_id", F.col("author_id").cast(links.schema["author_id"].dataType), "author_position")
    return (
        new_rows(papers, fresh, ["id"]).select(*papers.columns),
        added.select([F.col(c).cast(authors.schema[c].dataType) for c in authors.columns]),
        new_rows(links, tied, ["paper_id", "author_id"]).select(*links.columns),
    )


def ingest_core(
    records: DataFrame, papers: DataFrame, authors: DataFrame, links: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stored tables with what core records add to them."""
    added = core_additions(records, papers, authors, links)
    return tuple(old.unionByName(new) for old, new in zip((papers, authors, links), added, strict=True))


def ingest_versions(version_rows: DataFrame, papers: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add versions of known papers, then refresh dates and withdrawal of the papers."""
    known = without_orphans(version_rows, papers, "paper_id", "id")
    merged = insert_ignore(versions, known, ["paper_id", "version"])
    return merged, apply_version_summary(papers, merged)
