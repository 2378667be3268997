"""Data-quality reports: counts, coverage, distributions, duplicates, constraint checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarium.functions.text import author_display, normalize_title, percent, primary_category


def share_of_rows(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """One row per condition: how many rows meet it and what share of all rows that is. One pass."""
    counted = df.agg(F.count("*").alias("_total"), *[F.count_if(c).alias(n) for n, c in conditions.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("n")) for n in conditions])
    return counted.select("_total", F.explode(pairs).alias("p")).select(
        "p.metric", "p.n", F.col("_total").alias("total"), percent(F.col("p.n"), F.col("_total")).alias("pct")
    )


def field_coverage(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Non-NULL count and share per field, in one pass."""
    return share_of_rows(df, {f: F.col(f).isNotNull() for f in fields}).withColumnRenamed("metric", "field")


def category_frequency(papers: DataFrame, column: str = "categories", top: int = 10) -> DataFrame:
    """Most frequent categories of a space-separated list, with their share of all papers."""
    total = papers.agg(F.count("*")).scalar()
    words = papers.select(F.explode(F.split(column, " ")).alias("category")).where("category <> ''")
    return (
        words.groupBy("category")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "category")
        .limit(top)
        .withColumn("pct", percent(F.col("n"), total))
    )


def primary_category_counts(papers: DataFrame, prefix: str = "cs.") -> DataFrame:
    """Papers, and active papers, whose first category starts with ``prefix``."""
    return (
        papers.where(F.col("categories").isNotNull())
        .where(primary_category("categories").startswith(prefix))
        .agg(F.count("*").alias("total"), F.count_if(~F.col("withdrawn")).alias("active"))
    )


def group_size_histogram(df: DataFrame, key: str, smallest: int | None = 10) -> DataFrame:
    """How many groups have 1, 2, 3, … rows."""
    sizes = df.groupBy(key).agg(F.count("*").alias("group_size"))
    hist = sizes.groupBy("group_size").agg(F.count("*").alias("n_groups")).orderBy("group_size")
    return hist if smallest is None else hist.limit(smallest)


def repeated_groups(df: DataFrame, key: str) -> DataFrame:
    """Groups with more than one row."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def mean_group_size(df: DataFrame, key: str) -> DataFrame:
    """Average number of rows per group."""
    return df.groupBy(key).agg(F.count("*").alias("n")).agg(F.round(F.avg("n"), 6).alias("mean_size"))


def author_strings(papers: DataFrame, links: DataFrame, authors: DataFrame) -> DataFrame:
    """Papers with the display string of their authors, in author order; NULL without authors.

    Only links of the papers asked for are grouped. They meet the author table before the papers, so the grouped side
    carries names only and the wide text columns are joined after the aggregate.
    """
    asked = links.join(papers.select(F.col("id").alias("paper_id")), "paper_id", "left_semi")
    named = asked.join(
        authors.select(
            F.col("id").alias("author_id"), author_display("keyname", "forenames", "suffix").alias("_name")
        ),
        "author_id",
    )
    strings = named.groupBy("paper_id").agg(
        F.expr("listagg(_name, ', ') WITHIN GROUP (ORDER BY author_position)").alias("authors")
    )
    return papers.join(strings, papers["id"] == strings["paper_id"], "left").drop("paper_id")


def duplicate_titles(papers: DataFrame) -> DataFrame:
    """Normalised titles that several active papers share: group size and smallest id."""
    active = papers.where(F.col("title").isNotNull() & ~F.col("withdrawn"))
    return (
        active.select("id", normalize_title("title").alias("norm_title"))
        .groupBy("norm_title")
        .agg(F.count("*").alias("n_papers"), F.min("id").alias("first_id"))
        .where("n_papers > 1")
    )


def duplicate_title_members(papers: DataFrame) -> DataFrame:
    """Every paper of a duplicate-title group, as rows: no group is collected."""
    groups = duplicate_titles(papers)
    active = papers.where(F.col("title").isNotNull() & ~F.col("withdrawn"))
    return active.select("id", "title", "categories", normalize_title("title").alias("norm_title")).join(
        groups.select("norm_title", "n_papers"), "norm_title"
    )


def duplicate_title_totals(papers: DataFrame) -> DataFrame:
    """Number of groups and of papers in them."""
    return duplicate_titles(papers).agg(
        F.count("*").alias("n_groups"), F.coalesce(F.sum("n_papers"), F.lit(0)).alias("n_papers")
    )


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def check_foreign_key(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Key values without a parent, and how many rows carry each."""
    lost = children.where(F.col(child_key).isNotNull()).join(
        parents.select(F.col(parent_key).alias("_p")), F.col(child_key) == F.col("_p"), "left_anti"
    )
    return lost.groupBy(child_key).agg(F.count("*").alias("n"))


def check_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULLs per required column; only columns that have some."""
    return (
        share_of_rows(df, {c: F.col(c).isNull() for c in columns})
        .where("n > 0")
        .select(F.col("metric").alias("column_name"), "n")
    )


def run_summary(before: DataFrame, incoming: DataFrame, versions: DataFrame, key: str = "id") -> DataFrame:
    """Harvest report: rows before, added and after, versions stored, papers that have versions."""
    added = incoming.select(key).distinct().join(before.select(key), key, "left_anti").agg(F.count("*")).scalar()
    counted = before.agg(F.count("*").alias("rows_before")).select("rows_before", added.alias("rows_added"))
    v = versions.agg(
        F.struct(F.count("*").alias("n_versions"), F.countDistinct("paper_id").alias("papers_with_versions"))
    ).scalar()
    return counted.withColumn("_v", v).select(
        "rows_before",
        "rows_added",
        (F.col("rows_before") + F.col("rows_added")).alias("rows_after"),
        F.col("_v.n_versions").alias("n_versions"),
        F.col("_v.papers_with_versions").alias("papers_with_versions"),
    )


def store_report(
    papers: DataFrame, versions: DataFrame, links: DataFrame, authors: DataFrame, artifacts: DataFrame,
    trees: DataFrame, trial_id: int,
) -> DataFrame:
    """Verification report of a filtered store as (metric, value) rows.

    ``papers`` needs ``embedding`` and ``citation_count``. Each input is scanned once or twice and
    reduced to a one-row aggregate; the noise cluster counts like any other, as published.
    """

    def rows(df: DataFrame, aggs: Mapping[str, Column]) -> DataFrame:
        one = df.agg(*[a.cast("double").alias(n) for n, a in aggs.items()])
        pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in aggs])
        return one.select(F.explode(pairs).alias("p")).select("p.metric", "p.value")

    cites = F.col("citation_count")
    trial = artifacts.where(F.col("trial_id") == trial_id)
    parts = [
        rows(papers, {
            "papers": F.count("*"),
            "embedded_papers": F.count("embedding"),
            "papers_with_citation_data": F.count("citation_count"),
            "cited_papers": F.count_if(cites > 0),
            "uncited_papers": F.count_if(cites == 0),
            "unknown_citation_papers": F.count_if(cites.isNull()),
        }),
        rows(versions.groupBy("paper_id").agg(F.count("*").alias("n")), {
            "versions": F.coalesce(F.sum("n"), F.lit(0)), "mean_versions": F.avg("n"),
        }),
        rows(trial, {
            "artifacts": F.count("*"),
            "clusters": F.countDistinct("cluster_id"),
            "mean_probability": F.avg(F.when(F.col("cluster_id").isNotNull(), F.col("cluster_prob"))),
            "std_probability": F.stddev_samp(F.when(F.col("cluster_id").isNotNull(), F.col("cluster_prob"))),
        }),
        rows(trees.where(F.col("trial_id") == trial_id), {"tree_edges": F.count("*")}),
        rows(authors.join(links.select(F.col("author_id").alias("id")), "id", "left_semi"), {
            "active_authors": F.countDistinct("id"),
        }),
        rows(links.join(papers.select(F.col("id").alias("paper_id")), "paper_id", "left_semi"), {
            "papers_with_authors": F.countDistinct("paper_id"),
        }),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("value", F.round("value", 6))
