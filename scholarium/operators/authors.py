"""Author identity: find or create, merge duplicates, merge keynames with trailing commas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholarium.functions.text import blank_to_null, normalize_suffix, strip_trailing_commas
from scholarium.operators.ordering import number_rows
from scholarium.session import cut_lineage

KEYS = ["keyname", "forenames_key", "suffix_key"]


def with_identity(authors: DataFrame) -> DataFrame:
    """Add the comparison form of the optional name parts; absent and empty are the same."""
    return authors.withColumn("forenames_key", F.coalesce("forenames", F.lit(""))).withColumn(
        "suffix_key", F.coalesce(normalize_suffix("suffix"), F.lit(""))
    )


def canonical_authors(authors: DataFrame) -> DataFrame:
    """One row per identity, under its smallest id."""
    grouped = with_identity(authors).groupBy(*KEYS).agg(F.min("id").alias("id"))
    return grouped.select(
        "id",
        "keyname",
        F.nullif("forenames_key", F.lit("")).alias("forenames"),
        F.nullif("suffix_key", F.lit("")).alias("suffix"),
    )


def author_mapping(authors: DataFrame) -> DataFrame:
    """Old author id to canonical id."""
    known = with_identity(authors)
    target = known.groupBy(*KEYS).agg(F.min("id").alias("new_id"))
    return known.join(target, KEYS).select(F.col("id").alias("old_id"), "new_id")


def unmapped_authors(authors: DataFrame, mapping: DataFrame) -> DataFrame:
    """Authors the mapping misses; must be empty before anything is replaced."""
    return authors.join(mapping.select(F.col("old_id").alias("id")), "id", "left_anti")


def rewrite_links(links: DataFrame, mapping: DataFrame) -> DataFrame:
    """Point links at canonical authors. Links that fall together keep the smallest position."""
    moved = links.join(mapping, links["author_id"] == mapping["old_id"], "left").select(
        "paper_id", F.coalesce("new_id", "author_id").alias("author_id"), "author_position"
    )
    return moved.groupBy("paper_id", "author_id").agg(F.min("author_position").alias("author_position"))


def check_coverage(authors: DataFrame, links: DataFrame, mapping: DataFrame, shown: int = 5) -> None:
    """Fail, naming a few, if the mapping misses an author or if a link points at an author that it does not know."""
    lost = unmapped_authors(authors, mapping).select(F.lit("unmapped authors").alias("what"), F.col("id").cast("string").alias("which"))
    known = mapping.select(F.col("old_id").alias("author_id"))
    stray = links.join(known, "author_id", "left_anti").select(
        F.lit("links to unknown authors").alias("what"), F.concat_ws("-", F.col("paper_id").cast("string"), F.col("author_id").cast("string")).alias("which")
    )
    some = Window.partitionBy("what").orderBy("which")
    counted = lost.unionByName(stray)
    first = counted.withColumn("r", F.row_number().over(some)).where(F.col("r") <= shown).groupBy("what").agg(F.collect_list("which").alias("some"))
    found = counted.groupBy("what").agg(F.count("*").alias("n")).join(first, "what").orderBy("what").collect()
    if found:
        raise ValueError("; ".join(f"{r['n']} {r['what']}, such as {', '.join(sorted(r['some']))}" for r in found))


def deduplicate_authors(authors: DataFrame, links: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Merged author table and rewritten links.

    Links to unknown authors stay as they are; ``strict`` fails on them, before anything is replaced.
    """
    mapping = author_mapping(authors)
    if strict:
        mapping = cut_lineage(mapping)
        check_coverage(authors, links, mapping)
    return canonical_authors(authors), rewrite_links(links, mapping)


def comma_mapping(authors: DataFrame) -> DataFrame:
    """Authors with trailing commas, and the author each one becomes.

    The target is the smallest id that already carries the clean name, else the smallest id among
    the comma authors that clean to the same name.
    """
    parts = authors.select(
        "id",
        "keyname",
        strip_trailing_commas("keyname").alias("clean"),
        F.coalesce("forenames", F.lit("")).alias("f"),
        F.coalesce("suffix", F.lit("")).alias("s"),
        F.col("keyname").endswith(",").alias("comma"),
    )
    targets = parts.groupBy("clean", "f", "s").agg(
        F.min(F.when(~F.col("comma"), F.col("id"))).alias("existing"), F.min("id").alias("first_id")
    )
    return (
        parts.where("comma")
        .join(targets, ["clean", "f", "s"])
        .select(F.col("id").alias("old_id"), F.coalesce("existing", "first_id").alias("new_id"), "clean")
    )


def merge_comma_authors(
    authors: DataFrame, links: DataFrame, affiliations: DataFrame | None = None
) -> tuple[DataFrame, DataFrame] | tuple[DataFrame, DataFrame, DataFrame]:
    """Merge comma authors into the clean author where there is one, else rename them.

    ``affiliations(author_id, affiliation)``, if given, follow their authors and come back as a third table.
    """
    mapping = comma_mapping(authors)
    moved = mapping.where("old_id <> new_id").select("old_id", "new_id")
    kept = authors.join(moved.select(F.col("old_id").alias("id")), "id", "left_anti")
    renamed = kept.withColumn("keyname", strip_trailing_commas("keyname"))
    merged = renamed, rewrite_links(links, moved)
    return merged if affiliations is None else (*merged, move_affiliations(affiliations, moved))


def move_affiliations(affiliations: DataFrame, mapping: DataFrame) -> DataFrame:
    """Hand affiliations over to the merged author, each at most once."""
    return (
        affiliations.join(mapping, affiliations["author_id"] == mapping["old_id"], "left")
        .select(F.coalesce("new_id", "author_id").alias("author_id"), "affiliation")
        .distinct()
    )


def sighted_authors(paper_author_lists: DataFrame) -> DataFrame:
    """Explode author lists to one row per paper and author, positions from 1, names cleaned."""
    flat = paper_author_lists.select("paper_id", F.posexplode("authors").alias("pos", "a"))
    return flat.select(
        "paper_id",
        (F.col("pos") + 1).alias("author_position"),
        blank_to_null("a.keyname").alias("keyname"),
        blank_to_null("a.forenames").alias("forenames"),
        normalize_suffix("a.suffix").alias("suffix"),
    ).where(F.col("keyname").isNotNull())


def find_or_create(existing: DataFrame, sighted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Author rows to add for unseen names, and the author id of every sighting.

    New names are numbered after the highest id in the order of (keyname, forenames, suffix).
    """
    names = ["keyname", "forenames", "suffix"]
    known = (
        existing.groupBy(*names).agg(F.min("id").alias("known_id"))
        .select("known_id", *[F.col(n).alias(f"_{n}") for n in names])
    )

    def same() -> list:
        return [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names]

    misses = sighted.select(*names).distinct().join(known, same(), "left_anti")
    numbered = number_rows(misses, names, name="_rn")
    highest = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).scalar()
    added = numbered.select((F.col("_rn") + highest).alias("id"), *names)
    every = known.unionByName(
        added.select(F.col("id").alias("known_id"), *[F.col(n).alias(f"_{n}") for n in names])
    )
    resolved = sighted.join(every, same(), "left").drop(*[f"_{n}" for n in names])
    return added, resolved.withColumnRenamed("known_id", "author_id")
