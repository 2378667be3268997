"""Insert, upsert, fill, delete and subset on whole tables: every change is a new DataFrame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarium.session import scratch_path


def one_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep the smallest row of each key. A plain aggregate, so copies are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    picked = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def new_rows(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is not stored yet, one per key.

    The stored keys are first cut to those that come in: with a small delivery that join needs no
    shuffle of the store, only a scan of its key columns.
    """
    known = existing.select(*keys).join(incoming.select(*keys), list(keys), "left_semi")
    return one_per_key(incoming, keys).join(known, list(keys), "left_anti")


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Append rows with new keys; rows whose key exists are ignored."""
    return existing.unionByName(new_rows(existing, incoming, keys).select(*existing.columns))


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert new keys and overwrite the columns that ``incoming`` carries on known keys."""
    fresh = one_per_key(incoming, keys)
    changed = [c for c in incoming.columns if c not in keys]
    right = fresh.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_n_{c}") for c in changed], F.lit(True).alias("_hit")
    )
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    joined = existing.join(right, on, "full")
    out: list[Column] = []
    for c in existing.columns:
        if c in keys:
            out.append(F.coalesce(F.col(c), F.col(f"_k_{c}")).alias(c))
        elif c in changed:
            out.append(F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def fill_column(df: DataFrame, results: DataFrame, key: str, column: str) -> DataFrame:
    """Write results into ``column``; rows without a result keep what they have."""
    found = results.select(F.col(key), F.col(column).alias("_new"))
    return (
        df.join(found, key, "left")
        .withColumn(column, F.coalesce(F.col("_new"), F.col(column)))
        .select(*df.columns)
    )


def pending(df: DataFrame, column: str) -> DataFrame:
    """Work queue: rows whose result is still missing."""
    return df.where(F.col(column).isNull())


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows without a parent."""
    return children.join(parents.select(F.col(parent_key).alias("_p")), F.col(child_key) == F.col("_p"), "left_anti")


def without_orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows that have a parent."""
    return children.join(parents.select(F.col(parent_key).alias("_p")), F.col(child_key) == F.col("_p"), "left_semi")


def members_of(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """Rows whose key is in a list that may be long."""
    return without_orphans(df, wanted, key, wanted_key)


def related_subset(
    papers: DataFrame, versions: DataFrame, links: DataFrame, authors: DataFrame, keep: DataFrame, known: bool = False
) -> dict[str, DataFrame]:
    """The four core tables cut down to the papers in ``keep`` (a table with an ``id`` column).

    ``known`` says that every id in ``keep`` is a paper, which spares the children a second join.
    """
    kept = without_orphans(papers, keep, "id", "id")
    ids = keep if known else kept
    kept_links = without_orphans(links, ids, "paper_id", "id")
    return {
        "papers": kept,
        "paper_versions": without_orphans(versions, ids, "paper_id", "id"),
        "paper_authors": kept_links,
        "authors": without_orphans(authors, kept_links, "id", "author_id"),
    }


def copy_columns(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Copy by column list with type coercion (0/1 to boolean, text to timestamp and so on)."""
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in columns.items()])


def compare_copies(pairs: Mapping[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Row counts of each table in both stores and whether they agree."""
    out: DataFrame | None = None
    for name, (source, target) in pairs.items():
        counts = source.agg(F.count("*").alias("source_rows")).select(
            F.lit(name).alias("table_name"),
            "source_rows",
            target.agg(F.count("*")).scalar().alias("target_rows"),
        )
        out = counts if out is None else out.unionByName(counts)
    if out is None:
        raise ValueError("nothing to compare")
    return out.withColumn("matches", F.col("source_rows") == F.col("target_rows"))


def validate_then_publish(df: DataFrame, violations: DataFrame, path: str) -> str:
    """All-or-nothing replace: write to a new folder only if the check finds no row.

    The input is never overwritten; the caller swaps its pointer to the returned folder.
    """
    bad = violations.limit(5).collect()
    if bad:
        raise ValueError(f"not published, violations such as {bad}")
    df.write.mode("errorifexists").parquet(path)
    return path


def publish_new(df: DataFrame, name: str) -> str:
    """Write ``df`` to a fresh folder of the shared working area and return its path."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return path
