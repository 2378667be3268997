"""Row numbering and batching that never funnels all rows, or one hot key, through a single task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarium.session import cut_lineage


def number_rows(df: DataFrame, order: Sequence[str | Column], name: str = "row_number", start: int = 1) -> DataFrame:
    """Number all rows in ``order`` from ``start`` on, without a one-task window.

    Rows are range-partitioned and sorted; the position inside a partition comes from the low bits of
    the partition-wise id, and the partition offsets from a window over one row per partition. The
    sorted rows are materialised once, because a second evaluation may choose other range borders.
    Rows that tie in ``order`` are ordered by a hash of the row, so that a frequent value can be split.
    """
    hashed = [f.name for f in df.schema if not isinstance(f.dataType, T.MapType)]
    order_cols = [*(F.col(c) if isinstance(c, str) else c for c in order), F.xxhash64(*hashed)]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(
        df.repartitionByRange(parts, *order_cols)
        .sortWithinPartitions(*order_cols)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    local = placed.withColumn("_part", F.shiftright("_mid", 33)).withColumn(
        "_pos", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    )
    # One row per partition, so the window below is over a handful of rows.
    sizes = local.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (
        local.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_pos") + F.lit(start))
        .drop("_mid", "_part", "_pos", "_offset")
    )


def number_within(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str | Column], name: str
) -> DataFrame:
    """Number the rows of each key from 1, splitting every key into ordered buckets.

    ``bucket`` must grow with ``order`` (the hour of a timestamp, say). Each (key, bucket) is sorted on
    its own and shifted by the size of the key's earlier buckets, so a key that holds a large share of
    all rows is spread over as many tasks as it has buckets.
    """
    tagged = df.withColumn("_bucket", bucket)
    sizes = tagged.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        tagged.join(offsets, [*keys, "_bucket"])
        .withColumn(name, F.row_number().over(inside) + F.col("_offset"))
        .drop("_bucket", "_offset")
    )


def fixed_batches(df: DataFrame, order: Sequence[str | Column], size: int, name: str = "batch") -> DataFrame:
    """Cut the ordered rows into batches of ``size``; adds the batch number and the position inside it, both from 0."""
    numbered = number_rows(df, order, name="_rn", start=0)
    return (
        numbered.withColumn(name, F.floor(F.col("_rn") / F.lit(size)).cast("long"))
        .withColumn("position", (F.col("_rn") % F.lit(size)).cast("long"))
        .drop("_rn")
    )


def seeded_order(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Shuffle rows reproducibly: the order depends on key and seed only, not on the partitioning."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key))


def page(df: DataFrame, order: Sequence[str | Column], offset: int, limit: int) -> DataFrame:
    """LIMIT/OFFSET page of the ordered rows."""
    return df.orderBy(*order).offset(offset).limit(limit)


def sample_rows(df: DataFrame, order: Sequence[str | Column], n: int = 5) -> DataFrame:
    """First ``n`` rows in key order, for a report."""
    return df.orderBy(*order).limit(n)


def running_within(df: DataFrame, keys: Sequence[str], order: str, value: str, total: str, following: str) -> DataFrame:
    """Per row the sum of ``value`` over the rows of its key up to it, and the next row's ``order`` (null for the last).

    ``order`` is distinct within a key. Rows are range-partitioned by key and order, so one key may be many partitions;
    what a key carries from one partition to the next is one line, and only for the keys that go over a border.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(parts, *keys, order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *keys).orderBy(order)
    local = ranged.withColumn("_sum", F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    local = local.withColumn("_next", F.lead(order).over(inside))
    pieces = ranged.groupBy("_part", *keys).agg(F.sum(value).alias("_all"), F.min(order).alias("_first"))
    along = Window.partitionBy(*keys).orderBy("_part")
    carried = pieces.select(
        "_part", *keys, F.count("*").over(Window.partitionBy(*keys)).alias("_pieces"),
        F.coalesce(F.sum("_all").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.lead("_first").over(along).alias("_beyond"),
    ).where("_pieces > 1").drop("_pieces")
    # At most two lines a partition.
    return local.join(F.broadcast(cut_lineage(carried)), ["_part", *keys], "left").withColumns({
        total: F.col("_sum") + F.coalesce("_before", F.lit(0)), following: F.coalesce("_next", "_beyond"),
    }).drop("_part", "_sum", "_next", "_before", "_beyond")
