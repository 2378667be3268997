"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Each row draws an exponential key, divided by its quality weight. A source whose target is k times its
size and a rest gives k whole epochs; the rest is filled in key order up to the token budget. What a
source takes is a rule on (size, key, id) alone, so rows with texts never move to be sampled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarium.llm.common import column, free_names, small, step
from scholarium.operators.ordering import number_rows

#: No row is repeated more often than this.
MAX_EPOCHS = 3
#: Rows of a source that are sorted together when its budget is cut; the rest is only summed.
BUCKET_ROWS = 2000
#: Passes over the rows that are left, each filling the gap with rows no larger than it. A last one may add one row.
PASSES = 3
#: Rated rows that are shared with all tasks (some 16 bytes each), so that texts do not move; more are joined.
RATED_ROWS = 2_000_000


def words(text: Column) -> Column:
    """Number of runs of characters that are not white space; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def exponential_key(key: Column, size: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u from a hash of the row, the same in every run."""
    u = (F.shiftrightunsigned(F.xxhash64(key, size, F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(u) / F.coalesce(weight, F.lit(1.0))


def targets(rows: DataFrame, weights: Sequence[float], max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source of ``rows(source, size)``: n_rows, source_size, target.

    Sources by code point, null last, take ``weights`` in turn and share the sum of all sizes. A target
    stops at ``max_epochs`` times its source; the excess is shared by weight among the others until none is above.
    """
    sources = rows.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    ranked = number_rows(sources, [F.col("source").asc_nulls_last()], "place", 0)
    turn = F.array(*[F.lit(float(w)) for w in weights])
    state = ranked.select(
        "source", "n_rows", "source_size", F.element_at(turn, (F.col("place") % len(weights) + 1).cast("int")).alias("weight")
    )
    state = step(state)
    most = F.col("source_size") * max_epochs
    # A source is capped once level * weight passes its limit; the level only rises, so this ends.
    total = state.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = F.lit(level) * F.col("weight") > most
        n, held, free = state.agg(
            F.sum(full.cast("long")), F.sum(F.when(full, most).otherwise(0)), F.sum(F.when(~full, F.col("weight")).otherwise(0.0))
        ).first()
        if n is None or n == capped or not free:
            break
        capped, level = n, (total - held) / free
    target = F.when(F.lit(level) * F.col("weight") > most, most.cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return state.select("source", "n_rows", "source_size", target.alias("target"))


def _cuts(rows: DataFrame, gaps: DataFrame) -> DataFrame:
    """Last key that each source takes from ``rows(source, size, key, id)``: (source, cut, got).

    Only rows no larger than the gap take part. Sums of key buckets show in which bucket the gap ends, and
    just that bucket is sorted, so that a source with a third of all rows is no single task.
    """
    fit = rows.join(gaps.select(F.col("source").alias("s"), "gap", "n_buckets"), F.col("source").eqNullSafe(F.col("s"))).where(
        F.col("size") <= F.col("gap")
    )
    spot = fit.select(
        "source", "size", "key", "id", "gap", F.floor((1 - F.exp(-F.col("key"))) * F.col("n_buckets")).alias("bucket")
    )
    sums = spot.groupBy("source", "bucket").agg(F.sum("size").alias("total"), F.first("gap").alias("gap"))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("total").over(run))
    # The last bucket that fits wholly, and the first one that does not.
    ends = sums.groupBy("source").agg(
        F.max(F.when(F.col("upto") <= F.col("gap"), F.col("bucket"))).alias("whole"),
        F.min(F.when(F.col("upto") > F.col("gap"), F.col("bucket"))).alias("broken"),
        F.max(F.when(F.col("upto") <= F.col("gap"), F.col("upto"))).alias("before"),
    )
    # Joined by source and bucket, so that the rows of a large source stay spread.
    ends = ends.select(
        F.col("source").alias("s"), "broken", F.coalesce("before", F.lit(0)).alias("before"),
        F.explode(F.array("whole", "broken")).alias("b"),
    ).where(F.col("b").isNotNull())
    near = spot.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    place = F.struct("key", "id", "size")
    inside = Window.partitionBy("source").orderBy("key", F.col("id").asc_nulls_first(), "size").rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    in_broken = F.when(F.col("bucket") == F.col("broken"), F.col("size")).otherwise(0)
    near = near.withColumn("sum", F.col("before") + F.sum(in_broken).over(inside)).where(F.col("sum") <= F.col("gap"))
    return near.groupBy("source").agg(F.max(place).alias("cut"), F.max("sum").alias("got"))


def _nearest(rows: DataFrame, gaps: DataFrame) -> DataFrame:
    """The one row of each source that brings it nearest to its target, if any does: (source, cut, got)."""
    near = rows.join(gaps.select(F.col("source").alias("s"), "gap"), F.col("source").eqNullSafe(F.col("s"))).where(
        F.abs(F.col("size") - F.col("gap")) < F.col("gap")
    )
    best = near.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "key", "id", "size")).alias("b"))
    return best.select("source", F.struct("b.key", "b.id", "b.size").alias("cut"), F.col("b.size").alias("got"))


def _taken(cuts: Column, place: Column, size: Column) -> Column:
    return F.exists(
        cuts, lambda c: F.when(c["one"], place == c["cut"]).otherwise((size <= c["gap"]) & (place <= c["cut"]))
    )


def mix_rules(rows: DataFrame, weights: Sequence[float], max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source of ``rows(source, size, key, id)``: source_size, target, epochs and the cuts of the rest."""
    plan = targets(rows, weights, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("gap", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = step(plan.withColumn("n_buckets", F.ceil(F.col("n_rows") / BUCKET_ROWS)).withColumn("cuts", F.expr(
        "cast(array() as array<struct<gap:double,cut:struct<key:double,id:bigint,size:bigint>,one:boolean>>)")))
    place = F.struct("key", "id", "size")
    for turn in range(PASSES + 1):
        left = rows.join(plan.select(F.col("source").alias("p"), "cuts"), F.col("source").eqNullSafe(F.col("p")))
        left = left.where(~_taken(F.col("cuts"), place, F.col("size"))).select("source", "size", "key", "id")
        one = turn == PASSES
        found = (_nearest if one else _cuts)(left, plan).select(F.col("source").alias("f"), "cut", "got")
        plan = plan.join(found, F.col("source").eqNullSafe(F.col("f")), "left")
        more = F.array(F.struct("gap", "cut", F.lit(one).alias("one")))
        plan = step(plan.select(
            "source", "n_rows", "source_size", "target", "epochs", "n_buckets",
            F.when(F.col("cut").isNull(), F.col("cuts")).otherwise(F.concat("cuts", more)).alias("cuts"),
            (F.col("gap") - F.coalesce("got", F.lit(0))).alias("gap"),
        ))
    return plan


def sized(docs: DataFrame, quality: DataFrame | None, seed: int, key: str, text: str, source: str) -> DataFrame:
    """(id, source, size, key) of every row. ``quality(id, weight)`` has a positive weight for some ids."""
    rows = docs.select(
        column(docs, key).cast("long").alias("id"), column(docs, source).cast("string").alias("source"),
        words(column(docs, text)).alias("size"),
    )
    if quality is None:
        rows = rows.withColumn("weight", F.lit(1.0))
    else:
        rows = rows.join(quality, "id", "left")
    return rows.select("id", "source", "size", exponential_key(F.col("id"), F.col("size"), F.col("weight"), seed).alias("key"))


def quality_weights(labels: DataFrame) -> DataFrame:
    """(id, weight) from rated documents: good ones weigh 2, poor ones 0.5; unrated ones are absent and weigh 1."""
    rated = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("q"))
    return rated.select(F.col("doc_id").alias("id"), F.when(F.col("q") > 0, 2.0).otherwise(0.5).alias("weight"))


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), quality: DataFrame | None = None, seed: int = 1,
    key: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """What the mix takes of each document: (key, source, size, source_size, target, taken, copies).

    ``taken`` is a multiple of the size: whole epochs, and one more for the rows of the fractional selection.
    Null texts have size 0. Rows that repeat with the same id and size share their key and are taken together; null ids
    and null sources take part. An empty table gives an empty result.
    """
    rows = step(sized(docs, quality, seed, key, text, source))
    rules = mix_rules(rows, weights).select(F.col("source").alias("r"), "source_size", "target", "epochs", "cuts")
    copies = F.col("epochs") + _taken(F.col("cuts"), F.struct("key", "id", "size"), F.col("size")).cast("long")
    return rows.join(rules, F.col("source").eqNullSafe(F.col("r"))).select(
        F.col("id").alias(key), "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"),
        copies.alias("copies"),
    )


def mixed_rows(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), quality: DataFrame | None = None, seed: int = 1,
    key: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """The rows of the mix with all their columns, each as often as it is taken."""
    rows = step(sized(docs, quality, seed, key, text, source))
    rules = step(mix_rules(rows, weights).select("source", "epochs", "cuts"))
    # Every row decides for itself by its source's rule; weights come by id.
    r_source, r_epochs, r_cuts, r_size, r_id, r_weight = free_names(
        docs, "r_source", "r_epochs", "r_cuts", "r_size", "r_id", "r_weight"
    )
    out = docs
    if quality is None:
        out = out.withColumn(r_weight, F.lit(1.0))
    else:
        rated = small(step(quality.select(F.col("id").alias(r_id), F.col("weight").alias(r_weight))), RATED_ROWS)
        out = out.join(rated, column(docs, key).cast("long") == F.col(r_id), "left").drop(r_id)
    rules = rules.select(F.col("source").alias(r_source), F.col("epochs").alias(r_epochs), F.col("cuts").alias(r_cuts))
    out = out.join(rules, F.col(f"`{source}`").cast("string").eqNullSafe(F.col(r_source)))
    id_ = F.col(f"`{key}`").cast("long")
    out = out.withColumn(r_size, words(F.col(f"`{text}`")))
    place = F.struct(
        exponential_key(id_, F.col(r_size), F.col(r_weight), seed).alias("key"), id_.alias("id"), F.col(r_size).alias("size")
    )
    copies = F.col(r_epochs) + _taken(F.col(r_cuts), place, F.col(r_size)).cast("long")
    # A count of 0 gives an empty list, and no row.
    return out.withColumn(r_id, F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*docs.columns)
