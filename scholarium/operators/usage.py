"""Request and token usage: rolling windows, daily counts, totals, token-budget packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholarium.operators.ordering import number_within

MICROS = 1_000_000


def rolling_usage(
    log: DataFrame, requests_per_minute: int, tokens_per_minute: int, seconds: int = 60, bucket_seconds: int = 600
) -> DataFrame:
    """Requests and tokens per key in the ``seconds`` up to each request, with limit flags.

    A request exactly ``seconds`` old no longer counts. A key is not one window partition: time is cut
    into buckets, and the rows at the end of a bucket are copied to the next one as context, so a key
    that holds most of the log is spread over its buckets. The copies are dropped again at the end.
    """
    if bucket_seconds < seconds:
        raise ValueError("a bucket must be at least as long as the window")
    width = bucket_seconds * MICROS
    t = F.unix_micros("ts")
    own = F.floor(t / F.lit(width)).cast("long")
    late = t % F.lit(width) > F.lit(width - seconds * MICROS)
    spread = log.withColumn("_t", t).withColumn("_own", own).withColumn(
        "_bucket", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own)))
    )
    w = (
        Window.partitionBy("api_key", "_bucket").orderBy("_t").rangeBetween(-(seconds * MICROS - 1), Window.currentRow)
    )
    return (
        spread.withColumn("requests_in_window", F.count("*").over(w))
        .withColumn("tokens_in_window", F.sum("tokens").over(w))
        .where(F.col("_own") == F.col("_bucket"))
        .drop("_t", "_own", "_bucket")
        .withColumn("over_requests", F.col("requests_in_window") > requests_per_minute)
        .withColumn("over_tokens", F.col("tokens_in_window") > tokens_per_minute)
    )


def daily_count(log: DataFrame, requests_per_day: int, order: list[str]) -> DataFrame:
    """Running number of a key's requests within the day, and whether it passes the daily limit."""
    dated = log.withColumn("day", F.to_date("ts"))
    counted = number_within(dated, ["api_key", "day"], F.date_trunc("hour", "ts"), order, "requests_today")
    return counted.withColumn("over_day", F.col("requests_today") > requests_per_day)


def usage_totals(log: DataFrame) -> DataFrame:
    """Requests and tokens in total."""
    return log.agg(F.count("*").alias("n_requests"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def pack_by_budget(batched: DataFrame, budget: int) -> DataFrame:
    """Split each batch into sub-batches that stay within a token budget.

    Greedy and in order; a text that is too long on its own is left out. Input columns: ``batch``,
    ``position``, ``id``, ``tokens`` and perhaps others. Batches have a fixed size, so a batch is walked as one array of
    token counts; what the walk carries is the places where a sub-batch opens.
    """
    fits = batched.where(F.col("tokens") <= budget).withColumn("tokens", F.col("tokens").cast("long"))
    item = F.struct(*[F.col(c) for c in ["position", *[c for c in fits.columns if c not in ("batch", "position")]]])
    lists = fits.groupBy("batch").agg(F.array_sort(F.collect_list(item), lambda x, y: (x["position"] - y["position"]).cast("int")).alias("items"))
    nothing = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("opened"))

    def step(acc, x):
        opens = acc["used"] + x["tokens"] > budget
        return F.struct(
            F.when(opens, x["tokens"]).otherwise(acc["used"] + x["tokens"]).alias("used"),
            F.when(opens, F.concat(acc["opened"], F.array(x["position"].cast("long")))).otherwise(acc["opened"]).alias("opened"),
        )

    walked = lists.withColumn("opened", F.aggregate("items", nothing, step)["opened"])
    placed = walked.select("batch", "opened", F.explode("items").alias("x"))
    sub = F.size(F.filter("opened", lambda p: p <= F.col("x.position"))).cast("long")
    return placed.select("batch", sub.alias("sub_batch"), "x.*")
