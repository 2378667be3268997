"""Queries: streaming jobs run to the end of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholarium.plans.registry import query
from scholarium.plans.stores import _core_files, _version_files
from scholarium.plans import views as v
from scholarium.session import scratch_path
from scholarium.streaming import ingest as ing
from scholarium.streaming import usage as us


@query("st1_stream_core_ingest", """WITH p AS (SELECT * FROM papers WHERE NOT withdrawn)
    SELECT 'papers' AS table_name, count(*) AS n FROM p UNION ALL SELECT 'authors', count(*) FROM
      (SELECT DISTINCT id % 40, id % 3=0, CASE WHEN id % 3=0 THEN 0 ELSE id % 2 END, id % 5=0 FROM p)
    UNION ALL SELECT 'paper_authors', count(*) FROM p""")
def _(spark, sf):
    root, check = scratch_path(spark, "ingested"), scratch_path(spark, "ingest-checkpoint")
    source = _core_files(spark, sf)
    for _ in range(2):
        # The second run finds nothing new.
        ing.stream_core_records(spark, source, root, check).awaitTermination()
    out = None
    for name in ("papers", "authors", "paper_authors"):
        row = ing.read_table(spark, root, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def _known_papers(spark, sf, root) -> None:
    known = v.papers(spark, sf).where(~F.col("withdrawn")).select(F.col("id").cast("string").alias("id"))
    for c in ing.TABLES["papers"].split(", ")[1:]:
        name, dtype = c.split(" ")
        known = known.withColumn(name, F.lit(None).cast(dtype))
    known.write.parquet(f"{root}/papers/batch_id=0")


@query("st1_stream_version_ingest", """SELECT CAST(o_orderkey AS VARCHAR) AS paper_id, unnest(CASE WHEN o_orderkey % 2=0 THEN [2,10] ELSE [1,2,10] END) AS version
    FROM orders WHERE o_orderkey IN (SELECT id FROM papers WHERE NOT withdrawn)""")
def _(spark, sf):
    root = scratch_path(spark, "ingested")
    _known_papers(spark, sf, root)
    ing.stream_version_records(spark, _version_files(spark, sf), root, scratch_path(spark, "checkpoint")).awaitTermination()
    return ing.read_table(spark, root, "paper_versions").select("paper_id", "version")


@query("st1_stream_paper_updates", """SELECT id AS paper_id, epoch(o_orderdate)::BIGINT AS created_second,
      epoch(CASE WHEN o_orderdate IS NOT NULL THEN o_orderdate + INTERVAL 30 DAY END)::BIGINT AS updated_second,
      coalesce(o_orderkey % 9=0, false) AS withdrawn, CASE WHEN o_orderkey IS NULL THEN 0 ELSE 2 + o_orderkey % 2 END AS n_versions,
      CASE WHEN o_orderkey IS NULL THEN 0 ELSE 2 END AS n_updates, CASE WHEN o_orderkey IS NULL THEN 0 WHEN o_orderkey % 4=0 THEN 1 ELSE 0 END AS n_once_withdrawn
    FROM (SELECT CAST(id AS VARCHAR) AS id, o.* FROM papers p LEFT JOIN orders o ON o.o_orderkey=p.id WHERE NOT p.withdrawn)""")
def _(spark, sf):
    root, files = scratch_path(spark, "ingested"), scratch_path(spark, "deliveries")
    checks = [scratch_path(spark, "checkpoint") for _ in range(2)]
    _known_papers(spark, sf, root)
    # The second delivery repeats all versions and brings a new last one, which withdraws some papers and restores others.
    for name, without in (("first", ("v10",)), ("second", ())):
        _version_files(spark, sf, f"{files}/{name}", without, 30)
        ing.stream_version_records(spark, f"{files}/*", root, checks[0]).awaitTermination()
        ing.stream_paper_updates(spark, root, checks[1]).awaitTermination()
    early = F.col("withdrawn") & (F.col("last_version") == 2)
    log = ing.read_table(spark, root, "paper_updates").groupBy("paper_id").agg(
        F.count("*").alias("n_updates"), F.count_if(early).alias("n_once_withdrawn")
    )
    papers = ing.current_papers(spark, root).withColumnRenamed("id", "paper_id").join(log, "paper_id", "left")
    return papers.select(
        "paper_id", F.unix_seconds("created").alias("created_second"), F.unix_seconds("updated").alias("updated_second"),
        F.coalesce("withdrawn", F.lit(False)).alias("withdrawn"), "n_versions",
        F.coalesce("n_updates", F.lit(0)).alias("n_updates"), F.coalesce("n_once_withdrawn", F.lit(0)).alias("n_once_withdrawn"),
    )


@query("st2_stream_sliding_usage", """SELECT epoch(w)::BIGINT AS start_second, api_key, count(*) AS n_requests, CAST(sum(tokens) AS BIGINT) AS tokens FROM
    (SELECT api_key, tokens, unnest(generate_series(time_bucket(INTERVAL '10 seconds', ts) - INTERVAL '50 seconds',
      time_bucket(INTERVAL '10 seconds', ts), INTERVAL '10 seconds')) AS w FROM usage_log) GROUP BY w, api_key""")
def _(spark, sf):
    schema = v.table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    log = raw.select(
        F.col("event_type").alias("api_key"), F.col("ts").cast("timestamp").alias("ts"), F.floor("value").cast("int").alias("tokens")
    )
    return us.run_usage(spark, log).select(F.unix_seconds("window_start").alias("start_second"), "api_key", "n_requests", "tokens")
