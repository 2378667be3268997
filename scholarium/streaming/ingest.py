"""Incremental ingest: new record files become rows of the stored tables, once each, and papers follow their versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from scholarium.operators.maintenance import core_additions
from scholarium.operators.tables import without_orphans
from scholarium.operators.versions import is_withdrawn
from scholarium.sources.records import CORE_RECORD, VERSION_RECORD, XML_OPTIONS, core_columns, version_columns, version_rows
from scholarium.sources.store import path_exists

TABLES = {
    "papers": "id string, title string, abstract string, categories string, msc_class string, acm_class string, "
    "doi string, license string, comments string, withdrawn boolean",
    "authors": "id long, keyname string, forenames string, suffix string",
    "paper_authors": "paper_id string, author_id long, author_position int",
    "paper_versions": "paper_id string, version int, source_type string, size string, date timestamp",
    "paper_updates": "paper_id string, created timestamp, updated timestamp, withdrawn boolean, n_versions long, last_version int",
}

#: State lives on local disks with its changes in the checkpoint folder, so its size is not bound by the heap.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_table(spark: SparkSession, root: str, name: str, before: int | None = None) -> DataFrame:
    """A table below ``root``; each applied batch is one partition. ``before`` hides later batches.

    Versions are those of stored papers: what arrived ahead of its paper waits in the folder.
    """
    path = f"{root}/{name}"
    if not path_exists(spark, path):
        return spark.createDataFrame([], TABLES[name])
    df = spark.read.schema(f"{TABLES[name]}, batch_id long").parquet(path)
    df = (df if before is None else df.where(F.col("batch_id") < before)).drop("batch_id")
    return without_orphans(df, read_table(spark, root, "papers"), "paper_id", "id") if name == "paper_versions" else df


def current_papers(spark: SparkSession, root: str) -> DataFrame:
    """Stored papers with the dates and the withdrawal that their versions say; without versions, without dates.

    Of a paper's updates the one with the most versions is the latest.
    """
    state = F.struct("created", "updated", "withdrawn", "n_versions")
    latest = read_table(spark, root, "paper_updates").groupBy("paper_id").agg(F.max_by(state, "n_versions").alias("_u"))
    papers = read_table(spark, root, "papers")
    return papers.join(latest, papers["id"] == latest["paper_id"], "left").select(
        *[c for c in papers.columns if c != "withdrawn"],
        F.coalesce("_u.withdrawn", "withdrawn").alias("withdrawn"), "_u.created", "_u.updated",
        F.coalesce("_u.n_versions", F.lit(0)).alias("n_versions"),
    )


def _append(df: DataFrame, root: str, name: str, batch_id: int) -> None:
    # Overwriting the batch's own partition makes a repeated batch harmless.
    df.write.mode("overwrite").parquet(f"{root}/{name}/batch_id={batch_id}")


def _start(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _start_keyed(spark: SparkSession, writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    """Start a query that keeps state per key. It copies the session's settings, which are put back after that."""
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, STATE_STORE)
    try:
        return _start(writer, checkpoint)
    finally:
        spark.conf.set(name, old)


def stream_core_records(spark: SparkSession, source: str, root: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Apply core record files that were not seen before, then stop. A restart continues where it ended."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        old = {n: read_table(spark, root, n, batch_id) for n in ("papers", "authors", "paper_authors")}
        added = core_additions(core_columns(batch), old["papers"], old["authors"], old["paper_authors"])
        for name, rows in zip(old, added, strict=True):
            _append(rows, root, name, batch_id)

    stream = (
        spark.readStream.format("xml").schema(CORE_RECORD).options(**XML_OPTIONS)
        .option("maxFilesPerTrigger", files_per_batch).load(source)
    )
    return _start(stream.writeStream.foreachBatch(apply), checkpoint)


def stream_version_records(spark: SparkSession, source: str, root: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Store the versions of record files that were not seen before, each (paper, version) as it was first delivered.

    Seen keys are state, so a batch looks up the keys that it brings and reads no stored table. Of differing rows
    of one key in the same batch any one stays.
    """
    stream = (
        spark.readStream.format("xml").schema(VERSION_RECORD).options(**XML_OPTIONS)
        .option("maxFilesPerTrigger", files_per_batch).load(source)
    )
    rows = version_rows(version_columns(stream)).dropDuplicates(["paper_id", "version"])
    return _start_keyed(spark, rows.writeStream.format("parquet").option("path", f"{root}/paper_versions"), checkpoint)


def stream_paper_updates(spark: SparkSession, root: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Follow the stored versions and write, for each paper that a batch touches, its dates and withdrawal as of now.

    The state is a line per paper: its first and its last version by number. A batch restores and changes
    the lines of its own papers only; ``current_papers`` joins the result with the papers.
    """
    stream = (
        spark.readStream.schema(TABLES["paper_versions"]).option("maxFilesPerTrigger", files_per_batch)
        .parquet(f"{root}/paper_versions")
    )
    last = F.max_by(F.struct("version", "date", "source_type", "size"), "version")
    state = stream.groupBy("paper_id").agg(
        F.min_by("date", "version").alias("created"), last.alias("last"), F.count("*").alias("n_versions")
    )
    update = state.select(
        "paper_id", "created", F.col("last.date").alias("updated"),
        F.coalesce(is_withdrawn(F.col("last.source_type"), F.col("last.size")), F.lit(False)).alias("withdrawn"),
        "n_versions", F.col("last.version").alias("last_version"),
    )

    def apply(batch: DataFrame, batch_id: int) -> None:
        _append(batch, root, "paper_updates", batch_id)

    return _start_keyed(spark, update.writeStream.outputMode("update").foreachBatch(apply), checkpoint)
