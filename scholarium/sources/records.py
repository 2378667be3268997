"""Readers for harvested metadata records in their two XML formats.

Both use an explicit schema: inference would turn an id such as ``1706.10`` into a number and a
single version into a struct instead of a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarium.functions.text import (
    empty_to_null,
    parse_record_date,
    strip_identifier_prefix,
    strip_trailing_commas,
    version_number,
)

HEADER = "header struct<identifier: string, _status: string>"
CORE_RECORD = (
    f"{HEADER}, metadata struct<arXiv: struct<id: string, created: string, updated: string, "
    "authors: struct<author: array<struct<keyname: string, forenames: string, suffix: string, "
    "affiliation: array<string>>>>, title: string, `msc-class`: string, `acm-class`: string, "
    "`report-no`: string, `journal-ref`: string, comments: string, abstract: string, categories: string, "
    "doi: string, proxy: string, license: string>>"
)
VERSION_RECORD = (
    f"{HEADER}, metadata struct<arXivRaw: struct<id: string, submitter: string, "
    "version: array<struct<_version: string, date: string, size: string, source_type: string>>>>"
)
# Column name and the element it is read from.
CORE_FIELDS = {
    "created": "created",
    "updated": "updated",
    "title": "title",
    "abstract": "abstract",
    "categories": "categories",
    "msc_class": "msc-class",
    "acm_class": "acm-class",
    "report_no": "report-no",
    "journal_ref": "journal-ref",
    "doi": "doi",
    "comments": "comments",
    "license": "license",
}
#: Few enough to be read by one task, and enough that a delivery stays within one batch of files.
RECORDS_PER_FILE = 500_000
XML_OPTIONS = {"rowTag": "record", "mode": "PERMISSIVE", "ignoreSurroundingSpaces": "false"}


def record_reader(spark: SparkSession, schema: str, modified_after: str | None = None):
    """Reader for one record format; ``modified_after`` resumes with files newer than that time."""
    reader = spark.read.format("xml").schema(schema).options(**XML_OPTIONS)
    return reader.option("modifiedAfter", modified_after) if modified_after else reader


def live_records(records: DataFrame, body: str) -> DataFrame:
    """Records that are not deleted, have an id and carry their metadata element."""
    return records.where(
        (~F.col("header._status").eqNullSafe(F.lit("deleted")))
        & F.col("header.identifier").isNotNull()
        & F.col(f"metadata.{body}").isNotNull()
    )


def core_columns(records: DataFrame) -> DataFrame:
    """Core metadata: id, optional fields (empty text is NULL) and the author list."""
    m = "metadata.arXiv"

    def clean(a: Column) -> Column:
        return F.struct(
            strip_trailing_commas(a["keyname"]).alias("keyname"),
            empty_to_null(a["forenames"]).alias("forenames"),
            empty_to_null(a["suffix"]).alias("suffix"),
        )

    listed = F.coalesce(F.col(f"{m}.authors.author"), F.array().cast("array<struct<keyname:string,forenames:string,suffix:string,affiliation:array<string>>>"))
    named = F.filter(listed, lambda a: F.coalesce(a["keyname"], F.lit("")) != "")
    return live_records(records, "arXiv").select(
        strip_identifier_prefix("header.identifier").alias("id"),
        *[empty_to_null(F.col(f"{m}.`{x}`")).alias(c) for c, x in CORE_FIELDS.items()],
        F.transform(named, clean).alias("authors"),
    )


def version_columns(records: DataFrame) -> DataFrame:
    """Version lists in number order; versions without a readable number are dropped."""

    def one(x: Column) -> Column:
        return F.struct(
            version_number(x["_version"]).alias("version"),
            parse_record_date(x["date"]).alias("date"),
            empty_to_null(x["size"]).alias("size"),
            F.coalesce(x["source_type"], F.lit("D")).alias("source_type"),
        )

    listed = F.transform(F.col("metadata.arXivRaw.version"), one)
    numbered = F.filter(listed, lambda x: x["version"].isNotNull())
    return live_records(records, "arXivRaw").select(
        strip_identifier_prefix("header.identifier").alias("id"), F.array_sort(numbered).alias("versions")
    )


def read_core_records(
    spark: SparkSession, path: str, max_records: int | None = None, modified_after: str | None = None
) -> DataFrame:
    """Scan core records below ``path``."""
    out = core_columns(record_reader(spark, CORE_RECORD, modified_after).load(path))
    return out if max_records is None else out.limit(max_records)


def read_version_records(
    spark: SparkSession, path: str, max_records: int | None = None, modified_after: str | None = None
) -> DataFrame:
    """Scan version records below ``path``."""
    out = version_columns(record_reader(spark, VERSION_RECORD, modified_after).load(path))
    return out if max_records is None else out.limit(max_records)


def version_rows(records: DataFrame) -> DataFrame:
    """Version lists to one row per paper and version."""
    return records.select(F.col("id").alias("paper_id"), F.explode("versions").alias("v")).select(
        "paper_id", "v.version", "v.source_type", "v.size", "v.date"
    )


def write_records(df: DataFrame, path: str) -> None:
    """Write nested records as XML, the inverse of the readers.

    Tags and indents are most of a record, so files are compressed. No task splits a file, hence none is very long.
    """
    out = df.write.format("xml").option("rowTag", "record").option("rootTag", "records")
    out.option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).save(path)
