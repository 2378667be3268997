"""Small helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarium.session import scratch_path

#: The six characters that count as white space in every contract of this folder.
WHITE = " \t\n\x0b\x0c\r"

#: Rows that travel to a Python worker at once. Texts may be long, so batches are short.
BATCH_ROWS = 256

Query = Callable[[SparkSession, str], DataFrame]


def short_batches(spark: SparkSession) -> None:
    """Keep the memory of a Python worker bounded by a few hundred texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def slices(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of a worker in pieces of a few rows, whatever the session sends at once."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal rows out evenly, for work that is heavy per row but reads little."""
    return df.repartition(partitions or parts(df.sparkSession))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def step(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there; survives lost executors.

    Steps hold texts, word numbers and sketches, which take much less room under zstd than under the default.
    """
    path = scratch_path(df.sparkSession, "step")
    _written.append(path)
    return _stored(df, path)


def kept_step(df: DataFrame) -> DataFrame:
    """As ``step``, but ``release`` leaves it."""
    return _stored(df, scratch_path(df.sparkSession, "kept"))


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Folders of the steps that this process has written and not yet removed.
_written: list[str] = []


def steps() -> list[str]:
    """The folders of all steps there are."""
    return list(_written)


def release(spark: SparkSession, paths: Iterable[str]) -> None:
    """Remove steps: whatever reads them has itself been written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
        _written.remove(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if it has at most ``rows`` rows; else joins find their own way."""
    return F.broadcast(df) if df.count() <= rows else df


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that ``df`` does not use."""
    out = []
    for name in wanted:
        while name.lower() in {c.lower() for c in df.columns}:
            name = f"_{name}"
        out.append(name)
    return out


def column(df: DataFrame, name: str) -> Column:
    """A column by its plain name, dots and spaces included."""
    return df[f"`{name}`"]


def fold(key: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id falls in fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(0)) % folds
