"""Statistics over vectors and clusterings: scaling, centroids, representatives, histograms, summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarium.functions.vectors import as_double, euclidean, standardise


def dimension_stats(df: DataFrame, vector: str = "embedding", by: list[str] | None = None) -> DataFrame:
    """Mean, population standard deviation and row count per dimension, as arrays; per group if asked.

    The summariser merges one buffer per task (and group) instead of shuffling a row per dimension.
    """
    stats = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(as_double(vector)))
    grouped = df.groupBy(*by) if by else df.groupBy()
    s = grouped.agg(stats.alias("s")).withColumn("n", F.col("s.count"))
    # The library variance divides by n - 1.
    shrink = F.when(F.col("n") > 0, (F.col("n") - 1) / F.col("n")).otherwise(F.lit(0.0))
    return s.select(
        *(by or []),
        "n",
        vector_to_array("s.mean").alias("mean"),
        F.transform(vector_to_array("s.variance"), lambda x: F.sqrt(F.greatest(x * shrink, F.lit(0.0)))).alias("std"),
    )


def scale_vectors(df: DataFrame, vector: str = "embedding", out: str = "scaled_embedding") -> DataFrame:
    """Standard-scale every dimension over all rows; dimensions without spread are only centred."""
    stats = dimension_stats(df.where(F.col(vector).isNotNull()), vector)
    # Rounding of the variance of a constant dimension must not blow it up.
    std = F.transform("std", lambda x: F.when(x < 1e-12, F.lit(0.0)).otherwise(x))
    one = stats.select(F.struct("mean", std.alias("std"))).scalar()
    return (
        df.withColumn("_s", one)
        .withColumn(out, standardise(as_double(vector), F.col("_s.mean"), F.col("_s.std")))
        .drop("_s")
    )


def centroids(members: DataFrame, vector: str = "embedding") -> DataFrame:
    """Mean vector per cluster."""
    return dimension_stats(members, vector, by=["cluster_id"]).select("cluster_id", F.col("mean").alias("centroid"), "n")


def representatives(
    members: DataFrame, n: int = 10, at_least: int = 5, vector: str = "embedding", salts: int = 32
) -> DataFrame:
    """The ``n`` members nearest to their cluster's centroid, for clusters with enough members.

    ``members`` has (cluster_id, paper_id, vector). A join and a rank by cluster alone would send a
    large cluster to one task: its members are spread over ``salts`` parts, each part keeps its ``n``
    best, and the best of those are ranked.
    """
    c = centroids(members, vector).where(F.col("n") >= at_least)
    copies = c.select("cluster_id", "centroid", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    salted = members.withColumn("_salt", F.pmod(F.xxhash64("paper_id"), F.lit(salts)).cast("int"))
    d = F.round(euclidean(as_double(vector), F.col("centroid")), 6)
    near = salted.join(copies, ["cluster_id", "_salt"]).select("cluster_id", "_salt", "paper_id", d.alias("distance"))
    part = Window.partitionBy("cluster_id", "_salt").orderBy("distance", "paper_id")
    best = near.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= n)
    w = Window.partitionBy("cluster_id").orderBy("distance", "paper_id")
    return (
        best.select("cluster_id", "paper_id", "distance")
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= n)
    )


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """Equal-width bins over [min, max], the last one closed; every bin gets a row.

    Equal values all around give one bin half a unit to each side. Density integrates to one.
    """
    values = df.select(value.cast("double").alias("_x")).where(F.col("_x").isNotNull())
    lims = values.agg(
        F.struct(F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.count("*").alias("n"))
    ).scalar()
    flat = F.col("_l.lo") == F.col("_l.hi")
    framed = (
        values.withColumn("_l", lims)
        .withColumn("_lo", F.when(flat, F.col("_l.lo") - 0.5).otherwise(F.col("_l.lo")))
        .withColumn("_w", F.when(flat, F.lit(1.0)).otherwise(F.col("_l.hi") - F.col("_l.lo")) / bins)
    )
    bin_of = F.least(F.floor((F.col("_x") - F.col("_lo")) / F.col("_w")), F.lit(bins - 1)).cast("int")
    counts = framed.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("_c"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).withColumn("_l", lims)
    width = F.when(flat, F.lit(1.0)).otherwise(F.col("_l.hi") - F.col("_l.lo")) / bins
    lo = F.when(flat, F.col("_l.lo") - 0.5).otherwise(F.col("_l.lo"))
    n = F.coalesce("_c", F.lit(0))
    return every.join(counts, "bin", "left").select(
        "bin",
        F.round(lo + width * F.col("bin"), 6).alias("lower"),
        F.round(lo + width * (F.col("bin") + 1), 6).alias("upper"),
        n.alias("n"),
        F.round(F.try_divide(n, F.col("_l.n") * width), 6).alias("density"),
    )


def clustering_summary(artifacts: DataFrame, trial_id: int, persistence: DataFrame | None = None) -> DataFrame:
    """Noise ratio, cluster count, size statistics and persistence of one trial; zeros when all is noise.

    ``persistence`` has one row per cluster (cluster_id, persistence).
    """
    rows = artifacts.where(F.col("trial_id") == trial_id)
    sizes = rows.groupBy("cluster_id").agg(F.count("*").alias("size"))
    real = F.when(F.col("cluster_id") != -1, F.col("size"))
    s = sizes.agg(
        F.round(
            F.coalesce(F.sum(F.when(F.col("cluster_id") == -1, F.col("size"))), F.lit(0)) / F.sum("size"), 6
        ).alias("noise_ratio"),
        F.count(real).alias("n_clusters"),
        F.round(F.coalesce(F.avg(real), F.lit(0.0)), 6).alias("mean_cluster_size"),
        F.round(F.coalesce(F.stddev_pop(real), F.lit(0.0)), 6).alias("std_cluster_size"),
        F.round(F.coalesce(F.try_divide(F.max(real), F.min(real)), F.lit(0.0)), 6).alias("cluster_size_ratio"),
    )
    if persistence is None:
        return s
    p = persistence.agg(
        F.struct(
            F.round(F.coalesce(F.avg("persistence"), F.lit(0.0)), 6).alias("m"),
            F.round(F.coalesce(F.stddev_pop("persistence"), F.lit(0.0)), 6).alias("s"),
        )
    ).scalar()
    return (
        s.withColumn("_p", p)
        .withColumn("mean_persistence", F.col("_p.m"))
        .withColumn("std_persistence", F.col("_p.s"))
        .drop("_p")
    )


def random_projection(df: DataFrame, k: int, vector: str = "embedding", out: str = "reduced", seed: int = 42) -> DataFrame:
    """Gaussian random projection to ``k`` dimensions.

    Row ``i`` of the matrix depends on seed and ``i`` only, so every task builds the same matrix from
    the vector length and nothing is shipped.
    """
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, `{out}` array<double>"

    def project(batches):
        matrix = None
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[vector].to_numpy()).astype(float)
                if matrix is None:
                    rng = np.random.default_rng(seed)
                    matrix = rng.normal(size=(x.shape[1], k)) / np.sqrt(k)
                yield pdf.assign(**{out: list(x @ matrix)})
            else:
                yield pdf.assign(**{out: pd.Series(dtype=object)})

    return df.mapInPandas(project, schema)


def pca_projection(df: DataFrame, k: int, vector: str = "embedding", out: str = "reduced") -> DataFrame:
    """Principal components from the covariance that Spark gathers (dimension × dimension, not rows)."""
    from pyspark.ml.feature import PCA

    with_vec = df.withColumn("_v", array_to_vector(as_double(vector)))
    model = PCA(k=k, inputCol="_v", outputCol="_r").fit(with_vec)
    return model.transform(with_vec).withColumn(out, vector_to_array("_r")).drop("_v", "_r")


def reduce_dims(df: DataFrame, k: int, method: str = "pca", vector: str = "embedding", out: str = "reduced") -> DataFrame:
    """Fewer dimensions for clustering or display."""
    if method == "pca":
        return pca_projection(df, k, vector, out)
    if method == "random_projection":
        return random_projection(df, k, vector, out)
    raise ValueError(f"unknown method {method}")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_f32(blob: pd.Series) -> pd.Series:
    """Little-endian float32 bytes to a vector."""
    return blob.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4"))


@F.pandas_udf(T.BinaryType())
def encode_f32(vec: pd.Series) -> pd.Series:
    """Vector to little-endian float32 bytes."""
    return vec.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


