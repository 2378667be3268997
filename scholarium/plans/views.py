"""The given tables seen through the scholarly schemas, once as DataFrames and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarium.operators.ordering import number_within


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with an instant instead of a zone-less time."""
    df = table(spark, sf, "events")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def papers(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    lab = table(spark, sf, "labels")
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.substring_index("text", ". ", 1).alias("title"),
        F.col("text").alias("abstract"),
        F.concat_ws(" ", "lang", "source").alias("categories"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("withdrawn"),
        "quality",
    )


def paper_versions(spark: SparkSession, sf: str) -> DataFrame:
    numbered = number_within(
        events(spark, sf), ["user_id"], F.date_trunc("hour", "ts"), ["ts", "event_id"], "version"
    )
    return numbered.select(
        F.col("user_id").alias("paper_id"),
        F.col("version").cast("int").alias("version"),
        F.when(F.col("event_type") == "error", "I").otherwise("D").alias("source_type"),
        F.concat(F.floor("value").cast("int").cast("string"), F.lit("kb")).alias("size"),
        F.col("ts").alias("date"),
    )


def authors(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        key.alias("id"),
        F.concat(F.lit("Key"), (key % 40).cast("string")).alias("keyname"),
        F.when(key % 3 == 0, None).otherwise(F.concat(F.lit("F"), (F.col("s_nationkey") % 2).cast("string"))).alias(
            "forenames"
        ),
        F.when(key % 5 == 0, "jr").when(key % 5 == 1, "JR.").when(key % 5 == 2, "iii").alias("suffix"),
    )


def comma_authors(spark: SparkSession, sf: str) -> DataFrame:
    """Authors of which every seventh carries trailing commas in its key name."""
    a = authors(spark, sf)
    return a.withColumn(
        "keyname",
        F.when(F.col("id") % 14 == 0, F.concat("keyname", F.lit(",,")))
        .when(F.col("id") % 7 == 0, F.concat("keyname", F.lit(",")))
        .otherwise(F.col("keyname")),
    )


def paper_authors(spark: SparkSession, sf: str) -> DataFrame:
    links = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("author_id"))
        .agg(F.min("l_linenumber").alias("first_line"))
    )
    # Line number 1, 2, 3, ... of an order: the bucket that splits an order of very many lines.
    numbered = number_within(links, ["paper_id"], F.col("first_line"), ["first_line", "author_id"], "author_position")
    return numbered.select("paper_id", "author_id", F.col("author_position").cast("int").alias("author_position"))


def artifacts(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        F.lit(1).alias("trial_id"),
        v.alias("paper_id"),
        F.when(v % 4 == 0, -1).otherwise(F.col("label")).alias("cluster_id"),
        F.when(v % 4 == 0, 0.0).otherwise((1 + v % 10).cast("double") / 10).alias("cluster_prob"),
    )


def viz_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """Artifacts with a two-dimensional position (the first two dimensions)."""
    e = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("paper_id"),
        F.col("embedding")[0].cast("double").alias("x"),
        F.col("embedding")[1].cast("double").alias("y"),
    )
    return artifacts(spark, sf).join(e, "paper_id")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def cluster_labels(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("label")
    return (
        table(spark, sf, "embeddings")
        .where("label < 9")
        .select("label")
        .distinct()
        .select(
            k.alias("cluster_id"),
            F.when(k % 4 == 3, None).otherwise(F.concat(F.lit("Topic "), k.cast("string"))).alias("label"),
            F.when(k % 5 == 4, None).otherwise((k % 5).cast("double") / 4).alias("safety_relevance"),
        )
    )


def cluster_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """A metric row per cluster, noise included, plus one cluster without members."""
    k = F.col("cluster_id")
    known = artifacts(spark, sf).select("trial_id", "cluster_id").distinct()
    extra = table(spark, sf, "region").where("r_regionkey = 0").select(
        F.lit(1).alias("trial_id"), (F.col("r_regionkey") + 999).cast("int").alias("cluster_id")
    )
    return known.unionByName(extra).select(
        "trial_id",
        "cluster_id",
        (((k * 37) % 101).cast("double") / 100).alias("validity_index"),
        F.when(k % 3 == 0, F.concat(F.lit("L"), k.cast("string"))).alias("llm_label"),
    )


def cluster_trees(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    nations = table(spark, sf, "nation").join(
        customers, F.col("n_nationkey") == F.col("c_nationkey"), "left"
    ).select("n_nationkey", "n_regionkey", F.coalesce("n", F.lit(0)).alias("n"))
    per_region = nations.groupBy("n_regionkey").agg(F.sum("n").alias("n"))
    top = table(spark, sf, "region").join(per_region, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(
        F.lit(1).alias("trial_id"),
        # Not a literal: a constant key would turn joins on it into nested loops.
        (F.col("r_regionkey") * 0).cast("long").alias("parent_cluster_id"),
        (F.col("r_regionkey") + 1).cast("long").alias("child_cluster_id"),
        ((F.col("r_regionkey") + 1).cast("double") / 10).alias("lambda_val"),
        F.coalesce("n", F.lit(0)).cast("int").alias("child_size"),
    )
    low = nations.select(
        F.lit(1).alias("trial_id"),
        (F.col("n_regionkey") + 1).cast("long").alias("parent_cluster_id"),
        (F.col("n_nationkey") + 100).cast("long").alias("child_cluster_id"),
        ((F.col("n_nationkey") + 60).cast("double") / 100).alias("lambda_val"),
        F.col("n").cast("int").alias("child_size"),
    )
    return top.unionByName(low)


def tree_edges(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf, "embeddings").where("vec_id > 0").select(
        (v - 1).alias("src"), v.alias("dst"), ((1 + (v * 37) % 101).cast("double") / 100).alias("distance")
    )


def citation_edges(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .select(F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited"))
        .distinct()
    )


def usage_log(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(
        F.col("event_type").alias("api_key"), "ts", F.floor("value").cast("int").alias("tokens"), "event_id"
    )


def trials(spark: SparkSession, sf: str) -> DataFrame:
    """One trial per customer segment and nation, its value an average balance."""
    c = table(spark, sf, "customer")
    return (
        c.groupBy((F.col("c_nationkey") + 1).cast("int").alias("trial_id"))
        .agg(F.round(F.floor(F.avg("c_acctbal") / 500) / 10, 6).alias("value"), F.count("*").alias("n_customers"))
    )


VIEW_SQL: dict[str, str] = {
    "papers": """SELECT d.doc_id AS id, split_part(d.text,'. ',1) AS title, d.text AS abstract,
        concat(d.lang,' ',d.source) AS categories, (coalesce(l.toxic,0)=1) AS withdrawn, l.quality AS quality
        FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id""",
    "paper_versions": """SELECT user_id AS paper_id,
        CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts,event_id) AS INT) AS version,
        CASE WHEN event_type='error' THEN 'I' ELSE 'D' END AS source_type,
        concat(CAST(CAST(floor(value) AS INT) AS VARCHAR),'kb') AS size, ts AS date FROM events""",
    "authors": """SELECT s_suppkey AS id, concat('Key',CAST(s_suppkey % 40 AS VARCHAR)) AS keyname,
        CASE WHEN s_suppkey % 3=0 THEN NULL ELSE concat('F',CAST(s_nationkey % 2 AS VARCHAR)) END AS forenames,
        CASE WHEN s_suppkey % 5=0 THEN 'jr' WHEN s_suppkey % 5=1 THEN 'JR.'
             WHEN s_suppkey % 5=2 THEN 'iii' ELSE NULL END AS suffix FROM supplier""",
    "comma_authors": """SELECT id, CASE WHEN id % 14=0 THEN concat(keyname,',,') WHEN id % 7=0 THEN concat(keyname,',')
        ELSE keyname END AS keyname, forenames, suffix FROM authors""",
    "paper_authors": """SELECT paper_id, author_id,
        CAST(row_number() OVER (PARTITION BY paper_id ORDER BY first_line, author_id) AS INT) AS author_position
        FROM (SELECT l_orderkey AS paper_id, l_suppkey AS author_id, min(l_linenumber) AS first_line
              FROM lineitem GROUP BY l_orderkey, l_suppkey) t""",
    "artifacts": """SELECT 1 AS trial_id, vec_id AS paper_id,
        CASE WHEN vec_id % 4=0 THEN -1 ELSE label END AS cluster_id,
        CASE WHEN vec_id % 4=0 THEN CAST(0 AS DOUBLE) ELSE CAST(1 + vec_id % 10 AS DOUBLE)/10 END AS cluster_prob
        FROM embeddings""",
    "viz_artifacts": """SELECT a.*, CAST(e.embedding[1] AS DOUBLE) AS x, CAST(e.embedding[2] AS DOUBLE) AS y
        FROM artifacts a JOIN embeddings e ON a.paper_id=e.vec_id""",
    "cluster_labels": """SELECT label AS cluster_id,
        CASE WHEN label % 4=3 THEN NULL ELSE concat('Topic ',CAST(label AS VARCHAR)) END AS label,
        CASE WHEN label % 5=4 THEN NULL ELSE CAST(label % 5 AS DOUBLE)/4 END AS safety_relevance
        FROM (SELECT DISTINCT label FROM embeddings WHERE label < 9) t""",
    "cluster_metrics": """SELECT trial_id, cluster_id, CAST((cluster_id*37) % 101 AS DOUBLE)/100 AS validity_index,
        CASE WHEN cluster_id % 3=0 THEN concat('L',CAST(cluster_id AS VARCHAR)) ELSE NULL END AS llm_label
        FROM (SELECT DISTINCT trial_id, cluster_id FROM artifacts
              UNION ALL SELECT 1, CAST(r_regionkey+999 AS INT) FROM region WHERE r_regionkey=0) t""",
    "cluster_trees": """SELECT 1 AS trial_id, CAST(0 AS BIGINT) AS parent_cluster_id, 1+r_regionkey AS child_cluster_id,
        CAST(1+r_regionkey AS DOUBLE)/10 AS lambda_val,
        CAST((SELECT count(*) FROM customer JOIN nation ON c_nationkey=n_nationkey
              WHERE n_regionkey=r_regionkey) AS INT) AS child_size FROM region
        UNION ALL SELECT 1, 1+n_regionkey, 100+n_nationkey, CAST(60+n_nationkey AS DOUBLE)/100,
        CAST((SELECT count(*) FROM customer WHERE c_nationkey=n_nationkey) AS INT) FROM nation""",
    "tree_edges": """SELECT vec_id-1 AS src, vec_id AS dst, CAST(1 + (vec_id*37) % 101 AS DOUBLE)/100 AS distance
        FROM embeddings WHERE vec_id > 0""",
    "citation_edges": "SELECT DISTINCT l_orderkey AS citing, l_partkey AS cited FROM lineitem",
    "usage_log": "SELECT event_type AS api_key, ts, CAST(floor(value) AS INT) AS tokens, event_id FROM events",
    "trials": """SELECT CAST(c_nationkey+1 AS INT) AS trial_id, round(floor(avg(c_acctbal)/500)/10,6) AS value,
        count(*) AS n_customers FROM customer GROUP BY c_nationkey""",
}
