"""Queries: scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholarium.functions import text as tx
from scholarium.functions import vectors as vf
from scholarium.operators import prompts as pr
from scholarium.plans import views as v
from scholarium.plans.aggregates import TITLE_SQL
from scholarium.plans.registry import query


@query("f01_identifier_prefix", "SELECT doc_id, '2401.' || CAST(doc_id AS VARCHAR) AS id FROM documents")
def _(spark, sf):
    raw = F.concat(F.lit("oai:arXiv.org:2401."), F.col("doc_id").cast("string"))
    return v.table(spark, sf, "documents").select("doc_id", tx.strip_identifier_prefix(raw).alias("id"))


@query("f02_trailing_commas", "SELECT id, rtrim(keyname,',') AS keyname FROM comma_authors")
def _(spark, sf):
    return v.comma_authors(spark, sf).select("id", tx.strip_trailing_commas("keyname").alias("keyname"))


@query("f03_blank_to_null", """SELECT c_custkey, CASE WHEN c_custkey % 3=0 THEN NULL ELSE c_mktsegment END AS segment FROM customer""")
def _(spark, sf):
    padded = F.when(F.col("c_custkey") % 3 == 0, F.lit("   ")).otherwise(F.concat(F.lit("  "), "c_mktsegment", F.lit(" ")))
    return v.table(spark, sf, "customer").select("c_custkey", tx.blank_to_null(padded).alias("segment"))


@query("f04_suffix", "SELECT id, CASE WHEN suffix IN ('jr','JR.') THEN 'Jr.' WHEN suffix='iii' THEN 'III' ELSE NULL END AS suffix FROM authors")
def _(spark, sf):
    return v.authors(spark, sf).select("id", tx.normalize_suffix("suffix").alias("suffix"))


@query("f05_normalised_titles", f"SELECT id, {TITLE_SQL} AS norm_title FROM papers")
def _(spark, sf):
    return v.papers(spark, sf).select("id", tx.normalize_title("title").alias("norm_title"))


@query("f05_normalised_texts", f"SELECT id, {TITLE_SQL.replace('lower(title)', 'lower(abstract)')} AS norm_text FROM papers")
def _(spark, sf):
    return v.papers(spark, sf).select("id", tx.normalize_title("abstract").alias("norm_text"))


@query("f06_split_categories", "SELECT id, unnest(string_split(categories,' ')) AS category, split_part(categories,' ',1) AS first FROM papers")
def _(spark, sf):
    p = v.papers(spark, sf)
    return p.select("id", F.explode(tx.split_categories("categories")).alias("category"), tx.primary_category("categories").alias("first"))


@query("f07_author_display", "SELECT id, keyname || coalesce(', '||forenames,'') || coalesce(' '||suffix,'') AS name FROM authors")
def _(spark, sf):
    return v.authors(spark, sf).select("id", tx.author_display("keyname", "forenames", "suffix").alias("name"))


@query("f08_text_prefixes", "SELECT id, substring(abstract,1,200) AS p200, substring(abstract,1,300) AS p300, substring(abstract,1,500) AS p500 FROM papers")
def _(spark, sf):
    return v.papers(spark, sf).select("id", *[tx.text_prefix("abstract", n).alias(f"p{n}") for n in (200, 300, 500)])


@query("f09_doi", "SELECT id, '10.48550/arXiv.' || CAST(id AS VARCHAR) AS doi FROM papers")
def _(spark, sf):
    return v.papers(spark, sf).select("id", tx.preprint_doi("id").alias("doi"))


@query("f10_resume_token", """SELECT page_id, CASE WHEN page_id % 5=0 THEN NULL ELSE CAST(page_id AS VARCHAR) || '|a+b c' END AS token FROM pages""")
def _(spark, sf):
    url = F.concat(
        F.col("url"),
        F.when(F.col("page_id") % 5 == 0, F.lit("?verb=ListRecords")).otherwise(
            F.concat(F.lit("?verb=ListRecords&resumptionToken="), F.col("page_id").cast("string"), F.lit("%7Ca+b%20c&x=1"))
        ),
    )
    return v.table(spark, sf, "pages").select("page_id", tx.resume_token(url).alias("token"))


@query("f11_version_numbers", """SELECT event_id, CASE WHEN event_type='error' THEN NULL ELSE CAST(event_id % 12 AS INT) END AS version FROM events""")
def _(spark, sf):
    mark = F.when(F.col("event_type") == "error", F.lit("vX")).otherwise(F.concat(F.lit("v"), (F.col("event_id") % 12).cast("string")))
    return v.table(spark, sf, "events").select("event_id", tx.version_number(mark).alias("version"))


@query("f12_record_dates", "SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS seconds FROM orders")
def _(spark, sf):
    text = F.concat(F.date_format("o_orderdate", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    return v.table(spark, sf, "orders").select("o_orderkey", F.unix_seconds(tx.parse_record_date(text)).alias("seconds"))


@query("f13_creation_stamp", "SELECT doc_id, TIMESTAMP '2024-05-06 07:08:09' AS created_at FROM documents")
def _(spark, sf):
    stamp = F.lit("2024-05-06 07:08:09").cast("timestamp")
    return v.table(spark, sf, "documents").select("doc_id", stamp.alias("created_at"))


@query("f14_guarded_shares", """SELECT c_nationkey, round(100.0*count(*) FILTER (WHERE c_acctbal>9000)/nullif(count(*) FILTER (WHERE c_acctbal>0),0),1) AS pct
    FROM customer GROUP BY c_nationkey""")
def _(spark, sf):
    b = F.col("c_acctbal")
    return v.table(spark, sf, "customer").groupBy("c_nationkey").agg(
        tx.percent(F.count_if(b > 9000), F.count_if(b > 0)).alias("pct")
    )


@query("f15_similarity", "SELECT src, dst, round(1-distance,6) AS similarity FROM tree_edges")
def _(spark, sf):
    return v.tree_edges(spark, sf).select("src", "dst", F.round(vf.similarity(F.col("distance")), 6).alias("similarity"))


@query("f16_distance_between_neighbours", """SELECT t.src, t.dst, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]),6) AS d,
    round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]),6) AS product
    FROM tree_edges t JOIN embeddings a ON t.src=a.vec_id JOIN embeddings b ON t.dst=b.vec_id""")
def _(spark, sf):
    e = v.vectors(spark, sf)
    a = e.select(F.col("id").alias("src"), vf.as_double("embedding").alias("a"))
    b = e.select(F.col("id").alias("dst"), vf.as_double("embedding").alias("b"))
    return v.tree_edges(spark, sf).join(a, "src").join(b, "dst").select(
        "src", "dst",
        F.round(vf.euclidean(F.col("a"), F.col("b")), 6).alias("d"),
        F.round(vf.dot(F.col("a"), F.col("b")), 6).alias("product"),
    )


@query("f17_slices", """SELECT vec_id, array_to_string(embedding[1:10]::VARCHAR[] , ' ') IS NOT NULL AS has_ten, len(embedding[1:10]) AS n,
    len(list_distinct(list_concat([label],[label]))) AS n_labels FROM embeddings""")
def _(spark, sf):
    first = F.slice("embedding", 1, 10)
    return v.table(spark, sf, "embeddings").select(
        "vec_id",
        F.array_join(first.cast("array<string>"), " ").isNotNull().alias("has_ten"),
        F.size(first).cast("long").alias("n"),
        F.size(F.array_distinct(F.array("label", "label"))).cast("long").alias("n_labels"),
    )


@query("f18_parsed_answers", """SELECT event_id, CASE WHEN ok THEN event_type END AS label, CASE WHEN ok THEN round(value/40,6) END AS safety_relevance,
    CASE WHEN event_id % 11=0 THEN 'unreadable' WHEN event_id % 7=0 THEN 'no label' WHEN NOT ok THEN 'relevance out of range' END AS rejected
    FROM (SELECT *, event_id % 11<>0 AND event_id % 7<>0 AND round(value/40,6)<=1 AS ok FROM events)""")
def _(spark, sf):
    score = F.round(F.col("value") / 40, 6)
    answer = (
        F.when(F.col("event_id") % 11 == 0, F.lit("not json"))
        .when(F.col("event_id") % 7 == 0, F.to_json(F.struct(score.alias("safety_relevance"))))
        .otherwise(F.to_json(F.struct(F.col("event_type").alias("label"), score.alias("safety_relevance"))))
    )
    return pr.parse_cluster_answers(v.table(spark, sf, "events").select("event_id", answer.alias("answer"))).drop("answer")


@query("f18_parsed_batches", """SELECT o_orderkey, CASE WHEN len(string_split(o_orderpriority,'-'))<>2 THEN 'wrong length' END AS rejected,
    len(string_split(o_orderpriority,'-')) AS n_labels FROM orders""")
def _(spark, sf):
    a = v.table(spark, sf, "orders").select(
        "o_orderkey", F.to_json(F.split("o_orderpriority", "-")).alias("answer"), F.lit(2).alias("n_items")
    )
    return pr.parse_batch_answers(a).select("o_orderkey", "rejected", F.size("labels").cast("long").alias("n_labels"))


@query("f19_json", """SELECT n_nationkey, '{"id":' || n_nationkey || ',"name":"' || n_name || '"}' AS json FROM nation""")
def _(spark, sf):
    return v.table(spark, sf, "nation").select(
        "n_nationkey", F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))).alias("json")
    )


@query("f20_boolean_coercion", "SELECT doc_id, CAST(toxic AS BOOLEAN) AS toxic FROM labels")
def _(spark, sf):
    return v.table(spark, sf, "labels").select("doc_id", F.col("toxic").cast("boolean").alias("toxic"))


@query("f21_vector_sizes", "SELECT vec_id, len(embedding)*4 AS bytes FROM embeddings")
def _(spark, sf):
    return v.table(spark, sf, "embeddings").select("vec_id", tx.vector_bytes("embedding").cast("long").alias("bytes"))


@query("f22_fixed_decimals", """SELECT cluster_id, CASE WHEN coalesce(safety_relevance,0)=0 THEN 'N/A' ELSE printf('%.2f', safety_relevance) END AS text FROM cluster_labels""")
def _(spark, sf):
    return v.cluster_labels(spark, sf).select("cluster_id", tx.fixed_decimals("safety_relevance").alias("text"))


@query("f23_token_counts", "SELECT id, len(list_filter(string_split_regex(abstract,'\\s+'), lambda x: x<>'')) AS n_tokens FROM papers")
def _(spark, sf):
    return v.papers(spark, sf).select("id", tx.count_tokens("abstract").cast("long").alias("n_tokens"))


# DuckDB has ASCII word borders only: letters and digits outside ASCII become 0 first.
FLAT = r"regexp_replace(regexp_replace(lower({0}), '[^\P{{L}}a-z]', '0', 'g'), '[^\P{{N}}0-9]', '0', 'g')"


def words_sql(expr: str) -> str:
    stops = ",".join(f"'{w}'" for w in tx.STOP_WORDS)
    return rf"list_filter(regexp_extract_all({FLAT.format(expr)}, '\b[a-z][a-z-]+\b'), lambda x: x NOT IN ({stops}))"


@query("f24_words_and_pairs", f"""WITH w AS (SELECT id, {words_sql('abstract')} AS w FROM papers),
    t AS (SELECT id, unnest(w) AS term FROM w UNION ALL
      SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) FROM w WHERE len(w)>1)
    SELECT id, term, count(*) AS n FROM t GROUP BY id, term""")
def _(spark, sf):
    t = v.papers(spark, sf).select("id", F.explode(tx.words_and_pairs(tx.words("abstract"))).alias("term"))
    return t.groupBy("id", "term").agg(F.count("*").alias("n"))


@query("f25_edge_widths", """SELECT parent_cluster_id, child_cluster_id, round(2.0*child_size/max(child_size) OVER (),6) AS width FROM cluster_trees WHERE child_size>1""")
def _(spark, sf):
    from scholarium.operators.hierarchy import network_edges

    return network_edges(v.cluster_trees(spark, sf), 1).select("parent_cluster_id", "child_cluster_id", "width")
