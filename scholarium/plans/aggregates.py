"""Queries: aggregates, histograms, windows, batching."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholarium.functions import text as tx
from scholarium.operators import authors as au
from scholarium.operators import citations as ci
from scholarium.operators import clusters as cl
from scholarium.operators import density as de
from scholarium.operators import hierarchy as hi
from scholarium.operators import ordering as od
from scholarium.operators import quality as qa
from scholarium.operators import tables as tb
from scholarium.operators import trials as tr
from scholarium.operators import usage as us
from scholarium.operators import vectors as ve
from scholarium.operators import versions as vs
from scholarium.plans import views as v
from scholarium.plans.registry import query
from scholarium.plans.relational import AUTHOR_SQL, IDENTITY_SQL


@query("a01_counts_and_shares", """SELECT 'active' AS metric, count(*) FILTER (WHERE NOT withdrawn) AS n, count(*) AS total,
      round(100.0*count(*) FILTER (WHERE NOT withdrawn)/count(*),1) AS pct FROM papers
    UNION ALL SELECT 'withdrawn', count(*) FILTER (WHERE withdrawn), count(*),
      round(100.0*count(*) FILTER (WHERE withdrawn)/count(*),1) FROM papers""")
def _(spark, sf):
    w = F.col("withdrawn")
    return qa.share_of_rows(v.papers(spark, sf), {"active": ~w, "withdrawn": w})


@query("a02_distinct_counts", "SELECT count(DISTINCT paper_id) AS papers, count(*) AS versions FROM paper_versions")
def _(spark, sf):
    return v.paper_versions(spark, sf).agg(F.countDistinct("paper_id").alias("papers"), F.count("*").alias("versions"))


@query("a03_category_frequency", """SELECT category, n, round(100.0*n/(SELECT count(*) FROM papers),1) AS pct FROM
    (SELECT category, count(*) AS n FROM (SELECT unnest(string_split(categories,' ')) AS category FROM papers)
     WHERE category<>'' GROUP BY category) ORDER BY n DESC, category LIMIT 10""")
def _(spark, sf):
    return qa.category_frequency(v.papers(spark, sf))


@query("a04_papers_per_author", """SELECT group_size, count(*) AS n_groups FROM (SELECT author_id, count(*) AS group_size
    FROM paper_authors GROUP BY author_id) GROUP BY group_size ORDER BY group_size LIMIT 10""")
def _(spark, sf):
    return qa.group_size_histogram(v.paper_authors(spark, sf), "author_id")


@query("a05_prolific_authors", "SELECT count(*) AS n FROM (SELECT author_id FROM paper_authors GROUP BY author_id HAVING count(*)>1)")
def _(spark, sf):
    return qa.repeated_groups(v.paper_authors(spark, sf), "author_id").agg(F.count("*").alias("n"))


@query("a06_mean_group_sizes", """SELECT 'authors_per_paper' AS metric, round(avg(n),6) AS mean_size FROM
      (SELECT count(*) AS n FROM paper_authors GROUP BY paper_id)
    UNION ALL SELECT 'versions_per_paper', round(avg(n),6) FROM (SELECT count(*) AS n FROM paper_versions GROUP BY paper_id)""")
def _(spark, sf):
    a = qa.mean_group_size(v.paper_authors(spark, sf), "paper_id")
    b = qa.mean_group_size(v.paper_versions(spark, sf), "paper_id")
    return a.select(F.lit("authors_per_paper").alias("metric"), "mean_size").unionByName(
        b.select(F.lit("versions_per_paper").alias("metric"), "mean_size")
    )


@query("a07_conditional_counts", """SELECT count(*) AS total, count(quality) AS labelled, count(*) FILTER (WHERE quality IS NULL) AS unlabelled,
    count(*) FILTER (WHERE quality>0) AS positive, count(*) FILTER (WHERE quality=0) AS zero FROM papers""")
def _(spark, sf):
    q = F.col("quality")
    return v.papers(spark, sf).agg(
        F.count("*").alias("total"),
        F.count("quality").alias("labelled"),
        F.count_if(q.isNull()).alias("unlabelled"),
        F.count_if(q > 0).alias("positive"),
        F.count_if(q == 0).alias("zero"),
    )


@query("a08_author_strings", AUTHOR_SQL.replace("SELECT pa.paper_id,", "SELECT pa.paper_id AS id,"))
def _(spark, sf):
    links = v.paper_authors(spark, sf)
    ids = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return qa.author_strings(ids, links, v.authors(spark, sf)).where(F.col("authors").isNotNull()).select("id", "authors")


@query("a09_citation_statistics", """SELECT count(*) AS processed, 0 AS unprocessed, round(avg(n),6) AS mean, round(stddev_samp(n),6) AS stddev,
    min(n) AS minimum, max(n) AS maximum, round(count(*) FILTER (WHERE n>0)*1.0/count(*),6) AS cited_share
    FROM (SELECT p.id, coalesce(c.n,0) AS n FROM papers p LEFT JOIN
      (SELECT cited, count(*) AS n FROM citation_edges GROUP BY cited) c ON p.id=c.cited)""")
def _(spark, sf):
    return ci.citation_statistics(ci.attach_citations(v.papers(spark, sf), v.citation_edges(spark, sf)))


@query("a09_pending_citations", """SELECT count(n) AS processed, count(*) FILTER (WHERE n IS NULL) AS unprocessed, round(avg(n),6) AS mean, round(stddev_samp(n),6) AS stddev,
    min(n) AS minimum, max(n) AS maximum, round(count(*) FILTER (WHERE n>0)*1.0/count(n),6) AS cited_share
    FROM (SELECT CASE WHEN p.id % 6<>0 THEN coalesce(c.n,0) END AS n FROM papers p LEFT JOIN
      (SELECT cited, count(*) AS n FROM citation_edges GROUP BY cited) c ON p.id=c.cited)""")
def _(spark, sf):
    # Papers whose count nobody has asked for yet.
    counted = ci.attach_citations(v.papers(spark, sf), v.citation_edges(spark, sf))
    return ci.citation_statistics(counted.withColumn("citation_count", F.when(F.col("id") % 6 != 0, F.col("citation_count"))))


@query("a10_membership_probability", """SELECT count(DISTINCT cluster_id) AS clusters, round(avg(cluster_prob),6) AS mean_prob,
    round(stddev_samp(cluster_prob),6) AS std_prob FROM artifacts WHERE trial_id=1 AND cluster_id IS NOT NULL""")
def _(spark, sf):
    return v.artifacts(spark, sf).where("trial_id = 1 AND cluster_id IS NOT NULL").agg(
        F.countDistinct("cluster_id").alias("clusters"),
        F.round(F.avg("cluster_prob"), 6).alias("mean_prob"),
        F.round(F.stddev_samp("cluster_prob"), 6).alias("std_prob"),
    )


@query("a11_field_coverage", """SELECT f AS field, n, total, round(100.0*n/total,1) AS pct FROM (
    SELECT unnest(['title','abstract','categories','quality']) AS f,
    unnest([count(title),count(abstract),count(categories),count(quality)]) AS n, count(*) AS total FROM papers)""")
def _(spark, sf):
    return qa.field_coverage(v.papers(spark, sf), ["title", "abstract", "categories", "quality"])


TITLE_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(title),
    '\bv\d+\b','','g'), 'arxiv:\d+\.\d+','','g'), '[^\p{L}\p{N}_\s]','','g'), '\s+',' ','g'))"""


@query("a12_duplicate_titles", f"""SELECT norm_title, count(*) AS n_papers, min(id) AS first_id FROM
    (SELECT id, {TITLE_SQL} AS norm_title FROM papers WHERE title IS NOT NULL AND NOT withdrawn)
    GROUP BY norm_title HAVING count(*)>1""")
def _(spark, sf):
    return qa.duplicate_titles(v.papers(spark, sf))


@query("a12_duplicate_title_members", f"""SELECT id, title, categories, norm_title, n_papers FROM
    (SELECT id, title, categories, {TITLE_SQL} AS norm_title, count(*) OVER (PARTITION BY {TITLE_SQL}) AS n_papers
     FROM papers WHERE title IS NOT NULL AND NOT withdrawn) WHERE n_papers>1""")
def _(spark, sf):
    return qa.duplicate_title_members(v.papers(spark, sf)).select("id", "title", "categories", "norm_title", "n_papers")


@query("a12_duplicate_title_totals", f"""SELECT count(*) AS n_groups, CAST(coalesce(sum(n),0) AS BIGINT) AS n_papers FROM (SELECT count(*) AS n FROM
    (SELECT {TITLE_SQL} AS norm_title FROM papers WHERE title IS NOT NULL AND NOT withdrawn) GROUP BY norm_title HAVING count(*)>1)""")
def _(spark, sf):
    return qa.duplicate_title_totals(v.papers(spark, sf))


@query("a13_canonical_authors", f"""SELECT min(id) AS id, keyname, nullif(f,'') AS forenames, nullif(s,'') AS suffix
    FROM ({IDENTITY_SQL}) GROUP BY keyname, f, s""")
def _(spark, sf):
    return au.canonical_authors(v.authors(spark, sf))


@query("a14_version_summary", """SELECT paper_id, min(date) FILTER (WHERE version=1) AS created, arg_max(date,version) AS updated,
    arg_max(source_type='I' OR size='0kb', version) AS withdrawn, count(*) AS n_versions FROM paper_versions GROUP BY paper_id""")
def _(spark, sf):
    s = vs.version_summary(v.paper_versions(spark, sf))
    return s.select(
        "paper_id",
        F.col("created").cast("timestamp_ntz").alias("created"),
        F.col("updated").cast("timestamp_ntz").alias("updated"),
        "withdrawn",
        "n_versions",
    )


@query("a15_cluster_sizes", "SELECT cluster_id, count(*) AS size FROM artifacts WHERE trial_id=1 AND cluster_id<>-1 GROUP BY cluster_id")
def _(spark, sf):
    return cl.cluster_sizes(v.artifacts(spark, sf), 1)


def _members(spark, sf):
    vec = v.vectors(spark, sf).select(F.col("id").alias("paper_id"), "embedding")
    return cl.clustered(v.artifacts(spark, sf), 1).join(vec, "paper_id").select("cluster_id", "paper_id", "embedding")


MEMBER_SQL = """SELECT a.cluster_id, a.paper_id, e.embedding FROM artifacts a JOIN embeddings e ON a.paper_id=e.vec_id
    WHERE a.cluster_id<>-1"""
CENTROID_SQL = f"""SELECT cluster_id, i AS dim, avg(x) AS value FROM (SELECT cluster_id, CAST(unnest(embedding) AS DOUBLE) AS x,
    generate_subscripts(embedding,1)-1 AS i FROM ({MEMBER_SQL})) GROUP BY cluster_id, i"""


@query("a16_centroids", f"SELECT cluster_id, dim, round(value,6) AS value FROM ({CENTROID_SQL})")
def _(spark, sf):
    c = ve.centroids(_members(spark, sf))
    return c.select("cluster_id", F.posexplode("centroid").alias("dim", "value")).select(
        "cluster_id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value")
    )


@query("a17_clustering_summary", """WITH s AS (SELECT cluster_id, count(*) AS n FROM artifacts GROUP BY cluster_id),
    c AS (SELECT * FROM s WHERE cluster_id<>-1), p AS (SELECT validity_index AS x FROM cluster_metrics WHERE cluster_id BETWEEN 0 AND 998)
    SELECT round((SELECT sum(n) FROM s WHERE cluster_id=-1)/(SELECT sum(n) FROM s),6) AS noise_ratio,
    (SELECT count(*) FROM c) AS n_clusters, (SELECT round(avg(n),6) FROM c) AS mean_cluster_size,
    (SELECT round(stddev_pop(n),6) FROM c) AS std_cluster_size, (SELECT round(max(n)/min(n),6) FROM c) AS cluster_size_ratio,
    (SELECT round(avg(x),6) FROM p) AS mean_persistence, (SELECT round(stddev_pop(x),6) FROM p) AS std_persistence""")
def _(spark, sf):
    pers = v.cluster_metrics(spark, sf).where("cluster_id BETWEEN 0 AND 998").select(
        "cluster_id", F.col("validity_index").alias("persistence")
    )
    return ve.clustering_summary(v.artifacts(spark, sf), 1, pers)


DIM_SQL = """SELECT vec_id AS id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding,1)-1 AS dim FROM embeddings"""


@query("a18_dimension_stats", f"SELECT dim, round(avg(x),6) AS mean, round(stddev_pop(x),6) AS std FROM ({DIM_SQL}) GROUP BY dim")
def _(spark, sf):
    s = ve.dimension_stats(v.vectors(spark, sf))
    return s.select(F.posexplode(F.arrays_zip("mean", "std")).alias("dim", "s")).select(
        F.col("dim").cast("long").alias("dim"), F.round("s.mean", 6).alias("mean"), F.round("s.std", 6).alias("std")
    )


@query("a19_probability_histogram", """WITH x AS (SELECT cluster_prob AS x FROM artifacts WHERE cluster_id<>-1),
    l AS (SELECT min(x) AS lo, max(x) AS hi, (max(x)-min(x))/50 AS w, count(*) AS n FROM x),
    c AS (SELECT CAST(least(floor((x-lo)/w),49) AS INT) AS bin, count(*) AS n FROM x, l GROUP BY 1)
    SELECT CAST(b.bin AS INT) AS bin, round(lo+w*b.bin,6) AS lower, round(lo+w*(b.bin+1),6) AS upper, coalesce(c.n,0) AS n,
    round(coalesce(c.n,0)/(l.n*w),6) AS density FROM range(50) b(bin) CROSS JOIN l LEFT JOIN c ON b.bin=c.bin""")
def _(spark, sf):
    return ve.histogram(cl.clustered(v.artifacts(spark, sf), 1), F.col("cluster_prob"), 50)


@query("a20_usage_totals", "SELECT count(*) AS n_requests, CAST(sum(tokens) AS BIGINT) AS tokens FROM usage_log")
def _(spark, sf):
    return us.usage_totals(v.usage_log(spark, sf))


@query("a21_scaled_levels", """SELECT parent_cluster_id, child_cluster_id,
    round((lambda_val-min(lambda_val) OVER ())/(max(lambda_val) OVER ()-min(lambda_val) OVER ()),6) AS level FROM cluster_trees""")
def _(spark, sf):
    return hi.lambda_range(v.cluster_trees(spark, sf), 1).select(
        "parent_cluster_id", "child_cluster_id", F.round("level", 6).alias("level")
    )


@query("a22_copy_validation", """SELECT 'papers' AS table_name, (SELECT count(*) FROM papers) AS source_rows, (SELECT count(*) FROM papers WHERE NOT withdrawn) AS target_rows,
      (SELECT count(*) FROM papers)=(SELECT count(*) FROM papers WHERE NOT withdrawn) AS matches
    UNION ALL SELECT 'authors', (SELECT count(*) FROM authors), (SELECT count(*) FROM authors), true""")
def _(spark, sf):
    p, a = v.papers(spark, sf), v.authors(spark, sf)
    return tb.compare_copies({"papers": (p, p.where(~F.col("withdrawn"))), "authors": (a, a)})


@query("a22_vector_sizes", "SELECT len(embedding)*4 AS bytes, count(*) AS n FROM embeddings GROUP BY 1")
def _(spark, sf):
    return v.vectors(spark, sf).groupBy(tx.vector_bytes("embedding").cast("long").alias("bytes")).agg(
        F.count("*").alias("n")
    )


@query("a23_best_trial", "SELECT trial_id, value FROM trials ORDER BY value DESC, trial_id LIMIT 1")
def _(spark, sf):
    return tr.best_trial(v.trials(spark, sf)).select("trial_id", "value")


@query("a24_levels_and_roots", """SELECT (SELECT count(DISTINCT lambda_val) FROM cluster_trees) AS n_levels,
    (SELECT count(DISTINCT parent_cluster_id) FROM cluster_trees WHERE parent_cluster_id NOT IN (SELECT child_cluster_id FROM cluster_trees)) AS n_roots""")
def _(spark, sf):
    t = v.cluster_trees(spark, sf)
    levels = hi.hierarchy_levels(t, 1).agg(F.count("*").alias("n_levels"))
    return levels.withColumn("n_roots", hi.roots(t, 1).agg(F.count("*")).scalar())


@query("a25_citation_counts", "SELECT cited, count(DISTINCT citing) AS citation_count FROM citation_edges GROUP BY cited")
def _(spark, sf):
    return ci.citation_counts(v.citation_edges(spark, sf))


LABEL_SQL = "SELECT paper_id AS id, cluster_id AS label FROM artifacts"
EDGE_CLASS_SQL = f"""WITH lab AS ({LABEL_SQL}), e AS (SELECT t.distance AS d, a.label AS la, b.label AS lb FROM tree_edges t
      JOIN lab a ON t.src=a.id JOIN lab b ON t.dst=b.id),
    k AS (SELECT DISTINCT label FROM lab WHERE label<>-1),
    dsc AS (SELECT la AS label, max(d) AS v FROM e WHERE la=lb AND la<>-1 GROUP BY la),
    dspc AS (SELECT label, min(d) AS v FROM (SELECT la AS label, d FROM e WHERE la<>lb AND la<>-1 AND lb<>-1
      UNION ALL SELECT lb, d FROM e WHERE la<>lb AND la<>-1 AND lb<>-1) GROUP BY label)"""


@query("a27_edge_class_extremes", EDGE_CLASS_SQL + """ SELECT k.label, coalesce(dsc.v,0) AS inside_max, dspc.v AS between_min
    FROM k LEFT JOIN dsc ON k.label=dsc.label LEFT JOIN dspc ON k.label=dspc.label""")
def _(spark, sf):
    labels = v.artifacts(spark, sf).select(F.col("paper_id").alias("id"), F.col("cluster_id").alias("label"))
    return de.edge_extremes(v.tree_edges(spark, sf), labels).select("label", "inside_max", "between_min")


@query("a28_unique_violations", """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1,2 HAVING count(*)>1""")
def _(spark, sf):
    return qa.check_unique(v.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("a28_foreign_key_violations", """SELECT paper_id, count(*) AS n FROM paper_authors
    WHERE paper_id NOT IN (SELECT doc_id FROM documents) GROUP BY paper_id""")
def _(spark, sf):
    return qa.check_foreign_key(v.paper_authors(spark, sf), v.table(spark, sf, "documents"), "paper_id", "doc_id")


@query("a28_null_violations", """SELECT 'forenames' AS column_name, count(*) AS n FROM authors WHERE forenames IS NULL
    UNION ALL SELECT 'suffix', count(*) FROM authors WHERE suffix IS NULL""")
def _(spark, sf):
    return qa.check_not_null(v.authors(spark, sf), ["keyname", "forenames", "suffix"])


# --- windows and batching ------------------------------------------------------------------------

@query("w01_author_positions", """SELECT o_orderkey AS paper_id, unnest(string_split(o_orderpriority,'-')) AS name,
    generate_subscripts(string_split(o_orderpriority,'-'),1) AS author_position FROM orders""")
def _(spark, sf):
    return v.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("paper_id"), F.posexplode(F.split("o_orderpriority", "-")).alias("pos", "name")
    ).select("paper_id", "name", (F.col("pos") + 1).cast("long").alias("author_position"))


@query("w02_first_and_last_version", """SELECT paper_id, CAST(min(version) AS INT) AS first_version, CAST(max(version) AS INT) AS last_version
    FROM paper_versions GROUP BY paper_id""")
def _(spark, sf):
    return vs.version_summary(v.paper_versions(spark, sf)).select("paper_id", "first_version", "last_version")


REPRESENTATIVE_SQL = f"""WITH m AS ({MEMBER_SQL}), c AS (SELECT cluster_id, list(value ORDER BY dim) AS c FROM ({CENTROID_SQL}) GROUP BY cluster_id),
    d AS (SELECT m.cluster_id, m.paper_id, round(list_distance(m.embedding::DOUBLE[], c.c),6) AS distance FROM m JOIN c ON m.cluster_id=c.cluster_id)
    SELECT cluster_id, paper_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY distance, paper_id) AS rank,
      count(*) OVER (PARTITION BY cluster_id) AS n FROM d) WHERE rank<=10 AND n>=5"""


@query("w03_representatives", REPRESENTATIVE_SQL)
def _(spark, sf):
    return ve.representatives(_members(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


@query("w04_rolling_usage", """SELECT event_id, api_key, count(*) OVER w AS requests_in_window, CAST(sum(tokens) OVER w AS BIGINT) AS tokens_in_window,
    count(*) OVER w > 2 AS over_requests, sum(tokens) OVER w > 100 AS over_tokens FROM usage_log
    WINDOW w AS (PARTITION BY api_key ORDER BY ts RANGE BETWEEN INTERVAL '59.999999 seconds' PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    return us.rolling_usage(v.usage_log(spark, sf), 2, 100).drop("ts", "tokens")


@query("w05_daily_count", """SELECT event_id, api_key, row_number() OVER (PARTITION BY api_key, CAST(ts AS DATE) ORDER BY ts, event_id) AS requests_today,
    row_number() OVER (PARTITION BY api_key, CAST(ts AS DATE) ORDER BY ts, event_id) > 50 AS over_day FROM usage_log""")
def _(spark, sf):
    return us.daily_count(v.usage_log(spark, sf), 50, ["ts", "event_id"]).select(
        "event_id", "api_key", "requests_today", "over_day"
    )


@query("w06_fixed_batches", "SELECT id, (row_number() OVER (ORDER BY id)-1)//128 AS batch, (row_number() OVER (ORDER BY id)-1)%128 AS position FROM papers")
def _(spark, sf):
    return od.fixed_batches(v.papers(spark, sf).select("id"), ["id"], 128)


TOKEN_SQL = "len(list_filter(string_split_regex(abstract,'\\s+'), lambda x: x<>''))"


@query("w07_token_packing", f"""WITH RECURSIVE b AS (SELECT id, {TOKEN_SQL} AS tokens, (row_number() OVER (ORDER BY id)-1)//128 AS batch,
      (row_number() OVER (ORDER BY id)-1)%128 AS position FROM papers),
    f AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY position) AS k FROM b WHERE tokens<=2000),
    s AS (SELECT batch, k, position, id, tokens, tokens AS used, CAST(0 AS BIGINT) AS sub_batch FROM f WHERE k=1
      UNION ALL SELECT f.batch, f.k, f.position, f.id, f.tokens,
        CASE WHEN s.used+f.tokens>2000 THEN f.tokens ELSE s.used+f.tokens END,
        CASE WHEN s.used+f.tokens>2000 THEN s.sub_batch+1 ELSE s.sub_batch END
      FROM s JOIN f ON f.batch=s.batch AND f.k=s.k+1)
    SELECT batch, sub_batch, position, id, tokens FROM s""")
def _(spark, sf):
    p = v.papers(spark, sf).select("id", tx.count_tokens("abstract").alias("tokens"))
    return us.pack_by_budget(od.fixed_batches(p, ["id"], 128), 2000)


@query("w10_continued_ids", """SELECT (SELECT max(s_suppkey) FROM supplier)+row_number() OVER (ORDER BY c_name, c_custkey) AS id, c_name FROM customer""")
def _(spark, sf):
    top = v.table(spark, sf, "supplier").agg(F.max("s_suppkey")).scalar()
    c = od.number_rows(v.table(spark, sf, "customer").select("c_name", "c_custkey"), ["c_name", "c_custkey"], "_n")
    return c.select((F.col("_n") + top).alias("id"), "c_name")
