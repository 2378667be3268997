"""Queries: vectors, neighbours, clustering, keywords, reports."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from scholarium.functions import text as tx
from scholarium.operators import clusters as cl
from scholarium.operators import density as de
from scholarium.operators import descent as dc
from scholarium.operators import hierarchy as hi
from scholarium.operators import keywords as kw
from scholarium.operators import models as mo
from scholarium.operators import neighbours as nb
from scholarium.operators import prompts as pr
from scholarium.operators import quality_graph as qg
from scholarium.operators import report as rp
from scholarium.operators import tables as tb
from scholarium.operators import trials as tr
from scholarium.operators import vectors as ve
from scholarium.plans import views as v
from scholarium.plans.aggregates import EDGE_CLASS_SQL, LABEL_SQL, REPRESENTATIVE_SQL, _members
from scholarium.plans.functions import words_sql
from scholarium.plans.registry import query
from scholarium.plans.relational import REPORT_SQL, WALK_SQL
from scholarium.plans.stores import _trial_records
from scholarium.session import cut_lineage, scratch_path
from scholarium.sources import store

KNN_SQL = """SELECT src, rank, dst, distance FROM (SELECT src, dst, distance, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM
    (SELECT a.vec_id AS src, b.vec_id AS dst, round(greatest(1-list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]),0),6)+0.0 AS distance
     FROM embeddings a, embeddings b)) WHERE rank<={k}"""


def _graph(spark, sf, k=100):
    return nb.knn_graph(v.vectors(spark, sf), k, "cosine").withColumn("rank", F.col("rank").cast("long"))


@query("j19_knn_graph", KNN_SQL.replace("{k}", "100"))
def _(spark, sf):
    return _graph(spark, sf)


@query("j19_knn_euclidean", """SELECT src, rank, dst, distance FROM (SELECT src, dst, distance, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM
    (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]),6) AS distance
     FROM embeddings a, embeddings b WHERE a.vec_id<>b.vec_id)) WHERE rank<=10""")
def _(spark, sf):
    return nb.knn_graph(v.vectors(spark, sf), 10, "euclidean", include_self=False).withColumn("rank", F.col("rank").cast("long"))


@query("j19_approximate_neighbours")
def _(spark, sf):
    return nb.approximate_graph(v.vectors(spark, sf), 10, 1.2)


@query("j19_descent_neighbours")
def _(spark, sf):
    return dc.descent_graph(v.vectors(spark, sf), 10)


# Lists are full, and at least 95 % of the exact neighbours are found; SQL knows how many those are.
@query("j19_descent_recall", "SELECT 10*count(*) AS n_exact, 10*count(*) AS n_listed, true AS recall_reached FROM embeddings")
def _(spark, sf):
    found = cut_lineage(dc.descent_graph(v.vectors(spark, sf), 10))
    exact = nb.knn_graph(v.vectors(spark, sf), 10, "cosine", include_self=False)
    n_listed = found.agg(F.count("*")).scalar()
    return dc.recall(found, exact).select("n_exact", n_listed.alias("n_listed"), (F.col("recall") >= 0.95).alias("recall_reached"))


@query("w08_top_neighbours", KNN_SQL.replace("{k}", "5"))
def _(spark, sf):
    return _graph(spark, sf, 5)


@query("s10_stored_graph", KNN_SQL.replace("{k}", "20"))
def _(spark, sf):
    path = scratch_path(spark, "graph")
    name = "graph_" + path.rsplit("-", 1)[1]
    store.save_graph(_graph(spark, sf, 20), name, path, buckets=8)
    return spark.table(name)


@query("v01_embedded_documents")
def _(spark, sf):
    d = v.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return mo.hashed_tfidf(d, dim=256)


@query("v01_embedder_plug_in", "SELECT doc_id AS id, length(text) AS n_chars FROM documents")
def _(spark, sf):
    import numpy as np

    d = v.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    vec = mo.embed(d, lambda texts: np.array([[len(t), 1.0] for t in texts]))
    return vec.select("id", F.col("embedding")[0].cast("long").alias("n_chars"))


@query("v01_pending_embeddings", """WITH RECURSIVE t AS (SELECT id, title || chr(10) || abstract AS text FROM papers WHERE id % 3<>0),
    b AS (SELECT id, length(text) AS n_chars, len(list_filter(string_split_regex(text,'\\s+'), lambda x: x<>'')) AS tokens,
      (row_number() OVER (ORDER BY id)-1)//128 AS batch, (row_number() OVER (ORDER BY id)-1)%128 AS position FROM t),
    f AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY position) AS k FROM b WHERE tokens<=2000),
    s AS (SELECT batch, k, id, n_chars, tokens AS used, 0::BIGINT AS sub FROM f WHERE k=1
      UNION ALL SELECT f.batch, f.k, f.id, f.n_chars, CASE WHEN s.used+f.tokens>2000 THEN f.tokens ELSE s.used+f.tokens END,
        CASE WHEN s.used+f.tokens>2000 THEN s.sub+1 ELSE s.sub END FROM s JOIN f ON f.batch=s.batch AND f.k=s.k+1),
    c AS (SELECT id, n_chars, count(*) OVER w AS call_texts, CAST(sum(n_chars) OVER w AS BIGINT) AS call_chars,
      row_number() OVER (PARTITION BY batch, sub ORDER BY k) AS place FROM s WINDOW w AS (PARTITION BY batch, sub))
    SELECT id, n_chars, call_texts, call_chars, place FROM c UNION ALL SELECT id, -1, -1, -1, -1 FROM papers WHERE id % 3=0
    UNION ALL SELECT id, NULL, NULL, NULL, NULL FROM b WHERE tokens>2000""")
def _(spark, sf):
    p = v.papers(spark, sf)
    stored = F.when(F.col("id") % 3 == 0, F.array_repeat(F.lit(-1.0), 4).cast("array<float>"))
    texts = p.select("id", tx.embedding_text(F.lit(""), "title", "abstract", prefix=False).alias("text"))

    def measure(texts):
        # What a call sees: its texts in order.
        return [[len(t), len(texts), sum(map(len, texts)), i + 1] for i, t in enumerate(texts)]

    done = mo.embed_pending(p.select("id", stored.alias("embedding")), texts, measure, per_call=128, token_limit=2000)
    names = ["n_chars", "call_texts", "call_chars", "place"]
    return done.select("id", *[F.col("embedding")[i].cast("long").alias(c) for i, c in enumerate(names)])


SCALED_SQL = """SELECT vec_id AS id, dim, round((x-avg(x) OVER (PARTITION BY dim))/stddev_pop(x) OVER (PARTITION BY dim),6)+0.0 AS value FROM
    (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding,1)-1 AS dim FROM embeddings)"""


@query("v02_scaled_vectors", SCALED_SQL)
def _(spark, sf):
    s = ve.scale_vectors(v.vectors(spark, sf))
    return s.select("id", F.posexplode("scaled_embedding").alias("dim", "value")).select(
        "id", F.col("dim").cast("long").alias("dim"), (F.round("value", 6) + 0.0).alias("value")
    )


@query("v03_scaled_knn_graph", f"""WITH s AS (SELECT id, list(value ORDER BY dim) AS e FROM ({SCALED_SQL.replace('round((', '((').replace(',6)+0.0 AS value', ') AS value')}) GROUP BY id)
    SELECT src, rank, dst, distance FROM (SELECT src, dst, distance, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM
    (SELECT a.id AS src, b.id AS dst, round(greatest(1-list_cosine_similarity(a.e, b.e),0),6)+0.0 AS distance FROM s a, s b)) WHERE rank<=100""")
def _(spark, sf):
    s = ve.scale_vectors(v.vectors(spark, sf)).select("id", F.col("scaled_embedding").alias("embedding"))
    return nb.knn_graph(s, 100, "cosine").withColumn("rank", F.col("rank").cast("long"))


QUALITY_SQL = f"""WITH g AS ({KNN_SQL.replace('{k}', '100')}), p AS (SELECT src, avg(1-distance) AS m, var_pop(1-distance) AS s2 FROM g GROUP BY src),
    t AS (SELECT avg(m) AS m, stddev_pop(m) AS s, avg(s2) AS vm, stddev_pop(s2) AS vs FROM p)"""


@query("v04_neighbourhood_quality", QUALITY_SQL + """ SELECT src, round(p.m,6) AS mean_similarity, round(p.s2,6) AS variance,
    (p.m<t.m-2*t.s OR p.s2>t.vm+2*t.vs) AS outlier FROM p, t""")
def _(spark, sf):
    q = nb.neighbourhood_quality(cut_lineage(_graph(spark, sf, 100)))
    return q.select("src", F.round("mean_similarity", 6).alias("mean_similarity"), F.round("variance", 6).alias("variance"), "outlier")


@query("v04_quality_summary", QUALITY_SQL + """ SELECT round(avg(p.m),6) AS global_mean, round(stddev_pop(p.m),6) AS global_std, round(avg(p.s2),6) AS var_mean,
    round(stddev_pop(p.s2),6) AS var_std, count(*) FILTER (WHERE p.m<t.m-2*t.s OR p.s2>t.vm+2*t.vs) AS outlier_count,
    round(min(p.m),6) AS lowest, round(max(p.m),6) AS highest FROM p, t""")
def _(spark, sf):
    return nb.quality_summary(cut_lineage(_graph(spark, sf, 100)))


@query("v04_similarity_histogram", QUALITY_SQL + """, l AS (SELECT min(m) AS lo, (max(m)-min(m))/20 AS w FROM p)
    SELECT CAST(b.bin AS INT) AS bin, coalesce(c.n,0) AS n FROM range(20) b(bin) LEFT JOIN
    (SELECT least(floor((m-lo)/w),19) AS bin, count(*) AS n FROM p, l GROUP BY 1) c ON b.bin=c.bin""")
def _(spark, sf):
    q = nb.neighbourhood_quality(cut_lineage(_graph(spark, sf, 100)))
    return ve.histogram(cut_lineage(q), F.col("mean_similarity"), 20).select("bin", "n")


@query("v05_principal_components")
def _(spark, sf):
    return ve.reduce_dims(v.vectors(spark, sf), 15, "pca").select("id", "reduced")


@query("v05_random_projection")
def _(spark, sf):
    return ve.reduce_dims(v.vectors(spark, sf), 15, "random_projection").select("id", "reduced")


def _clustering(spark, sf):
    return de.density_clusters(v.vectors(spark, sf).select("id", "embedding"), 10, 5)


# Prim's tree over mutual reachability, then its merges one by one: lists hold the state of all points.
MERGES_SQL = """WITH RECURSIVE
    e AS (SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL),
    d AS (SELECT a.i AS i, b.i AS j, round(list_distance(a.x, b.x), 6) AS d FROM e a JOIN e b ON a.i <> b.i),
    core AS (SELECT i, max(d) AS core FROM (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM d) WHERE r <= {m} GROUP BY i),
    m AS (SELECT d.i, list(greatest(d.d, a.core, b.core) ORDER BY d.j) AS ws, list(d.j ORDER BY d.j) AS js
          FROM d JOIN core a ON d.i = a.i JOIN core b ON d.j = b.i GROUP BY d.i),
    full_rows AS MATERIALIZED (SELECT i, list_concat(list_concat(ws[1:i - 1], ['infinity'::DOUBLE]), ws[i:len(ws)]) AS row FROM m),
    prim AS (
        SELECT 0 AS step, 1::BIGINT AS pt, 0::BIGINT AS src, 0::DOUBLE AS w, row AS best, list_transform(row, lambda x: 1::BIGINT) AS via, [1::BIGINT] AS done
        FROM full_rows WHERE i = 1
        UNION ALL
        SELECT p.step + 1, p.pick, p.via[p.pick], p.best[p.pick],
               list_transform(p.best, lambda x, k: CASE WHEN list_contains(p.done, k) OR k = p.pick THEN 'infinity'::DOUBLE ELSE least(x, r.row[k]) END),
               list_transform(p.via, lambda x, k: CASE WHEN r.row[k] < p.best[k] THEN p.pick ELSE x END),
               list_append(p.done, p.pick)
        FROM (SELECT *, list_position(best, list_min(best))::BIGINT AS pick FROM prim) p JOIN full_rows r ON r.i = p.pick
        WHERE len(p.done) < len(p.best)),
    tree AS MATERIALIZED (SELECT row_number() OVER (ORDER BY w, least(pt, src), greatest(pt, src)) AS step, least(pt, src) AS u, greatest(pt, src) AS v, w FROM prim WHERE step > 0),
    merges AS (
        SELECT 0::BIGINT AS step, NULL::DOUBLE AS w, -1 AS x_node, -1 AS y_node, -1 AS node, 0 AS total, 0 AS made,
               list_transform(range(1, 1 + (SELECT count(*) FROM e)), lambda i: {'c': i, 'n': -1, 'w': 0::DOUBLE}) AS pts,
               list_transform(range(1, 1 + (SELECT count(*) FROM e)), lambda i: {'s': 1, 'n': -1}) AS comps
        UNION ALL
        SELECT q.step + 1, q.nw, q.nx, q.ny, q.nn, q.ns, q.made + CASE WHEN q.fresh THEN 1 ELSE 0 END,
               list_transform(q.pts, lambda p: CASE WHEN p.c <> q.x AND p.c <> q.y THEN p
                   WHEN q.nn >= 0 AND (p.c = q.x AND q.nx < 0 OR p.c = q.y AND q.ny < 0) THEN {'c': q.x, 'n': q.nn, 'w': q.nw}
                   ELSE {'c': q.x, 'n': p.n, 'w': p.w} END),
               list_transform(q.comps, lambda s, k: CASE WHEN k = q.x THEN {'s': q.ns, 'n': q.nn} ELSE s END)
        FROM (SELECT *, CASE WHEN nx >= 0 AND ny >= 0 OR nx < 0 AND ny < 0 AND ns >= {s} THEN made WHEN nx >= 0 THEN nx WHEN ny >= 0 THEN ny ELSE -1 END AS nn,
                     nx >= 0 AND ny >= 0 OR nx < 0 AND ny < 0 AND ns >= {s} AS fresh
              FROM (SELECT g.*, t.w AS nw, g.pts[t.u].c AS x, g.pts[t.v].c AS y, g.comps[g.pts[t.u].c].n AS nx, g.comps[g.pts[t.v].c].n AS ny,
                           g.comps[g.pts[t.u].c].s + g.comps[g.pts[t.v].c].s AS ns FROM merges g JOIN tree t ON t.step = g.step + 1)) q),
    nodes AS (SELECT node, max(total) AS size FROM merges WHERE node >= 0 GROUP BY node),
    edges AS (SELECT node AS parent, unnest([x_node, y_node]) AS child, w FROM merges WHERE x_node >= 0 AND y_node >= 0)"""
MERGES_SQL = MERGES_SQL.replace("{m}", "5").replace("{s}", "10")


@query("v06_density_clusters", MERGES_SQL + """,
    left_at AS (SELECT i, p.n AS node, p.w AS w FROM (SELECT unnest(range(1, 1 + len(pts))) AS i, unnest(pts) AS p FROM merges
                ORDER BY step DESC LIMIT (SELECT count(*) FROM e))),
    owned AS (SELECT e.vec_id AS id, l.w, l.node FROM left_at l JOIN e ON e.i = l.i
              WHERE node IN (SELECT child FROM edges) AND node NOT IN (SELECT parent FROM edges)),
    named AS (SELECT node, row_number() OVER (ORDER BY min(id)) - 1 AS cluster_id, 1 / min(w) AS top FROM owned GROUP BY node)
    SELECT v.vec_id AS id, CAST(coalesce(n.cluster_id, -1) AS INTEGER) AS cluster_id,
           CASE WHEN n.node IS NULL THEN 0.0::DOUBLE WHEN o.w = 0 THEN 1.0 ELSE least(1 / o.w, n.top) / n.top END AS cluster_prob
    FROM embeddings v LEFT JOIN owned o ON o.id = v.vec_id LEFT JOIN named n ON n.node = o.node""")
def _(spark, sf):
    return _clustering(spark, sf).labels


@query("v06_condensed_tree", MERGES_SQL + """
    SELECT CAST(parent AS BIGINT) AS parent_cluster_id, CAST(child AS BIGINT) AS child_cluster_id,
           CASE WHEN w = 0 THEN 'infinity'::DOUBLE ELSE 1 / w END AS lambda_val, CAST(size AS BIGINT) AS child_size
    FROM edges JOIN nodes ON nodes.node = edges.child""")
def _(spark, sf):
    return _clustering(spark, sf).tree


@query("v06_spanning_tree_weight", MERGES_SQL + " SELECT count(*) AS n_edges, round(sum(w), 4) AS weight FROM tree")
def _(spark, sf):
    return _clustering(spark, sf).mst.agg(F.count("*").alias("n_edges"), F.round(F.sum("w"), 4).alias("weight"))


# The spanning tree has n - 1 edges; SQL can say that much about it.
@query("v06_spanning_tree_size", "SELECT count(*)-1 AS n_edges FROM embeddings")
def _(spark, sf):
    return _clustering(spark, sf).mst.agg(F.count("*").alias("n_edges"))


@query("v07_relative_validity", EDGE_CLASS_SQL + """, x AS (SELECT max(d) AS longest, min(d) FILTER (WHERE (la=-1)<>(lb=-1)) AS outlier FROM e),
    z AS (SELECT k.label, (SELECT count(*) FROM lab WHERE lab.label=k.label) AS size, coalesce(dsc.v,0) AS a,
      coalesce(dspc.v, 2*CASE WHEN (SELECT count(*) FROM k)>1 THEN x.longest ELSE coalesce(x.outlier,x.longest) END) AS b
      FROM k CROSS JOIN x LEFT JOIN dsc ON k.label=dsc.label LEFT JOIN dspc ON k.label=dspc.label)
    SELECT round(sum(size*(b-a)/greatest(a,b))/(SELECT count(*) FROM lab),6) AS relative_validity FROM z""")
def _(spark, sf):
    labels = v.artifacts(spark, sf).select(F.col("paper_id").alias("id"), F.col("cluster_id").alias("label"))
    return de.relative_validity(v.tree_edges(spark, sf), labels)


@query("v08_clustering_summary", """WITH c AS (SELECT cluster_id, count(*) AS n FROM artifacts WHERE cluster_id<>-1 GROUP BY 1)
    SELECT round((SELECT count(*) FROM artifacts WHERE cluster_id=-1)*1.0/(SELECT count(*) FROM artifacts),6) AS noise_ratio,
    count(*) AS n_clusters, round(avg(n),6) AS mean_cluster_size, round(stddev_pop(n),6) AS std_cluster_size,
    round(max(n)/min(n),6) AS cluster_size_ratio FROM c""")
def _(spark, sf):
    return ve.clustering_summary(v.artifacts(spark, sf), 1)


RANK_SQL = """SELECT a.vec_id AS src, b.vec_id AS dst, row_number() OVER (PARTITION BY a.vec_id
    ORDER BY round(list_distance(a.embedding[1:{d}]::DOUBLE[], b.embedding[1:{d}]::DOUBLE[]),6), b.vec_id) AS r
    FROM embeddings a, embeddings b WHERE a.vec_id<>b.vec_id"""


@query("v09_trustworthiness", f"""WITH h AS ({RANK_SQL.replace('{d}', '64')}), l AS ({RANK_SQL.replace('{d}', '8')}), n AS (SELECT count(*) AS n FROM embeddings)
    SELECT round(1-2.0/(n.n*5*(2*n.n-3*5-1))*s.s,6) AS trustworthiness FROM n, (SELECT sum(greatest(h.r-5,0)) AS s FROM l JOIN h USING (src,dst) WHERE l.r<=5) s""")
def _(spark, sf):
    # The first eight dimensions stand for a reduction that SQL can repeat.
    e = v.vectors(spark, sf).select("id", "embedding")
    return qg.trustworthiness(e, e.select("id", F.slice("embedding", 1, 8).alias("embedding")), 5)


@query("w09_full_neighbour_ranks", f"""SELECT src, dst, r AS far_rank FROM ({RANK_SQL.replace('{d}', '64')}) JOIN tree_edges USING (src, dst)""")
def _(spark, sf):
    return qg.full_ranks(v.vectors(spark, sf), v.tree_edges(spark, sf).select("src", "dst"))


@query("v12_centroid_norms", """SELECT cluster_id, round(sqrt(sum(x*x)),6) AS length FROM (SELECT cluster_id, i, avg(x) AS x FROM
    (SELECT a.cluster_id, CAST(unnest(e.embedding) AS DOUBLE) AS x, generate_subscripts(e.embedding,1) AS i
     FROM artifacts a JOIN embeddings e ON a.paper_id=e.vec_id WHERE a.cluster_id<>-1) GROUP BY 1,2) GROUP BY 1""")
def _(spark, sf):
    from scholarium.functions.vectors import norm

    return ve.centroids(_members(spark, sf)).select("cluster_id", F.round(norm(F.col("centroid")), 6).alias("length"))


@query("v13_representative_titles", f"""SELECT r.cluster_id, r.rank, p.title FROM ({REPRESENTATIVE_SQL}) r JOIN papers p ON r.paper_id=p.id""")
def _(spark, sf):
    r = ve.representatives(_members(spark, sf)).select("cluster_id", "paper_id", F.col("rank").cast("long").alias("rank"))
    titles = v.papers(spark, sf).select(F.col("id").alias("paper_id"), "title")
    return r.join(titles, "paper_id").select("cluster_id", "rank", "title")


def _text_members(spark, sf):
    return cl.members_with_text(v.artifacts(spark, sf), v.papers(spark, sf), 1).select("cluster_id", "paper_id", "title", "abstract")


KEYWORD_SQL = f"""WITH m AS (SELECT a.cluster_id, a.paper_id, {words_sql("(p.title || ' ' || p.abstract)")} AS w
      FROM artifacts a JOIN papers p ON a.paper_id=p.id WHERE a.cluster_id<>-1),
    t AS (SELECT cluster_id, paper_id, unnest(w) AS term FROM m UNION ALL SELECT cluster_id, paper_id,
      unnest(list_transform(range(1,len(w)), lambda i: w[i] || ' ' || w[i+1])) FROM m WHERE len(w)>1),
    tf AS (SELECT cluster_id, paper_id, term, count(*) AS tf FROM t GROUP BY ALL),
    nd AS (SELECT cluster_id, count(*) AS n FROM m GROUP BY 1),
    df AS (SELECT f.cluster_id, f.term, count(*) AS df, any_value(nd.n) AS n FROM tf f JOIN nd ON f.cluster_id=nd.cluster_id GROUP BY 1,2
      HAVING count(*)>=3 AND count(*)<=0.7*any_value(nd.n)),
    w AS (SELECT tf.cluster_id, tf.paper_id, tf.term, tf*(ln((1+n)/(1+df))+1) AS w FROM tf JOIN df ON tf.cluster_id=df.cluster_id AND tf.term=df.term),
    l AS (SELECT cluster_id, paper_id, sqrt(sum(w*w)) AS len FROM w GROUP BY 1,2),
    s AS (SELECT w.cluster_id, w.term, round(sum(w/len),6) AS score FROM w JOIN l ON w.cluster_id=l.cluster_id AND w.paper_id=l.paper_id GROUP BY 1,2),
    keywords AS (SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, term) AS rank, term, score FROM s QUALIFY rank<=10)"""


@query("v14_cluster_keywords", KEYWORD_SQL + " SELECT cluster_id, rank, term, score FROM keywords")
def _(spark, sf):
    return kw.cluster_keywords(_text_members(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


@query("v15_default_labels", KEYWORD_SQL + """ SELECT cluster_id, string_agg(term, ', ' ORDER BY rank) AS keywords FROM keywords WHERE rank<=3 GROUP BY cluster_id""")
def _(spark, sf):
    return kw.keyword_lines(kw.cluster_keywords(_text_members(spark, sf)), 3)


@query("v15_labeler_plug_in", """SELECT cluster_id, 'Size ' || least(count(*),10) AS label, 0.5::DOUBLE AS safety_relevance FROM artifacts a JOIN papers p ON a.paper_id=p.id
    WHERE cluster_id<>-1 GROUP BY cluster_id""")
def _(spark, sf):
    members = cl.members_with_text(v.artifacts(spark, sf), v.papers(spark, sf), 1)
    prompts = pr.cluster_prompts(cl.top_members(members, 10), "Name the topic.")

    def count_blocks(texts):
        return ['{"label": "Size %d", "safety_relevance": 0.5}' % t.count("Title: ") for t in texts]

    return mo.label_prompts(prompts, count_blocks).select("cluster_id", "label", "safety_relevance")


@query("v15_paper_labels", """SELECT id, CASE WHEN id % 4=0 THEN 'kept' WHEN length(abstract) % 23<>0 THEN 'Length ' || length(abstract) END AS llm_category FROM papers""")
def _(spark, sf):
    def measure(prompts):
        # A paper of certain lengths spoils the answer of its whole prompt.
        for prompt in prompts:
            sizes = [len(x.split("\nAbstract: ", 1)[1]) for x in prompt.split("\n\nTitle: ")[1:]]
            labels = [f"Length {n}" for n in sizes]
            yield json.dumps(labels[1:] if any(n % 23 == 0 for n in sizes) else labels)

    p = v.papers(spark, sf).withColumn("llm_category", F.when(F.col("id") % 4 == 0, "kept"))
    return mo.label_papers(p, measure, "Give each paper a category.").select("id", "llm_category")


@query("v16_parameter_sweep")
def _(spark, sf):
    done = tr.run_trials(v.vectors(spark, sf).select("id", "embedding"), tr.parameter_grid(spark, 3, seed=7), scratch_path(spark, "trials"))
    return tr.best_trial(done).select("trial_id", "value", F.col("metrics")["n_clusters"].alias("n_clusters"))


@query("v17_papers_in_cluster", """SELECT a.paper_id, p.title, a.cluster_prob FROM artifacts a JOIN papers p ON a.paper_id=p.id WHERE a.cluster_id=3""")
def _(spark, sf):
    return rp.papers_in_cluster(v.artifacts(spark, sf), v.papers(spark, sf), 1, 3).select("paper_id", "title", "cluster_prob")


@query("v17_cluster_analysis", KEYWORD_SQL + """, k AS (SELECT cluster_id, string_agg(term, ', ' ORDER BY rank) AS keywords FROM keywords WHERE rank<=5 GROUP BY cluster_id),
    n AS (SELECT cluster_id, count(*) AS size FROM artifacts GROUP BY 1),
    c AS (SELECT parent_cluster_id AS cluster_id, count(*) AS n_children, max(child_size) AS largest_child FROM cluster_trees WHERE lambda_val>=0.2 GROUP BY 1)
    SELECT coalesce(n.cluster_id,c.cluster_id) AS cluster_id, coalesce(size,0) AS size, coalesce(n_children,0) AS n_children, largest_child, coalesce(keywords,'') AS keywords
    FROM n FULL JOIN c ON n.cluster_id=c.cluster_id LEFT JOIN k ON coalesce(n.cluster_id,c.cluster_id)=k.cluster_id""")
def _(spark, sf):
    lines = kw.keyword_lines(kw.cluster_keywords(_text_members(spark, sf)), 5)
    return rp.cluster_analysis(v.artifacts(spark, sf), v.cluster_trees(spark, sf), 1, 0.2, lines)


@query("v18_hierarchy_print", """WITH RECURSIVE w AS (
      SELECT DISTINCT parent_cluster_id AS cluster_id, 0 AS depth FROM cluster_trees WHERE parent_cluster_id NOT IN (SELECT child_cluster_id FROM cluster_trees)
      UNION ALL SELECT t.child_cluster_id, w.depth+1 FROM cluster_trees t JOIN w ON t.parent_cluster_id=w.cluster_id)
    SELECT depth, repeat('  ', depth) || 'Cluster ' || w.cluster_id || ' (' || coalesce(n.size,0) || ' papers)' AS line FROM w
    LEFT JOIN (SELECT cluster_id, count(*) AS size FROM artifacts GROUP BY 1) n ON w.cluster_id=n.cluster_id""")
def _(spark, sf):
    walk = hi.hierarchy_walk(v.cluster_trees(spark, sf), 1, sizes=cl.cluster_sizes(v.artifacts(spark, sf), 1))
    line = F.concat(F.expr("repeat('  ', depth)"), F.lit("Cluster "), F.col("cluster_id").cast("string"), F.lit(" ("), F.col("size").cast("string"), F.lit(" papers)"))
    return walk.orderBy("path").select("depth", line.alias("line"))


PREORDER_SQL = """w AS (
      SELECT DISTINCT parent_cluster_id AS cluster_id, 0 AS depth, lpad(CAST(parent_cluster_id AS VARCHAR),20,'0') AS path
        FROM cluster_trees WHERE parent_cluster_id NOT IN (SELECT child_cluster_id FROM cluster_trees)
      UNION ALL SELECT t.child_cluster_id, w.depth+1, w.path || '/' || lpad(CAST(1000000000000-t.child_size AS VARCHAR),13,'0')
        || '-' || lpad(CAST(t.child_cluster_id AS VARCHAR),20,'0') FROM cluster_trees t JOIN w ON t.parent_cluster_id=w.cluster_id),
    placed AS (SELECT cluster_id, depth, path, row_number() OVER (ORDER BY path) AS place FROM w)"""


@query("j15_preorder_walk", f"""WITH RECURSIVE {PREORDER_SQL} SELECT cluster_id, place, CAST(depth AS BIGINT) AS depth,
    (SELECT count(*) FROM placed b WHERE starts_with(b.path, a.path)) AS n_below FROM placed a""")
def _(spark, sf):
    return hi.preorder(v.cluster_trees(spark, sf), 1)


@query("v18_printed_tree", KEYWORD_SQL.replace("WITH ", f"WITH RECURSIVE {PREORDER_SQL.replace('w AS', 'walk AS', 1).replace('JOIN w ON', 'JOIN walk w ON').replace('FROM w)', 'FROM walk)')}, ", 1) + """,
    lines AS (SELECT cluster_id, string_agg(term, ', ' ORDER BY rank) AS line FROM keywords WHERE rank<=5 GROUP BY 1),
    n AS (SELECT cluster_id, count(*) AS size FROM artifacts WHERE cluster_id<>-1 GROUP BY 1)
    SELECT p.place, p.cluster_id, CAST(p.depth AS BIGINT) AS depth, repeat('  ', p.depth) || 'Cluster ' || p.cluster_id || ' (' || coalesce(n.size,0) || ' papers)' AS line,
      repeat('  ', p.depth) || 'Keywords: ' || l.line AS keywords FROM placed p LEFT JOIN n ON n.cluster_id=p.cluster_id LEFT JOIN lines l ON l.cluster_id=p.cluster_id""")
def _(spark, sf):
    sizes = cl.cluster_sizes(v.artifacts(spark, sf), 1)
    lines = kw.keyword_lines(kw.cluster_keywords(_text_members(spark, sf)), 5)
    return hi.printed_tree(v.cluster_trees(spark, sf), 1, sizes, lines)


@query("v19_network_edges", """SELECT parent_cluster_id, child_cluster_id, child_size AS weight, round((lambda_val-lo)/(hi-lo),6) AS level,
    round(2.0*child_size/max(child_size) OVER (),6) AS width FROM cluster_trees, (SELECT min(lambda_val) AS lo, max(lambda_val) AS hi FROM cluster_trees)
    WHERE child_size>1""")
def _(spark, sf):
    return hi.network_edges(v.cluster_trees(spark, sf), 1)


NODES_SQL = """WITH e AS (SELECT *, (lambda_val-min(lambda_val) OVER ())/(max(lambda_val) OVER ()-min(lambda_val) OVER ()) AS level FROM cluster_trees),
    x AS (SELECT parent_cluster_id AS c, level, false AS child FROM e WHERE child_size>1 UNION ALL SELECT child_cluster_id, level, true FROM e WHERE child_size>1),
    n AS (SELECT c AS cluster_id, max(level) AS level, bool_or(child) AS child FROM x GROUP BY c),
    a AS (SELECT cluster_id, count(*) AS size FROM artifacts WHERE cluster_id<>-1 GROUP BY 1),
    y AS (SELECT n.cluster_id, round(n.level,6) AS level, CASE WHEN child THEN coalesce(a.size,0) ELSE 0 END AS size FROM n LEFT JOIN a ON n.cluster_id=a.cluster_id)
    SELECT *, CASE WHEN size>0 THEN round(1000.0*size/(SELECT count(*) FROM y WHERE size>0),6) ELSE 100.0 END AS node_size FROM y"""


@query("v19_network_nodes", NODES_SQL)
def _(spark, sf):
    return hi.network_nodes(v.cluster_trees(spark, sf), 1, cl.cluster_sizes(v.artifacts(spark, sf), 1))


@query("v19_network_labels", KEYWORD_SQL + f""",
    lines AS (SELECT cluster_id, string_agg(term, chr(10) ORDER BY rank) AS line FROM keywords WHERE rank<=3 GROUP BY 1)
    SELECT o.*, CASE WHEN o.size>5 THEN l.line WHEN o.size=0 THEN '' END AS text FROM ({NODES_SQL}) o LEFT JOIN lines l ON l.cluster_id=o.cluster_id""")
def _(spark, sf):
    nodes = hi.network_nodes(v.cluster_trees(spark, sf), 1, cl.cluster_sizes(v.artifacts(spark, sf), 1))
    return hi.network_labels(nodes, kw.keyword_lines(kw.cluster_keywords(_text_members(spark, sf)), 3, "\n"))


@query("v20_dendrogram_matrix", """SELECT parent_cluster_id AS row_id, child_cluster_id AS col_id, lambda_val FROM cluster_trees
    UNION ALL SELECT child_cluster_id, parent_cluster_id, lambda_val FROM cluster_trees""")
def _(spark, sf):
    return hi.dendrogram_matrix(v.cluster_trees(spark, sf), 1)


SERIES = "coalesce(nullif(l.label,''),'Cluster ' || a.cluster_id)"


@query("v21_scatter", f"""SELECT a.paper_id, a.cluster_id, a.x, a.y, CASE WHEN a.cluster_id=-1 THEN 0.1 ELSE a.cluster_prob END AS alpha,
    CASE WHEN a.cluster_id=-1 THEN 'Noise' ELSE {SERIES} END AS series FROM viz_artifacts a LEFT JOIN cluster_labels l ON a.cluster_id=l.cluster_id""")
def _(spark, sf):
    return rp.scatter(v.viz_artifacts(spark, sf), v.cluster_labels(spark, sf), 1)


@query("v21_scatter_noise", "SELECT paper_id, x, y, CASE WHEN cluster_id=-1 THEN 'Noise' ELSE 'Clusters' END AS series FROM viz_artifacts")
def _(spark, sf):
    return rp.scatter_noise(v.viz_artifacts(spark, sf), 1)


@query("v21_scatter_largest", f"""SELECT a.paper_id, a.cluster_id, a.x, a.y, CASE WHEN t.cluster_id IS NULL THEN 'Other Clusters' ELSE {SERIES} END AS series
    FROM viz_artifacts a LEFT JOIN cluster_labels l ON a.cluster_id=l.cluster_id LEFT JOIN (SELECT cluster_id FROM artifacts WHERE cluster_id<>-1
      GROUP BY 1 ORDER BY count(*) DESC, cluster_id DESC LIMIT 4) t ON a.cluster_id=t.cluster_id WHERE a.cluster_id<>-1""")
def _(spark, sf):
    return rp.scatter_largest(v.viz_artifacts(spark, sf), v.cluster_labels(spark, sf), 1, 4)


@query("v21_scatter_most_relevant", f"""SELECT a.paper_id, a.cluster_id, a.x, a.y, CASE WHEN t.cluster_id IS NULL THEN 'Other Clusters' ELSE {SERIES} END AS series
    FROM viz_artifacts a LEFT JOIN cluster_labels l ON a.cluster_id=l.cluster_id LEFT JOIN (SELECT cluster_id FROM cluster_labels WHERE safety_relevance IS NOT NULL
      ORDER BY safety_relevance DESC, cluster_id LIMIT 4) t ON a.cluster_id=t.cluster_id WHERE a.cluster_id<>-1""")
def _(spark, sf):
    return rp.scatter_most_relevant(v.viz_artifacts(spark, sf), v.cluster_labels(spark, sf), 1, 4)


@query("v21_relevance_heat", """SELECT a.paper_id, a.cluster_id, a.x, a.y, coalesce(l.safety_relevance,0) AS relevance FROM viz_artifacts a
    LEFT JOIN cluster_labels l ON a.cluster_id=l.cluster_id WHERE a.cluster_id<>-1""")
def _(spark, sf):
    return rp.relevance_heat(v.viz_artifacts(spark, sf), v.cluster_labels(spark, sf), 1)


@query("v21_scatter_at_level", f"""SELECT a.paper_id, a.cluster_id, a.cluster_prob, CASE WHEN a.cluster_id IN (SELECT cluster_id FROM
    ({WALK_SQL.replace('{x}', '0.25')}) w) THEN 'Cluster ' || a.cluster_id ELSE 'Noise' END AS series FROM artifacts a""")
def _(spark, sf):
    return rp.scatter_at_level(v.artifacts(spark, sf), v.cluster_trees(spark, sf), 1, 0.25)


@query("v22_persistence_listing", "SELECT cluster_id, validity_index AS persistence FROM cluster_metrics WHERE trial_id=1")
def _(spark, sf):
    return rp.persistence_listing(v.cluster_metrics(spark, sf), 1)


@query("v23_cluster_report", f"""SELECT cluster_id, size, label, relevance, CASE WHEN relevance=0 THEN 'N/A' ELSE printf('%.2f', relevance) END AS relevance_text FROM ({REPORT_SQL})""")
def _(spark, sf):
    return rp.cluster_report(v.artifacts(spark, sf), v.cluster_labels(spark, sf), 1)


@query("v24_parameters", "SELECT trial_id, 'min_cluster_size' AS parameter, CAST(trial_id+20 AS VARCHAR) AS value FROM trials")
def _(spark, sf):
    return tr.parameter_rows(_trial_records(spark, sf))


@query("v24_metrics", "SELECT trial_id, 'n_customers' AS metric, CAST(n_customers AS DOUBLE) AS value FROM trials UNION ALL SELECT trial_id, 'value', value FROM trials")
def _(spark, sf):
    return tr.metric_rows(_trial_records(spark, sf), ["n_customers", "value"])


@query("v11_missing_metrics", """SELECT trial_id, cluster_id, validity_index FROM cluster_metrics UNION ALL
    SELECT 2, cluster_id, CAST(count(*) AS DOUBLE) FROM artifacts WHERE cluster_id<>-1 GROUP BY cluster_id""")
def _(spark, sf):
    stored = v.cluster_metrics(spark, sf).select("trial_id", "cluster_id", "validity_index")
    a = v.artifacts(spark, sf)
    both = a.unionByName(a.withColumn("trial_id", F.lit(2)))
    have = stored.select("trial_id", "cluster_id")
    todo = both.where("cluster_id <> -1").select("trial_id", "cluster_id").distinct().join(have, ["trial_id", "cluster_id"], "left_anti")
    fresh = both.join(todo, ["trial_id", "cluster_id"], "left_semi").groupBy("trial_id", "cluster_id").agg(
        F.count("*").cast("double").alias("validity_index")
    )
    return tb.upsert(stored, fresh, ["trial_id", "cluster_id"])


def _validity(spark, sf):
    m = _members(spark, sf).select(F.col("paper_id").alias("id"), "cluster_id", "embedding")
    return de.density_validity(m, 5)


@query("v10_density_validity")
def _(spark, sf):
    return de.cluster_validity(_members(spark, sf).select(F.col("paper_id").alias("id"), "cluster_id", "embedding"), 5)


MEMBER_REACH_SQL = """WITH m AS (SELECT a.cluster_id, e.vec_id, e.embedding::DOUBLE[] AS v FROM artifacts a JOIN embeddings e ON a.paper_id=e.vec_id
      WHERE a.cluster_id<>-1),
    d AS (SELECT a.vec_id, round(list_distance(a.v,b.v),6) AS d FROM m a JOIN m b ON a.cluster_id=b.cluster_id),
    c AS (SELECT m.*, core FROM m JOIN (SELECT vec_id, max(d) AS core FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS r FROM d)
      WHERE r<=5 GROUP BY vec_id) k ON m.vec_id=k.vec_id)"""


@query("v10_cluster_separations", MEMBER_REACH_SQL + """ SELECT a.cluster_id, round(min(greatest(list_distance(a.v,b.v), a.core, b.core)),6) AS separation
    FROM c a JOIN c b ON a.cluster_id<>b.cluster_id GROUP BY a.cluster_id""")
def _(spark, sf):
    return de.cluster_separations(_members(spark, sf).select(F.col("paper_id").alias("id"), "cluster_id", "embedding"), 5)


@query("v11_computed_metrics")
def _(spark, sf):
    m = _members(spark, sf).select(F.col("paper_id").alias("id"), "cluster_id", "embedding")
    both = m.select(F.lit(1).alias("trial_id"), "*").unionByName(m.select(F.lit(2).alias("trial_id"), "*"))
    # The given metrics are those of trial 1.
    return de.metrics_where_absent(v.cluster_metrics(spark, sf), both, 5)[0]


@query("v10_pair_separations")
def _(spark, sf):
    return _validity(spark, sf)[1]


@query("a26_separation_overview")
def _(spark, sf):
    return de.validity_overview(*_validity(spark, sf))
