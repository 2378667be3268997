"""Queries: filters, projections, joins, set operations, sorts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scholarium.functions import text as tx
from scholarium.operators import authors as au
from scholarium.operators import citations as ci
from scholarium.operators import clusters as cl
from scholarium.operators import hierarchy as hi
from scholarium.operators import ordering as od
from scholarium.operators import prompts as pr
from scholarium.operators import quality as qa
from scholarium.operators import tables as tb
from scholarium.operators import versions as ve
from scholarium.plans import views as v
from scholarium.plans.registry import query

CATEGORIES = ["en", "fr", "src1", "src3"]
SQL_CATEGORIES = "['en','fr','src1','src3']"


# --- filters and projections -------------------------------------------------------------------

@query("p01_active_embedded_papers", """SELECT p.id FROM papers p JOIN embeddings e ON p.id=e.vec_id
    WHERE e.embedding IS NOT NULL AND NOT p.withdrawn""")
def _(spark, sf):
    vec = v.table(spark, sf, "embeddings").where(F.col("embedding").isNotNull()).select(F.col("vec_id").alias("id"))
    return v.papers(spark, sf).where(~F.col("withdrawn")).join(vec, "id", "left_semi").select("id")


@query("p02_pending_papers", "SELECT id, title FROM papers WHERE quality IS NULL")
def _(spark, sf):
    return tb.pending(v.papers(spark, sf), "quality").select("id", "title")


@query("p03_target_category_papers", f"""SELECT id, categories FROM papers
    WHERE NOT coalesce((NOT list_has_any(string_split(categories,' '), {SQL_CATEGORIES})) OR withdrawn, false)""")
def _(spark, sf):
    p = v.papers(spark, sf)
    drop = ~tx.overlaps_categories(tx.split_categories("categories"), CATEGORIES) | F.col("withdrawn")
    return p.where(~F.coalesce(drop, F.lit(False))).select("id", "categories")


@query("p04_primary_category", """SELECT count(*) AS total, count(*) FILTER (WHERE NOT withdrawn) AS active FROM papers
    WHERE categories IS NOT NULL AND split_part(categories,' ',1) LIKE 'e%'""")
def _(spark, sf):
    return qa.primary_category_counts(v.papers(spark, sf), "e")


@query("p05_withdrawn_by_last_version", """SELECT paper_id, (source_type='I' OR size='0kb') AS withdrawn
    FROM paper_versions QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY version DESC)=1""")
def _(spark, sf):
    return ve.version_summary(v.paper_versions(spark, sf)).select("paper_id", "withdrawn")


@query("p06_field_presence", """SELECT unnest(['title','categories','quality']) AS field,
    unnest([count(title),count(categories),count(quality)]) AS n FROM papers""")
def _(spark, sf):
    return qa.field_coverage(v.papers(spark, sf), ["title", "categories", "quality"]).select("field", "n")


@query("p07_cluster_members", "SELECT paper_id, cluster_id, cluster_prob FROM artifacts WHERE trial_id=1 AND cluster_id<>-1")
def _(spark, sf):
    return cl.clustered(v.artifacts(spark, sf), 1).select("paper_id", "cluster_id", "cluster_prob")


@query("p08_papers_in_list", "SELECT id, title FROM papers WHERE id IN (SELECT doc_id FROM labels WHERE quality=1)")
def _(spark, sf):
    wanted = v.table(spark, sf, "labels").where("quality = 1")
    return tb.members_of(v.papers(spark, sf), "id", wanted, "doc_id").select("id", "title")


@query("p09_trailing_comma_authors", "SELECT id, keyname FROM comma_authors WHERE keyname LIKE '%,'")
def _(spark, sf):
    return v.comma_authors(spark, sf).where(F.col("keyname").endswith(",")).select("id", "keyname")


@query("p10_within_token_limit", """SELECT id, n_tokens FROM (SELECT id,
    len(list_filter(string_split_regex(abstract,'\\s+'), lambda x: x<>'')) AS n_tokens FROM papers) WHERE n_tokens<=500""")
def _(spark, sf):
    p = v.papers(spark, sf).select("id", tx.count_tokens("abstract").cast("long").alias("n_tokens"))
    return p.where("n_tokens <= 500")


@query("p11_meaningful_edges", "SELECT * FROM cluster_trees WHERE child_size>1")
def _(spark, sf):
    return hi.meaningful_edges(v.cluster_trees(spark, sf))


@query("p12_children_at_level", """SELECT parent_cluster_id, child_cluster_id, child_size FROM cluster_trees
    WHERE trial_id=1 AND lambda_val>=0.25""")
def _(spark, sf):
    return hi.children_at(v.cluster_trees(spark, sf), 1, 0.25).select("parent_cluster_id", "child_cluster_id", "child_size")


@query("p13_large_enough_clusters", """SELECT cluster_id, count(*) AS size FROM artifacts WHERE cluster_id<>-1
    GROUP BY cluster_id HAVING count(*)>=5""")
def _(spark, sf):
    return cl.cluster_sizes(v.artifacts(spark, sf), 1, at_least=5)


@query("p14_outside_top_clusters", """SELECT a.paper_id, a.cluster_id, t.cluster_id IS NOT NULL AS in_top FROM artifacts a
    LEFT JOIN (SELECT cluster_id FROM artifacts WHERE cluster_id<>-1 GROUP BY cluster_id
               ORDER BY count(*) DESC, cluster_id DESC LIMIT 3) t ON a.cluster_id=t.cluster_id""")
def _(spark, sf):
    a = v.artifacts(spark, sf)
    return cl.flag_members(a, cl.largest_clusters(a, 1, 3), "in_top").select("paper_id", "cluster_id", "in_top")


@query("p15_embedding_text", """SELECT id, 'Category: ' || coalesce(c,'None') || chr(10) || coalesce(title,'None') || chr(10)
    || coalesce(abstract,'None') AS text
    FROM (SELECT *, CASE WHEN quality=1 THEN categories ELSE NULL END AS c FROM papers)""")
def _(spark, sf):
    p = v.papers(spark, sf).withColumn("c", F.when(F.col("quality") == 1, F.col("categories")))
    return p.select("id", tx.embedding_text("c", "title", "abstract").alias("text"))


@query("p16_display_label", """SELECT a.paper_id, coalesce(nullif(l.label,''), 'Cluster ' || a.cluster_id) AS display
    FROM artifacts a LEFT JOIN cluster_labels l ON a.cluster_id=l.cluster_id""")
def _(spark, sf):
    return cl.with_labels(v.artifacts(spark, sf), v.cluster_labels(spark, sf)).select("paper_id", "display")


@query("p17_renamed_fields", "SELECT doc_id AS id, text AS abstract, lang AS arxiv_categories FROM documents")
def _(spark, sf):
    names = {"doc_id": "id", "text": "abstract", "lang": "arxiv_categories"}
    return v.table(spark, sf, "documents").select(*[F.col(a).alias(b) for a, b in names.items()])


@query("p18_cluster_prompts", """WITH near AS (SELECT a.cluster_id, p.title, p.abstract,
      row_number() OVER (PARTITION BY a.cluster_id ORDER BY a.cluster_prob DESC, a.paper_id) AS rn
      FROM artifacts a JOIN papers p ON a.paper_id=p.id WHERE a.cluster_id<>-1)
    SELECT cluster_id, 'Name the topic of these papers.' || chr(10) || chr(10) ||
      string_agg('- ' || title || ': ' || substring(abstract,1,300) || '...', chr(10)||chr(10) ORDER BY rn) AS prompt
    FROM near WHERE rn<=10 GROUP BY cluster_id""")
def _(spark, sf):
    members = cl.members_with_text(v.artifacts(spark, sf), v.papers(spark, sf), 1)
    first = cl.top_members(members, 10)
    return pr.cluster_prompts(first, "Name the topic of these papers.", abstract_chars=300)


@query("p18_batch_prompts", """WITH b AS (SELECT *, (row_number() OVER (ORDER BY id)-1)//50 AS batch FROM papers)
    SELECT batch, count(*) AS n_items, 'Give each paper a category.' || chr(10) || chr(10) ||
      string_agg('Title: ' || title || chr(10) || 'Abstract: ' || abstract, chr(10)||chr(10) ORDER BY id) AS prompt
    FROM b GROUP BY batch""")
def _(spark, sf):
    batched = od.fixed_batches(v.papers(spark, sf).select("id", "title", "abstract"), ["id"], 50)
    return pr.batch_prompts(batched, "Give each paper a category.")


# --- joins ---------------------------------------------------------------------------------------

AUTHOR_SQL = """SELECT pa.paper_id, string_agg(a.keyname || coalesce(', '||a.forenames,'') || coalesce(' '||a.suffix,''), ', '
    ORDER BY pa.author_position) AS authors FROM paper_authors pa JOIN authors a ON pa.author_id=a.id GROUP BY pa.paper_id"""


@query("j01_papers_with_authors", f"SELECT p.id, p.title, s.authors FROM papers p LEFT JOIN ({AUTHOR_SQL}) s ON p.id=s.paper_id")
def _(spark, sf):
    return qa.author_strings(
        v.papers(spark, sf).select("id", "title"), v.paper_authors(spark, sf), v.authors(spark, sf)
    ).select("id", "title", "authors")


@query("j02_paper_author_counts", """SELECT p.id, count(a.id) AS n_authors FROM papers p
    JOIN paper_authors pa ON p.id=pa.paper_id JOIN authors a ON pa.author_id=a.id GROUP BY p.id""")
def _(spark, sf):
    links = v.paper_authors(spark, sf)
    p = v.papers(spark, sf).select(F.col("id").alias("paper_id"))
    a = v.authors(spark, sf).select(F.col("id").alias("author_id"))
    joined = links.join(a, "author_id", "left_semi").groupBy("paper_id").agg(F.count("*").alias("n_authors"))
    return joined.join(p, "paper_id", "left_semi").select(F.col("paper_id").alias("id"), "n_authors")


@query("j03_members_with_text", """SELECT a.paper_id, a.cluster_id, p.title, a.cluster_prob FROM artifacts a
    JOIN papers p ON a.paper_id=p.id WHERE a.trial_id=1 AND a.cluster_id<>-1""")
def _(spark, sf):
    return cl.members_with_text(v.artifacts(spark, sf), v.papers(spark, sf), 1).select(
        "paper_id", "cluster_id", "title", "cluster_prob"
    )


@query("j04_artifacts_with_label", """SELECT a.paper_id, a.cluster_id, l.label FROM artifacts a
    LEFT JOIN cluster_labels l ON a.cluster_id=l.cluster_id WHERE a.trial_id=1""")
def _(spark, sf):
    return cl.with_labels(v.artifacts(spark, sf).where("trial_id = 1"), v.cluster_labels(spark, sf)).select(
        "paper_id", "cluster_id", "label"
    )


@query("j05_clusters_needing_labels", """SELECT DISTINCT m.trial_id, m.cluster_id FROM cluster_metrics m
    WHERE m.llm_label IS NULL AND m.cluster_id<>-1 AND EXISTS (SELECT 1 FROM artifacts a
      WHERE a.cluster_id=m.cluster_id AND a.trial_id=m.trial_id)""")
def _(spark, sf):
    return cl.clusters_needing_labels(v.cluster_metrics(spark, sf), v.artifacts(spark, sf))


@query("j05_clusters_needing_labels_literal", """SELECT m.cluster_id FROM cluster_metrics m LEFT JOIN artifacts a
    ON m.cluster_id=a.cluster_id WHERE m.llm_label IS NULL GROUP BY m.cluster_id HAVING count(a.paper_id)>0""")
def _(spark, sf):
    return cl.clusters_needing_labels(v.cluster_metrics(spark, sf), v.artifacts(spark, sf), strict=False)


SUFFIX_SQL = "CASE " + " ".join(
    f"WHEN upper(trim(suffix)) IN ({', '.join(map(repr, spellings))}) THEN {kept}"
    for spellings, kept in (
        (tx.JUNIOR_SPELLINGS, "'Jr.'"), (tx.SENIOR_SPELLINGS, "'Sr.'"), (tx.ROMAN_SUFFIXES, "upper(trim(suffix))")
    )
) + " ELSE nullif(trim(suffix),'') END"
IDENTITY_SQL = f"SELECT id, keyname, coalesce(forenames,'') AS f, coalesce({SUFFIX_SQL},'') AS s FROM authors"
MAPPING_SQL = f"""SELECT i.id AS old_id, c.new_id FROM ({IDENTITY_SQL}) i JOIN
    (SELECT keyname, f, s, min(id) AS new_id FROM ({IDENTITY_SQL}) GROUP BY keyname, f, s) c
    ON i.keyname=c.keyname AND i.f=c.f AND i.s=c.s"""


@query("j06_author_mapping", MAPPING_SQL)
def _(spark, sf):
    return au.author_mapping(v.authors(spark, sf))


@query("j07_unmapped_authors", f"""SELECT a.id, a.keyname FROM authors a LEFT JOIN
    (SELECT * FROM ({MAPPING_SQL}) WHERE old_id % 7 <> 0) m ON a.id=m.old_id WHERE m.new_id IS NULL""")
def _(spark, sf):
    # A mapping with gaps, so that the check has something to find.
    mapping = au.author_mapping(v.authors(spark, sf)).where("old_id % 7 <> 0")
    return au.unmapped_authors(v.authors(spark, sf), mapping).select("id", "keyname")


@query("j08_orphan_versions", """SELECT paper_id, version FROM paper_versions
    WHERE paper_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)""")
def _(spark, sf):
    return tb.orphans(v.paper_versions(spark, sf), v.table(spark, sf, "labels"), "paper_id", "doc_id").select(
        "paper_id", "version"
    )


@query("j09_orphan_authors", """SELECT id FROM authors a WHERE NOT EXISTS (SELECT 1 FROM paper_authors pa
    JOIN papers p ON pa.paper_id=p.id WHERE pa.author_id=a.id AND p.withdrawn)""")
def _(spark, sf):
    gone = v.papers(spark, sf).where("withdrawn")
    links = tb.without_orphans(v.paper_authors(spark, sf), gone, "paper_id", "id")
    return tb.orphans(v.authors(spark, sf), links, "id", "author_id").select("id")


KEEP_SQL = "SELECT vec_id FROM embeddings"


@query("j10_subset_counts", f"""SELECT 'papers' AS table_name, count(*) AS n FROM papers WHERE id IN ({KEEP_SQL})
    UNION ALL SELECT 'paper_versions', count(*) FROM paper_versions WHERE paper_id IN (SELECT id FROM papers WHERE id IN ({KEEP_SQL}))
    UNION ALL SELECT 'paper_authors', count(*) FROM paper_authors WHERE paper_id IN (SELECT id FROM papers WHERE id IN ({KEEP_SQL}))
    UNION ALL SELECT 'authors', count(*) FROM authors WHERE id IN (SELECT author_id FROM paper_authors
      WHERE paper_id IN (SELECT id FROM papers WHERE id IN ({KEEP_SQL})))""")
def _(spark, sf):
    keep = v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    parts = tb.related_subset(
        v.papers(spark, sf), v.paper_versions(spark, sf), v.paper_authors(spark, sf), v.authors(spark, sf), keep
    )
    out = None
    for name, df in parts.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("j11_rewritten_links", f"""SELECT pa.paper_id, m.new_id AS author_id, min(pa.author_position) AS author_position
    FROM paper_authors pa JOIN ({MAPPING_SQL}) m ON pa.author_id=m.old_id GROUP BY pa.paper_id, m.new_id""")
def _(spark, sf):
    return au.rewrite_links(v.paper_authors(spark, sf), au.author_mapping(v.authors(spark, sf)))


SIGHTED_SQL = """SELECT c_custkey AS paper_id, 1 AS author_position, concat('Key',CAST(c_custkey % 60 AS VARCHAR)) AS keyname,
    CASE WHEN c_custkey % 3=0 THEN NULL ELSE concat('F',CAST(c_nationkey % 2 AS VARCHAR)) END AS forenames,
    CASE WHEN c_custkey % 2=0 THEN 'III' ELSE NULL END AS suffix FROM customer"""


def _sighted(spark, sf):
    k = F.col("c_custkey")
    lists = v.table(spark, sf, "customer").select(
        k.alias("paper_id"),
        F.array(
            F.struct(
                F.concat(F.lit(" Key"), (k % 60).cast("string")).alias("keyname"),
                F.when(k % 3 == 0, " ").otherwise(F.concat(F.lit("F"), (F.col("c_nationkey") % 2).cast("string"))).alias(
                    "forenames"
                ),
                F.when(k % 2 == 0, "iii ").alias("suffix"),
            )
        ).alias("authors"),
    )
    return au.sighted_authors(lists)


@query("j12_find_or_create_authors", f"""WITH known AS (SELECT keyname, forenames, {SUFFIX_SQL} AS suffix, min(id) AS id
      FROM authors GROUP BY 1,2,3), s AS ({SIGHTED_SQL}), misses AS (SELECT DISTINCT keyname, forenames, suffix FROM s
      WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.keyname=s.keyname AND k.forenames IS NOT DISTINCT FROM s.forenames
        AND k.suffix IS NOT DISTINCT FROM s.suffix)),
    added AS (SELECT keyname, forenames, suffix, (SELECT max(id) FROM authors) + row_number() OVER
      (ORDER BY keyname, forenames NULLS FIRST, suffix NULLS FIRST) AS id FROM misses),
    every AS (SELECT * FROM known UNION ALL SELECT * FROM added)
    SELECT s.paper_id, s.author_position, e.id AS author_id FROM s JOIN every e ON e.keyname=s.keyname
      AND e.forenames IS NOT DISTINCT FROM s.forenames AND e.suffix IS NOT DISTINCT FROM s.suffix""")
def _(spark, sf):
    existing = v.authors(spark, sf).withColumn("suffix", tx.normalize_suffix("suffix"))
    _, resolved = au.find_or_create(existing, _sighted(spark, sf))
    return resolved.select("paper_id", "author_position", "author_id")


@query("j13_versions_of_known_papers", "SELECT paper_id, version FROM paper_versions WHERE paper_id IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return tb.without_orphans(v.paper_versions(spark, sf), v.table(spark, sf, "labels"), "paper_id", "doc_id").select(
        "paper_id", "version"
    )


# A cluster belongs if no edge on its way from the root is below x: the walk carries the lowest one down.
WALK_SQL = """WITH RECURSIVE edges AS (
      SELECT parent_cluster_id AS up, child_cluster_id AS down, lambda_val AS l FROM cluster_trees WHERE trial_id=1),
    tops AS (SELECT * FROM edges WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.down = edges.up)),
    reached AS (
      SELECT down, l, l AS lowest FROM tops
      UNION ALL SELECT e.down, e.l, least(e.l, r.lowest) FROM reached r JOIN edges e ON e.up = r.down)
    SELECT down AS cluster_id, l AS lambda_val FROM reached WHERE lowest >= {x}
    UNION SELECT up, l FROM tops WHERE l >= {x}"""


@query("j14_clusters_at_lambda", WALK_SQL.replace("{x}", "0.25"))
def _(spark, sf):
    return hi.clusters_at_lambda(v.cluster_trees(spark, sf), 1, 0.25)


@query("j14_clusters_at_lambda_zero", WALK_SQL.replace("{x}", "0"))
def _(spark, sf):
    return hi.clusters_at_lambda(v.cluster_trees(spark, sf), 1, 0.0)


@query("j14_clusters_at_lambda_recursive", WALK_SQL.replace("{x}", "0.25"))
def _(spark, sf):
    return hi.clusters_at_lambda_by_jumps(v.cluster_trees(spark, sf), 1, 0.25)


@query("j15_hierarchy_walk", """WITH RECURSIVE w AS (
      SELECT DISTINCT parent_cluster_id AS cluster_id, 0 AS depth, lpad(CAST(parent_cluster_id AS VARCHAR),20,'0') AS path
        FROM cluster_trees WHERE parent_cluster_id NOT IN (SELECT child_cluster_id FROM cluster_trees)
      UNION ALL SELECT t.child_cluster_id, w.depth+1, w.path || '/' || lpad(CAST(1000000000000-t.child_size AS VARCHAR),13,'0')
        || '-' || lpad(CAST(t.child_cluster_id AS VARCHAR),20,'0')
        FROM cluster_trees t JOIN w ON t.parent_cluster_id=w.cluster_id WHERE w.depth+1<3),
    n AS (SELECT cluster_id, count(*) AS size FROM artifacts GROUP BY cluster_id)
    SELECT w.cluster_id, w.depth, w.path, coalesce(n.size,0) AS size FROM w LEFT JOIN n ON w.cluster_id=n.cluster_id""")
def _(spark, sf):
    sizes = cl.cluster_sizes(v.artifacts(spark, sf), 1)
    return hi.hierarchy_walk(v.cluster_trees(spark, sf), 1, max_depth=3, sizes=sizes)


@query("j16_active_authors", "SELECT count(DISTINCT a.id) AS n FROM authors a JOIN paper_authors pa ON a.id=pa.author_id")
def _(spark, sf):
    return tb.without_orphans(v.authors(spark, sf), v.paper_authors(spark, sf), "id", "author_id").agg(
        F.countDistinct("id").alias("n")
    )


@query("j17_label_lookup_with_default", """SELECT s.cluster_id, s.size, CASE WHEN l.cluster_id IS NULL THEN 'No label' ELSE l.label END AS label,
    coalesce(l.safety_relevance,0) AS relevance FROM (SELECT cluster_id, count(*) AS size FROM artifacts
    WHERE cluster_id<>-1 GROUP BY cluster_id) s LEFT JOIN cluster_labels l ON s.cluster_id=l.cluster_id""")
def _(spark, sf):
    return cl.labelled_sizes(v.artifacts(spark, sf), v.cluster_labels(spark, sf), 1)


@query("j18_cluster_pairs", """WITH c AS (SELECT DISTINCT cluster_id FROM artifacts WHERE cluster_id<>-1)
    SELECT a.cluster_id AS left_id, b.cluster_id AS right_id FROM c a JOIN c b ON a.cluster_id<b.cluster_id""")
def _(spark, sf):
    return cl.cluster_pairs(v.artifacts(spark, sf), 1)


@query("j20_tree_edge_labels", """SELECT e.src, e.dst, e.distance, a.cluster_id AS src_label, b.cluster_id AS dst_label
    FROM tree_edges e JOIN artifacts a ON e.src=a.paper_id JOIN artifacts b ON e.dst=b.paper_id""")
def _(spark, sf):
    labels = v.artifacts(spark, sf).select(F.col("paper_id").alias("id"), F.col("cluster_id").alias("label"))
    return cl.label_edges(v.tree_edges(spark, sf), labels)


@query("j21_positional_zip", """WITH q AS (SELECT l_orderkey AS batch, l_partkey AS item,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)-1 AS pos FROM lineitem),
    a AS (SELECT o_orderkey AS batch, unnest(string_split(o_orderpriority,'-')) AS answer,
      generate_subscripts(string_split(o_orderpriority,'-'),1)-1 AS pos FROM orders)
    SELECT q.batch, q.pos, q.item, a.answer FROM q JOIN a ON q.batch=a.batch AND q.pos=a.pos""")
def _(spark, sf):
    li = v.table(spark, sf, "lineitem")
    numbered = od.number_within(
        li, ["l_orderkey"], F.col("l_linenumber"), ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "rn"
    )
    items = numbered.select(
        F.col("l_orderkey").alias("batch"), (F.col("rn") - 1).alias("pos"), F.col("l_partkey").alias("item")
    )
    answers = v.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("batch"), F.split("o_orderpriority", "-").alias("answers")
    )
    return pr.zip_answers(items, answers)


@query("j22_citation_counts", """SELECT p.id, '10.48550/arXiv.' || CAST(p.id AS VARCHAR) AS doi, coalesce(c.n,0) AS citation_count
    FROM papers p LEFT JOIN (SELECT cited, count(DISTINCT citing) AS n FROM citation_edges GROUP BY cited) c ON p.id=c.cited""")
def _(spark, sf):
    return ci.attach_citations(v.papers(spark, sf), v.citation_edges(spark, sf)).select("id", "doi", "citation_count")


# --- sorting, top-k, sampling --------------------------------------------------------------------

@query("o01_top_categories", """SELECT category, n FROM (SELECT category, count(*) AS n FROM
    (SELECT unnest(string_split(categories,' ')) AS category FROM papers) WHERE category<>'' GROUP BY category)
    ORDER BY n DESC, category LIMIT 10""")
def _(spark, sf):
    return qa.category_frequency(v.papers(spark, sf)).select("category", "n")


@query("o02_seeded_order", "SELECT id, title FROM papers")
def _(spark, sf):
    return od.seeded_order(v.papers(spark, sf).select("id", "title"), "id", seed=42)


@query("o03_page", "SELECT id, title FROM papers ORDER BY id LIMIT 100 OFFSET 50")
def _(spark, sf):
    return od.page(v.papers(spark, sf).select("id", "title"), ["id"], offset=50, limit=100)


@query("o04_ranked_children", """SELECT parent_cluster_id, child_cluster_id, child_size, row_number() OVER
    (PARTITION BY parent_cluster_id ORDER BY child_size DESC, child_cluster_id) AS rank FROM cluster_trees""")
def _(spark, sf):
    w = Window.partitionBy("trial_id", "parent_cluster_id").orderBy(F.desc("child_size"), "child_cluster_id")
    return v.cluster_trees(spark, sf).select(
        "parent_cluster_id", "child_cluster_id", "child_size", F.row_number().over(w).cast("long").alias("rank")
    )


@query("o05_largest_clusters", """SELECT cluster_id, count(*) AS size FROM artifacts WHERE cluster_id<>-1 GROUP BY cluster_id
    ORDER BY size DESC, cluster_id DESC LIMIT 10""")
def _(spark, sf):
    return cl.largest_clusters(v.artifacts(spark, sf), 1, 10)


@query("o06_most_relevant_clusters", """SELECT cluster_id, safety_relevance FROM cluster_labels WHERE safety_relevance IS NOT NULL
    ORDER BY safety_relevance DESC, cluster_id LIMIT 10""")
def _(spark, sf):
    return cl.most_relevant_clusters(v.cluster_labels(spark, sf), 10)


REPORT_SQL = """SELECT cluster_id, size, label, relevance,
      row_number() OVER (ORDER BY size DESC, cluster_id) AS size_rank,
      row_number() OVER (ORDER BY relevance DESC, cluster_id) AS relevance_rank FROM (
    SELECT s.cluster_id, s.size, CASE WHEN l.cluster_id IS NULL THEN 'No label' ELSE l.label END AS label,
    coalesce(l.safety_relevance,0) AS relevance FROM (SELECT cluster_id, count(*) AS size FROM artifacts
    WHERE cluster_id<>-1 GROUP BY cluster_id) s LEFT JOIN cluster_labels l ON s.cluster_id=l.cluster_id)"""


@query("o07_report_orders", REPORT_SQL)
def _(spark, sf):
    rows = cl.labelled_sizes(v.artifacts(spark, sf), v.cluster_labels(spark, sf), 1)
    ranked = od.number_rows(rows, [F.desc("size"), F.asc("cluster_id")], "size_rank")
    return od.number_rows(ranked, [F.desc("relevance"), F.asc("cluster_id")], "relevance_rank")


@query("o08_sample_papers", "SELECT id, substring(abstract,1,200) AS start FROM papers ORDER BY id LIMIT 5")
def _(spark, sf):
    return od.sample_rows(v.papers(spark, sf), ["id"], 5).select("id", tx.text_prefix("abstract", 200).alias("start"))


# --- set operations ------------------------------------------------------------------------------

@query("u01_walk_steps", """SELECT parent_cluster_id AS cluster_id, lambda_val FROM cluster_trees
    UNION ALL SELECT child_cluster_id, lambda_val FROM cluster_trees""")
def _(spark, sf):
    t = v.cluster_trees(spark, sf)
    return t.select(F.col("parent_cluster_id").alias("cluster_id"), "lambda_val").unionByName(
        t.select(F.col("child_cluster_id").alias("cluster_id"), "lambda_val")
    )


@query("u02_top_and_other_rows", """SELECT a.paper_id, a.cluster_id, t.cluster_id IS NOT NULL AS is_top,
    coalesce(nullif(l.label,''),'Cluster ' || a.cluster_id) AS display FROM artifacts a
    LEFT JOIN (SELECT cluster_id FROM artifacts WHERE cluster_id<>-1 GROUP BY cluster_id
               ORDER BY count(*) DESC, cluster_id DESC LIMIT 10) t ON a.cluster_id=t.cluster_id
    LEFT JOIN cluster_labels l ON a.cluster_id=l.cluster_id WHERE a.cluster_id<>-1""")
def _(spark, sf):
    a = v.artifacts(spark, sf)
    shown = cl.with_labels(cl.clustered(a, 1), v.cluster_labels(spark, sf))
    return cl.flag_members(shown, cl.largest_clusters(a, 1, 10), "is_top").select(
        "paper_id", "cluster_id", "is_top", "display"
    )


@query("u03_distinct_levels", "SELECT DISTINCT lambda_val FROM cluster_trees WHERE trial_id=1")
def _(spark, sf):
    return hi.hierarchy_levels(v.cluster_trees(spark, sf), 1)


@query("u04_tree_nodes", "SELECT parent_cluster_id AS cluster_id FROM cluster_trees UNION SELECT child_cluster_id FROM cluster_trees")
def _(spark, sf):
    return hi.tree_nodes(v.cluster_trees(spark, sf))


@query("u05_merged_affiliations", f"""SELECT DISTINCT coalesce(m.new_id, x.author_id) AS author_id, x.affiliation FROM
    (SELECT l_suppkey AS author_id, l_returnflag || l_linestatus AS affiliation FROM lineitem) x
    LEFT JOIN ({MAPPING_SQL}) m ON x.author_id=m.old_id""")
def _(spark, sf):
    aff = v.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("author_id"), F.concat("l_returnflag", "l_linestatus").alias("affiliation")
    ).distinct()
    return au.move_affiliations(aff, au.author_mapping(v.authors(spark, sf)))
