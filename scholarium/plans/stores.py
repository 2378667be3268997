"""Queries: record sources, stores, inserts, merges, clean-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholarium.operators import authors as au
from scholarium.operators import maintenance as ma
from scholarium.operators import quality as qa
from scholarium.operators import tables as tb
from scholarium.operators import vectors as vec
from scholarium.plans import views as v
from scholarium.plans.registry import query
from scholarium.plans.relational import KEEP_SQL, MAPPING_SQL, SQL_CATEGORIES, CATEGORIES
from scholarium.schemas import add_column_if_missing, conform, drop_column_if_present, empty_table
from scholarium.session import scratch_path
from scholarium.sources import records as rec
from scholarium.sources import store


def _core_files(spark, sf) -> str:
    """The documents, written as core records: withdrawn ones as deleted, comma keynames, empty fields."""
    k = F.col("id")
    p = v.papers(spark, sf)
    author = F.struct(
        F.concat(F.lit("Key"), (k % 40).cast("string"), F.when(k % 7 == 0, ",,").otherwise("")).alias("keyname"),
        F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("F"), (k % 2).cast("string"))).alias("forenames"),
        F.when(k % 5 == 0, F.lit("jr")).alias("suffix"),
    )
    nameless = F.struct(F.lit(None).cast("string").alias("keyname"), F.lit("X").alias("forenames"), F.lit(None).cast("string").alias("suffix"))
    out = p.select(
        F.struct(
            F.concat(F.lit("oai:arXiv.org:1706."), k.cast("string")).alias("identifier"),
            F.when(F.col("withdrawn"), F.lit("deleted")).alias("_status"),
        ).alias("header"),
        F.struct(
            F.struct(
                k.cast("string").alias("id"),
                F.struct(F.when(k % 4 == 0, F.array(author, nameless)).otherwise(F.array(author)).alias("author")).alias("authors"),
                F.concat(F.lit("Paper "), k.cast("string")).alias("title"),
                "categories",
                F.when(k % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("note "), k.cast("string"))).alias("comments"),
            ).alias("arXiv")
        ).alias("metadata"),
    )
    path = scratch_path(spark, "core-records")
    rec.write_records(out, path)
    return path


def _version_files(spark, sf, path: str | None = None, without: tuple[str, ...] = (), apart: int = 0) -> str:
    """Orders as version records, priority and key deciding numbers, sizes and source types.

    ``without`` leaves version marks out; version 10 is ``apart`` days later than the others.
    """
    o = v.table(spark, sf, "orders")
    k = F.col("o_orderkey")

    def one(mark, size, kind, days=0):
        return F.struct(
            mark.alias("_version"),
            F.concat(F.date_format(F.date_add("o_orderdate", days), "EEE, d MMM yyyy HH:mm:ss"), F.lit(" GMT")).alias("date"),
            size.alias("size"),
            kind.alias("source_type"),
        )

    none = F.lit(None).cast("string")
    versions = F.array(
        one(F.lit("v10"), F.lit("5kb"), F.when(k % 9 == 0, F.lit("I")), apart),
        one(F.lit("v2"), F.when(k % 4 == 0, F.lit("0kb")).otherwise(F.lit("7kb")), F.lit("D")),
        one(F.when(k % 2 == 0, F.lit("vX")).otherwise(none), F.lit("1kb"), none),
    )
    delivered = F.filter(versions, lambda x: F.coalesce(~x["_version"].isin(*without), F.lit(True))) if without else versions
    out = o.select(
        F.struct(F.concat(F.lit("oai:arXiv.org:"), k.cast("string")).alias("identifier")).alias("header"),
        F.struct(F.struct(k.cast("string").alias("id"), delivered.alias("version")).alias("arXivRaw")).alias("metadata"),
    )
    path = path or scratch_path(spark, "version-records")
    rec.write_records(out, path)
    return path


@query("s01_core_records", """SELECT '1706.' || id AS id, 'Paper ' || id AS title, categories, CASE WHEN id % 2=0 THEN NULL ELSE 'note ' || id END AS comments,
    'Key' || (id % 40) AS keyname, CASE WHEN id % 3=0 THEN NULL ELSE 'F' || (id % 2) END AS forenames,
    CASE WHEN id % 5=0 THEN 'jr' END AS suffix, 1 AS n_authors FROM papers WHERE NOT withdrawn""")
def _(spark, sf):
    r = rec.read_core_records(spark, _core_files(spark, sf))
    return r.select(
        "id", "title", "categories", "comments",
        F.col("authors")[0]["keyname"].alias("keyname"),
        F.col("authors")[0]["forenames"].alias("forenames"),
        F.col("authors")[0]["suffix"].alias("suffix"),
        F.size("authors").alias("n_authors"),
    )


@query("s02_version_records", """SELECT CAST(o_orderkey AS VARCHAR) AS paper_id, v.version, v.source_type, v.size, epoch(o_orderdate)::BIGINT AS seconds FROM
    (SELECT o_orderkey, o_orderdate, unnest([
      {'version': 10, 'size': '5kb', 'source_type': CASE WHEN o_orderkey % 9=0 THEN 'I' ELSE 'D' END},
      {'version': 2, 'size': CASE WHEN o_orderkey % 4=0 THEN '0kb' ELSE '7kb' END, 'source_type': 'D'},
      {'version': CASE WHEN o_orderkey % 2=0 THEN NULL ELSE 1 END, 'size': '1kb', 'source_type': 'D'}]) AS v FROM orders)
    WHERE v.version IS NOT NULL""")
def _(spark, sf):
    r = rec.version_rows(rec.read_version_records(spark, _version_files(spark, sf)))
    return r.select("paper_id", "version", "source_type", "size", F.unix_seconds("date").alias("seconds"))


@query("s03_harvest_scan", "SELECT count(*) AS n_records, count(DISTINCT id) AS n_papers FROM papers WHERE NOT withdrawn")
def _(spark, sf):
    r = rec.read_core_records(spark, _core_files(spark, sf), modified_after="2020-01-01T00:00:00")
    return r.agg(F.count("*").alias("n_records"), F.countDistinct("id").alias("n_papers"))


@query("s04_insert_papers", """SELECT id, title FROM papers WHERE quality IS NOT NULL
    UNION ALL SELECT id, 'new ' || title FROM papers WHERE quality IS NULL""")
def _(spark, sf):
    p = v.papers(spark, sf)
    stored = p.where("quality IS NOT NULL").select("id", "title")
    return tb.insert_ignore(stored, p.select("id", F.concat(F.lit("new "), "title").alias("title")), ["id"])


@query("s05_insert_versions", """SELECT paper_id, version, CASE WHEN version<=20 THEN size ELSE 'new' END AS size FROM paper_versions""")
def _(spark, sf):
    p = v.paper_versions(spark, sf).select("paper_id", "version", "size")
    return tb.insert_ignore(p.where("version <= 20"), p.withColumn("size", F.lit("new")), ["paper_id", "version"])


@query("s06_upsert_labels", """WITH n AS (SELECT CAST(n_nationkey AS INT) AS cluster_id, n_name AS label FROM nation WHERE n_regionkey<3)
    SELECT coalesce(l.cluster_id,n.cluster_id) AS cluster_id, CASE WHEN n.cluster_id IS NOT NULL THEN n.label ELSE l.label END AS label,
    l.safety_relevance FROM cluster_labels l FULL JOIN n ON l.cluster_id=n.cluster_id""")
def _(spark, sf):
    incoming = v.table(spark, sf, "nation").where("n_regionkey < 3").select(
        F.col("n_nationkey").alias("cluster_id"), F.col("n_name").alias("label")
    )
    return tb.upsert(v.cluster_labels(spark, sf), incoming, ["cluster_id"])


@query("s07_copied_table", "SELECT doc_id, CAST(toxic AS BOOLEAN) AS toxic, CAST(quality AS VARCHAR) AS quality FROM labels")
def _(spark, sf):
    return tb.copy_columns(v.table(spark, sf, "labels"), {"doc_id": "long", "toxic": "boolean", "quality": "string"})


def _store(spark, sf):
    p = v.papers(spark, sf).join(
        v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id", "left"
    ).withColumn("citation_count", F.col("quality"))
    return ma.filtered_store(
        p, v.paper_versions(spark, sf), v.paper_authors(spark, sf), v.authors(spark, sf), v.artifacts(spark, sf),
        v.cluster_trees(spark, sf), 1,
    )


STORE_KEEP = f"SELECT id FROM papers WHERE NOT withdrawn AND id IN ({KEEP_SQL})"


@query("s08_filtered_store_counts", f"""SELECT 'papers' AS table_name, count(*) AS n FROM papers WHERE id IN ({STORE_KEEP})
    UNION ALL SELECT 'paper_versions', count(*) FROM paper_versions WHERE paper_id IN ({STORE_KEEP})
    UNION ALL SELECT 'paper_authors', count(*) FROM paper_authors WHERE paper_id IN ({STORE_KEEP})
    UNION ALL SELECT 'authors', count(*) FROM authors WHERE id IN (SELECT author_id FROM paper_authors WHERE paper_id IN ({STORE_KEEP}))
    UNION ALL SELECT 'artifacts', count(*) FROM artifacts WHERE paper_id IN ({STORE_KEEP})
    UNION ALL SELECT 'cluster_trees', count(*) FROM cluster_trees""")
def _(spark, sf):
    path = scratch_path(spark, "filtered-store")
    tables = _store(spark, sf)
    store.save_snapshot(tables, path, partition_by={"artifacts": ["trial_id"]})
    out = None
    for name in tables:
        row = spark.read.parquet(f"{path}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def _trial_records(spark, sf):
    return v.trials(spark, sf).select(
        "trial_id", "value",
        F.create_map(F.lit("min_cluster_size"), (F.col("trial_id") + 20).cast("string")).alias("params"),
        F.create_map(F.lit("n_customers"), F.col("n_customers").cast("double"), F.lit("value"), F.col("value")).alias("metrics"),
    )


@query("s09_trial_records", """SELECT trial_id, value, CAST(trial_id+20 AS VARCHAR) AS min_cluster_size, CAST(n_customers AS DOUBLE) AS n_customers FROM trials""")
def _(spark, sf):
    path = scratch_path(spark, "trials")
    store.write_trials(_trial_records(spark, sf), path)
    r = store.read_trials(spark, path)
    return r.select("trial_id", "value", F.col("params")["min_cluster_size"].alias("min_cluster_size"), F.col("metrics")["n_customers"].alias("n_customers"))


@query("s09_updated_trials", """SELECT trial_id, value, CAST(n_customers AS DOUBLE) AS n_customers, CASE WHEN trial_id % 5=0 THEN trial_id/2.0 ELSE value END AS value_metric,
    CASE WHEN trial_id % 5=0 THEN 0.25::DOUBLE END AS validity_index FROM trials""")
def _(spark, sf):
    path = scratch_path(spark, "trials")
    store.write_trials(_trial_records(spark, sf), path)
    new = F.create_map(F.lit("value"), F.col("trial_id") / 2, F.lit("validity_index"), F.lit(0.25).cast("double"))
    store.update_trials(spark, path, v.trials(spark, sf).where("trial_id % 5 = 0").select("trial_id", new.alias("metrics")))
    m = F.col("metrics")
    return store.read_trials(spark, path).select(
        "trial_id", "value", m["n_customers"].alias("n_customers"), m["value"].alias("value_metric"), m["validity_index"].alias("validity_index")
    )


@query("o03_page_after_key", "SELECT id, title, true AS few_files FROM papers WHERE id>37 ORDER BY id LIMIT 100")
def _(spark, sf):
    path = scratch_path(spark, "pages")
    store.save_pages(v.papers(spark, sf).select("id", "title"), path, "id", rows_per_file=100)
    few = len(store.page_files(spark, path, 100, 37)) <= 4
    return store.page_after(spark, path, "id", 100, 37).withColumn("few_files", F.lit(few))


@query("s11_vector_codec", """SELECT vec_id, len(embedding)*4 AS bytes, round(list_sum(embedding::DOUBLE[]),6) AS total FROM embeddings""")
def _(spark, sf):
    e = v.table(spark, sf, "embeddings").select("vec_id", vec.encode_f32("embedding").alias("blob"))
    back = e.select("vec_id", F.octet_length("blob").cast("long").alias("bytes"), vec.decode_f32("blob").alias("x"))
    total = F.aggregate(F.col("x").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return back.select("vec_id", "bytes", F.round(total, 6).alias("total"))


@query("s12_snapshot", "SELECT 'authors' AS table_name, count(*) AS n FROM authors UNION ALL SELECT 'paper_authors', count(*) FROM paper_authors")
def _(spark, sf):
    path = scratch_path(spark, "snapshot")
    names = ["authors", "paper_authors"]
    store.save_snapshot({"authors": conform(v.authors(spark, sf), "authors"), "paper_authors": conform(v.paper_authors(spark, sf), "paper_authors")}, path)
    back = store.load_snapshot(spark, path, names)
    a, b = (back[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n in names)
    return a.unionByName(b)


@query("s13_widened_table", "SELECT id, CAST(NULL AS VARCHAR) AS llm_category FROM papers")
def _(spark, sf):
    p = add_column_if_missing(v.papers(spark, sf), "llm_category", "string")
    for c in ("title", "abstract", "categories", "withdrawn", "quality", "not_there"):
        p = drop_column_if_present(p, c)
    return empty_table(spark, "papers").select(F.col("id").cast("long").alias("id"), "llm_category").unionByName(p)


@query("s14_existence", """SELECT t AS table_name, t<>'missing' AS present, CASE WHEN t='missing' THEN 0 ELSE (SELECT count(*) FROM documents) END AS n
    FROM (SELECT unnest(['documents','missing']) AS t)""")
def _(spark, sf):
    docs = v.table(spark, sf, "documents")
    out = None
    for name in ("documents", "missing"):
        there = store.path_exists(spark, f"{sf.rstrip('/')}/{name}.parquet")
        row = docs.agg((F.count("*") if there else F.lit(0).cast("long")).alias("n")).select(
            F.lit(name).alias("table_name"), F.lit(there).alias("present"), "n"
        )
        out = row if out is None else out.unionByName(row)
    return out


# --- maintenance ---------------------------------------------------------------------------------

@query("d01_filled_column", "SELECT id, coalesce(100+l.toxic, p.quality) AS quality FROM papers p LEFT JOIN labels l ON p.id=l.doc_id AND l.toxic=1")
def _(spark, sf):
    new = v.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"), (F.col("toxic") + 100).alias("quality"))
    return tb.fill_column(v.papers(spark, sf).select("id", "quality"), new, "id", "quality")


KEPT_SQL = f"""SELECT id FROM papers WHERE NOT coalesce((NOT list_has_any(string_split(categories,' '), {SQL_CATEGORIES})) OR withdrawn, false)"""


@query("d02_cleaned_tables", f"""SELECT 'papers' AS table_name, count(*) AS n FROM ({KEPT_SQL})
    UNION ALL SELECT 'paper_versions', count(*) FROM paper_versions WHERE paper_id IN ({KEPT_SQL})
    UNION ALL SELECT 'paper_authors', count(*) FROM paper_authors WHERE paper_id IN ({KEPT_SQL})
    UNION ALL SELECT 'authors', count(*) FROM authors WHERE id IN (SELECT author_id FROM paper_authors WHERE paper_id IN ({KEPT_SQL}))""")
def _(spark, sf):
    p = v.papers(spark, sf).withColumn("arxiv_categories", F.split("categories", " "))
    parts = ma.clean_by_category(p, v.paper_versions(spark, sf), v.paper_authors(spark, sf), v.authors(spark, sf), CATEGORIES)
    out = None
    for name, df in parts.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("d03_deduplicated_links", f"""SELECT pa.paper_id, m.new_id AS author_id, min(pa.author_position) AS author_position
    FROM paper_authors pa JOIN ({MAPPING_SQL}) m ON pa.author_id=m.old_id GROUP BY pa.paper_id, m.new_id""")
def _(spark, sf):
    authors, links = au.deduplicate_authors(v.authors(spark, sf), v.paper_authors(spark, sf), strict=True)
    # Every rewritten link must point at a kept author.
    return tb.without_orphans(links, authors, "author_id", "id")


COMMA_SQL = """WITH c AS (SELECT id, keyname, rtrim(keyname,',') AS clean, coalesce(forenames,'') AS f, coalesce(suffix,'') AS s,
      keyname LIKE '%,' AS comma, forenames, suffix FROM comma_authors),
    t AS (SELECT clean, f, s, coalesce(min(id) FILTER (WHERE NOT comma), min(id)) AS new_id FROM c GROUP BY clean, f, s),
    m AS (SELECT c.id AS old_id, t.new_id FROM c JOIN t ON c.clean=t.clean AND c.f=t.f AND c.s=t.s WHERE c.comma)"""


@query("d04_comma_authors", COMMA_SQL + """ SELECT id, clean AS keyname, forenames, suffix FROM c
    WHERE id NOT IN (SELECT old_id FROM m WHERE old_id<>new_id)""")
def _(spark, sf):
    authors, _ = au.merge_comma_authors(v.comma_authors(spark, sf), v.paper_authors(spark, sf))
    return authors.select("id", "keyname", "forenames", "suffix")


@query("d04_comma_links", COMMA_SQL + """ SELECT paper_id, coalesce(m.new_id, author_id) AS author_id, min(author_position) AS author_position
    FROM paper_authors LEFT JOIN m ON author_id=old_id GROUP BY 1,2""")
def _(spark, sf):
    _, links = au.merge_comma_authors(v.comma_authors(spark, sf), v.paper_authors(spark, sf))
    return links


@query("d04_comma_affiliations", COMMA_SQL + """ SELECT DISTINCT coalesce(m.new_id, c.id) AS author_id, 'U' || (c.id % 11) AS affiliation FROM c LEFT JOIN m ON c.id=m.old_id""")
def _(spark, sf):
    a = v.comma_authors(spark, sf)
    held = a.select(F.col("id").alias("author_id"), F.concat(F.lit("U"), F.col("id") % 11).alias("affiliation"))
    return au.merge_comma_authors(a, v.paper_authors(spark, sf), held)[2]


@query("d05_orphans_removed", "SELECT count(*) AS removed FROM paper_versions WHERE paper_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    _, removed = ma.remove_orphan_versions(v.paper_versions(spark, sf), v.table(spark, sf, "labels").withColumnRenamed("doc_id", "id"))
    return removed


@query("d06_validated_publish", f"SELECT old_id, new_id FROM ({MAPPING_SQL})")
def _(spark, sf):
    a = v.authors(spark, sf)
    mapping = au.author_mapping(a)
    path = tb.validate_then_publish(mapping, au.unmapped_authors(a, mapping), scratch_path(spark, "mapping"))
    return spark.read.parquet(path)


@query("d07_store_report", f"""WITH k AS ({STORE_KEEP}), p AS (SELECT * FROM papers WHERE id IN (SELECT id FROM k)),
    vv AS (SELECT count(*) AS n FROM paper_versions WHERE paper_id IN (SELECT id FROM k) GROUP BY paper_id),
    l AS (SELECT * FROM paper_authors WHERE paper_id IN (SELECT id FROM k)), a AS (SELECT * FROM artifacts WHERE paper_id IN (SELECT id FROM k))
    SELECT 'papers' AS metric, CAST((SELECT count(*) FROM p) AS DOUBLE) AS value
    UNION ALL SELECT 'embedded_papers', (SELECT count(*) FROM p) UNION ALL SELECT 'papers_with_citation_data', (SELECT count(quality) FROM p)
    UNION ALL SELECT 'cited_papers', (SELECT count(*) FROM p WHERE quality>0) UNION ALL SELECT 'uncited_papers', (SELECT count(*) FROM p WHERE quality=0)
    UNION ALL SELECT 'unknown_citation_papers', (SELECT count(*) FROM p WHERE quality IS NULL)
    UNION ALL SELECT 'versions', (SELECT CAST(sum(n) AS DOUBLE) FROM vv) UNION ALL SELECT 'mean_versions', (SELECT round(avg(n),6) FROM vv)
    UNION ALL SELECT 'artifacts', (SELECT count(*) FROM a) UNION ALL SELECT 'clusters', (SELECT count(DISTINCT cluster_id) FROM a)
    UNION ALL SELECT 'mean_probability', (SELECT round(avg(cluster_prob),6) FROM a) UNION ALL SELECT 'std_probability', (SELECT round(stddev_samp(cluster_prob),6) FROM a)
    UNION ALL SELECT 'tree_edges', (SELECT count(*) FROM cluster_trees) UNION ALL SELECT 'active_authors', (SELECT count(DISTINCT author_id) FROM l WHERE author_id IN (SELECT id FROM authors))
    UNION ALL SELECT 'papers_with_authors', (SELECT count(DISTINCT paper_id) FROM l)""")
def _(spark, sf):
    # The report describes a store on disk, as it is after the export.
    path = scratch_path(spark, "filtered-store")
    tables = _store(spark, sf)
    store.save_snapshot(tables, path)
    t = {n: spark.read.schema(df.schema).parquet(f"{path}/{n}") for n, df in tables.items()}
    return qa.store_report(
        t["papers"], t["paper_versions"], t["paper_authors"], t["authors"], t["artifacts"], t["cluster_trees"], 1
    )


@query("d08_run_summary", """SELECT (SELECT count(*) FROM papers WHERE quality IS NOT NULL) AS rows_before, (SELECT count(*) FROM papers WHERE quality IS NULL) AS rows_added,
    (SELECT count(*) FROM papers) AS rows_after, (SELECT count(*) FROM paper_versions) AS n_versions, (SELECT count(DISTINCT paper_id) FROM paper_versions) AS papers_with_versions""")
def _(spark, sf):
    p = v.papers(spark, sf)
    return qa.run_summary(p.where("quality IS NOT NULL"), p, v.paper_versions(spark, sf))
