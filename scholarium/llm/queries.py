"""The query of each operator over its whole table, with production parameters, and its SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarium.llm.blocked_search import ranked
from scholarium.llm.common import Query, table
from scholarium.llm.divergence import audit
from scholarium.llm.exact_dedup import exact_groups
from scholarium.llm.language import languages
from scholarium.llm.maxscore import top_k
from scholarium.llm.mixing import mix, quality_weights
from scholarium.llm.near_dedup import near_classes
from scholarium.llm.packing import pack
from scholarium.llm.repeats import without_repeats
from scholarium.llm.ring import shard_rows
from scholarium.llm.toxicity import toxic_scores
from scholarium.llm.url_filters import judge, stated_rules
from scholarium.llm.warc import archived_pages

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query(
    "op1_exact_dedup",
    r"""
    WITH d AS (
        SELECT doc_id, length(coalesce(text, '')) AS points,
               regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
        FROM documents),
    g AS (
        SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
               first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id
        FROM d)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


@query("op3_mixing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs, quality=quality_weights(table(spark, sf_dir, "labels"))).drop("source", "copies")


@query("op6_sharding")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), shards=40)


@query(
    "op2_top_k",
    """
    WITH e AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
               CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
    SELECT query_id, rank, vec_id, score FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    WHERE rank <= 5
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


@query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op7_warc",
    """
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
    b AS (
        SELECT page_id, payload_bytes, max(page_id) OVER (PARTITION BY h) AS first,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + CAST((CAST('0x' || substr(h, 1 + 5 * CAST(i // 4 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31
                       AS INTEGER), 1)), 'string_agg', '') AS payload_digest
        FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to
    FROM b
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages"))


@query("op8_language")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


@query("op10_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


@query("op4_repeated_strings")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


@query(
    "op11_ranked_search",
    r"""
    WITH d AS (
        SELECT row_number() OVER () AS r, doc_id,
               regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
        FROM documents),
    a AS (SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d WHERE len(ts) > 0),
    tf AS (SELECT r, doc_id, len(ts) AS n, t, count(*) AS tf FROM (SELECT r, doc_id, ts, unnest(ts) AS t FROM d) GROUP BY ALL),
    df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
    q AS (
        SELECT i, item_id, t, count(*) AS times FROM (
            SELECT row_number() OVER () AS i, item_id,
                   unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
            FROM benchmark)
        GROUP BY ALL),
    s AS (
        SELECT i, item_id, r, doc_id, CAST(sum(
                   times * CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT)
                   * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
        FROM q JOIN df USING (t) JOIN tf USING (t) CROSS JOIN a
        GROUP BY ALL)
    SELECT item_id, rank, doc_id, score FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, r) AS INTEGER) AS rank FROM s WHERE score > 0)
    WHERE rank <= 20
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op12_divergence",
    r"""
    WITH d AS (
        SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
        FROM documents),
    w AS (SELECT r, lang, source, unnest(ts) AS t FROM (SELECT *, row_number() OVER () AS r FROM d)),
    k AS (SELECT lang, t FROM w GROUP BY lang, t HAVING count(DISTINCT r) >= 3),
    v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, t, count(*) AS n FROM w JOIN k USING (lang, t) GROUP BY ALL),
    f AS (SELECT g.lang, g.source, k.t, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, t)),
    p AS (
        SELECT lang, source, t, n, 1 + (1000000000 * CAST(n + 1 AS HUGEINT)) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p
        FROM f JOIN v USING (lang)),
    l AS (
        SELECT lang, t, 1 + (1000000000 * CAST(n + 1 AS HUGEINT)) // (sum(n) OVER (PARTITION BY lang) + v) AS q
        FROM (SELECT lang, t, sum(n) AS n FROM f GROUP BY lang, t) JOIN v USING (lang)),
    o AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
        LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.t = x.t
        WHERE x.t IS NULL OR y.t IS NOT NULL
        GROUP BY ALL
        UNION ALL
        SELECT lang, source, 'term', t, (p - q) * (p - q) // q FROM p JOIN l USING (lang, t) WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM o)
    WHERE part = 'pair' OR rank <= 200
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


@query(
    "op13_url_filters",
    r"""
    WITH u AS (
        SELECT row_number() OVER () AS r, page_id,
               translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
        FROM pages),
    f(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
    j AS (
        SELECT u.*, h || p AS rule, v, row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC NULLS LAST, length(h) DESC) AS place
        FROM u LEFT JOIN f ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
    SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM j WHERE place = 1
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), stated_rules(spark))
