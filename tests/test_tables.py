"""Literal fixtures for names, titles, dates, versions, authors, inserts and batches."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholarium import schemas
from scholarium.functions import text as tx
from scholarium.operators import authors as au
from scholarium.operators import clusters as cl
from scholarium.operators import hierarchy as hi
from scholarium.operators import maintenance as ma
from scholarium.operators import ordering as od
from scholarium.operators import prompts as pr
from scholarium.operators import quality as qa
from scholarium.operators import report as rp
from scholarium.operators import tables as tb
from scholarium.operators import trials as tr
from scholarium.operators import usage as us
from scholarium.operators import vectors as ve
from scholarium.operators import versions as vs


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def values(spark, items, expr, dtype="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {dtype}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_text_functions(spark):
    assert values(spark, ["JR", "jr.", " Junior ", "SR", "iii", "PhD", "", " ", None], tx.normalize_suffix("x")) == [
        "Jr.", "Jr.", "Jr.", "Sr.", "III", "PhD", None, None, None
    ]
    titles = ["Foo: A v2 Study (arXiv:1706.03762)", "Étude  sur l'État", "漢字 v10 テスト", "vv2 v2x", None, ""]
    assert values(spark, titles, tx.normalize_title("x")) == [
        "foo a study", "étude sur létat", "漢字 テスト", "vv2 v2x", "", ""
    ]
    assert values(spark, ["Li,", "Li,,", "Li", ","], tx.strip_trailing_commas("x")) == ["Li", "Li", "Li", ""]
    assert values(spark, ["v3", "vX", None, "v10", "vv2"], tx.version_number("x")) == [3, None, 1, 10, 2]
    dates = values(spark, ["Mon, 1 Jan 2024 00:00:00 GMT", "rubbish", None], F.date_format(tx.parse_record_date("x"), "yyyy-MM-dd"))
    assert dates == ["2024-01-01", None, None]
    urls = ["http://a/b?resumptionToken=1%7Ca+b&x=1", "http://a/b"]
    assert values(spark, urls, tx.resume_token("x")) == ["1|a+b", None]
    assert values(spark, [0.0, None, 0.7, 0.456], tx.fixed_decimals("x"), "double") == ["N/A", "N/A", "0.70", "0.46"]
    assert values(spark, ["a  b\tc", "", " ", "x"], tx.count_tokens("x")) == [3, 0, 0, 1]
    texts = ["Self-attention is all: élan x1 cafés foo-é bar- b", None]
    assert values(spark, texts, tx.words("x")) == [["self-attention", "foo-", "bar"], []]
    assert values(spark, ["red green blue", "one"], tx.words_and_pairs(tx.words("x", []))) == [
        ["red", "green", "blue", "red green", "green blue"], ["one"]
    ]
    assert values(spark, ["c", None], tx.embedding_text("x", F.lit("t"), F.lit(None).cast("string"))) == [
        "Category: c\nt\nNone", "Category: None\nt\nNone"
    ]


def test_versions_decide_dates_and_withdrawal(spark):
    d = [dt.datetime(2024, 1, i) for i in range(1, 9)]
    v = spark.createDataFrame(
        [("a", 10, "I", "5kb", d[2]), ("a", 2, "D", "5kb", d[4]), ("b", 1, "D", "0kb", d[0]), ("b", 2, "D", "9kb", d[1]), ("c", 1, "D", "0kb", d[3])],
        schemas.PAPER_VERSIONS,
    )
    got = {r["paper_id"]: r for r in vs.version_summary(v).collect()}
    # By number, not by date.
    assert (got["a"]["created"], got["a"]["updated"], got["a"]["withdrawn"]) == (d[4], d[2], True)
    assert got["b"]["withdrawn"] is False and got["c"]["withdrawn"] is True
    p = spark.createDataFrame([("a",), ("z",)], "id string")
    assert rows(vs.apply_version_summary(p, v).select("id", "updated", "withdrawn")) == [("a", d[2], True), ("z", None, False)]


def test_authors_merge_and_links_collapse(spark):
    a = spark.createDataFrame(
        [(1, "Li", None, "JR"), (2, "Li", "", "jr."), (3, "Li", "X", None), (4, "Li,", "X", None), (5, "Wu,,", None, None), (6, "Wu,", "", "")],
        schemas.AUTHORS,
    )
    links = spark.createDataFrame([("p", 2, 2), ("p", 1, 1), ("p", 4, 3), ("q", 6, 1), ("q", 99, 2)], schemas.PAPER_AUTHORS)
    canon, moved = au.deduplicate_authors(a, links)
    moved_before = moved.count()
    assert rows(canon.where("keyname = 'Li'")) == [(1, "Li", None, "Jr."), (3, "Li", "X", None)]
    assert ("p", 1, 1) in rows(moved) and len(rows(moved)) == 4
    kept, moved = au.merge_comma_authors(a, links)
    assert rows(kept.select("id", "keyname"))[2:] == [(3, "Li"), (5, "Wu")]
    assert ("p", 3, 3) in rows(moved) and ("q", 5, 1) in rows(moved)
    aff = spark.createDataFrame([(4, "U"), (3, "U"), (5, "V")], "author_id int, affiliation string")
    assert rows(au.move_affiliations(aff, au.comma_mapping(a).select("old_id", "new_id"))) == [(3, "U"), (5, "V")]
    assert rows(au.merge_comma_authors(a, links, aff)[2]) == [(3, "U"), (5, "V")]
    with pytest.raises(ValueError, match="1 links to unknown authors, such as q-99"):
        au.deduplicate_authors(a, links, strict=True)
    inside = links.where("author_id <> 99")
    assert au.deduplicate_authors(a, inside, strict=True)[1].count() == moved_before - 1
    with pytest.raises(ValueError, match="unmapped authors"):
        au.check_coverage(a, links.limit(0), au.author_mapping(a).limit(0))


def test_find_or_create_numbers_after_the_maximum(spark):
    known = spark.createDataFrame([(7, "Li", None, None)], schemas.AUTHORS)
    lists = spark.createDataFrame(
        [("p", [("Li", " ", ""), ("Wu", "B", "jr")]), ("q", [("Wu", "B", "JR."), ("Wu", None, None), (" ", "x", None)])],
        "paper_id string, authors array<struct<keyname string, forenames string, suffix string>>",
    )
    added, resolved = au.find_or_create(known, au.sighted_authors(lists))
    assert rows(added) == [(8, "Wu", None, None), (9, "Wu", "B", "Jr.")]
    assert rows(resolved.select("paper_id", "author_position", "author_id")) == [("p", 1, 7), ("p", 2, 9), ("q", 1, 9), ("q", 2, 8)]


def test_insert_upsert_fill(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, x string, y double")
    new = spark.createDataFrame([(2, "B", 9.0), (3, "d", 3.0), (3, "c", 4.0)], "k int, x string, y double")
    assert rows(tb.insert_ignore(old, new, ["k"])) == [(1, "a", 1.0), (2, "b", 2.0), (3, "c", 4.0)]
    part = spark.createDataFrame([(2, None), (4, "z")], "k int, x string")
    assert rows(tb.upsert(old, part, ["k"])) == [(1, "a", 1.0), (2, None, 2.0), (4, "z", None)]
    res = spark.createDataFrame([(1, "A")], "k int, x string")
    assert rows(tb.fill_column(old, res, "k", "x")) == [(1, "A", 1.0), (2, "b", 2.0)]
    with pytest.raises(ValueError, match="not published"):
        tb.validate_then_publish(old, old, "/tmp/never-written")


def test_category_clean_up_keeps_unknown_categories(spark):
    p = spark.createDataFrame(
        [("a", ["cs.LG"], False), ("b", ["math.CO"], False), ("c", None, False), ("d", None, True), ("e", ["cs.AI"], True)],
        "id string, arxiv_categories array<string>, withdrawn boolean",
    )
    assert rows(ma.category_keep_set(p)) == [("a",), ("c",)]


def test_duplicate_titles_and_author_strings(spark):
    p = spark.createDataFrame(
        [("1", "Deep  Nets!", False), ("2", "deep nets", False), ("3", "deep nets", True), ("4", None, False), ("5", None, False)],
        "id string, title string, withdrawn boolean",
    )
    assert rows(qa.duplicate_titles(p)) == [("deep nets", 2, "1")]
    links = spark.createDataFrame([("1", 2, 1), ("1", 1, 2)], schemas.PAPER_AUTHORS)
    a = spark.createDataFrame([(1, "Li", "X", None), (2, "Wu", None, "Jr.")], schemas.AUTHORS)
    got = dict(rows(qa.author_strings(p.select("id"), links, a)))
    assert got["1"] == "Wu Jr., Li, X" and got["2"] is None


def test_numbering_and_batches(spark):
    df = spark.range(1000).repartition(7)
    assert [r[1] for r in od.number_rows(df, ["id"]).orderBy("id").collect()] == list(range(1, 1001))
    last = od.fixed_batches(df, ["id"], 128).groupBy("batch").count().orderBy(F.desc("batch")).first()
    assert tuple(last) == (7, 1000 - 7 * 128)
    hot = spark.range(500).select((F.col("id") % 3 == 0).cast("int").alias("k"), "id")
    got = od.number_within(hot, ["k"], F.floor(F.col("id") / 50), ["id"], "n").collect()
    assert all(r["n"] == (r["id"] // 3 + 1 if r["k"] else r["id"] - r["id"] // 3) for r in got)
    a = [r[0] for r in od.seeded_order(df, "id", 1).limit(20).collect()]
    assert a == [r[0] for r in od.seeded_order(df.repartition(3), "id", 1).limit(20).collect()]


def test_token_packing(spark):
    items = [(0, 0, "a", 60), (0, 1, "b", 60), (0, 2, "big", 121), (0, 3, "c", 1), (0, 4, "d", 120), (1, 0, "x", 500)]
    df = spark.createDataFrame(items, "batch int, position int, id string, tokens int")
    got = [(r["id"], r["sub_batch"]) for r in us.pack_by_budget(df, 120).orderBy("batch", "position").collect()]
    assert got == [("a", 0), ("b", 0), ("c", 1), ("d", 2)]


def test_rolling_window_edges(spark):
    t = dt.datetime(2024, 1, 1, 0, 9, 30)
    at = [0, 30, 59, 60, 61, 700]
    log = spark.createDataFrame([("k", t + dt.timedelta(seconds=s), 10) for s in at], "api_key string, ts timestamp, tokens int")
    got = [r["requests_in_window"] for r in us.rolling_usage(log, 3, 25).orderBy("ts").collect()]
    # A request exactly 60 seconds old is out.
    assert got == [1, 2, 3, 3, 4, 1]


def test_answers(spark):
    a = spark.createDataFrame(
        [(1, '{"label":"x","safety_relevance":0.5}'), (2, '{"label":"x","safety_relevance":1.2}'), (3, "{"), (4, '{"safety_relevance":0.1}'), (5, '{"label":"y"}')],
        "id int, answer string",
    )
    assert [r["rejected"] for r in pr.parse_cluster_answers(a).orderBy("id").collect()] == [
        None, "relevance out of range", "unreadable", "no label", "no relevance"
    ]


def test_histogram_edges(spark):
    h = ve.histogram(spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "x double"), F.col("x"), 2)
    assert [r["n"] for r in h.orderBy("bin").collect()] == [1, 2]
    flat = ve.histogram(spark.createDataFrame([(3.0,), (3.0,)], "x double"), F.col("x"), 4).orderBy("bin").collect()
    assert (flat[0]["lower"], flat[-1]["upper"], [r["n"] for r in flat]) == (2.5, 3.5, [0, 0, 2, 0])


def test_scaling_leaves_constant_dimensions(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0])], "id int, embedding array<float>")
    assert rows(ve.scale_vectors(df).select("id", "scaled_embedding")) == [(1, [-1.0, 0.0]), (2, [1.0, 0.0])]
    one = df.select(ve.encode_f32("embedding").alias("b")).orderBy("b").first()["b"]
    assert bytes(one)[:4].hex() in ("0000803f", "00004040")


def test_weak_edge_hides_its_subtree(spark):
    t = spark.createDataFrame(
        [(1, 0, 1, 0.5, 9), (1, 0, 2, 0.1, 9), (1, 2, 3, 0.9, 4), (1, 1, 4, 0.7, 1)], schemas.CLUSTER_TREES
    ).withColumn("lambda_val", F.round(F.col("lambda_val").cast("double"), 3))
    want = [(0, 0.5), (1, 0.5), (4, 0.7)]
    assert rows(hi.clusters_at_lambda(t, 1, 0.3)) == want
    assert rows(hi.clusters_at_lambda_by_jumps(t, 1, 0.3)) == want
    assert rows(hi.meaningful_edges(t).select("child_cluster_id")) == [(1,), (2,), (3,)]
    walk = [r["cluster_id"] for r in hi.hierarchy_walk(t, 1).orderBy("path").collect()]
    assert walk == [0, 1, 4, 2, 3]


def test_reports(spark):
    a = spark.createDataFrame(
        [(1, f"p{i}", c, 0.5) for i, c in enumerate([0, 0, 1, 1, 2, 3, -1, -1, -1])],
        "trial_id int, paper_id string, cluster_id int, cluster_prob double",
    )
    labels = spark.createDataFrame([(0, "A", None), (1, "", 0.7), (2, "C", 0.0)], "cluster_id int, label string, safety_relevance double")
    r = rp.cluster_report(a, labels, 1)
    assert [tuple(x) for x in rp.report_by_size(r).collect()] == [
        (2, "A", "N/A"), (2, "", "0.70"), (1, "C", "N/A"), (1, "No label", "N/A")
    ]
    assert [x["label"] for x in rp.report_by_relevance(r).collect()] == ["", "A", "C", "No label"]
    assert [x["cluster_id"] for x in cl.largest_clusters(a, 1, 3).collect()] == [1, 0, 3]
    shown = {x["cluster_id"]: x["display"] for x in cl.with_labels(a, labels).collect()}
    assert shown[1] == "Cluster 1" and shown[-1] == "Cluster -1"
    noise = a.withColumn("cluster_id", F.lit(-1))
    assert tuple(ve.clustering_summary(noise, 1).first()) == (1.0, 0, 0.0, 0.0, 0.0)
    assert len(rows(cl.cluster_pairs(a, 1))) == 6


def test_best_trial_ties(spark):
    t = spark.createDataFrame([(3, 0.5), (1, 0.5), (2, None)], "trial_id int, value double")
    assert tr.best_trial(t).first()["trial_id"] == 1
    g = tr.parameter_grid(spark, 50, seed=3)
    assert rows(g) == rows(tr.parameter_grid(spark, 50, seed=3).repartition(3))
    lims = g.agg(F.min("min_samples"), F.max("min_samples")).first()
    assert 5 <= lims[0] and lims[1] <= 50


def test_representatives_of_a_hot_cluster(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    lab = [0 if i % 3 else 1 + i % 5 for i in range(400)]
    df = spark.createDataFrame(
        [(c, i, v.tolist()) for i, (c, v) in enumerate(zip(lab, x))], "cluster_id int, paper_id long, embedding array<double>"
    )
    got = [r["paper_id"] for r in ve.representatives(df).where("cluster_id = 0").orderBy("rank").collect()]
    at = [i for i, c in enumerate(lab) if c == 0]
    d = (((x[at] - x[at].mean(0)) ** 2).sum(1) ** 0.5).round(6)
    assert got == [i for _, i in sorted(zip(d, at))[:10]]
