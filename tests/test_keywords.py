"""Counting of terms for cluster keywords."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from scholarium.operators import keywords as kw


def test_term_counts_are_dealt_by_text(spark):
    rows = [(i % 3, i // 2, "alpha " + "beta" * (i % 5 + 1), None if i == 7 else "gamma delta alpha " * (i % 4 + 1)) for i in range(60)]
    members = spark.createDataFrame(rows, "cluster_id long, paper_id long, title string, abstract string")
    found = kw.term_counts(members, [], text_per_task=200)
    want = Counter()
    for c, p, title, abstract in rows:
        w = f"{title} {abstract}".lower().split()
        want.update((c, p, t) for t in w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    assert {(r["cluster_id"], r["paper_id"], r["term"]): r["tf"] for r in found.collect()} == want
    # Text decides on the number of parts, and a member's terms are counted in one.
    assert found.rdd.getNumPartitions() > 8, found.rdd.getNumPartitions()
    at = found.select("cluster_id", "paper_id", F.spark_partition_id().alias("part"))
    assert at.distinct().count() == at.select("cluster_id", "paper_id").distinct().count()
