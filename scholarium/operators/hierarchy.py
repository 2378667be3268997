"""Cluster hierarchy: levels, reachability, walks, and the data behind its pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarium.operators.ordering import running_within
from scholarium.session import cut_lineage


def _trial(trees: DataFrame, trial_id: int) -> DataFrame:
    return trees.where(F.col("trial_id") == trial_id)


def meaningful_edges(trees: DataFrame) -> DataFrame:
    """Edges to clusters, not to single points."""
    return trees.where(F.col("child_size") > 1)


def children_at(trees: DataFrame, trial_id: int, level: float) -> DataFrame:
    """Edges of a trial at or above a level."""
    return _trial(trees, trial_id).where(F.col("lambda_val") >= level)


def hierarchy_levels(trees: DataFrame, trial_id: int) -> DataFrame:
    """Distinct levels of a trial."""
    return _trial(trees, trial_id).select("lambda_val").distinct()


def tree_nodes(trees: DataFrame) -> DataFrame:
    """All clusters that occur in the tree."""
    return (
        trees.select(F.col("parent_cluster_id").alias("cluster_id"))
        .unionByName(trees.select(F.col("child_cluster_id").alias("cluster_id")))
        .distinct()
    )


def roots(trees: DataFrame, trial_id: int) -> DataFrame:
    """Parents that are nobody's child."""
    t = _trial(trees, trial_id)
    return (
        t.select(F.col("parent_cluster_id").alias("cluster_id"))
        .join(t.select(F.col("child_cluster_id").alias("cluster_id")), "cluster_id", "left_anti")
        .distinct()
    )


def clusters_at_lambda(trees: DataFrame, trial_id: int, level: float) -> DataFrame:
    """Clusters reachable from a root through edges at or above ``level``.

    A weak edge hides everything below it. Roots appear with the level of each outgoing edge. One join
    per tree depth; the frontier is materialised each round so that the plan does not grow, and the
    loop has no depth limit.
    """
    t = _trial(trees, trial_id).select("parent_cluster_id", "child_cluster_id", "lambda_val")
    top = roots(trees, trial_id)
    anchor = t.join(top.select(F.col("cluster_id").alias("parent_cluster_id")), "parent_cluster_id", "left_semi").select(
        F.col("parent_cluster_id").alias("cluster_id"), "lambda_val"
    )
    strong = t.where(F.col("lambda_val") >= level)
    found = anchor.where(F.col("lambda_val") >= level)
    frontier = top
    while True:
        step = cut_lineage(
            strong.join(frontier.select(F.col("cluster_id").alias("parent_cluster_id")), "parent_cluster_id", "left_semi")
            .select(F.col("child_cluster_id").alias("cluster_id"), "lambda_val")
            .distinct()
        )
        if step.isEmpty():
            return found.distinct()
        found = found.unionByName(step)
        frontier = step.select("cluster_id").distinct()


def clusters_at_lambda_by_jumps(trees: DataFrame, trial_id: int, level: float) -> DataFrame:
    """The same for trees in which every cluster has one parent, in as many rounds as the depth has binary digits.

    Each cluster keeps an ancestor and the lowest level on the way to it, and takes over its ancestor's ancestor.
    """
    t = _trial(trees, trial_id).select("parent_cluster_id", "child_cluster_id", "lambda_val")
    # A missing level hides what lies below, as any level under ``level`` does.
    known = F.coalesce("lambda_val", F.lit(float("-inf")))
    ways = cut_lineage(t.select(F.col("child_cluster_id").alias("node"), F.col("parent_cluster_id").alias("up"), known.alias("lowest")))
    while True:
        above = ways.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("lowest").alias("further"))
        jumped = cut_lineage(ways.join(above, "up", "left"))
        if jumped.where(F.col("next").isNotNull()).isEmpty():
            break
        ways = jumped.select("node", F.coalesce("next", "up").alias("up"), F.least("lowest", "further").alias("lowest"))
    open_ = ways.where(F.col("lowest") >= level).select(F.col("node").alias("child_cluster_id"))
    below = t.join(open_, "child_cluster_id", "left_semi").select(F.col("child_cluster_id").alias("cluster_id"), "lambda_val")
    top = roots(trees, trial_id).select(F.col("cluster_id").alias("parent_cluster_id"))
    first = t.where(F.col("lambda_val") >= level).join(top, "parent_cluster_id", "left_semi")
    return below.unionByName(first.select(F.col("parent_cluster_id").alias("cluster_id"), "lambda_val")).distinct()


def hierarchy_walk(
    trees: DataFrame, trial_id: int, max_depth: int | None = None, sizes: DataFrame | None = None
) -> DataFrame:
    """Every cluster with depth and a sortable path: parents before children, larger children first.

    Ordering the result by ``path`` prints the tree. ``sizes`` adds the member count per cluster.
    """
    t = _trial(trees, trial_id).select("parent_cluster_id", "child_cluster_id", "child_size")

    def padded(c: str, width: int = 20):
        return F.lpad(F.col(c).cast("string"), width, "0")

    frontier = roots(trees, trial_id).select("cluster_id", F.lit(0).alias("depth"), padded("cluster_id").alias("path"))
    found = frontier
    depth = 0
    while max_depth is None or depth + 1 < max_depth:
        size_key = F.lpad((F.lit(1_000_000_000_000) - F.col("child_size").cast("long")).cast("string"), 13, "0")
        step = cut_lineage(
            t.join(frontier, t["parent_cluster_id"] == frontier["cluster_id"]).select(
                F.col("child_cluster_id").alias("cluster_id"),
                (F.col("depth") + 1).alias("depth"),
                F.concat("path", F.lit("/"), size_key, F.lit("-"), padded("child_cluster_id")).alias("path"),
            )
        )
        if step.isEmpty():
            break
        found = found.unionByName(step)
        frontier = step
        depth += 1
    if sizes is None:
        return found
    return found.join(sizes.select("cluster_id", "size"), "cluster_id", "left").withColumn(
        "size", F.coalesce("size", F.lit(0))
    )


#: Stands for the parent of the roots where a key may not be null.
ABOVE = -(1 << 62)


def preorder(trees: DataFrame, trial_id: int) -> DataFrame:
    """(cluster_id, place, depth, n_below): the order in which the tree is printed, without a job per level.

    Parents come before their children, larger children first, then smaller ids; ``place`` counts from 1 and ``n_below``
    counts the clusters of the subtree. The tree is walked round its edges: every cluster is entered once and left once, and
    each of these steps knows the next. Pointers along the walk are doubled, so the rounds are as many as twice the
    number of clusters has binary digits, however deep the tree is and however many children a cluster has.
    """
    t = _trial(trees, trial_id).where(F.col("child_cluster_id").isNotNull())
    sizes = F.coalesce(F.col("child_size").cast("long"), F.lit(0))
    below = t.select(F.col("parent_cluster_id").cast("long").alias("up"), F.col("child_cluster_id").cast("long").alias("node"), sizes.alias("size"))
    first = roots(trees, trial_id).select(F.lit(ABOVE).alias("up"), F.col("cluster_id").cast("long").alias("node"), F.lit(0).cast("long").alias("size"))
    # Of repeated edges one stays.
    edges = below.unionByName(first).groupBy("up", "node").agg(F.max("size").alias("size"))
    edges = edges.select("up", F.struct((-F.col("size")).alias("size"), "node").alias("child"), F.lit(1).alias("one"))
    lined = cut_lineage(running_within(edges, ["up"], "child", "one", "nth", "following").select(
        "up", F.col("child.node").alias("node"), "nth", F.col("following.node").alias("following")
    ))
    total, distinct = lined.agg(F.count("*"), F.countDistinct("node")).first()
    if total != distinct:
        raise ValueError("a cluster has several parents")
    oldest = lined.where("nth = 1").select(F.col("up").alias("node"), F.col("node").alias("oldest"))
    enter = lined.join(oldest, "node", "left").select(
        (F.col("node") * 2).alias("at"), F.coalesce(F.col("oldest") * 2, F.col("node") * 2 + 1).alias("next"),
        F.lit(1).cast("long").alias("entered"), F.lit(1).cast("long").alias("deeper"),
    )
    over = F.when(F.col("up") != ABOVE, F.col("up") * 2 + 1)
    leave = lined.select(
        (F.col("node") * 2 + 1).alias("at"), F.coalesce(F.col("following") * 2, over).alias("next"),
        F.lit(0).cast("long").alias("entered"), F.lit(-1).cast("long").alias("deeper"),
    )
    walk = cut_lineage(enter.unionByName(leave))
    # Sums over the steps from one on up to the one it points to.
    for _ in range((2 * total).bit_length() + 1):
        if walk.where(F.col("next").isNotNull()).isEmpty():
            break
        ahead = walk.select(F.col("at").alias("next"), F.col("next").alias("n2"), F.col("entered").alias("e2"), F.col("deeper").alias("d2"))
        walk = cut_lineage(walk.join(ahead, "next", "left").select(
            "at", F.col("n2").alias("next"), (F.col("entered") + F.coalesce("e2", F.lit(0))).alias("entered"),
            (F.col("deeper") + F.coalesce("d2", F.lit(0))).alias("deeper"),
        ))
    else:
        raise ValueError("a cluster is below itself")
    left = walk.where("at % 2 <> 0").select((F.col("at") - 1).alias("at"), F.col("entered").alias("after"))
    return walk.where("at % 2 = 0").join(left, "at").select(
        F.shiftright("at", 1).alias("cluster_id"), (F.lit(total) - F.col("entered") + 1).alias("place"),
        (-F.col("deeper")).alias("depth"), (F.col("entered") - F.col("after")).alias("n_below"),
    )


def printed_tree(
    trees: DataFrame, trial_id: int, sizes: DataFrame, keyword_lines: DataFrame, max_depth: int | None = None
) -> DataFrame:
    """(place, cluster_id, depth, line, keywords): the tree as text, to be read in order of place.

    ``sizes`` has (cluster_id, size) and ``keyword_lines`` (cluster_id, keywords); a cluster without keywords has no
    second line, a null.
    """
    walk = preorder(trees, trial_id)
    walk = walk if max_depth is None else walk.where(F.col("depth") < max_depth)
    indent = F.repeat(F.lit("  "), F.col("depth").cast("int"))
    size = F.coalesce("size", F.lit(0)).cast("string")
    return (
        walk.join(sizes.select("cluster_id", "size"), "cluster_id", "left")
        .join(keyword_lines.select("cluster_id", F.col("keywords").alias("_k")), "cluster_id", "left")
        .select(
            "place", "cluster_id", "depth",
            F.concat(indent, F.lit("Cluster "), F.col("cluster_id").cast("string"), F.lit(" ("), size, F.lit(" papers)")).alias("line"),
            F.concat(indent, F.lit("Keywords: "), "_k").alias("keywords"),
        )
    )


def lambda_range(trees: DataFrame, trial_id: int) -> DataFrame:
    """Edges with their level scaled to [0, 1] over all edges of the trial."""
    t = _trial(trees, trial_id)
    r = t.agg(F.struct(F.min("lambda_val").alias("lo"), F.max("lambda_val").alias("hi"))).scalar()
    return (
        t.withColumn("_r", r)
        .withColumn(
            "level",
            F.coalesce(F.try_divide(F.col("lambda_val") - F.col("_r.lo"), F.col("_r.hi") - F.col("_r.lo")), F.lit(0.0)),
        )
        .drop("_r")
    )


def network_edges(trees: DataFrame, trial_id: int) -> DataFrame:
    """Cluster edges with weight and drawing width (2 for the heaviest)."""
    e = meaningful_edges(lambda_range(trees, trial_id))
    heaviest = meaningful_edges(_trial(trees, trial_id)).agg(F.max("child_size")).scalar()
    return e.select(
        "parent_cluster_id",
        "child_cluster_id",
        F.col("child_size").alias("weight"),
        F.round(F.col("level"), 6).alias("level"),
        F.round(F.lit(2.0) * F.col("child_size") / heaviest, 6).alias("width"),
    )


def network_nodes(trees: DataFrame, trial_id: int, sizes: DataFrame) -> DataFrame:
    """Nodes of the network with the level they first appear at, member count and drawing size.

    Edges are met from the highest level down, so a node takes the highest level of its edges.
    Nodes with members share 1000 units by member count over the number of such nodes; others get 100.
    Only clusters that some edge leads to carry members.
    """
    e = meaningful_edges(lambda_range(trees, trial_id))
    ends = e.select(F.col("parent_cluster_id").alias("cluster_id"), "level", F.lit(False).alias("child")).unionByName(
        e.select(F.col("child_cluster_id").alias("cluster_id"), "level", F.lit(True).alias("child"))
    )
    nodes = ends.groupBy("cluster_id").agg(F.max("level").alias("level"), F.max("child").alias("child"))
    with_size = nodes.join(sizes.select("cluster_id", "size"), "cluster_id", "left").select(
        "cluster_id",
        F.round("level", 6).alias("level"),
        F.when(F.col("child"), F.coalesce("size", F.lit(0))).otherwise(F.lit(0)).alias("size"),
    )
    populated = with_size.agg(F.count_if(F.col("size") > 0)).scalar()
    return with_size.withColumn(
        "node_size",
        F.when(F.col("size") > 0, F.round(F.lit(1000.0) * F.col("size") / populated, 6)).otherwise(F.lit(100.0)),
    )


def network_labels(nodes: DataFrame, keyword_lines: DataFrame, above: int = 5) -> DataFrame:
    """Nodes with the text drawn at them: keywords where there are more than ``above`` members, nothing at empty nodes.

    A smaller node has a null, and so has one whose members share no keyword.
    """
    lines = keyword_lines.select("cluster_id", F.col("keywords").alias("_k"))
    text = F.when(F.col("size") > above, F.col("_k")).when(F.col("size") == 0, F.lit(""))
    return nodes.join(lines, "cluster_id", "left").withColumn("text", text).drop("_k")


def dendrogram_matrix(trees: DataFrame, trial_id: int) -> DataFrame:
    """Symmetric parent/child level matrix as sparse rows."""
    t = _trial(trees, trial_id)
    one = t.select(F.col("parent_cluster_id").alias("row_id"), F.col("child_cluster_id").alias("col_id"), "lambda_val")
    other = t.select(F.col("child_cluster_id").alias("row_id"), F.col("parent_cluster_id").alias("col_id"), "lambda_val")
    return one.unionByName(other)
