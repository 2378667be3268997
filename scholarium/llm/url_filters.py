"""URL filters by a sort-merge range join on reversed hosts, with DataFrame functions only.

A host is written back to front ("net.example."), so that a domain and all below it are one interval of keys, and so is
everything below a path. Such intervals nest or are apart. Addresses and interval ends are sorted together and swept: an
opening pushes its rule, an end pops one, and the height of the stack is a running sum. The rule at a given height is the last one
that was opened there, so the whole stack is known at every address without being carried from row to row.

The sweep runs once over hosts, where every open domain counts, and once over the paths within each of these domains,
where only the top of the stack does. Addresses are range-partitioned by key and row, so a host with a third of all rows is
many ranges; an interval goes to every range that it overlaps, which is a few per range besides its own.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholarium.llm.common import column, step

#: Bytes that occur in no UTF-8 text: one between a domain and a path, one behind everything that begins alike.
BETWEEN, BEHIND = b"\xfe", b"\xff"

CLOSE, OPEN, POINT = 0, 1, 2


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both are empty where there is no ``://``."""
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(after, F.length(host) + 1), "^[^?#]*", 0)
    lower = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    """Labels back to front, each followed by a dot: the key of a domain begins the keys of all its subdomains."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")).cast("binary")


def sweep(points: DataFrame, intervals: DataFrame, whole_stack: bool) -> DataFrame:
    """``points(at, tie, point)`` with what is open there of ``intervals(start, rule)``: (point, rule, height).

    An interval holds all keys that begin with its start; starts are distinct. With ``whole_stack`` a point comes once for every
    open interval, else once with the innermost; where none is open, once with a null rule and height 0.
    """
    ranged = step(points.repartitionByRange("at", "tie").withColumn("range", F.spark_partition_id()))
    # One record a range, of which there are as many as shuffle partitions.
    spans = ranged.groupBy("range").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    spans = step(spans).agg(F.collect_list(F.struct("range", "low", "high")).alias("spans"))
    ended = intervals.withColumn("end", F.concat("start", F.lit(BEHIND))).withColumn("spans", spans.scalar())
    overlapped = F.filter("spans", lambda s: (s["low"] < F.col("end")) & (s["high"] >= F.col("start")))
    placed = ended.withColumn("span", F.explode(overlapped)).select(F.col("span.range").alias("range"), "start", "end", "rule")

    none = F.lit(None)
    rule_type, point_type = intervals.schema["rule"].dataType, points.schema["point"].dataType
    events = ranged.select("range", "at", F.lit(POINT).alias("kind"), none.cast(rule_type).alias("rule"), "point")
    for kind, at in ((OPEN, "start"), (CLOSE, "end")):
        events = events.unionByName(
            placed.select("range", F.col(at).alias("at"), F.lit(kind).alias("kind"), "rule", none.cast(point_type).alias("point"))
        )
    change = F.when(F.col("kind") == OPEN, 1).when(F.col("kind") == CLOSE, -1).otherwise(0)
    order = Window.orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    events = events.withColumn("height", F.sum(change).over(order.partitionBy("range"))).where(F.col("kind") != CLOSE)
    asked = F.array("height")
    if whole_stack:
        asked = F.when((F.col("kind") == POINT) & (F.col("height") > 0), F.sequence(F.lit(1).cast("long"), "height")).otherwise(asked)
    events = events.withColumn("level", F.explode(asked))
    opened = F.last(F.when(F.col("kind") == OPEN, F.col("rule")), ignorenulls=True)
    top = opened.over(order.partitionBy("range", "level"))
    return events.withColumn("rule", top).where(F.col("kind") == POINT).select("point", "rule", "height")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: (key, host, path, rule, verdict).

    ``rules(host, path, verdict)``: a rule fits its host and all subdomains if the path of the address begins with the rule's.
    Of those that fit the longest (host and path together) decides, among equally long ones that of the longer host; where
    none fits the rule is null and the verdict ``default``. Of rules that repeat, the greatest verdict counts ("block"
    before "allow"); rules with a null or empty host, or any other null, are left out.

    Null addresses and those without ``://`` have an empty host and path, and no rule. Repeated rows and null keys are judged
    one by one, however long the address; more columns are ignored. An empty table gives an empty result; without rules all get ``default``.
    """
    rules = rules.select(
        F.translate("host", string.ascii_uppercase, string.ascii_lowercase).alias("host"), F.col("path"), F.col("verdict").cast("string")
    ).where("host <> '' AND path IS NOT NULL AND verdict IS NOT NULL")
    rules = step(rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("zone", host_key(F.col("host"))))

    host, path = host_and_path(column(pages, url))
    rows = pages.select(column(pages, key).alias("id"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    points = rows.select(host_key(F.col("host")).alias("at"), F.xxhash64("row").alias("tie"), F.struct("row", "id", "host", "path").alias("point"))
    zones = rules.select(F.col("zone").alias("start"), F.col("zone").alias("rule")).distinct()
    in_zones = step(sweep(points, zones, whole_stack=True))

    found = in_zones.where("rule IS NOT NULL").select(
        F.concat("rule", F.lit(BETWEEN), F.col("point.path").cast("binary")).alias("at"), F.xxhash64("point.row").alias("tie"),
        F.struct("point.*", "height").alias("point"),
    )
    text = F.concat("host", "path")
    best = F.struct(F.length(text).alias("n"), F.length("host").alias("m"), text.alias("rule"), "verdict")
    paths = rules.select(F.concat("zone", F.lit(BETWEEN), F.col("path").cast("binary")).alias("start"), best.alias("rule"))
    fits = step(sweep(found, paths, whole_stack=False).select("point.*", F.col("rule").alias("best")))

    # An address in one zone only is decided there; the others compare their zones.
    plain = ["row", "id", "host", "path"]
    out = fits.where("height = 1").select(*plain, "best")
    several = fits.where("height > 1").groupBy(*plain).agg(F.max("best").alias("best"))
    free = in_zones.where("rule IS NULL").select("point.*", F.lit(None).cast(fits.schema["best"].dataType).alias("best"))
    out = out.unionByName(several).unionByName(free.select(*plain, "best"))
    return out.select(
        F.col("id").alias(key), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def stated_rules(spark: SparkSession) -> DataFrame:
    """The four rules of the contract."""
    return spark.sql(
        "SELECT * FROM VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),"
        " ('org', '/fr/', 'allow') AS rules(host, path, verdict)"
    )
