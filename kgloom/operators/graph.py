"""Graph views and measures: nodes, degrees, distances, layout, top-k."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.sources.writers import materialise


def nodes_of(e: DataFrame) -> DataFrame:
    """One node per key over edge ends; ``MENTION::`` ids for unlinked ends; the first name met counts."""
    ends = e.select(F.coalesce("head_id", F.concat(F.lit("MENTION::"), "head")).alias("node_id"), F.col("head").alias("name"), (F.col("triple_id") * 2).alias("ord")).unionByName(
        e.select(F.coalesce("tail_id", F.concat(F.lit("MENTION::"), "tail")).alias("node_id"), F.col("tail").alias("name"), (F.col("triple_id") * 2 + 1).alias("ord"))).where("node_id IS NOT NULL")
    return ends.groupBy("node_id").agg(F.min_by("name", "ord").alias("name"), F.count("*").alias("n_ends"))


def active_nodes(nodes: DataFrame, e: DataFrame) -> DataFrame:
    """Nodes that end at least one edge which is no self loop."""
    used = e.where("hk <> tk").select(F.explode(F.array("hk", "tk")).alias("k"))
    n = nodes.select(F.upper(F.trim("node_id")).alias("node_id"), "name", "type").where("node_id IS NOT NULL").distinct()
    return n.join(used, n.node_id == used.k, "left_semi")


def simple_edges(e: DataFrame) -> DataFrame:
    """Parallel edges collapse; the last label stands."""
    return e.where("hk <> tk").groupBy("hk", "tk").agg(F.max_by("relation", "triple_id").alias("relation"), F.count("*").alias("n_parallel"))


def degrees(simple: DataFrame) -> DataFrame:
    return simple.select(F.explode(F.array("hk", "tk")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def hub(deg: DataFrame) -> DataFrame:
    return deg.orderBy(F.desc("degree"), "node").limit(1)  # the feature: the one centre


def distances(simple: DataFrame, start: DataFrame) -> DataFrame:
    """(node, dist): undirected breadth-first distances of all nodes the start reaches; each frontier is written to the shared folder, only new nodes move on."""
    both = materialise(simple.select(F.col("hk").alias("a"), F.col("tk").alias("b")).unionByName(simple.select(F.col("tk").alias("a"), F.col("hk").alias("b"))).distinct(), "adjacent")
    seen = materialise(start.select("node", F.lit(0).alias("dist")), "seen")
    front, d = seen, 0
    while not front.isEmpty():
        d += 1
        new = both.join(front, both.a == front.node).select(F.col("b").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("dist", F.lit(d))
        front = materialise(new, "front")
        seen = seen.unionByName(front)
    return seen


def layout(dist: DataFrame, deg: DataFrame, ring: int = 8) -> DataFrame:
    """Radial positions: rings of ``ring`` nodes per distance, ordered by degree.

    The order of a distance is ranked on two levels: nodes of one degree are ordered among themselves, counts of the higher degrees (few rows) give where they begin.
    """
    j = dist.join(deg, "node")
    counts = j.groupBy("dist", "degree").agg(F.count("*").alias("n"))
    w = Window.partitionBy("dist").orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, -1)  # one row per distinct degree
    base = counts.select("dist", "degree", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    j = j.withColumn("r", F.row_number().over(Window.partitionBy("dist", "degree").orderBy("node")) - 1).join(base, ["dist", "degree"]).withColumn("i", F.col("base") + F.col("r"))
    r = F.col("dist") * 10 + F.floor(F.col("i") / ring) * 2
    a = F.col("i") % ring * (2 * 3.141592653589793 / ring)
    return j.select("node", "dist", "degree", (F.round(r * F.cos(a), 6) + 0.0).alias("x"), (F.round(r * F.sin(a), 6) + 0.0).alias("y"))


def submission(e: DataFrame, priority: dict[str, int], per_relation: int = 3, total: int = 20) -> DataFrame:
    """Top edges for a report: by relation priority, confidence, linked ends, short texts; at most ``per_relation`` of a relation."""
    pr = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in priority.items() for x in kv]), F.col("relation")), F.lit(0))
    order = [F.desc("priority"), F.desc("confidence"), F.desc(F.col("head_id").isNotNull()), F.desc(F.col("tail_id").isNotNull()), F.asc(F.length("head")), F.asc(F.length("tail")), F.asc("triple_id")]
    one = e.withColumn("priority", pr).withColumn("r", F.row_number().over(Window.partitionBy("head", "relation", "tail").orderBy(*order))).where("r = 1")
    capped = one.withColumn("r", F.row_number().over(Window.partitionBy("relation").orderBy(*order))).where(F.col("r") <= per_relation)
    return capped.orderBy(*order).limit(total).select("triple_id", "head", "relation", "tail", "confidence", "source")
