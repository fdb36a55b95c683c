"""Threshold clustering, representatives and closures as iterative DataFrame jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.operators.ranking import best_per_key, number_groups
from siftline.session import LoopState, cut, stage_table


def threshold_clusters(edges: DataFrame, nodes: DataFrame, id_col: str, threshold: float) -> DataFrame:
    """Complete-linkage clusters cut at ``threshold``: (id, cluster = smallest id).

    ``edges``: id_a < id_b and distance, with at least every pair below the threshold. Clusters
    that are each other's nearest neighbour merge, all in one round: complete linkage is
    reducible, so this gives the clusters of the one-at-a-time method. Two clusters are linked
    only while every cross pair is below the threshold, hence the pair count beside the distance;
    a broken link can never heal and is dropped. No component is gathered anywhere. Of the states of
    links, members and merges the last two are kept, so disk follows the links of the first rounds.
    """
    spark = edges.sparkSession
    keep_links, keep_merges, keep_members = (LoopState(spark, tag) for tag in ("links", "merges", "members"))
    links = edges.filter(F.col("distance") < threshold).select(
        F.col("id_a").alias("lo"), F.col("id_b").alias("hi"), "distance", F.lit(1).cast("long").alias("n"),
        F.lit(1).cast("long").alias("lo_size"), F.lit(1).cast("long").alias("hi_size"),
    )
    links = keep_links(links)
    members = nodes.select(id_col, F.col(id_col).alias("cluster"))
    while not links.isEmpty():
        rank = F.struct("distance", "lo", "hi", "lo_size", "hi_size").alias("edge")
        ends = links.select(F.explode(F.array("lo", "hi")).alias("node"), rank)
        best = ends.groupBy("node").agg(F.min("edge").alias("edge"))
        # An edge that is best for both ends appears twice.
        merges = best.groupBy("edge").agg(F.count(F.lit(1)).alias("votes")).filter(F.col("votes") == 2)
        merges = keep_merges(merges.select("edge.lo", "edge.hi", (F.col("edge.lo_size") + F.col("edge.hi_size")).alias("size")))
        moved = merges.select(F.explode(F.array(
            F.struct(F.col("lo").alias("node"), F.col("lo").alias("new"), "size"), F.struct(F.col("hi").alias("node"), F.col("lo").alias("new"), "size"),
        )).alias("m")).select("m.*")

        def relabel(df: DataFrame, side: str) -> DataFrame:
            m = moved.select(F.col("node").alias(side), F.col("new").alias("_new"), F.col("size").alias("_size"))
            out = df.join(m, side, "left").withColumn(side, F.coalesce("_new", side))
            if f"{side}_size" in df.columns:
                out = out.withColumn(f"{side}_size", F.coalesce("_size", f"{side}_size"))
            return out.drop("_new", "_size")

        members = keep_members(relabel(members, "cluster"))
        shifted = relabel(relabel(links, "lo"), "hi").filter(F.col("lo") != F.col("hi"))
        swap = F.col("lo") > F.col("hi")
        flipped = shifted.select(
            F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi"), "distance", "n",
            F.when(swap, F.col("hi_size")).otherwise(F.col("lo_size")).alias("lo_size"),
            F.when(swap, F.col("lo_size")).otherwise(F.col("hi_size")).alias("hi_size"),
        )
        grouped = flipped.groupBy("lo", "hi", "lo_size", "hi_size").agg(F.max("distance").alias("distance"), F.sum("n").alias("n"))
        links = keep_links(grouped.filter(F.col("n") == F.col("lo_size") * F.col("hi_size")).select("lo", "hi", "distance", "n", "lo_size", "hi_size"))
    return members.select(id_col, "cluster")


def expand_members(members: DataFrame, copies: DataFrame, id_col: str) -> DataFrame:
    """Members of clusters found among representatives, with all their copies.

    ``copies``: id and representative, as ``collapse_copies`` gives them. Copies are at distance 0,
    so complete linkage would have put them together first.
    """
    named = members.select(F.col(id_col).alias("representative"), "cluster")
    return copies.join(named, "representative").select(id_col, "cluster")


def number_clusters(members: DataFrame, id_col: str, prefix: str = "FWC") -> DataFrame:
    """Cluster ids in the order of each cluster's smallest member."""
    return number_groups(members, "cluster", id_col, prefix, name="cluster_id")


def representatives(members: DataFrame, nodes: DataFrame, id_col: str, group: str, order: Sequence, pinned: Column | None = None,
                    metrics: DataFrame | Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Representative per cluster, cluster size, and each member's metrics to it.

    A pinned member wins over the quality order. ``metrics``: id_a, id_b and metric columns, or a function
    that gives them for pairs (id_a < id_b), so that only members and their representatives are compared.
    """
    pin = F.coalesce(pinned, F.lit(False)) if pinned is not None else F.lit(False)
    detailed = members.join(nodes, id_col).withColumn("_pin", pin)
    best = best_per_key(detailed, [group], [F.col("_pin").desc(), *order]).select(
        group, F.col(id_col).alias("representative"), F.when(F.col("_pin"), "pinned").otherwise("quality_order").alias("reason")
    )
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("cluster_size"))
    out = members.join(best, group).join(sizes, group).withColumn("is_representative", F.col(id_col) == F.col("representative"))
    if metrics is None:
        return out
    lo, hi = F.least(id_col, "representative"), F.greatest(id_col, "representative")
    keyed = out.withColumns({"id_a": lo, "id_b": hi})
    if callable(metrics):
        keyed = stage_table(keyed, "members")
        metrics = metrics(keyed.filter(~F.col("is_representative")).select("id_a", "id_b"))
    return keyed.join(metrics, ["id_a", "id_b"], "left").drop("id_a", "id_b")


def closure(edges: DataFrame, roots: DataFrame, parent: str, child: str, node: str = "node") -> DataFrame:
    """Every node reached from the roots, with its least depth; cycles end by themselves.

    A node with one parent is one deeper than it. Such runs are contracted by doubling pointers
    (``chain_roots``), so a chain or a tree of any depth takes rounds in the order of its logarithm.
    What is left are edges with lengths between roots and nodes of several parents; their depths are
    relaxed, and only nodes whose depth has fallen go into the next round.
    """
    start = cut(roots.select(F.col(node).alias("_node")).distinct())
    links = edges.select(F.col(parent).alias("_up"), F.col(child).alias("_node")).filter("_up IS NOT NULL AND _node IS NOT NULL AND _up != _node").distinct()
    links = cut(links.join(start, "_node", "left_anti"))
    one = links.groupBy("_node").agg(F.count(F.lit(1)).alias("_n"), F.min("_up").alias("_up"))
    ups = links.select(F.col("_up").alias("_node")).union(start).distinct().join(one.select("_node"), "_node", "left_anti")
    tops = ups.select("_node", F.lit(None).alias("_up"))
    held = one.select("_node", F.when(F.col("_n") == 1, F.col("_up")).alias("_up")).unionByName(tops)
    chains = cut(chain_roots(held, "_node", "_up").filter("root IS NOT NULL").select(F.col("node").alias("_node"), F.col("root").alias("_top"), "hops"))
    many = one.filter("_n > 1").select("_node")
    long = cut(links.join(many, "_node", "left_semi").join(chains.withColumnRenamed("_node", "_up"), "_up").groupBy("_top", "_node").agg((F.min("hops") + 1).alias("_length")))
    best = cut(start.withColumn("depth", F.lit(0).cast("long")))
    fallen = best
    while not fallen.isEmpty():
        offered = long.join(fallen.withColumnRenamed("_node", "_top"), "_top").groupBy("_node").agg(F.min(F.col("depth") + F.col("_length")).alias("_new"))
        fallen = cut(offered.join(best, "_node", "left").filter("depth IS NULL OR _new < depth").select("_node", F.col("_new").alias("depth")))
        best = cut(best.join(fallen.select("_node"), "_node", "left_anti").unionByName(fallen))
    reached = chains.join(best.withColumnRenamed("_node", "_top"), "_top")
    return reached.select(F.col("_node").alias(node), (F.col("depth") + F.col("hops")).cast("int").alias("depth"))


def chain_roots(links: DataFrame, node: str, parent: str) -> DataFrame:
    """Last ancestor and distance to it for nodes with at most one parent.

    Pointers are doubled each round, so a chain of n links takes log2(n) rounds. A node whose
    parent is unknown or missing is its own root; members of a cycle have a NULL root.
    """
    known = links.select(F.col(node).alias(parent))
    anchored = links.join(known.distinct().withColumn("_k", F.lit(True)), parent, "left")
    up = F.when(F.col("_k"), F.col(parent))
    state = cut(anchored.select(F.col(node).alias("node"), F.coalesce(up, F.col(node)).alias("ptr"), F.when(up.isNull(), 0).otherwise(1).cast("long").alias("hops")))
    total = state.count()
    reach = 1
    while True:
        jump = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("_next"), F.col("hops").alias("_more"))
        state = cut(state.join(jump, "ptr").select("node", F.col("_next").alias("ptr"), (F.col("hops") + F.col("_more")).alias("hops")))
        reach *= 2
        open_ends = state.join(state.filter("hops = 0").select(F.col("node").alias("ptr")), "ptr", "left_anti")
        if open_ends.isEmpty() or reach > 2 * total:
            break
    done = state.filter("hops = 0").select(F.col("node").alias("ptr"), F.lit(True).alias("_root"))
    return state.join(done, "ptr", "left").select(
        "node", F.when(F.col("_root"), F.col("ptr")).alias("root"), F.when(F.col("_root"), F.col("hops")).alias("hops")
    )
