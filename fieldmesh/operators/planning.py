"""Blocks, groups, orders and plans over small graphs of images and tasks."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmesh.operators.graph import components, settled


def balanced_blocks(edges: DataFrame, target: int) -> DataFrame:
    """node, root, block: each component in ceil(n / target) blocks; a block grows by the node most strongly tied to it, ties by
    weighted degree, then id. Greedy, so a component of images is one group; heaps find the next node, so time grows with the edges
    (times their logarithm), not with the square of the nodes."""
    found = components(edges.select("a", "b"))
    # a sorted join on either side's nodes: components may be as many as the edges
    rows = edges.join(found.withColumnRenamed("node", "a").hint("merge"), "a").select("root", "a", "b", "n")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, dict[int, float]] = defaultdict(dict)
        for a, b, n in zip(pdf["a"].tolist(), pdf["b"].tolist(), pdf["n"].tolist()):
            near[a][b] = near[a].get(b, 0) + n
            near[b][a] = near[b].get(a, 0) + n
        degree = {v: sum(x.values()) for v, x in near.items()}
        # where nothing is tied, the node with the highest degree that is left
        fresh = iter(sorted(near, key=lambda v: (-degree[v], v)))
        left, out = set(near), []
        blocks = -(-len(near) // target)
        size = -(-len(near) // blocks)
        for k in range(blocks):
            block: list[int] = []
            pull: dict[int, float] = defaultdict(float)
            heap: list[tuple] = []
            while left and len(block) < size:
                # a tie that grew since was pushed again; what was taken or has another pull by now is passed over
                while heap and (heap[0][2] not in left or -heap[0][0] != pull[heap[0][2]]):
                    heappop(heap)
                pick = heappop(heap)[2] if heap else next(v for v in fresh if v in left)
                block.append(pick)
                left.discard(pick)
                for v, n in near[pick].items():
                    if v in left:
                        pull[v] += n
                        heappush(heap, (-pull[v], -degree[v], v))
            out += [(v, k) for v in sorted(block)]
        return pd.DataFrame(out, columns=["node", "block"]).assign(root=pdf["root"].iloc[0])[["node", "root", "block"]]

    return rows.groupBy("root").applyInPandas(grow, "node long, root long, block long")


def block_overlap(blocks: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """root, block, nodes: each block's nodes and its most strongly tied outside ones."""
    from pyspark.sql.window import Window

    blocks = settled(blocks)  # three times met below, and grown once
    both = edges.select("a", "b", "n").union(edges.select("b", "a", "n")).toDF("node", "other", "n")
    inside = both.join(blocks.hint("merge"), "node").select("root", "block", "other", "n")
    outer = inside.join(blocks.select(F.col("node").alias("other"), F.col("block").alias("own")).hint("merge"), "other").where("own != block").groupBy("root", "block", "other").agg(F.sum("n").alias("n"))
    top = outer.withColumn("k", F.row_number().over(Window.partitionBy("root", "block").orderBy(F.desc("n"), "other"))).where(F.col("k") <= most)
    everything = blocks.select("root", "block", "node").union(top.select("root", "block", F.col("other").alias("node")))
    return everything.groupBy("root", "block").agg(F.array_sort(F.collect_set("node")).alias("nodes"))


def admissible(tasks: DataFrame, needs: DataFrame) -> DataFrame:
    """task, depth: the longest chain of needs below each task; tasks on or behind a cycle or with an unknown need are left out.
    Rounds take tasks the last of whose needs were placed in the round before, and drop those needs; what a round placed is written."""
    from fieldmesh.operators.graph import settled

    left = needs.select("task", "need").distinct()
    ready, depth, placed = settled(tasks.select("task").distinct().join(left, "task", "left_anti")), 0, []
    while not placed or ready.limit(1).count():
        placed.append(ready.withColumn("depth", F.lit(depth)))
        done = ready.select(F.col("task").alias("need"))
        freed = left.join(done, "need", "left_semi").select("task").distinct()
        left = settled(left.join(done, "need", "left_anti"))
        ready = settled(freed.join(left.select("task").distinct(), "task", "left_anti").join(tasks.select("task").distinct(), "task", "left_semi"))
        depth += 1
    return reduce(DataFrame.unionByName, placed)


def stationary_tracks(obs: DataFrame, factor: float = 4.0, units: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Tracks whose observations (x, y, scale) all stay within factor times their mean scale of one another. A unit of x and of y is so
    many of scale's; extents, not places, are turned into them, as a place that is rounded first puts tracks over the limit."""
    b = obs.groupBy("track").agg(F.max("x").alias("x1"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.min("y").alias("y0"), F.avg("scale").alias("s"), F.count("*").alias("n"))
    return b.where((F.col("n") >= 2) & (F.greatest((F.col("x1") - F.col("x0")) * units[0], (F.col("y1") - F.col("y0")) * units[1]) <= factor * F.col("s"))).select("track")


def source_scores(obs: DataFrame, angles: DataFrame) -> DataFrame:
    """ref, src, common, angle: shared points of two views and the upper median of the angles under which they see them (ref, src, angle)."""
    from fieldmesh.functions.order_stats import order_statistics, upper_median
    from fieldmesh.operators.joins import both_ways, shared_tracks

    common = both_ways(shared_tracks(obs)).toDF("ref", "src", "common")
    return common.join(order_statistics(angles, ["ref", "src"], "angle", {"angle": upper_median}).drop("n"), ["ref", "src"], "left")


def scene_shape(cameras: DataFrame) -> DataFrame:
    """One row about camera places (x, y): spread along and across, largest gap in azimuth around the middle (degrees)."""
    from pyspark.sql.window import Window

    m = cameras.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("vxy"))
    root = F.sqrt(((F.col("vx") - F.col("vy")) / 2) ** 2 + F.col("vxy") ** 2)
    mid = (F.col("vx") + F.col("vy")) / 2
    turn = cameras.join(F.broadcast(m), F.lit(True)).select(F.degrees(F.atan2(F.col("y") - F.col("my"), F.col("x") - F.col("mx"))).alias("t"))
    # whole degrees bound what is ordered
    held = turn.select(F.floor("t").alias("t")).distinct()
    order = Window.partitionBy(F.lit(1)).orderBy("t")
    gaps = held.select(F.coalesce(F.lead("t").over(order), F.first("t").over(order) + 360).alias("u"), "t").agg(F.max(F.col("u") - F.col("t")).alias("gap"))
    return m.select((mid + root).alias("along"), (mid - root).alias("across")).join(F.broadcast(gaps), F.lit(True))
