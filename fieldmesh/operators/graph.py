"""Graphs of images and features: components, tracks, degrees, networks, spanning forests, strong cores."""

from __future__ import annotations

import atexit
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _folder(spark) -> str:
    """The folder named in spark.checkpoint.dir, which all executors share. Only a local session may go without (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        at = f"file://{tempfile.gettempdir()}/checkpoints"
    return at.rstrip("/")


#: Folders to delete when the driver ends: results that hang on them are read lazily until then.
_left: set[str] = set()


def until_exit(path: str) -> str:
    """path, deleted when the driver ends (unless it is gone by then)."""
    if not _left:
        atexit.register(_clear)
    _left.add(path)
    return path


def _clear() -> None:
    jvm = SparkContext._jvm
    for at in _left if jvm is not None else ():
        try:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
        except (Py4JError, OSError):  # the JVM went first; what is left there is the shared folder's owner's to clear
            return


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, survives lost executors. Deleted when the driver ends."""
    path = until_exit(f"{_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark, *frames: DataFrame) -> None:
    """Deletes what settled() wrote for these frames, once nothing will read it again."""
    for at in {x.rsplit("/", 1)[0] for f in frames for x in f.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Nodes that a task's union-find holds at once.
LOCAL_NODES = 500_000


def _local_stars(edges: DataFrame) -> DataFrame:
    """(u, v) of edges (a, b): what each task's own edges join becomes stars, every node with the least one; centres name themselves."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches):
        root: dict = {}

        def find(i):
            while (r := root.setdefault(i, i)) != i:
                root[i] = i = root[r]
            return i

        def stars():
            pairs = [(i, find(i)) for i in [*root]]
            root.clear()
            for i in range(0, len(pairs), 50_000):
                u, v = zip(*pairs[i : i + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(u, at), pa.array(v, at)], ["u", "v"])

        for batch in batches:
            at = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(a), find(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
            if len(root) > LOCAL_NODES:
                yield from stars()
        if root:
            yield from stars()

    return edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").mapInArrow(run, f"u {kind}, v {kind}")


def components(edges: DataFrame, nodes: DataFrame | None = None, write=settled) -> DataFrame:
    """node, root: the least node reachable over edges (a, b: both long or both string; edges with a null are left out).

    Each task first joins what its own edges join. If what is left is no more than a task holds (LOCAL_NODES), one joins it; else
    rounds of a large star (larger neighbours go to the least of the
    neighbourhood) and a small star (smaller ones do) then run until all edges are stars. Every step is written to the
    shared folder. Minima are aggregated and written before edges meet them, so both sides of that join are plain exchanges, and a
    node with very many edges can be split among tasks. Nodes of `nodes` without edges are their own roots. write() settles a
    step; steps that nothing reads again are deleted.
    """
    first = write(_local_stars(edges))
    now = first.where("u != v")
    few = now.count() <= LOCAL_NODES // 2
    if few:  # as few as one task's union-find holds
        now = write(_local_stars(now.toDF("a", "b").coalesce(1))).where("u != v")
    while not few:
        centres = now.select(F.col("v").alias("u")).distinct()
        deep = now.join(centres, "u", "left_semi").select("u").union(now.groupBy("u").count().where("count > 1").select("u"))
        if not deep.limit(1).count():
            break
        both = now.union(now.select("v", "u"))
        least = write(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        large = write(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        small_least = write(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(small_least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        before, now = now, write(small.where("u != v").distinct())
        dropped(edges.sparkSession, least, large, small_least, *([before] if before.inputFiles() != first.inputFiles() else []))
    every = first.select("u").union(nodes.select("node")) if nodes is not None else first.select("u")
    return every.distinct().join(now.distinct(), "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("root"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree, weight."""
    ends = edges.select(F.col("a").alias("node"), "n").union(edges.select(F.col("b").alias("node"), "n"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"), F.sum("n").alias("weight"))


def knn_network(edges: DataFrame, k: int) -> DataFrame:
    """Edges that either end ranks among its k strongest (ties by neighbour)."""
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other"), "n").union(edges.select(F.col("b"), F.col("a"), "n"))
    top = ends.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), "other"))).where(F.col("k") <= k)
    return top.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), "n").distinct()


def strong_core(edges: DataFrame, least: int) -> DataFrame:
    """Edges with at least so many matches, if they keep together all that the edges held together; else all edges."""
    strong = edges.where(F.col("n") >= least)
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    def parts(e: DataFrame) -> int:
        return components(e, nodes).select("root").distinct().count()

    return strong if parts(strong) == parts(edges) else edges


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Maximum spanning forest (Boruvka): every component takes its strongest edge out, ties by ends, until none is left.
    Edges (a, b, n) with a < b."""
    tree = None
    root = None
    while True:
        if root is None:
            live = edges.select("a", "b", "n", F.col("a").alias("ra"), F.col("b").alias("rb"))
        else:
            ra, rb = root.select(F.col("node").alias("a"), F.col("root").alias("ra")), root.select(F.col("node").alias("b"), F.col("root").alias("rb"))
            live = edges.join(ra, "a").join(rb, "b").where("ra != rb").select("a", "b", "n", "ra", "rb")
        ends = live.select(F.col("ra").alias("r"), "a", "b", "n").union(live.select(F.col("rb"), "a", "b", "n"))
        best = ends.withColumn("k", F.row_number().over(Window.partitionBy("r").orderBy(F.desc("n"), "a", "b"))).where("k = 1").select("a", "b", "n").distinct()
        best = settled(best)
        if not best.limit(1).count():
            return tree if tree is not None else best
        tree = best if tree is None else settled(tree.union(best).distinct())
        root = components(tree, edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct())


def weak_edges_pruned(edges: DataFrame, ratios: DataFrame, least: float) -> DataFrame:
    """Edges below the inlier ratio go; edges without one stay."""
    return edges.join(ratios, ["a", "b"], "left").where(F.col("ratio").isNull() | (F.col("ratio") >= least))


def tracks(matches: DataFrame) -> DataFrame:
    """track, image, feature: features joined by matches; a track loses images it holds twice, then goes if it has one left."""
    from fieldmesh.operators.filters import conflicting_tracks

    ends = matches.select(F.struct(F.col("image_a").alias("image"), F.col("feature_a").alias("feature")).alias("s"), F.struct(F.col("image_b").alias("image"), F.col("feature_b").alias("feature")).alias("t"))
    edges = ends.select(F.to_json("s").alias("a"), F.to_json("t").alias("b"))
    found = components(edges)
    key = F.from_json("node", "image long, feature long")
    return conflicting_tracks(found.select(F.col("root").alias("track"), key["image"].alias("image"), key["feature"].alias("feature")))
