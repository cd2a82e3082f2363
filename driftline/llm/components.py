"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from driftline.llm.common import cut_lineage

#: Edges up to which parents (16 bytes each) are sent to all tasks rather than exchanged.
SENT_EDGES = 200_000
#: Beyond, nodes above this share of all edges are hot: at most 1 / HOT_SHARE of them, which are sent to all tasks.
HOT_SHARE = 1 / 2000


def connected_components(edges: DataFrame, max_rounds: int = 60, sent_edges: int = SENT_EDGES) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b), both long.

    root is the smallest node of the component. Loops and repeated edges are
    allowed; nodes without an edge to another node are absent. Each round writes
    its edges to the checkpoint folder, so a lost executor repeats one round only.
    Rows go to no driver: a round's count and checksum decide when it ends.

    An edge is held as (a, b), a > b; a node's parent is its smallest neighbour below
    it. A round hangs each edge's upper end on the parent of its lower end, then all
    that an upper end meets on the smallest of that. Ends can be hot (the middle of a
    star). With few edges all parents are broadcast, and a star is a window over that
    few rows at most; else parents and minima of the hot ends, of which there are few,
    are broadcast, so no task gets a hot end's rows.
    """
    cur, seen = _written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        if not seen[0]:
            break
        cur, now = _written(_small_star(_large_star(cur, seen[0], sent_edges), seen[0], sent_edges))
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _large_star(cur: DataFrame, n_edges: int, sent_edges: int) -> DataFrame:
    """Edges (a, b) with the parent of b in place of b where it has one; a's own edge to its parent stays."""
    parents = cur.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "b")
    top = F.coalesce("m", "b").alias("b")
    if n_edges <= sent_edges:
        return cur.join(F.broadcast(parents), "b", "left").select("a", top)
    hot = F.broadcast(cur.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > n_edges * HOT_SHARE).select("b"))
    marked = cur.join(hot.withColumn("hot", F.lit(True)), "b", "left")
    few = F.broadcast(parents.join(hot, "b"))
    swift = marked.where("hot").drop("hot").join(few, "b", "left").select("a", top)
    return swift.unionByName(marked.where("hot IS NULL").drop("hot").join(parents, "b", "left").select("a", top))


def _small_star(large: DataFrame, n_edges: int, sent_edges: int) -> DataFrame:
    """All nodes that a node meets below it, and the node itself, hung on the smallest of them."""
    if n_edges <= sent_edges:
        return _stars(large)
    hot = large.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("m")).where(F.col("n") > n_edges * HOT_SHARE).select("a", "m")
    marked = large.join(F.broadcast(hot), "a", "left")
    swift = marked.where("m IS NOT NULL AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = hot.select("a", F.col("m").alias("b"))
    return swift.unionByName(own).distinct().unionByName(_stars(marked.where("m IS NULL").select("a", "b")))


def _stars(edges: DataFrame) -> DataFrame:
    below = Window.partitionBy("a").orderBy("b")
    ranked = edges.select("a", "b", F.first("b").over(below).alias("m"), F.lag("b").over(below).alias("last"))
    fresh = ranked.where("last IS NULL OR last <> b")
    return fresh.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges from the checkpoint folder, with their number and checksum, taken while they are written."""
    seen = Observation()
    total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    written = cut_lineage(edges.observe(seen, F.count(F.lit(1)).alias("n"), total.alias("s")))
    return written, (seen.get["n"], seen.get["s"])
