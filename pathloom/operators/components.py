"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pathloom.plans.durable import durable
from pathloom.plans.skew import spread_join

MAX_ROUNDS = 60
#: Edges in a file of a round at least, where there are so many.
FILE_EDGES = 50_000


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both(edges)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return spread_join(both.where("b > a"), least, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = spread_join(down, least, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _written(edges: DataFrame, most: int | None = None) -> tuple[DataFrame, dict]:
    """The edges, written, with how many they are and a hash of all, both taken while they are written. Where they are known to be
    ``most`` at most, they go to as many files as those fill: on a local file system each file that a task opens starts processes."""
    seen = Observation()
    if most is not None:
        edges = edges.coalesce(-(-most // FILE_EDGES) or 1)
    now = durable(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("a", "b") % 1000003).alias("s")))
    return now, {"n": 0, **seen.get}


def connected_components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``edges(a, b)`` of any ordered type, undirected, loops and repeats allowed → ``(node, component)``
    with the smallest node of each component. Nodes without an edge are not listed; nulls are ignored.

    Each round is written to the shared folder; the rounds grow with the logarithm of the component size.
    """
    nodes = _both(edges.where("a is not null and b is not null")).select(F.col("a").alias("node")).distinct()
    now, before = _written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        if not before["n"]:
            break
        now, after = _written(_small_star(_large_star(now)), before["n"])  # a round makes no more edges than it has read
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    label = now.groupBy("a").agg(F.min("b").alias("m"))
    return nodes.join(label, nodes["node"] == label["a"], "left").select("node", F.coalesce("m", "node").alias("component"))
