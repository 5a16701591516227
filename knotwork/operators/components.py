"""Connected components of an undirected graph given as links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.session import cut, merged


def connected_components(links: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``links``; the component is its smallest node.

    Alternating large-star and small-star steps: each node's larger neighbours are tied to its smallest neighbour, then
    its smaller ones, until no link changes. The number of rounds is logarithmic in the longest path, and links to a hub
    are spread over its neighbours' keys, not gathered. Each round is cut into the checkpoint folder. Self links make a
    node of one component, NULL ends and repeated links are ignored; no links give an empty frame. Raises
    ``RuntimeError`` after ``max_rounds``.
    """
    # The links are computed once: what they come from may cost far more than the rounds.
    ends = links.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null")
    pairs = cut(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    edges = pairs.filter("a <> b")
    previous = None
    for _ in range(max_rounds):
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if previous is not None and tuple(mark) == previous:
            break
        previous = tuple(mark)
        # Large star: every larger neighbour goes to the smallest of the neighbourhood, the node included.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(merged(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: the smaller neighbours and the node itself go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(merged(least), "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = cut(small.select("e.a", "e.b").filter("a <> b").distinct())
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    found = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return nodes.join(merged(found), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
