"""Connected components of a graph given as edges, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.store import discard, spread_join, table


def _least(e: DataFrame) -> DataFrame:
    """(a, m): the least neighbour of each a; tasks hand on one row a key."""
    return e.groupBy("a").agg(F.min("b").alias("m"))


def _print(e: DataFrame) -> tuple:
    """What tells two sets of edges apart, in one pass: their number and two sums of hashes."""
    h = F.xxhash64("a", "b")
    return tuple(e.agg(F.count("*"), F.sum(F.shiftright(h, 20)), F.bit_xor(h)).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of the component. edges: (a, b); loops are ignored.

    Large-star and small-star rounds: every node hands its larger neighbours, then its smaller ones,
    to the least of them, until nothing changes. The number of rounds grows with the logarithm of a
    component's diameter. Each round is written to the shared folder and frees the one before. A
    node's neighbours are never listed, only their least one is computed, and the edges of a node
    meet it dealt over many tasks, so the root of a large component is no hot key.
    """
    e = table(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _print(e)
    while mark[0]:
        # large star: the larger neighbours of u go to the least of u and its neighbours
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = spread_join(both, _least(both), ["a"], F.xxhash64("b")).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = table(large.distinct(), "large-star")
        # small star: the smaller neighbours of u, and u, go to the least of them
        small = spread_join(large, _least(large), ["a"], F.xxhash64("b"))
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(_least(large).select("a", F.col("m").alias("b")))
        new = table(small.distinct(), "small-star")
        discard(e, large)
        e, before = new, mark
        mark = _print(e)
        if mark == before:
            break
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(e.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root")))
