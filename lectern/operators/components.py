"""Connected components of a link table by alternating star contraction, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.tables import stored


def _stars(pairs: DataFrame, large: bool) -> DataFrame:
    """Hook each vertex's larger (or own and smaller) neighbours to the smallest of them."""
    if large:
        both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(vertex, component) for every vertex of ``links(a, b)``; the component is its smallest vertex.

    Each round costs two joins on keys that pre-aggregate to one row a vertex; the number of rounds grows with
    the logarithm of a component's diameter, and goes on to the fixed point.  Only a count and a checksum of each round
    reach the driver.  Rounds are written as tables: sizes estimated over checkpoints would be multiplied round by round.
    """
    pairs = stored(links.select("a", "b").where("a <> b").distinct(), "links")
    seen = None
    while True:
        pairs = stored(_stars(_stars(pairs, large=True), large=False), "links")
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0])
        if now == seen:
            break
        seen = now
    return pairs.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(
        pairs.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct()
    )


def spanning_forest(edges: DataFrame) -> DataFrame:
    """``edges(a, b, seen)`` of a minimum spanning forest: cut at any bound on ``seen``, it joins what all edges join.

    Every vertex, then every component, takes its least edge to another one; those are in the forest, what they join is
    contracted, and of edges between the same two components the least is left.  Each round halves the components at
    least.  Edges are ordered by (seen, a, b), so no round makes a circle.  Loops and repeated edges do no harm.
    """
    rows = edges.select("a", "b", "seen").where("a <> b").withColumns({"x": F.col("a"), "y": F.col("b")})
    left, forest = stored(rows, "forest-edges"), None
    while not left.isEmpty():
        edge = F.struct("seen", "a", "b").alias("edge")
        ends = left.select("x", edge, "y").unionByName(left.select(F.col("y").alias("x"), edge, F.col("x").alias("y")))
        taken = stored(ends.groupBy("x").agg(F.min(F.struct("edge", "y")).alias("m")).select("x", "m.edge", "m.y"), "forest-round")
        new = taken.select("edge.a", "edge.b", "edge.seen").distinct()
        forest = new if forest is None else forest.unionByName(new)
        names = components(taken.select(F.col("x").alias("a"), F.col("y").alias("b")))
        to = lambda old, name: names.select(F.col("vertex").alias(old), F.col("component").alias(name))  # noqa: B023, E731
        joined = left.join(to("x", "x2"), "x").join(to("y", "y2"), "y").where("x2 <> y2")
        pair = [F.least("x2", "y2").alias("x"), F.greatest("x2", "y2").alias("y")]
        left = stored(joined.groupBy(*pair).agg(F.min(edge).alias("e")).select("x", "y", "e.a", "e.b", "e.seen"), "forest-edges")
    return forest if forest is not None else edges.select("a", "b", "seen").limit(0)
