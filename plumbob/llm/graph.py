"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbob.llm.common import stored, tally


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for each node of edges ``(a, b)``; the component is its smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): every
    node links its larger neighbours, then all its smaller ones, to the smallest
    it sees, until only stars remain. Minima are aggregated before they are
    shuffled, so a node that holds most edges needs no task of its own, and each
    round's edges, never more than the input's, are written to the shared
    folder. Rows with a null end are ignored; a loop makes its node a component.
    """
    pairs = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    stars = stored(
        pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    seen = None
    while (now := tuple(stars.agg(F.count(F.lit(1)), tally(F.col("u"), F.col("v"))).first())) != seen:
        seen = now
        stars = stored(_small_star(_large_star(stars)), "edges")
    joined = nodes.join(stars.select(F.col("u").alias("node"), "v"), "node", "left")
    return joined.select("node", F.coalesce("v", "node").alias("component"))


def _large_star(stars: DataFrame) -> DataFrame:
    both = stars.union(stars.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(stars: DataFrame) -> DataFrame:
    least = stars.groupBy("u").agg(F.min("v").alias("m"))
    own = least.select("u", F.col("m").alias("v"))
    others = stars.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.union(others).distinct()
