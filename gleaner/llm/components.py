"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import materialise


def connected(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of long ids → ``(node, component)`` for every linked node but the component's smallest id, which
    is ``component``.

    Each step points every neighbour to the smallest id seen, by a pre-aggregated minimum that is joined back, so a hub
    is never gathered in one task; rounds are written to the shared folder, and their number grows with the logarithm of
    a component's diameter.
    """
    edges = materialise(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("to"))
        .distinct()
    )
    state = _fingerprint(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("to").alias("node"), F.col("node").alias("to")))
        least = both.groupBy("node").agg(F.least(F.min("to"), F.first("node")).alias("least"))
        large = both.join(least, "node").where(F.col("to") > F.col("node"))
        large = large.select(F.col("to").alias("node"), F.col("least").alias("to")).distinct()
        least = large.groupBy("node").agg(F.min("to").alias("least"))
        small = large.join(least, "node")
        small = small.select(F.col("to").alias("node"), F.col("least").alias("to")).where("node <> to")
        small = small.unionByName(least.select("node", F.col("least").alias("to")))
        edges = materialise(small.distinct())
        before, state = state, _fingerprint(edges)
        if before == state:
            break
    return edges.select("node", F.col("to").alias("component"))


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "to")), F.bit_xor(F.xxhash64("to", "node"))).first())
