"""Connected components of a graph given as edges, by contraction.

In each round every node points to the neighbour that comes first in a random
order (or to itself), and edges are rewritten to what their ends point to. A round
removes a constant share of the nodes in expectation, whatever the graph's shape, and
only minima are gathered per node, which partial aggregation bounds for hubs. Each
round's tables are written to the shared folder, so lineage stays short and a lost
executor costs one round at most. Rounds with many nodes are joined by shuffles, whatever size
Spark takes their files for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.tables import unsent_if_large
from gaugework.session import stored


def _rank(node: str, turn: int) -> Column:
    return F.struct(F.xxhash64(F.lit(turn), node).alias("rank"), F.col(node).alias("node"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b); equal roots mean connected."""
    edges = stored(edges.where("a <> b").select("a", "b").distinct(), "edges")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        turn = len(steps)
        nearest = both.groupBy(F.col("a").alias("node")).agg(F.min(_rank("b", turn)).alias("near"))
        best = F.least("near", _rank("node", turn))["node"].alias("to")
        to = unsent_if_large(stored(nearest.select("node", best), "pointers"))
        steps.append(to)
        moved = (
            edges.join(to.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
            .join(to.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
            .where("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
        )
        edges = stored(moved.distinct(), "edges")
    # From the last round back: where a node's pointer ends.
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = steps[-1].select("node", F.col("to").alias("root"))
    for to in reversed(steps[:-1]):
        later = roots.select(F.col("node").alias("to"), "root")
        roots = stored(to.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root")), "roots")
    return roots
