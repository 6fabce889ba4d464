"""Connected components of a graph in DataFrames, by contracting it to local minima round by round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certus.plans.staging import staged


def _roots(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b): where steps to the smallest neighbour end. Jumps grow with the
    logarithm of the steps."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
    up = staged(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "labels")
    while True:
        above = up.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        found = staged(up.join(above, "label").select("node", F.col("beyond").alias("label"), (F.col("beyond") < F.col("label")).alias("moved")), "labels")
        up = found.select("node", "label")
        if not found.filter("moved").limit(1).count():
            return up


def _renamed(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The edges between the labels of their ends, each once; nodes without label are their own. Edges inside of a label go."""
    for end in "ab":
        edges = edges.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label")), end, "left")
    a, b = F.coalesce("a_label", "a"), F.coalesce("b_label", "b")
    return edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct()


def smallest_reachable(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b): the smallest node that it is connected with.

    labels: the result for earlier edges, which then count too without being read again; their nodes are in the result.

    In each round nodes take the name of the local minimum that they lead to, and only edges between different names go
    on. A name that is left by two rounds has taken in another one, so two rounds halve the nodes that have edges: rounds
    grow with the logarithm of their number, and later ones read what is left. Each round is written to the shared folder.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    own = nodes.select("node", F.col("node").alias("label"))
    if labels is None:
        between = edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    else:
        between, own = _renamed(edges, labels), labels.unionByName(own.join(labels, "node", "left_anti"))
    labels = staged(own, "labels")
    left, rounds = staged(between, "edges"), []
    while left.limit(1).count():
        rounds.append(_roots(left))
        left = staged(_renamed(left, rounds[-1]), "edges")
    # names of later rounds are fewer, so they are put in from the last round on
    names = None
    for found in [*rounds[::-1], labels]:
        if names is not None:
            later = names.select(F.col("node").alias("label"), F.col("label").alias("later"))
            found = staged(found.join(later, "label", "left").select("node", F.coalesce("later", "label").alias("label")), "labels")
        names = found
    return names
