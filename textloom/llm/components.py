"""Connected components of an edge table by repeated contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut


def _relabel(rows: DataFrame, key: str, parents: DataFrame) -> DataFrame:
    """rows with key replaced by its parent, if it has one. A key with many rows is split by Spark's skew join: rows are
    a few bytes and the join has one row a key on the other side."""
    out = rows.join(parents.withColumnRenamed("node", key), key, "left")
    return out.withColumn(key, F.coalesce("parent", key)).select(*rows.columns)


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node that it reaches, itself included) of every node of edges (a, b: long).

    Every round maps each node to its smallest neighbour or itself, relabels the edges and drops loops; a round at
    least halves the nodes that still have edges, so rounds grow with the logarithm of a component's size. Each round
    is written to the shared folder. No edges: an empty result.
    """
    both = edges.select("a", "b").where("a != b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    edges = cut(both.distinct(), "edges")
    found = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    while edges.take(1):
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = cut(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")).where("parent < node"), "parents")
        found = cut(_relabel(found, "component", parents), "components")
        edges = _relabel(_relabel(edges, "a", parents), "b", parents)
        edges = cut(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return found
