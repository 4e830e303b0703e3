"""Connected components by alternating large and small stars, in tables of edges.

Every round writes its edges to the shared folder, so lineage stays short and lost
executors cost one round. Minima are written before they are joined: both sides of a join
are then plain tables, which Spark broadcasts if they are small and splits if a vertex has
very many edges. The tables have as many files as their number of edges asks for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.session import materialize

EDGES_PER_TASK = 200_000


def _are_stars(edges: DataFrame, tasks: int) -> bool:
    """Whether every vertex is tied to one centre and no centre is tied to another."""
    centres = edges.select(F.col("v").alias("u")).distinct()
    ties = edges.select("u").unionByName(centres).groupBy("u").count().where("count > 1")
    return ties.coalesce(tasks).isEmpty()


def _star(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    """Tie the neighbours of each vertex to the least of them: the larger ones, or the smaller ones and itself.

    ``edges`` have u > v. Each result is a set of edges with u > v again.
    """
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    least = materialize(around.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks), "least")
    tied = around.join(least.withColumnRenamed("u", "at"), F.col("u") == F.col("at"))
    m = F.least("m", "u")
    if large:
        out = tied.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), m.alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), m.alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return materialize(out.where(F.col("u") > F.col("v")).distinct().coalesce(tasks), "star")


def _begin(edges: DataFrame) -> tuple[DataFrame, int]:
    edges = materialize(edges.where("a != b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    return edges, 1 + edges.count() // EDGES_PER_TASK


def _labels(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``) for every vertex of the undirected edges (a, b); the root is the component's least vertex."""
    edges, tasks = _begin(edges)
    while not _are_stars(edges, tasks):
        edges = _star(_star(edges, True, tasks), False, tasks)
    return materialize(_labels(edges).coalesce(tasks), "components")


def partial_components(edges: DataFrame) -> DataFrame:
    """The same after one round: vertices of one root are connected, but not all that are connected have one root."""
    edges, tasks = _begin(edges)
    return materialize(_labels(_star(_star(edges, True, tasks), False, tasks)).coalesce(tasks), "components")
