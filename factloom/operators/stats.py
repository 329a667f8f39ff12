"""Counts per type, zero-filled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.model import live
from factloom.sources.graph import Graph


def _filled(counts: DataFrame, types: list[str]) -> DataFrame:
    spark = counts.sparkSession
    given = spark.range(1).select(F.explode(F.array(*map(F.lit, types))).alias("label"))
    return given.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def vertex_counts(graph: Graph, types: list[str]) -> DataFrame:
    """(label, n) of live vertices for every type of the schema, also those without any."""
    return _filled(live(graph.vertices).groupBy("label").agg(F.count(F.lit(1)).alias("n")), types)


def edge_counts(graph: Graph, types: list[str]) -> DataFrame:
    """(label, n) of edges for every type of the schema; edges to deleted vertices count."""
    return _filled(graph.edges.groupBy("label").agg(F.count(F.lit(1)).alias("n")), types)


def totals(graph: Graph, vertex_types: list[str], edge_types: list[str]) -> DataFrame:
    """(total_entities, total_relationships): sums of the counts shown."""
    a = vertex_counts(graph, vertex_types).select(F.col("n").alias("v"), F.lit(0).cast("long").alias("e"))
    b = edge_counts(graph, edge_types).select(F.lit(0).cast("long").alias("v"), F.col("n").alias("e"))
    return a.unionByName(b).agg(F.sum("v").alias("total_entities"), F.sum("e").alias("total_relationships"))
