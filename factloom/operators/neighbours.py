"""Direct relationships of a vertex."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.bags import flattened
from factloom.model import live
from factloom.sources.graph import Graph


def relationships(graph: Graph, id_: str, direction: str = "both", type_filter: str | None = None, limit: int | None = 50) -> DataFrame:
    """(direction, label, id, start_id, end_id, other_name, properties): edges whose other end is live, by type and id.

    The limit counts for either direction by itself; a loop appears in both.
    """
    names = live(graph.vertices).select(F.col("id").alias("other"), F.col("name").alias("other_name"))
    edges = graph.edges.filter(F.col("label") == type_filter) if type_filter else graph.edges

    def side(name: str, own: str, other: str) -> DataFrame:
        # the anchor's edges are filtered in the scan, before the join
        hits = edges.filter(F.col(own) == id_).withColumn("other", F.col(other)).join(names, "other")
        hits = hits.select(F.lit(name).alias("direction"), "label", "id", "start_id", "end_id", "other_name", "properties")
        return hits.orderBy("label", "id").limit(limit) if limit is not None else hits

    sides = {"out": ("start_id", "end_id"), "in": ("end_id", "start_id")}
    wanted = [direction] if direction != "both" else ["out", "in"]
    out = [side(d, *sides[d]) for d in wanted]
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def with_names(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, label, from_name, to_name, properties) for reading: names instead of ids, the id where a name is missing."""
    names = vertices.select("id", "name")
    a = names.select(F.col("id").alias("start_id"), F.col("name").alias("a"))
    b = names.select(F.col("id").alias("end_id"), F.col("name").alias("b"))
    both = edges.join(a, "start_id", "left").join(b, "end_id", "left")
    return both.select("id", "label", F.coalesce("a", "start_id").alias("from_name"), F.coalesce("b", "end_id").alias("to_name"), flattened(F.col("properties")).alias("properties"))
