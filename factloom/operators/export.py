"""Export of whole graphs as JSON lines, and by pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.model import EXPORT_PAGE, GraphError, live
from factloom.operators.facts import fact_links
from factloom.sources.graph import Graph

#: Fixed values, in the order of an export.
SECTIONS = ("entities", "relationships", "facts")


def entities(graph: Graph, types: list[str] | None = None) -> DataFrame:
    """(id, label, name, properties, created_at) of live vertices that are no facts."""
    rows = live(graph.vertices).filter(F.col("label") != "Fact")
    return (rows.filter(F.col("label").isin(types)) if types else rows).select("id", "label", "name", "properties", "created_at")


def relationships(graph: Graph, types: list[str] | None = None) -> DataFrame:
    """(id, label, from_id, from_name, to_id, to_name, properties) of edges with both ends stored, deleted ones included."""
    names = graph.vertices.select("id", "name")
    edges = graph.edges.filter(F.col("label").isin(types)) if types else graph.edges
    a, b = (names.select(F.col("id").alias(k), F.col("name").alias(n)) for k, n in (("start_id", "from_name"), ("end_id", "to_name")))
    return edges.join(a, "start_id").join(b, "end_id").select("id", "label", F.col("start_id").alias("from_id"), "from_name", F.col("end_id").alias("to_id"), "to_name", "properties")


def facts(graph: Graph) -> DataFrame:
    """(id, name, created_at, entity_id, superseded_by) of all facts, deleted and replaced ones included; of several links the smallest."""
    links = fact_links(graph).groupBy("fact_id").agg(F.min("entity_id").alias("entity_id")).withColumnRenamed("fact_id", "id")
    by = graph.edges.filter(F.col("label") == "SUPERSEDED_BY").groupBy(F.col("start_id").alias("id")).agg(F.min("end_id").alias("superseded_by"))
    return graph.vertices.filter(F.col("label") == "Fact").select("id", "name", "created_at").join(links, "id", "left").join(by, "id", "left")


def page(rows: DataFrame, cursor: str | None = None, size: int = EXPORT_PAGE) -> tuple[DataFrame, str | None]:
    """Rows after `cursor` in the order of ids, and the next cursor, which is null once a page isn't full."""
    part = (rows.filter(F.col("id") > cursor) if cursor is not None else rows).orderBy("id").limit(size)
    last = part.agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("id")).first()
    return part, last["id"] if last["n"] == size else None


def lines(graph: Graph, sections: list[str] | None = None) -> DataFrame:
    """(section_order, id, line): one JSON line a record. Written as text this is the whole export, without pages."""
    wanted = SECTIONS if sections is None else sections
    for s in wanted:
        if s not in SECTIONS:
            raise GraphError(f'Invalid section: "{s}". Valid: {", ".join(SECTIONS)}')
    make = {"entities": entities, "relationships": relationships, "facts": facts}
    parts = [make[s](graph).select(F.lit(k).alias("section_order"), "id", F.to_json(F.struct(F.lit(s).alias("section"), F.struct("*").alias("data"))).alias("line")) for k, s in enumerate(SECTIONS) if s in wanted]
    return reduce(DataFrame.unionByName, parts) if parts else graph.vertices.sparkSession.createDataFrame([], "section_order int, id string, line string")


def write_lines(graph: Graph, path: str, sections: list[str] | None = None) -> None:
    """The export as text files under `path`, globally ordered by section and id."""
    lines(graph, sections).orderBy("section_order", "id").select("line").write.mode("error").text(path)
