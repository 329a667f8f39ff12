"""Graphs as two DataFrames, made from tables or read from a store."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.bags import from_json_text
from factloom.ids import canonical_id
from factloom.runtime import Scratch
from factloom.sources.tables import table


@dataclass
class Graph:
    """vertices(label, id, name, properties, created_at, deleted), edges(label, id, start_id, end_id, properties, created_at)."""

    vertices: DataFrame
    edges: DataFrame

    def stored(self, label: str = "graph") -> Graph:
        """The edges written once, for plans that read all of them in several rounds; later calls give the same."""
        if getattr(self, "_stored", None) is None:
            self._stored = Graph(self.vertices, Scratch(self.vertices.sparkSession, label).write(self.edges, "edges"))
            self._stored._stored = self._stored
        return self._stored

    def sql(self, text: str, args: dict | None = None) -> DataFrame:
        """An ad-hoc query over {vertices} and {edges}; values are passed as named parameters (:name), never as text."""
        return self.vertices.sparkSession.sql(text, args=args, vertices=self.vertices, edges=self.edges)


def _vertices(df: DataFrame, label: str, key: str, name, created=None, deleted=None, **properties: str) -> DataFrame:
    bag = [x for k, c in properties.items() for x in (F.lit(k), F.col(c).cast("string"))]
    return df.select(
        F.lit(label).alias("label"), F.concat(F.lit(label.lower() + ":"), F.col(key).cast("string")).alias("id"), (name if not isinstance(name, str) else F.col(name)).alias("name"),
        (F.create_map(*bag) if bag else F.create_map()).cast("map<string,string>").alias("properties"), (F.col(created) if created else F.lit(None)).cast("timestamp_ntz").alias("created_at"), (F.lit(False) if deleted is None else deleted).alias("deleted"),
    )


def _edges(df: DataFrame, label: str, start: tuple[str, str], end: tuple[str, str], created: str | None = None) -> DataFrame:
    ends = [F.concat(F.lit(kind + ":"), F.col(c).cast("string")) for kind, c in (start, end)]
    at = F.min(created) if created else F.min(F.lit(None).cast("timestamp_ntz"))
    once = df.select(ends[0].alias("start_id"), ends[1].alias("end_id"), *([created] if created else [])).groupBy("start_id", "end_id").agg(at.alias("created_at"))
    return once.select(F.lit(label).alias("label"), F.concat(F.lit(label + ":"), "start_id", F.lit(">"), "end_id").alias("id"), "start_id", "end_id", F.create_map().cast("map<string,string>").alias("properties"), "created_at")


def fact_vertices(spark: SparkSession, d: str) -> DataFrame:
    content = F.concat("event_type", F.lit(":"), F.col("value").cast("string"))
    return _vertices(table(spark, d, "events").withColumn("content", content), "Fact", "event_id", F.substring("content", 1, 100), "ts", None, user_id="user_id")


def star_graph(spark: SparkSession, d: str) -> Graph:
    """The star-schema tables as a graph: regions, nations, customers, suppliers, parts, orders and facts (events)."""
    t = lambda n: table(spark, d, n)
    vertices = [
        _vertices(t("region"), "Region", "r_regionkey", "r_name"),
        _vertices(t("nation"), "Nation", "n_nationkey", "n_name"),
        _vertices(t("customer"), "Customer", "c_custkey", "c_name", None, F.col("c_custkey") % 29 == 7, segment="c_mktsegment"),
        _vertices(t("supplier"), "Supplier", "s_suppkey", "s_name"),
        _vertices(t("part"), "Part", "p_partkey", "p_name", None, F.col("p_partkey") % 17 == 3, brand="p_brand", type="p_type"),
        _vertices(t("orders"), "Order", "o_orderkey", F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string")), "o_orderdate", F.col("o_orderstatus") == "P", priority="o_orderpriority"),
        fact_vertices(spark, d),
    ]
    chain = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    superseded = t("events").withColumn("next_id", F.lead("event_id").over(chain)).filter("next_id is not null")
    edges = [
        _edges(t("customer"), "LOCATED_IN", ("customer", "c_custkey"), ("nation", "c_nationkey")),
        _edges(t("supplier"), "LOCATED_IN", ("supplier", "s_suppkey"), ("nation", "s_nationkey")),
        _edges(t("nation"), "PART_OF", ("nation", "n_nationkey"), ("region", "n_regionkey")),
        _edges(t("orders"), "PLACED", ("customer", "o_custkey"), ("order", "o_orderkey"), "o_orderdate"),
        _edges(t("lineitem"), "CONTAINS", ("order", "l_orderkey"), ("part", "l_partkey"), "l_shipdate"),
        _edges(t("lineitem"), "SUPPLIES", ("supplier", "l_suppkey"), ("part", "l_partkey")),
        _edges(t("events"), "RELATES_TO", ("fact", "event_id"), ("customer", "user_id"), "ts"),
        _edges(superseded, "SUPERSEDED_BY", ("fact", "event_id"), ("fact", "next_id")),
    ]
    return Graph(reduce(DataFrame.unionByName, vertices), reduce(DataFrame.unionByName, edges))


def current_vertices(rows: DataFrame) -> DataFrame:
    """The last delivered version of each id; it counts as deleted if any version says so. Rows without an id are left out."""
    own = rows.withColumn("vid", canonical_id(F.col("id"))).filter("vid is not null")
    last = F.max(F.struct("ingested_at", "name", "entity_type", "properties", "confidence", "created_at", "updated_at", "graph_name"))
    g = own.groupBy("vid").agg(last.alias("r"), F.max("deleted_at").alias("deleted_at"))
    return g.select(F.col("r.entity_type").alias("label"), F.col("vid").alias("id"), F.col("r.name").alias("name"), from_json_text(F.col("r.properties")).alias("properties"), F.col("r.created_at").alias("created_at"), F.col("r.updated_at").alias("updated_at"), F.col("r.confidence").alias("confidence"), F.col("deleted_at").isNotNull().alias("deleted"), F.col("r.graph_name").alias("graph_name"))


def current_edges(rows: DataFrame) -> DataFrame:
    """The last delivered version of each relationship that has two ends."""
    own = rows.withColumn("eid", canonical_id(F.col("id"))).filter("eid is not null")
    g = own.groupBy("eid").agg(F.max(F.struct("ingested_at", "from_id", "to_id", "rel_type", "properties", "created_at")).alias("r"))
    ends = g.select(F.col("r.rel_type").alias("label"), F.col("eid").alias("id"), canonical_id(F.col("r.from_id")).alias("start_id"), canonical_id(F.col("r.to_id")).alias("end_id"), from_json_text(F.col("r.properties")).alias("properties"), F.col("r.created_at").alias("created_at"))
    return ends.filter("start_id is not null and end_id is not null")


def facts_graph(spark: SparkSession, d: str) -> Graph:
    """The delivered facts as vertices, with their RELATES_TO and SUPERSEDED_BY edges. Of a fact's rows the last counts, of its links any that is filled."""
    rows = table(spark, d, "facts").withColumn("fid", canonical_id(F.col("id"))).filter("fid is not null")
    last = F.max(F.struct("ingested_at", "content", "source", "confidence", "stated_at", canonical_id(F.col("entity_id")).alias("entity_id")))
    one = rows.groupBy("fid").agg(last.alias("r"), F.max(canonical_id(F.col("superseded_by"))).alias("later"))
    quoted = lambda c: F.substr(F.to_json(F.struct(c.alias("x"))), F.lit(6), F.length(F.to_json(F.struct(c.alias("x")))) - 6)
    bag = F.map_filter(F.create_map(F.lit("content"), F.when(F.col("r.content").isNotNull(), quoted(F.col("r.content"))), F.lit("source"), F.when(F.col("r.source").isNotNull(), quoted(F.col("r.source")))), lambda _, v: v.isNotNull())
    vertices = one.select(
        F.lit("Fact").alias("label"), F.col("fid").alias("id"), F.substring("r.content", 1, 100).alias("name"), bag.alias("properties"),
        F.col("r.stated_at").alias("created_at"), F.col("r.confidence").alias("confidence"), F.lit(False).alias("deleted"),
    )
    none = F.create_map().cast("map<string,string>")
    edge = lambda label, end: one.filter(F.col(end).isNotNull()).select(F.lit(label).alias("label"), F.concat_ws(":", F.lit(label), "fid").alias("id"), F.col("fid").alias("start_id"), F.col(end).alias("end_id"), none.alias("properties"), F.col("r.stated_at").alias("created_at"))
    return Graph(vertices, edge("RELATES_TO", "r.entity_id").unionByName(edge("SUPERSEDED_BY", "later")))


def memory_graph(spark: SparkSession, d: str) -> Graph:
    """The delivered entity and relationship tables as they stand."""
    entities = table(spark, d, "entities").unionByName(table(spark, d, "core_entities"))
    return Graph(current_vertices(entities), current_edges(table(spark, d, "relationships")))
