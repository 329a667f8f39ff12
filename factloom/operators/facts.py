"""Versioned facts: facts of an entity, active facts, versions and chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.model import live
from factloom.sources.graph import Graph


def fact_links(graph: Graph) -> DataFrame:
    """(fact_id, entity_id) of facts that relate to a vertex."""
    facts = graph.vertices.filter(F.col("label") == "Fact").select(F.col("id").alias("start_id"))
    return graph.edges.filter(F.col("label") == "RELATES_TO").join(facts, "start_id", "left_semi").select(F.col("start_id").alias("fact_id"), F.col("end_id").alias("entity_id"))


def facts_with_state(graph: Graph) -> DataFrame:
    """Live facts with `superseded`, whether a later fact replaces them."""
    replaced = graph.edges.filter(F.col("label") == "SUPERSEDED_BY").select(F.col("start_id").alias("id")).distinct().withColumn("superseded", F.lit(True))
    facts = live(graph.vertices).filter(F.col("label") == "Fact")
    return facts.join(replaced, "id", "left").withColumn("superseded", F.coalesce("superseded", F.lit(False)))


def facts_of(graph: Graph, entity_id: str) -> DataFrame:
    """(id, name, created_at, superseded) of an entity's live facts, oldest first; replaced ones are marked, not hidden."""
    own = fact_links(graph).filter(F.col("entity_id") == entity_id).select(F.col("fact_id").alias("id")).distinct()
    return facts_with_state(graph).join(own, "id", "left_semi").select("id", "name", "created_at", "superseded").orderBy("created_at", "id")


def active_facts(graph: Graph) -> DataFrame:
    """(entity_id, id, name, created_at) of every entity's live facts that nothing replaces: those to be checked for contradictions."""
    active = facts_with_state(graph).filter("not superseded").select("id", "name", "created_at")
    return fact_links(graph).withColumnRenamed("fact_id", "id").join(active, "id").select("entity_id", "id", "name", "created_at")


def active_counts(graph: Graph) -> DataFrame:
    """(entity_id, n_active): entities with more than one active fact."""
    return active_facts(graph).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_active")).filter("n_active > 1")
