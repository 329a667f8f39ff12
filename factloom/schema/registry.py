"""The types in force, and the guardrails that additions must pass."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.config import Guardrails
from factloom.functions.similarity import most_similar, similarity_column
from factloom.model import GraphError, check_identifier, is_identifier
from factloom.schema.presets import EntityType, Preset


def _percent(x: float) -> int:
    return math.floor(x * 100 + 0.5)


class Registry:
    def __init__(self, of: Preset, guardrails: Guardrails | None = None):
        self.preset, self.guardrails = of, guardrails or Guardrails()

    @property
    def types(self) -> list[str]:
        return [t.name for t in self.preset.entity_types]

    @property
    def links(self) -> list[str]:
        return list(self.preset.relationship_types)

    def get(self, name: str) -> EntityType | None:
        return next((t for t in self.preset.entity_types if t.name == name), None)

    def check_link(self, name: str) -> str:
        if name not in self.links:
            raise GraphError(f'Invalid relationship type: "{name}". Valid types: {", ".join(self.links)}')
        return name

    def check_addition(self, new: EntityType) -> None:
        """Raises for the first guardrail that refuses `new`."""
        g = self.guardrails
        check_identifier(new.name, "entity type name")
        if len(self.types) >= g.max_entity_types:
            raise GraphError(f'Maximum {g.max_entity_types} entity types reached. Cannot add "{new.name}".')
        if new.name in self.types:
            raise GraphError(f'Entity type "{new.name}" already exists.')
        near = most_similar(new.name, self.types)
        if near and near[1] >= g.similarity_threshold:
            raise GraphError(f'Type "{new.name}" is {_percent(near[1])}% similar to existing type "{near[0]}". Use the existing type or choose a more distinct name.')
        hints = [t.extraction_hint for t in self.preset.entity_types]
        near = most_similar(new.extraction_hint, hints)
        if near and near[1] >= g.similarity_threshold:
            raise GraphError(f'Extraction hint is {_percent(near[1])}% similar to existing type "{self.types[hints.index(near[0])]}". Consider using the existing type instead.')
        if len(new.examples) < g.min_examples_per_type:
            raise GraphError(f"At least {g.min_examples_per_type} examples required. Got {len(new.examples)}.")

    def add(self, new: EntityType) -> int:
        """Adds a type that passes; the number of types then."""
        self.check_addition(new)
        self.preset.entity_types.append(new)
        return len(self.types)

    def judge(self, candidates: DataFrame) -> DataFrame:
        """(name, verdict, nearest, percent) of distinct type names: invalid, exists, similar or ok, with the most similar type in force, of equal ones the first."""
        known = F.array(*map(F.lit, self.types))
        scored = F.transform(known, lambda t, k: F.struct(F.round(similarity_column(F.col("name"), t), 9).alias("s"), (-k).alias("k"), t.alias("t")))
        near = candidates.select("name").filter("name is not null").distinct().withColumn("best", F.array_max(scored))
        verdict = F.when(~is_identifier(F.col("name")), "invalid").when(F.col("name").isin(self.types), "exists").when(F.col("best.s") >= self.guardrails.similarity_threshold, "similar").otherwise("ok")
        return near.select("name", verdict.alias("verdict"), F.col("best.t").alias("nearest"), F.floor(F.col("best.s") * 100 + 0.5).cast("int").alias("percent"))
