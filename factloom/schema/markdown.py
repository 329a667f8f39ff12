"""A schema as a markdown file, and back to its type names."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.schema.presets import Preset

ENTITIES, LINKS = "## Entity Types", "## Relationship Types"


def render(p: Preset) -> str:
    intro = f"# Memory Schema\n\n> Preset: **{p.name}** — {p.description}\n>\n> Edit this file to see which types a graph should hold.\n\n{ENTITIES}\n"
    kinds = (f"\n### {t.name}\n\n- **Properties:** {', '.join(t.properties)}\n- **Extraction hint:** {t.extraction_hint}\n- **Examples:**\n" + "".join(f"  - {x}\n" for x in t.examples) for t in p.entity_types)
    return intro + "".join(kinds) + f"\n{LINKS}\n\n" + "".join(f"- `{r}`\n" for r in p.relationship_types)


def parse(text: str) -> tuple[list[str], list[str]]:
    """(entity type names, relationship type names): third-level headings and quoted list items below their second-level headings."""
    sections = re.split(r"(?m)^\s*(?=## )", text)
    body = lambda head: "\n".join(s for s in sections if s.split("\n", 1)[0].strip() == head)
    return [m.strip() for m in re.findall(r"(?m)^\s*### (.+)$", body(ENTITIES))], re.findall(r"(?m)^\s*- `(.+?)`", body(LINKS))


def write_file(path: str, p: Preset) -> None:
    Path(path).write_text(render(p), encoding="utf-8")


def read_file(path: str) -> tuple[list[str], list[str]] | None:
    return parse(Path(path).read_text(encoding="utf-8")) if Path(path).exists() else None


def reconcile(in_file: DataFrame, in_store: DataFrame) -> DataFrame:
    """(name, side): only_in_file, only_in_store or common, of two tables with a name column."""
    a, b = in_file.select("name").distinct().withColumn("f", F.lit(1)), in_store.select("name").distinct().withColumn("s", F.lit(1))
    return a.join(b, "name", "full").select("name", F.when(F.col("s").isNull(), "only_in_file").when(F.col("f").isNull(), "only_in_store").otherwise("common").alias("side"))
