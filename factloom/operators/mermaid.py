"""Diagrams of small subgraphs in mermaid's text form."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import node_key, short_label

MAX_NODES, LABEL_LENGTH = 30, 40
#: Brackets around the labels of a type's nodes; types not named have those of a project.
SHAPES = {
    "Person": ("(", ")"),
    "Team": ("(", ")"),
    "Organization": ("(", ")"),
    "Project": ("[", "]"),
    "Repository": ("[", "]"),
    "Codebase": ("[", "]"),
    "Decision": ("{", "}"),
    "Meeting": ("[[", "]]"),
    "Event": ("[[", "]]"),
    "Fact": (">", "]"),
    "Concept": ("{{", "}}"),
    "Skill": ("{{", "}}"),
    "Technology": ("{{", "}}"),
}
#: Fixed value: characters that need a quoted label.
SPECIAL = '"[](){}|<>/\\#&;'
_special = re.compile("[" + re.escape(SPECIAL) + "]")


def label(text: str) -> str:
    """At most LABEL_LENGTH characters; quoted if it has a special one."""
    short = text if len(text) <= LABEL_LENGTH else text[: LABEL_LENGTH - 3] + "..."
    return '"' + short.replace('"', "#quot;") + '"' if _special.search(short) else short


def _label_column(c: Column) -> Column:
    short = short_label(c, LABEL_LENGTH)
    plain = F.translate(short, SPECIAL, "") == short
    return F.when(plain, short).otherwise(F.concat(F.lit('"'), F.replace(short, F.lit('"'), F.lit("#quot;")), F.lit('"')))


def render(entities: list[dict], relationships: list[dict], max_nodes: int = MAX_NODES) -> tuple[str, bool]:
    """(text, truncated): the first max_nodes entities (id, name, type), and relationships (from_id, type, to_id) between them."""
    if not entities:
        return "graph LR\n  empty[No entities found]", False
    key = lambda i: "n_" + i.replace("-", "_")
    shown = entities[:max_nodes]
    ids = {e["id"] for e in shown}
    nodes = [f"  {key(e['id'])}{SHAPES.get(e['type'], ('[', ']'))[0]}{label(e['name'])}{SHAPES.get(e['type'], ('[', ']'))[1]}" for e in shown]
    links = [f"  {key(r['from_id'])} -->|{label(r['type'])}| {key(r['to_id'])}" for r in relationships if r["from_id"] in ids and r["to_id"] in ids]
    cut = len(entities) > len(shown)
    return "\n".join(["graph LR", *nodes, *links, *([f"  %% Truncated: showing {len(shown)} of {len(entities)} nodes"] if cut else [])]), cut


def node_lines(vertices: DataFrame) -> DataFrame:
    """(id, line) of every vertex: the same lines as `render`, made by expressions."""
    text = _label_column(F.col("name"))
    left, right = F.lit("["), F.lit("]")
    for kind, (a, b) in SHAPES.items():
        left, right = F.when(F.col("label") == kind, a).otherwise(left), F.when(F.col("label") == kind, b).otherwise(right)
    return vertices.select("id", F.concat(F.lit("  "), node_key(F.col("id")), left, text, right).alias("line"))


def link_lines(edges: DataFrame) -> DataFrame:
    """(id, line) of every edge: the same lines as `render`, made by expressions."""
    return edges.select("id", F.concat(F.lit("  "), node_key(F.col("start_id")), F.lit(" -->|"), _label_column(F.col("label")), F.lit("| "), node_key(F.col("end_id"))).alias("line"))
