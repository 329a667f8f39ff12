"""Graph values in their text form: JSON with a ::vertex, ::edge or ::path mark, or a scalar with a type mark."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARK = re.compile(r"::(vertex|edge|path)$")
_CAST = re.compile(r"::[a-zA-Z_][a-zA-Z0-9_]*$")


def _scalar(text: str):
    """JSON if it is JSON, else the text itself."""
    try:
        return json.loads(text)
    except ValueError:
        return text


def _plain(value):
    """Values whose text carries a type mark are read again without it."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return parse(value) if isinstance(value, str) and "::" in value else value


def _element(text: str, kind: str) -> dict:
    o = json.loads(text)
    out = {"type": kind, "id": str(o["id"]), "label": o.get("label", ""), "properties": _plain(o.get("properties") or {})}
    return out | ({"start_id": str(o["start_id"]), "end_id": str(o["end_id"])} if kind == "edge" else {})


def _path(text: str) -> dict:
    """Elements of a path in turn, found by where JSON objects end, so that marks inside strings do not count."""
    out, at, decoder = {"type": "path", "vertices": [], "edges": []}, 0, json.JSONDecoder()
    while (at := text.find("{", at)) >= 0:
        _, end = decoder.raw_decode(text, at)
        kind = "edge" if text.startswith("::edge", end) else "vertex"
        out["edges" if kind == "edge" else "vertices"].append(_element(text[at:end], kind))
        at = end
    return out


def parse(raw: str | None):
    """The value of a text: vertices, edges and paths as dicts, scalars, arrays and maps; text that is none of these stays text."""
    if raw is None:
        return None
    text = raw.strip()
    if mark := _MARK.search(text):
        body, kind = text[: mark.start()], mark[1]
        try:
            return _path(body) if kind == "path" else _element(body, kind)
        except (ValueError, KeyError):
            return text
    return _scalar(_CAST.sub("", text))


def parse_rows(rows: list[dict]) -> list[dict]:
    return [{k: parse(v) for k, v in r.items()} for r in rows]


def kind_column(c: Column) -> Column:
    """vertex, edge, path or scalar."""
    mark = F.regexp_extract(F.trim(c), r"::(vertex|edge|path)$", 1)
    return F.when(c.isNull(), None).when(mark == "", "scalar").otherwise(mark)


def body_column(c: Column) -> Column:
    """The text without its mark."""
    return F.regexp_replace(F.trim(c), r"::[a-zA-Z_][a-zA-Z0-9_]*$", "")


def vertex_columns(c: Column) -> list[Column]:
    """id, label and properties of vertex texts; null where the text is no vertex."""
    body = F.when(kind_column(c) == "vertex", body_column(c))
    fields = F.from_json(body, "id string, label string, properties map<string,string>")
    return [fields["id"].alias("id"), fields["label"].alias("label"), fields["properties"].alias("properties")]


def edge_columns(c: Column) -> list[Column]:
    """id, label, start_id, end_id and properties of edge texts; null where the text is no edge."""
    body = F.when(kind_column(c) == "edge", body_column(c))
    fields = F.from_json(body, "id string, label string, start_id string, end_id string, properties map<string,string>")
    return [fields[n].alias(n) for n in ("id", "label", "start_id", "end_id", "properties")]


def scalar_column(c: Column) -> Column:
    """The text of a scalar: without its type mark, a JSON string without its quotes; null where the text is no scalar."""
    body = F.when(kind_column(c) == "scalar", body_column(c))
    return F.when(body.startswith('"'), F.get_json_object(F.concat(F.lit('{"x":'), body, F.lit("}")), "$.x")).otherwise(body)
