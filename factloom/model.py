"""Identifier rules, limits, record shapes and the errors of the engine."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Identifiers of labels, relationship types, graphs and property keys; internal keys begin with an underscore.
IDENTIFIER = r"^[A-Za-z][A-Za-z0-9_]{1,30}$"
INTERNAL_KEY = r"^_[A-Za-z][A-Za-z0-9_]{0,29}$"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
#: Keys that relationship properties may not use.
RESERVED_EDGE_KEYS = ("type", "from", "to", "id", "created_at", "updated_at")
#: Fixed values.
DEPTH_MOST = 10
EXPORT_PAGE = 200
SEARCH_LIMIT = 10
RESOLVE_LIMIT = 5
FACT_NAME_LENGTH = 100

VERTEX = "label string, id string, name string, properties map<string,string>, created_at timestamp_ntz, updated_at timestamp_ntz, confidence double, deleted boolean, deleted_at timestamp_ntz, seq long"
EDGE = "label string, id string, start_id string, end_id string, properties map<string,string>, created_at timestamp_ntz, updated_at timestamp_ntz, seq long"


class GraphError(ValueError):
    """An argument or a state that an operation refuses; the message is meant for the caller."""


def check_identifier(text: str, what: str) -> str:
    if not isinstance(text, str) or not re.match(IDENTIFIER, text) or text.endswith("\n"):
        raise GraphError(f'Invalid {what}: "{text}". Use 2 to 31 letters, digits or underscores, beginning with a letter.')
    return text


def check_property_key(key: str) -> str:
    if not isinstance(key, str) or key.endswith("\n") or not (re.match(IDENTIFIER, key) or re.match(INTERNAL_KEY, key)):
        raise GraphError(f'Invalid property key: "{key}"')
    return key


def check_edge_properties(properties: dict | None) -> dict:
    for k in properties or {}:
        if k in RESERVED_EDGE_KEYS:
            raise GraphError(f"'{k}' is a reserved relationship field")
        check_property_key(k)
    return dict(properties or {})


def check_depth(depth) -> int:
    if isinstance(depth, bool) or not isinstance(depth, (int, float)) or depth != depth or depth in (float("inf"), float("-inf")) or int(depth) != depth or not 1 <= depth <= DEPTH_MOST:
        raise GraphError(f"Invalid depth: {depth}. Must be an integer between 1 and {DEPTH_MOST}.")
    return int(depth)


def check_confidence(c) -> None:
    if c is not None and not 0 <= c <= 1:
        raise GraphError("Confidence must be between 0.0 and 1.0")


def _whole(c: Column, pattern: str) -> Column:
    """Whether a pattern matches to the very end; its $ alone would allow for a line break behind."""
    return c.rlike(pattern.removesuffix("$") + r"\z")


def is_identifier(c: Column) -> Column:
    return _whole(c, IDENTIFIER)


def is_property_key(c: Column) -> Column:
    return _whole(c, IDENTIFIER) | _whole(c, INTERNAL_KEY)


def is_uuid(c: Column) -> Column:
    return _whole(c, UUID)


def live(df):
    """Rows that are not soft-deleted."""
    return df.filter(~F.coalesce("deleted", F.lit(False)))
