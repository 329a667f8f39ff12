"""Property bags: maps of JSON-encoded values. None of these depends on how the session treats duplicate map keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.model import RESERVED_EDGE_KEYS

_EMPTY = "map<string,string>"


def merged(old: Column, new: Column) -> Column:
    """Both bags; of keys in both the value of `new`. Null counts as empty."""
    a, b = F.coalesce(old, F.create_map().cast(_EMPTY)), F.coalesce(new, F.create_map().cast(_EMPTY))
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)


def without(bag: Column, *keys: str) -> Column:
    return F.map_filter(bag, lambda k, _: ~k.isin(*keys))


def without_own_id(bag: Column, id_: Column) -> Column:
    """A bag that repeats its record's id under "id", without it."""
    return F.map_filter(bag, lambda k, v: (k != "id") | (v != id_))


def flattened(bag: Column) -> Column:
    """Edge properties beside the edge's own fields: bookkeeping keys left out, keys that clash prefixed."""
    kept = without(bag, "id", "created_at", "updated_at")
    return F.transform_keys(kept, lambda k, _: F.when(k.isin(*[r for r in RESERVED_EDGE_KEYS if r in ("type", "from", "to")]), F.concat(F.lit("prop_"), k)).otherwise(k))


def from_json_text(c: Column) -> Column:
    return F.from_json(c, _EMPTY)


def as_text(bag: Column) -> Column:
    """key=value of each entry, in the order of the texts; null for null."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(bag), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
