"""Text expressions: trimming, length in UTF-16 units, match scores, diagram labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.ids import strip


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.length(c) + F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]", ""))


def match_score(name: Column, query: Column) -> Column:
    """1.0 equal, 0.8 name begins with query, 0.6 contains it, 0.4 is contained in it, else 0.0; without case, query trimmed."""
    n, q = F.lower(name), F.lower(strip(query))
    return F.when(n == q, 1.0).when(n.startswith(q), 0.8).when(n.contains(q), 0.6).when(q.contains(n), 0.4).otherwise(0.0)


def short_label(c: Column, most: int = 40) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def node_key(c: Column) -> Column:
    """An id as a diagram's node name."""
    return F.concat(F.lit("n_"), F.replace(c, F.lit("-"), F.lit("_")))
