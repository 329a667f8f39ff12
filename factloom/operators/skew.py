"""Results per key where a few keys hold most records.

All results are algebraic: every task first folds its rows into a hash table of mergeable states (Spark's partial
aggregate, which turns to sorting and spilling when its memory is full), so a key reaches its final task as at most one row per
map task, whatever share of the rows it holds. Distinct counts are taken in two levels, the first keyed by key and neighbour,
so no set of neighbours is held in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.ids import canonical_id, pack_id, unpack_id


def key_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, key_id, n): stored rows per id in each field. Null and blank hold no id; ids agree without case and outer white space."""
    each = df.select(F.inline(F.array(*(F.struct(F.lit(f).alias("field"), canonical_id(F.col(f)).alias("key_id")) for f in fields))))
    return each.filter("key_id is not null").groupBy("field", "key_id").agg(F.count(F.lit(1)).alias("n"))


def heavy_keys(df: DataFrame, fields: list[str], share: float = 0.02) -> DataFrame:
    """(field, key_id) of the ids that hold at least `share` of all stored rows in a field; none of an empty table."""
    counts = key_counts(df, fields)
    return counts.filter(F.col("n") >= F.lit(share) * F.lit(df.count())).select("field", "key_id")


def degrees(df: DataFrame) -> DataFrame:
    """(vertex_id, direction, rel_type, n_links, n_neighbours) of relationships(id, from_id, to_id, rel_type, ...).

    Re-delivered rows of one id count once (of differing rows the smallest values). A link with one end missing counts
    at its other end, without a neighbour. Null types form a group of their own; rows without an id count singly.
    """
    ends = df.select(pack_id(F.col("id")).alias("id"), pack_id(F.col("from_id")).alias("f"), pack_id(F.col("to_id")).alias("t"), "rel_type")
    once = ends.filter("id is not null").groupBy("id").agg(F.min(F.struct("f", "t", "rel_type")).alias("r")).select("r.*").unionByName(ends.filter("id is null").drop("id"))
    side = lambda d, v, n: F.struct(F.lit(d).alias("direction"), F.col(v).alias("v"), F.col(n).alias("neighbour"))
    both = once.select("rel_type", F.inline(F.array(side("out", "f", "t"), side("in", "t", "f")))).filter("v is not null")
    pairs = both.groupBy("v", "direction", "rel_type", "neighbour").agg(F.count(F.lit(1)).alias("n"))
    out = pairs.groupBy("v", "direction", "rel_type").agg(F.sum("n").alias("n_links"), F.count("neighbour").alias("n_neighbours"))
    return out.select(unpack_id(F.col("v")).alias("vertex_id"), "direction", "rel_type", "n_links", "n_neighbours")
