"""Traversal by frontiers: hops, edges on short paths, the live component, timelines.

The vertices on undirected paths of at most d edges are those at distance d or less, and the edges on such paths those with an
end at distance d - 1 or less, so no path is ever enumerated. While a frontier has at most LITERALS vertices, its ids are a filter
that Catalyst moves down to the scans of the edges, below unions and grouping, so that nothing else is read on, shuffled or
written. Beyond that the edges are written once and joined with each frontier, which is broadcast only if it is small. Rounds are
written to the shared folder and end as soon as a frontier is empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.model import check_depth, live
from factloom.runtime import Scratch, broadcast_if_small
from factloom.sources.graph import Graph


def seeds(spark, ids: list[str]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, ids))).alias("id"))


#: Frontiers of at most so many vertices become a filter.
LITERALS = 1_000


def literals(ids: DataFrame) -> list[str] | None:
    """The ids (id) if there are at most LITERALS of them."""
    rows = getattr(ids, "scratch_rows", None)
    if rows is not None and rows > LITERALS:
        return None
    got = [r[0] for r in ids.select("id").distinct().limit(LITERALS + 1).collect()]
    return got if len(got) <= LITERALS else None


def incident(graph: Graph, ids: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(id, other, edge): the edges at `ids`, from there; an edge between two of them from both."""
    few = literals(ids)
    edges = _typed(graph.edges if few is not None else graph.stored().edges, types)
    near = None if few is not None else broadcast_if_small(ids.select("id").distinct())

    def side(own: str, other: str) -> DataFrame:
        at = edges.select(F.col(own).alias("id"), F.col(other).alias("other"), F.col("id").alias("edge"))
        return at.filter(F.col("id").isin(few)) if near is None else at.join(near, "id")

    return side("start_id", "end_id").unionByName(side("end_id", "start_id"))


def at_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is among `ids`."""
    few = literals(ids)
    return rows.filter(F.col("id").isin(few)) if few is not None else rows.join(broadcast_if_small(ids.select("id").distinct()), "id", "left_semi")


def undirected(edges: DataFrame) -> DataFrame:
    """(id, other, edge): every edge from both of its ends."""
    ends = F.array(F.struct(F.col("start_id").alias("id"), F.col("end_id").alias("other")), F.struct(F.col("end_id").alias("id"), F.col("start_id").alias("other")))
    return edges.select(F.col("id").alias("edge"), F.inline(ends))


def bfs(around, start: DataFrame, depth: int | None, scratch: Scratch) -> DataFrame:
    """(id, dist) of everything within `depth` hops of `start`, or without a bound if depth is None. around(frontier): (id, other)."""
    levels, k = [scratch.write(start.select("id", F.lit(0).alias("dist")), "level0")], 0
    while depth is None or k < depth:
        k += 1
        seen = reduce(DataFrame.unionByName, levels).select("id")
        near = around(levels[-1]).select(F.col("other").alias("id")).distinct()
        new = near.join(broadcast_if_small(seen, rows=sum(x.scratch_rows for x in levels)), "id", "left_anti").select("id", F.lit(k).alias("dist"))
        new = scratch.write(new, f"level{k}")
        if not new.scratch_rows:
            break
        levels.append(new)
    near = reduce(DataFrame.unionByName, levels)
    near.scratch_rows = sum(x.scratch_rows for x in levels)
    return near


def _typed(edges: DataFrame, types: list[str] | None) -> DataFrame:
    return edges.filter(F.col("label").isin(types)) if types else edges


def hops(graph: Graph, ids: list[str], depth: int, types: list[str] | None = None) -> DataFrame:
    """(id, dist) of the vertices on undirected paths of at most `depth` edges, deleted ones included."""
    s = Scratch(graph.edges.sparkSession, "hops")
    return bfs(lambda frontier: incident(graph, frontier, types), seeds(graph.edges.sparkSession, ids), check_depth(depth), s)


def path_edges(graph: Graph, ids: list[str], depth: int, types: list[str] | None = None) -> DataFrame:
    """The edges on undirected paths of 1 to `depth` edges."""
    near = hops(graph, ids, check_depth(depth), types).filter(F.col("dist") < depth).select("id") if depth > 1 else seeds(graph.edges.sparkSession, ids)
    few = literals(near)
    if few is not None:
        return _typed(graph.edges, types).filter(F.col("start_id").isin(few) | F.col("end_id").isin(few))
    edges, near = _typed(graph.stored().edges, types), broadcast_if_small(near)
    a = edges.join(near.withColumnRenamed("id", "start_id"), "start_id", "left_semi")
    b = edges.join(near.withColumnRenamed("id", "end_id"), "end_id", "left_semi").join(near.withColumnRenamed("id", "start_id"), "start_id", "left_anti")
    return a.unionByName(b.select(*a.columns))


class Connections:
    """What can be reached from a vertex without passing through deleted ones, among the edges on paths of at most `depth`.

    entities: (id, label, name, dist, properties) without the anchor; relationships: the edges between reached vertices. dist is the
    distance over live vertices only, which may exceed depth: the bound holds for paths that deleted vertices take part in too.
    """

    def __init__(self, graph: Graph, anchor: str, depth: int, types: list[str] | None = None):
        spark = graph.edges.sparkSession
        s = Scratch(spark, "connections")
        on_paths = s.write(path_edges(graph, [anchor], depth, types), "path-edges")
        ends = on_paths.select(F.explode(F.array("start_id", "end_id")).alias("id")).unionByName(seeds(spark, [anchor])).distinct()
        ends = s.write(ends, "ends")
        alive = s.write(at_ids(live(graph.vertices), ends), "live-vertices")
        names = broadcast_if_small(alive.select("id"), rows=alive.scratch_rows)
        kept = on_paths.join(names.withColumnRenamed("id", "start_id"), "start_id", "left_semi").join(names.withColumnRenamed("id", "end_id"), "end_id", "left_semi")
        kept = s.write(kept, "live-edges")
        links = undirected(kept).select("id", "other")
        around = lambda last: links.join(broadcast_if_small(last.select("id"), rows=last.scratch_rows), "id")
        self.reached = s.write(bfs(around, seeds(spark, [anchor]), None, s), "reached")
        self.entities = alive.join(broadcast_if_small(self.reached), "id").filter(F.col("id") != anchor)
        own = broadcast_if_small(self.reached.select("id"), rows=self.reached.scratch_rows)
        self.relationships = kept.join(own.withColumnRenamed("id", "start_id"), "start_id", "left_semi").join(own.withColumnRenamed("id", "end_id"), "end_id", "left_semi")


    def envelope(self, limit: int) -> DataFrame:
        """(total_count, shown, truncated): how many entities were reached, and how many of them `limit` lets through."""
        n = F.count(F.lit(1))
        return self.entities.agg(n.alias("total_count"), F.least(n, F.lit(limit)).cast("long").alias("shown"), (n > limit).alias("truncated"))


def returns(graph: Graph, anchor: str, depth: int) -> bool:
    """Whether a trail of at most `depth` edges leads from the anchor back to it: a loop, a parallel pair or a cycle.

    Each vertex keeps the first two different first edges it is reached by; one of them differs from any edge back.
    """
    spark = graph.edges.sparkSession
    s = Scratch(spark, "returns")
    if not graph.edges.filter((F.col("start_id") == anchor) & (F.col("end_id") == anchor)).isEmpty():
        return True
    back = s.write(incident(graph, seeds(spark, [anchor])).filter(F.col("other") != anchor), "incident")
    known = frontier = s.write(back.select(F.col("other").alias("id"), F.col("edge").alias("first")).groupBy("id").agg(F.slice(F.array_sort(F.collect_set("first")), 1, 2).alias("firsts")), "firsts")
    for _ in range(1, depth):
        ends = back.select(F.col("other").alias("id"), F.col("edge").alias("last"))
        if not known.join(ends, "id").filter(F.exists("firsts", lambda f: f != F.col("last"))).isEmpty():
            return True
        spread = incident(graph, frontier).filter(F.col("other") != anchor).join(broadcast_if_small(frontier), "id").select(F.col("other").alias("id"), F.explode("firsts").alias("first"))
        near = spread.groupBy("id").agg(F.min("first").alias("a"), F.max("first").alias("b")).select("id", F.array_distinct(F.array("a", "b")).alias("more"))
        both = known.join(near, "id", "full").select("id", F.slice(F.array_distinct(F.concat(F.coalesce("firsts", F.array().cast("array<string>")), F.coalesce("more", F.array().cast("array<string>")))), 1, 2).alias("firsts"), F.coalesce(F.size("firsts"), F.lit(0)).alias("had"))
        both = s.write(both, "firsts")
        known, frontier = both.select("id", "firsts"), both.filter(F.size("firsts") > F.greatest("had", F.lit(0))).select("id", "firsts")
        if frontier.isEmpty():
            break
    return False


def timeline(graph: Graph, anchor: str, depth: int = 3, limit: int | None = 5) -> DataFrame:
    """(id, label, name, timestamp, properties) of live vertices with a creation time around the anchor, latest first, then by id.

    Walks through deleted vertices; the anchor itself takes part if a trail leads back to it.
    """
    near = hops(graph, [anchor], depth).select("id")
    if not returns(graph, anchor, depth):
        near = near.filter(F.col("id") != anchor)
    rows = at_ids(live(graph.vertices).filter("created_at is not null"), near)
    iso = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    stamped = rows.select("id", "label", "name", F.coalesce(F.col("properties")["date"], F.col("properties")["timestamp"], iso, F.lit("")).alias("timestamp"), "properties")
    ordered = stamped.orderBy(F.desc("timestamp"), "id")
    return ordered.limit(limit) if limit is not None else ordered
