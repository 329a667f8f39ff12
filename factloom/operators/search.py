"""Lookup, ranked search, resolution and listing of vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import match_score, utf16_length
from factloom.ids import strip
from factloom.model import RESOLVE_LIMIT, SEARCH_LIMIT, GraphError, live
from factloom.operators.contain import containment
from factloom.runtime import broadcast_if_small


#: So many queries at most are compared with every name.
FEW_QUERIES = 32


def _ordered(types: list[str] | None):
    """A type's place in the schema, which breaks ties; without a schema its name."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, types)), F.col("label")), F.lit(0)).cast("int") if types else F.col("label")


def check_type(type_: str, types: list[str]) -> str:
    if type_ not in types:
        raise GraphError(f'Invalid entity type: "{type_}". Valid types: {", ".join(types)}')
    return type_


def scan(vertices: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Live vertices of the given types; one scan, the types are a pushed filter."""
    return live(vertices.filter(F.col("label").isin(types)) if types else vertices)


def by_id(vertices: DataFrame, id_: str, types: list[str] | None = None) -> DataFrame:
    """The live vertex with this id, if any."""
    return scan(vertices, types).filter(F.col("id") == id_)


def by_name(vertices: DataFrame, name: str, types: list[str] | None = None, limit: int = 1) -> DataFrame:
    """Vertices whose name equals `name` without case, before those that contain it; ties by type, then id. `name` is not trimmed."""
    n, q = F.lower("name"), F.lower(F.lit(name))
    hits = scan(vertices, types).filter(n.contains(q)).withColumn("exact", n == q)
    return hits.orderBy(F.desc("exact"), _ordered(types), "id").limit(limit).drop("exact")


def search(vertices: DataFrame, query: str, types: list[str] | None = None, type_filter: str | None = None, exact: bool = False, limit: int = SEARCH_LIMIT) -> DataFrame:
    """(id, name, label, score, properties), best first; shorter names first among equals, then by type and id.

    A blank query finds nothing. A vertex without a name is not found; one with an empty name scores 0.4 for every query.
    `exact` keeps full matches only, before the limit.
    """
    rows = scan(vertices, [check_type(type_filter, types)] if type_filter and types else [type_filter] if type_filter else types)
    scored = rows.withColumn("score", match_score(F.col("name"), F.lit(query))).filter((F.col("score") == 1.0) if exact else (F.col("score") > 0))
    if not query.strip():
        scored = scored.filter(F.lit(False))
    top = scored.orderBy(F.desc("score"), utf16_length(F.col("name")), _ordered(types), "id").limit(limit)
    return top.select("id", "name", "label", "score", *(c for c in ("properties",) if c in vertices.columns))


def resolve_many(vertices: DataFrame, queries: list[str], types: list[str] | None = None) -> DataFrame:
    """(query, status, id, n_candidates) of each query string: resolved, ambiguous or not_found.

    One hit resolves at any score; of several, the first if it matches fully and the second does not. Up to FEW_QUERIES are looked
    for in one pass over the names, which leaves only hits; more meet the names by containment joins in both directions. Only the
    best RESOLVE_LIMIT hits of a query are kept per task before anything is shuffled.
    """
    spark = vertices.sparkSession
    given = spark.createDataFrame([(q,) for q in dict.fromkeys(queries)], "query string")
    asked = given.withColumn("low_query", F.lower(strip(F.col("query")))).filter("low_query != ''")
    rows = scan(vertices, types).select("id", "name", "label", F.lower("name").alias("low"))
    if len(queries) <= FEW_QUERIES:
        lows = F.array_distinct(F.transform(F.array(F.lit(""), *map(F.lit, queries)), lambda q: F.lower(strip(q))))
        hits = F.filter(lows, lambda q: (q != "") & (F.col("low").contains(q) | q.contains(F.col("low"))))
        met = rows.select("*", F.explode(hits).alias("low_query"))
    else:
        within = containment(asked.select("low_query"), rows.select("low")).select(F.col("needle").alias("low_query"), F.col("hay").alias("low"))
        around = containment(rows.select("low"), asked.select("low_query")).select(F.col("hay").alias("low_query"), F.col("needle").alias("low"))
        # an empty name is contained in every query
        met = rows.join(within.unionByName(around).unionByName(asked.select("low_query", F.lit("").alias("low"))).distinct(), "low")
    each = met.join(broadcast_if_small(asked, rows=len(queries)), "low_query")
    scored = each.withColumn("score", match_score(F.col("name"), F.col("query"))).filter(F.col("score") > 0)
    w = Window.partitionBy("query").orderBy(F.desc("score"), utf16_length(F.col("name")), _ordered(types), "id")
    top = scored.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= RESOLVE_LIMIT)
    found = top.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("rn") == 1, F.col("id"))).alias("first"), F.max(F.when(F.col("rn") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("rn") == 2, F.col("score"))).alias("s2"))
    sure = (F.col("n") == 1) | ((F.col("s1") == 1.0) & (F.col("s2") < 1.0))
    return given.join(found, "query", "left").select("query", F.when(F.col("n").isNull(), "not_found").when(sure, "resolved").otherwise("ambiguous").alias("status"), F.when(sure, F.col("first")).alias("id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_candidates"))


def listing(vertices: DataFrame, types: list[str] | None = None, type_filter: str | None = None, limit: int = 50) -> DataFrame:
    """(id, name, label, created_at) of live vertices in the order of a name list (Unicode collation), then by id."""
    rows = scan(vertices, [check_type(type_filter, types)] if type_filter and types else [type_filter] if type_filter else types)
    return rows.select("id", "name", "label", "created_at").orderBy(F.collate("name", "UNICODE"), "id").limit(limit)
