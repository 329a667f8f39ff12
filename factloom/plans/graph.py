"""Queries of the graph operators over the star-schema graph and the delivered memory tables, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions.bags import as_text
from factloom.operators import export, facts, neighbours, search, stats, traverse
from factloom.sources.graph import current_edges, facts_graph, memory_graph, star_graph
from factloom.sources.tables import table

TYPES = ["Region", "Nation", "Customer", "Supplier", "Part", "Order", "Fact", "Meeting"]
LINKS = ["LOCATED_IN", "PART_OF", "PLACED", "CONTAINS", "SUPPLIES", "RELATES_TO", "SUPERSEDED_BY", "FIXES"]
MEMORY_TYPES = ["Person", "Company", "Team", "Project", "Decision", "Meeting", "Repository", "Bug", "Pattern", "Topic", "Fact"]
MEMORY_LINKS = ["WORKS_AT", "REPORTS_TO", "COLLABORATES_WITH", "DECIDED", "ADVOCATED_FOR", "ATTENDED", "OWNS", "CONTRIBUTES_TO", "DEPENDS_ON", "CAUSED_BY", "RELATES_TO", "FIXES", "SUPERSEDED_BY"]
RESOLVE = ["FRANCE", "united", "Customer#000000007", "part", "supplier#000000001", "asia", "no such thing", "  germany ", "region asia minor", "e"]
ANCHOR, ORDER = "customer:0", "order:1"


def _memory(spark, d):
    return memory_graph(spark, d).stored("memory")


def _context(spark, d):
    g = star_graph(spark, d)
    c = traverse.Connections(g, ORDER, 2)
    ents = c.entities.select(F.lit("entity").alias("section"), "id", F.col("name").alias("text"))
    rels = c.relationships.select(F.lit("relationship").alias("section"), "id", F.col("label").alias("text"))
    known = facts.facts_of(g, ANCHOR).select(F.lit("fact").alias("section"), "id", "name").withColumnRenamed("name", "text")
    return ents.unionByName(rels).unionByName(known)


def _lines(lines):
    """What each line of an export says when it is read again."""
    said = lambda path: F.get_json_object("line", path)
    data = F.coalesce(said("$.data.label"), said("$.data.superseded_by")).alias("label")
    return lines.select("section_order", "id", said("$.section").alias("section"), said("$.data.id").alias("data_id"), data, F.coalesce(said("$.data.name"), said("$.data.from_name")).alias("name"), F.coalesce(said("$.data.to_name"), said("$.data.entity_id")).alias("other"))


def queries() -> dict:
    q = {
        "entity_by_id": lambda s, d: search.by_id(star_graph(s, d).vertices, "customer:3").select("label", "id", "name"),
        "entity_by_name": lambda s, d: search.by_name(star_graph(s, d).vertices, "customer#00000001", TYPES).select("label", "id", "name"),
        "search_ranked": lambda s, d: search.search(star_graph(s, d).vertices, " Customer#00000001 ", TYPES, limit=20).withColumn("properties", as_text(F.col("properties"))),
        "search_type_filter": lambda s, d: search.search(star_graph(s, d).vertices, "a", TYPES, "Nation").withColumn("properties", as_text(F.col("properties"))),
        "search_exact": lambda s, d: search.search(star_graph(s, d).vertices, "ASIA", TYPES, exact=True).withColumn("properties", as_text(F.col("properties"))),
        "search_memory": lambda s, d: search.search(memory_graph(s, d).vertices, "Gabriel", MEMORY_TYPES, limit=25).withColumn("properties", as_text(F.col("properties"))),
        "resolve_batch": lambda s, d: search.resolve_many(star_graph(s, d).vertices, RESOLVE, TYPES),
        "list_entities": lambda s, d: search.listing(star_graph(s, d).vertices, TYPES, limit=50),
        "list_entities_by_type": lambda s, d: search.listing(star_graph(s, d).vertices, TYPES, "Nation"),
        "relationships_out": lambda s, d: neighbours.relationships(star_graph(s, d), ANCHOR, "out", limit=5).withColumn("properties", as_text(F.col("properties"))),
        "relationships_in": lambda s, d: neighbours.relationships(star_graph(s, d), "nation:3", "in", "LOCATED_IN", None).withColumn("properties", as_text(F.col("properties"))),
        "relationships_both": lambda s, d: neighbours.relationships(star_graph(s, d), ANCHOR, "both", limit=7).withColumn("properties", as_text(F.col("properties"))),
        "relationships_flat": lambda s, d: neighbours.with_names(memory_graph(s, d).edges, memory_graph(s, d).vertices).withColumn("properties", as_text(F.col("properties"))),
        "khop_filtered_types": lambda s, d: traverse.hops(star_graph(s, d), [ANCHOR], 3, ["PLACED", "LOCATED_IN"]),
        "khop_edges_d2": lambda s, d: traverse.path_edges(star_graph(s, d), [ORDER], 2).select("id", "label"),
        "khop_live_component": lambda s, d: traverse.Connections(star_graph(s, d), ORDER, 2).entities.select("id", "label", "name"),
        "khop_live_edges": lambda s, d: traverse.Connections(star_graph(s, d), ORDER, 2).relationships.select("id"),
        "memory_khop": lambda s, d: traverse.hops(_memory(s, d), [table(s, d, "core_entities").agg(F.min("id")).first()[0]], 2),
        "context": _context,
        "connections_envelope": lambda s, d: traverse.Connections(star_graph(s, d), ORDER, 2).envelope(25),
        "timeline_topn": lambda s, d: traverse.timeline(star_graph(s, d), ANCHOR, 2, 10).select("id", "label", "timestamp"),
        "context_facts": lambda s, d: facts.facts_of(star_graph(s, d), ANCHOR),
        "active_facts": lambda s, d: facts.active_facts(star_graph(s, d)),
        "contradiction_counts": lambda s, d: facts.active_counts(star_graph(s, d)),
        "graph_stats_vertices": lambda s, d: stats.vertex_counts(star_graph(s, d), TYPES),
        "graph_stats_edges": lambda s, d: stats.edge_counts(star_graph(s, d), LINKS),
        "graph_stats_totals": lambda s, d: stats.totals(star_graph(s, d), TYPES, LINKS),
        "memory_stats_vertices": lambda s, d: stats.vertex_counts(memory_graph(s, d), MEMORY_TYPES),
        "memory_stats_edges": lambda s, d: stats.edge_counts(memory_graph(s, d), MEMORY_LINKS),
        "entities_current": lambda s, d: memory_graph(s, d).vertices.select("id", "label", "name", "confidence", "deleted"),
        "relationships_current": lambda s, d: current_edges(table(s, d, "relationships")).select("id", "label", "start_id", "end_id"),
        "export_entities_page": lambda s, d: export.page(export.entities(star_graph(s, d)), "customer:5")[0].withColumn("properties", as_text(F.col("properties"))),
        "export_relationships_page": lambda s, d: export.page(export.relationships(star_graph(s, d)), "LOCATED_IN:customer:5")[0].drop("properties"),
        "export_facts_page": lambda s, d: export.page(export.facts(star_graph(s, d)), "fact:5")[0],
        "export_entities": lambda s, d: export.entities(memory_graph(s, d)).withColumn("properties", as_text(F.col("properties"))),
        "export_relationships": lambda s, d: export.relationships(star_graph(s, d)).withColumn("properties", as_text(F.col("properties"))),
        "export_facts": lambda s, d: export.facts(star_graph(s, d)),
        "export_lines": lambda s, d: _lines(export.lines(memory_graph(s, d)).unionByName(export.lines(facts_graph(s, d), ["facts"]))),
    }
    for k in (1, 2, 3):
        q[f"khop_nodes_d{k}"] = lambda s, d, k=k: traverse.hops(star_graph(s, d), [ORDER], k)
    return q


_ID = "nullif(lower(trim({}, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(160))), '')"

_V = """v AS (SELECT 'Region' AS label, 'region:'||r_regionkey AS id, r_name AS name, NULL::TIMESTAMP AS created_at, false AS deleted, '' AS properties FROM region
 UNION ALL SELECT 'Nation', 'nation:'||n_nationkey, n_name, NULL, false, '' FROM nation
 UNION ALL SELECT 'Customer', 'customer:'||c_custkey, c_name, NULL, c_custkey % 29 = 7, 'segment='||c_mktsegment FROM customer
 UNION ALL SELECT 'Supplier', 'supplier:'||s_suppkey, s_name, NULL, false, '' FROM supplier
 UNION ALL SELECT 'Part', 'part:'||p_partkey, p_name, NULL, p_partkey % 17 = 3, 'brand='||p_brand||';type='||p_type FROM part
 UNION ALL SELECT 'Order', 'order:'||o_orderkey, 'Order#'||o_orderkey, o_orderdate, o_orderstatus = 'P', 'priority='||o_orderpriority FROM orders
 UNION ALL SELECT 'Fact', 'fact:'||event_id, left(event_type||':'||value, 100), ts, false, 'user_id='||user_id FROM events)"""

_E = """e0 AS (SELECT 'LOCATED_IN' AS label, 'customer:'||c_custkey AS start_id, 'nation:'||c_nationkey AS end_id FROM customer
 UNION SELECT 'LOCATED_IN', 'supplier:'||s_suppkey, 'nation:'||s_nationkey FROM supplier
 UNION SELECT 'PART_OF', 'nation:'||n_nationkey, 'region:'||n_regionkey FROM nation
 UNION SELECT 'PLACED', 'customer:'||o_custkey, 'order:'||o_orderkey FROM orders
 UNION SELECT 'CONTAINS', 'order:'||l_orderkey, 'part:'||l_partkey FROM lineitem
 UNION SELECT 'SUPPLIES', 'supplier:'||l_suppkey, 'part:'||l_partkey FROM lineitem
 UNION SELECT 'RELATES_TO', 'fact:'||event_id, 'customer:'||user_id FROM events
 UNION SELECT 'SUPERSEDED_BY', 'fact:'||event_id, 'fact:'||n FROM (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n IS NOT NULL),
e AS (SELECT label||':'||start_id||'>'||end_id AS id, * FROM e0),
u AS (SELECT start_id AS a, end_id AS b, label FROM e UNION SELECT end_id, start_id, label FROM e)"""

_MV = f"""mv AS (SELECT {_ID.format("id")} AS id, max(deleted_at) IS NOT NULL AS deleted, arg_max(name, (ingested_at, name)) AS name, arg_max(entity_type, (ingested_at, name)) AS label, arg_max(confidence, (ingested_at, name)) AS confidence, arg_max(properties, (ingested_at, name, properties)) AS bag, arg_max(created_at, (ingested_at, name)) AS created_at
 FROM (SELECT * FROM entities UNION ALL BY NAME SELECT * FROM core_entities) GROUP BY 1)"""
#: Properties of a memory vertex: key=value in the order of the texts.
_BAG = """array_to_string(list_sort(list_transform(json_keys(bag), lambda k: k||'='||json_extract_string(bag, '$."'||k||'"'))), ';')"""
_ME = f"""me AS (SELECT * FROM (SELECT {_ID.format("id")} AS id, arg_max(rel_type, ingested_at) AS label, {_ID.format("arg_max(from_id, ingested_at)")} AS start_id, {_ID.format("arg_max(to_id, ingested_at)")} AS end_id, arg_max(properties, ingested_at) AS properties FROM relationships GROUP BY 1) WHERE start_id IS NOT NULL AND end_id IS NOT NULL)"""

_SCORE = "CASE WHEN lower(name) = q THEN 1.0::DOUBLE WHEN starts_with(lower(name), q) THEN 0.8::DOUBLE WHEN contains(lower(name), q) THEN 0.6::DOUBLE WHEN contains(q, lower(name)) THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END"
_ORD = "list_position([" + ", ".join(f"'{t}'" for t in TYPES) + "], label)"
_MORD = "list_position([" + ", ".join(f"'{t}'" for t in MEMORY_TYPES) + "], label)"


def _hops(anchor: str, depth: int, source: str = "u", types: str = "") -> str:
    levels = [f"l0 AS (SELECT '{anchor}' AS id)"]
    for k in range(1, depth + 1):
        levels.append(f"l{k} AS (SELECT DISTINCT b AS id FROM {source} JOIN l{k - 1} ON a = l{k - 1}.id {types} UNION SELECT id FROM l{k - 1})")
    dist = "CASE " + " ".join(f"WHEN id IN (SELECT id FROM l{k}) THEN {k}" for k in range(depth)) + f" ELSE {depth} END"
    return ", ".join(levels) + f", near AS (SELECT id, {dist} AS dist FROM l{depth})"


_LIVE = f"""{_V}, {_E}, {_hops(ORDER, 2)},
 pe AS (SELECT * FROM e WHERE start_id IN (SELECT id FROM near WHERE dist <= 1) OR end_id IN (SELECT id FROM near WHERE dist <= 1)),
 ok AS (SELECT id FROM v WHERE NOT deleted), le AS (SELECT * FROM pe WHERE start_id IN (FROM ok) AND end_id IN (FROM ok)),
 lu AS (SELECT start_id AS a, end_id AS b FROM le UNION SELECT end_id, start_id FROM le),
 comp AS (SELECT '{ORDER}' AS id UNION SELECT b FROM comp JOIN lu ON a = comp.id)"""

_FACTS = f"""{_V}, {_E}, sup AS (SELECT DISTINCT start_id AS id FROM e WHERE label = 'SUPERSEDED_BY'),
 fs AS (SELECT v.*, v.id IN (FROM sup) AS superseded FROM v WHERE label = 'Fact' AND NOT deleted),
 fl AS (SELECT start_id AS fact_id, end_id AS entity_id FROM e WHERE label = 'RELATES_TO')"""


_EXPORT_FACTS = """SELECT v.id, name, created_at, r.end_id AS entity_id, s.end_id AS superseded_by FROM v LEFT JOIN e r ON r.start_id = v.id AND r.label = 'RELATES_TO'
 LEFT JOIN e s ON s.start_id = v.id AND s.label = 'SUPERSEDED_BY' WHERE v.label = 'Fact'"""

_MF = f"""mf AS (SELECT {_ID.format("id")} AS id, max({_ID.format("superseded_by")}) AS later, arg_max(content, (ingested_at, content)) AS content, arg_max(source, (ingested_at, content)) AS source,
 arg_max(confidence, (ingested_at, content)) AS confidence, arg_max(stated_at, (ingested_at, content)) AS stated_at, arg_max({_ID.format("entity_id")}, (ingested_at, content)) AS entity_id FROM facts GROUP BY 1)"""


def _given(types: list[str]) -> str:
    return "(SELECT unnest([" + ", ".join(f"'{t}'" for t in types) + "]) AS label)"


def _side(direction: str, own: str, other: str, anchor: str, extra: str, limit: int | None) -> str:
    return f"SELECT * FROM (SELECT '{direction}' AS direction, e.label, e.id, start_id, end_id, v.name AS other_name, '' AS properties FROM e JOIN v ON v.id = {other} WHERE {own} = '{anchor}' AND NOT v.deleted {extra} ORDER BY e.label, e.id {f'LIMIT {limit}' if limit else ''})"


def oracle_sql() -> dict[str, str]:
    o = {
        "entity_by_id": f"WITH {_V} SELECT label, id, name FROM v WHERE NOT deleted AND id = 'customer:3'",
        "entity_by_name": f"WITH {_V} SELECT label, id, name FROM v WHERE NOT deleted AND contains(lower(name), 'customer#00000001') ORDER BY lower(name) = 'customer#00000001' DESC, {_ORD}, id LIMIT 1",
        "search_ranked": f"WITH {_V}, s AS (SELECT id, name, label, properties, {_SCORE} AS score FROM (SELECT *, 'customer#00000001' AS q FROM v WHERE NOT deleted)) SELECT * FROM s WHERE score > 0 ORDER BY score DESC, length(name), {_ORD}, id LIMIT 20",
        "search_type_filter": f"WITH {_V}, s AS (SELECT id, name, label, properties, {_SCORE} AS score FROM (SELECT *, 'a' AS q FROM v WHERE NOT deleted AND label = 'Nation')) SELECT * FROM s WHERE score > 0 ORDER BY score DESC, length(name), id LIMIT 10",
        "search_exact": f"WITH {_V} SELECT id, name, label, properties, 1.0::DOUBLE AS score FROM v WHERE NOT deleted AND lower(name) = 'asia' ORDER BY length(name), {_ORD}, id LIMIT 10",
        "search_memory": f"WITH {_MV}, s AS (SELECT id, name, label, {_BAG} AS properties, {_SCORE} AS score FROM (SELECT *, 'gabriel' AS q FROM mv WHERE NOT deleted)) SELECT * FROM s WHERE score > 0 ORDER BY score DESC, length(name), {_MORD}, id LIMIT 25",
        "resolve_batch": f"""WITH {_V}, g AS (SELECT unnest([{", ".join(f"'{x}'" for x in RESOLVE)}]) AS query), s AS (SELECT query, id, name, label, {_SCORE} AS score FROM (SELECT v.*, query, lower(trim(query)) AS q FROM v, g WHERE NOT deleted)),
            r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, length(name), {_ORD}, id) AS rn FROM s WHERE score > 0),
            f AS (SELECT query, count(*) AS n, max(CASE WHEN rn = 1 THEN id END) AS first, max(CASE WHEN rn = 1 THEN score END) AS s1, max(CASE WHEN rn = 2 THEN score END) AS s2 FROM r WHERE rn <= 5 GROUP BY 1)
            SELECT query, CASE WHEN n IS NULL THEN 'not_found' WHEN n = 1 OR (s1 = 1 AND s2 < 1) THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 OR (s1 = 1 AND s2 < 1) THEN first END AS id, coalesce(n, 0) AS n_candidates FROM g LEFT JOIN f USING (query)""",
        "list_entities": f"WITH {_V} SELECT id, name, label, created_at FROM v WHERE NOT deleted AND label IN (SELECT label FROM {_given(TYPES)}) ORDER BY name COLLATE NOCASE, id LIMIT 50",
        "list_entities_by_type": f"WITH {_V} SELECT id, name, label, created_at FROM v WHERE NOT deleted AND label = 'Nation' ORDER BY name, id LIMIT 50",
        "relationships_out": f"WITH {_V}, {_E} {_side('out', 'start_id', 'end_id', ANCHOR, '', 5)}",
        "relationships_in": f"WITH {_V}, {_E} {_side('in', 'end_id', 'start_id', 'nation:3', "AND e.label = 'LOCATED_IN'", None)}",
        "relationships_both": f"WITH {_V}, {_E} {_side('out', 'start_id', 'end_id', ANCHOR, '', 7)} UNION ALL {_side('in', 'end_id', 'start_id', ANCHOR, '', 7)}",
        "relationships_flat": f"""WITH {_MV}, {_ME}, p AS (SELECT id, unnest(json_keys(properties)) AS k, properties FROM me),
            b AS (SELECT id, string_agg(CASE WHEN k IN ('type', 'from', 'to') THEN 'prop_' || k ELSE k END || '=' || json_extract_string(properties, '$."' || k || '"'), ';' ORDER BY k) AS bag FROM p WHERE k NOT IN ('id', 'created_at', 'updated_at') GROUP BY 1)
            SELECT me.id, me.label, coalesce(x.name, start_id) AS from_name, coalesce(y.name, end_id) AS to_name, coalesce(b.bag, CASE WHEN me.properties IS NOT NULL THEN '' END) AS properties FROM me LEFT JOIN mv x ON x.id = start_id LEFT JOIN mv y ON y.id = end_id LEFT JOIN b ON b.id = me.id""",
        "khop_filtered_types": f"WITH {_E}, {_hops(ANCHOR, 3, 'u', "AND label IN ('PLACED', 'LOCATED_IN')")} SELECT id, dist FROM near",
        "khop_edges_d2": f"WITH {_E}, {_hops(ORDER, 1)} SELECT id, label FROM e WHERE start_id IN (SELECT id FROM near) OR end_id IN (SELECT id FROM near)",
        "khop_live_component": f"WITH RECURSIVE {_LIVE} SELECT v.id, label, name FROM comp JOIN v USING (id) WHERE id != '{ORDER}'",
        "khop_live_edges": f"WITH RECURSIVE {_LIVE} SELECT id FROM le WHERE start_id IN (FROM comp) AND end_id IN (FROM comp)",
        "memory_khop": f"WITH {_ME}, u AS (SELECT start_id AS a, end_id AS b FROM me UNION SELECT end_id, start_id FROM me), l0 AS (SELECT min(id) AS id FROM core_entities), l1 AS (SELECT DISTINCT b AS id FROM u JOIN l0 ON a = l0.id UNION FROM l0), l2 AS (SELECT DISTINCT b AS id FROM u JOIN l1 ON a = l1.id UNION FROM l1) SELECT id, CASE WHEN id IN (FROM l0) THEN 0 WHEN id IN (FROM l1) THEN 1 ELSE 2 END AS dist FROM l2",
        "context": f"WITH RECURSIVE {_LIVE}, fl AS (SELECT start_id AS fact_id FROM e WHERE label = 'RELATES_TO' AND end_id = '{ANCHOR}') SELECT 'entity' AS section, v.id, name AS text FROM comp JOIN v USING (id) WHERE id != '{ORDER}' UNION ALL SELECT 'relationship', id, label FROM le WHERE start_id IN (FROM comp) AND end_id IN (FROM comp) UNION ALL SELECT 'fact', id, name FROM v WHERE id IN (FROM fl)",
        "timeline_topn": f"WITH {_V}, {_E}, {_hops(ANCHOR, 2)} SELECT v.id, label, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp FROM v JOIN near ON near.id = v.id WHERE NOT deleted AND created_at IS NOT NULL AND v.id != '{ANCHOR}' ORDER BY timestamp DESC, v.id LIMIT 10",
        "context_facts": f"WITH {_FACTS} SELECT id, name, created_at, superseded FROM fs WHERE id IN (SELECT fact_id FROM fl WHERE entity_id = '{ANCHOR}')",
        "active_facts": f"WITH {_FACTS} SELECT entity_id, id, name, created_at FROM fs JOIN fl ON fact_id = id WHERE NOT superseded",
        "contradiction_counts": f"WITH {_FACTS} SELECT entity_id, count(*) AS n_active FROM fs JOIN fl ON fact_id = id WHERE NOT superseded GROUP BY 1 HAVING count(*) > 1",
        "graph_stats_vertices": f"WITH {_V} SELECT g.label, count(v.id) AS n FROM {_given(TYPES)} g LEFT JOIN v ON v.label = g.label AND NOT deleted GROUP BY 1",
        "graph_stats_edges": f"WITH {_E} SELECT g.label, count(e.id) AS n FROM {_given(LINKS)} g LEFT JOIN e USING (label) GROUP BY 1",
        "graph_stats_totals": f"WITH {_V}, {_E} SELECT (SELECT count(*) FROM v WHERE NOT deleted) AS total_entities, (SELECT count(*) FROM e) AS total_relationships",
        "memory_stats_vertices": f"WITH {_MV} SELECT g.label, count(mv.id) AS n FROM {_given(MEMORY_TYPES)} g LEFT JOIN mv ON mv.label = g.label AND NOT deleted GROUP BY 1",
        "memory_stats_edges": f"WITH {_ME} SELECT g.label, count(me.id) AS n FROM {_given(MEMORY_LINKS)} g LEFT JOIN me USING (label) GROUP BY 1",
        "entities_current": f"WITH {_MV} SELECT id, label, name, confidence, deleted FROM mv",
        "relationships_current": f"WITH {_ME} SELECT id, label, start_id, end_id FROM me",
        "export_entities_page": f"WITH {_V} SELECT id, label, name, properties, created_at FROM v WHERE NOT deleted AND label != 'Fact' AND id > 'customer:5' ORDER BY id LIMIT 200",
        "export_entities": f"WITH {_MV} SELECT id, label, name, {_BAG} AS properties, created_at FROM mv WHERE NOT deleted AND label != 'Fact'",
        "export_relationships": f"WITH {_V}, {_E} SELECT e.id, e.label, start_id AS from_id, a.name AS from_name, end_id AS to_id, b.name AS to_name, '' AS properties FROM e JOIN v a ON a.id = start_id JOIN v b ON b.id = end_id",
        "export_relationships_page": f"""WITH {_V}, {_E} SELECT e.id, e.label, start_id AS from_id, a.name AS from_name, end_id AS to_id, b.name AS to_name FROM e JOIN v a ON a.id = start_id JOIN v b ON b.id = end_id
            WHERE e.id > 'LOCATED_IN:customer:5' ORDER BY e.id LIMIT 200""",
        "export_facts": f"WITH {_V}, {_E} {_EXPORT_FACTS}",
        "export_facts_page": f"WITH {_V}, {_E} {_EXPORT_FACTS} AND v.id > 'fact:5' ORDER BY v.id LIMIT 200",
        "export_lines": f"""WITH {_MV}, {_ME}, {_MF} SELECT 0 AS section_order, id, 'entities' AS section, id AS data_id, label, name, NULL AS other FROM mv WHERE NOT deleted AND label != 'Fact'
            UNION ALL SELECT 1, me.id, 'relationships', me.id, me.label, a.name, b.name FROM me JOIN mv a ON a.id = start_id JOIN mv b ON b.id = end_id
            UNION ALL SELECT 2, id, 'facts', id, later, left(content, 100), entity_id FROM mf""",
        "connections_envelope": f"WITH RECURSIVE {_LIVE} SELECT count(*) AS total_count, least(count(*), 25) AS shown, count(*) > 25 AS truncated FROM comp JOIN v USING (id) WHERE id != '{ORDER}'",
    }
    for k in (1, 2, 3):
        o[f"khop_nodes_d{k}"] = f"WITH {_E}, {_hops(ORDER, k)} SELECT id, dist FROM near"
    return o
