"""Queries of superseded facts, merged vertices, guardrails, text forms and counters, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import agtype
from factloom.functions.bags import as_text
from factloom.model import live
from factloom.operators import mutate
from factloom.operators.hierarchy import Hierarchy
from factloom.plans.changes import _SIM, _at, _edges_upserted, _new, _pairs, _upserted
from factloom.plans.changes import oracle_sql as _changes
from factloom.plans.graph import _MF, _MV
from factloom.schema.presets import preset
from factloom.schema.registry import Registry
from factloom.sources.graph import facts_graph, memory_graph
from factloom.sources.tables import table


def _superseding(spark, d):
    """Of every entity's facts the one with the greatest content is replaced; every second entity also states one that no fact holds."""
    g = facts_graph(spark, d)
    facts = g.vertices.select(F.col("id").alias("start_id"), F.get_json_object(F.concat(F.lit('{"c":'), F.col("properties")["content"], F.lit("}")), "$.c").alias("content"))
    own = g.edges.filter("label = 'RELATES_TO'").join(facts, "start_id").groupBy(F.col("end_id").alias("entity_id")).agg(F.max("content").alias("old"))
    ask = lambda kind, old: own.select(F.lit(0).cast("long").alias("ord"), "entity_id", F.concat(F.lit(f"{kind} of "), "entity_id").alias("new_fact"), old.alias("old_fact"), F.lit("review").alias("source"), F.lit(0.9).alias("confidence"))
    batch = ask("review", F.col("old")).unionByName(ask("first statement", F.lit("never \"stated\" so far")))
    return mutate.superseding(g, batch, _at(), _new(F.lit("new"), "entity_id", "new_fact"), _new(F.lit("made"), "entity_id", "new_fact"))


def _superseded_vertices(spark, d):
    return _superseding(spark, d)[0].select("id", "name", as_text(F.col("properties")).alias("properties"), "created_at", "confidence")


def _superseded_edges(spark, d):
    return _superseding(spark, d)[1].select("label", "start_id", "end_id", as_text(F.col("properties")).alias("properties"))


def _versions(spark, d):
    """Every fact's place in its chain of replacements: the current fact and how many steps it is away."""
    g = facts_graph(spark, d)
    links = g.edges.filter("label = 'SUPERSEDED_BY'").select("start_id", F.col("end_id").alias("later"))
    rows = g.vertices.select("id").join(links, F.col("id") == F.col("start_id"), "left").select("id", "later")
    return Hierarchy(rows, "id", "later").nodes().select(F.col("fact_id"), F.col("root_id").alias("current_id"), F.col("depth").alias("steps"), (F.col("depth") == 0).alias("is_current"))


def _merged(spark, d):
    return mutate.merged_vertices(memory_graph(spark, d).vertices, _pairs(spark, d), _at()).select("id", "label", "deleted", F.coalesce("deleted_at", "updated_at").alias("changed_at"), F.explode("properties").alias("key", "value"))


def _agtype_edges(spark, d):
    o = table(spark, d, "orders")
    bag = F.to_json(F.struct(F.col("o_orderpriority").alias("priority"), F.lit("a::edge {x}").alias("note")))
    text = F.concat(F.lit('{"id": '), F.col("o_orderkey").cast("string"), F.lit(', "label": "PLACED", "start_id": '), F.col("o_custkey").cast("string"), F.lit(', "end_id": '), F.col("o_orderkey").cast("string"), F.lit(', "properties": '), bag, F.lit("}::edge "))
    i, label, a, b, p = agtype.edge_columns(F.col("t"))
    return o.select(text.alias("t")).select(agtype.kind_column(F.col("t")).alias("kind"), i, label, a, b, as_text(p).alias("properties"))


def _agtype_scalars(spark, d):
    s = table(spark, d, "supplier")
    texts = F.array(F.concat(F.col("s_nationkey").cast("string"), F.lit("::numeric")), F.concat(F.lit('"'), F.col("s_name"), F.lit('"')), F.lit("null"), F.lit("true::boolean"))
    return s.select("s_suppkey", F.posexplode(texts).alias("place", "t")).select("s_suppkey", "place", agtype.kind_column(F.col("t")).alias("kind"), agtype.scalar_column(F.col("t")).alias("value"))


def _guardrails(spark, d):
    return Registry(preset("dev-team")).judge(table(spark, d, "bulk_inputs").select(F.col("entity_type").alias("name")))


def _counters(spark, d):
    count = lambda df, kind: df.groupBy("created").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), F.when(F.col("created"), "created").otherwise("updated").alias("outcome"), "n")
    return count(_upserted(spark, d), "entity").unionByName(count(_edges_upserted(spark, d), "relationship"))


def queries() -> dict:
    return {
        "supersede_facts": _superseded_vertices,
        "supersede_facts_edges": _superseded_edges,
        "supersession_steps": _versions,
        "merge_entities_properties": _merged,
        "agtype_edges": _agtype_edges,
        "agtype_scalars": _agtype_scalars,
        "schema_guardrails": _guardrails,
        "bulk_counters": _counters,
        "graph_sql": lambda s, d: memory_graph(s, d).sql("SELECT label, count(*) AS n FROM {vertices} WHERE NOT deleted AND length(name) > :least GROUP BY label", {"least": 12}),
        "deleted_vertices": lambda s, d: memory_graph(s, d).vertices.join(live(memory_graph(s, d).vertices).select("id"), "id", "left_anti").select("id", "label"),
    }


_SUPERSEDE = f"""{_MF}, own AS (SELECT entity_id, max(content) AS old FROM mf WHERE entity_id IS NOT NULL GROUP BY 1),
 b AS (SELECT entity_id, 'review of '||entity_id AS new_fact, old AS old_fact FROM own UNION ALL SELECT entity_id, 'first statement of '||entity_id, 'never "stated" so far' FROM own),
 h AS (SELECT entity_id, content, min(id) AS found FROM mf WHERE entity_id IS NOT NULL GROUP BY ALL),
 r AS (SELECT b.*, found, md5('new|'||b.entity_id||'|'||new_fact) AS new_id, CASE WHEN old_fact IS NOT NULL AND old_fact != '' THEN coalesce(found, md5('made|'||b.entity_id||'|'||new_fact)) END AS old_id FROM b LEFT JOIN h ON h.entity_id = b.entity_id AND content = old_fact)"""


def oracle_sql() -> dict[str, str]:
    changes = _changes()
    quoted = lambda c: f"json_quote({c})::VARCHAR"
    return {
        "supersede_facts": f"""WITH {_SUPERSEDE}
            SELECT new_id AS id, left(new_fact, 100) AS name, 'content='||{quoted("new_fact")}||';source="review"' AS properties, TIMESTAMP '2026-01-01' AS created_at, 0.9::DOUBLE AS confidence FROM r
            UNION ALL SELECT old_id, left(old_fact, 100), '_superseded=true;content='||{quoted("old_fact")}, TIMESTAMP '2026-01-01', NULL FROM r WHERE found IS NULL AND old_id IS NOT NULL
            UNION ALL SELECT id, left(content, 100), concat_ws(';', '_superseded=true', 'content='||{quoted("content")}, 'source='||{quoted("source")}), stated_at, confidence FROM mf WHERE id IN (SELECT found FROM r)""",
        "supersede_facts_edges": f"""WITH {_SUPERSEDE} SELECT 'RELATES_TO' AS label, new_id AS start_id, entity_id AS end_id, '' AS properties FROM r
            UNION ALL SELECT 'RELATES_TO', old_id, entity_id, '' FROM r WHERE found IS NULL AND old_id IS NOT NULL
            UNION ALL SELECT 'SUPERSEDED_BY', old_id, new_id, 'superseded_at="2026-01-01T00:00:00.000Z"' FROM r WHERE old_id IS NOT NULL""",
        "supersession_steps": f"""WITH RECURSIVE {_MF}, e AS (SELECT a.id AS c, a.later AS p FROM mf a JOIN mf b ON a.later = b.id),
            w AS (SELECT id, [id] AS path, p AS nxt FROM mf LEFT JOIN e ON c = id UNION ALL SELECT w.id, list_append(w.path, w.nxt), e.p FROM w LEFT JOIN e ON e.c = w.nxt WHERE w.nxt IS NOT NULL AND NOT list_contains(w.path, w.nxt)),
            f AS (SELECT id, path, CASE WHEN nxt IS NULL THEN path[-1] ELSE list_min(path[list_position(path, nxt):]) END AS root FROM w WHERE nxt IS NULL OR list_contains(path, nxt))
            SELECT id AS fact_id, root AS current_id, list_position(path, root) - 1 AS steps, root = id AS is_current FROM f""",
        "merge_entities_properties": f"""WITH RECURSIVE {_MV}, m AS (SELECT DISTINCT surviving_id AS s, merged_id AS m FROM merges), up AS (SELECT m AS v, s AS root FROM m UNION ALL SELECT up.v, m.s FROM up JOIN m ON m.m = up.root),
            p AS (SELECT DISTINCT v, root FROM up WHERE root NOT IN (SELECT m FROM m)),
            k AS (SELECT id, bag, unnest(json_keys(bag)) AS key FROM mv WHERE bag IS NOT NULL), kv AS (SELECT id, key, json_extract_string(bag, '$."'||key||'"') AS value FROM k),
            g AS (SELECT root, key, arg_min(value, v) AS value FROM kv JOIN p ON v = id GROUP BY ALL), l AS (SELECT root, max(v) AS last FROM p JOIN mv ON id = v GROUP BY 1),
            a AS (SELECT l.root AS id, key, value FROM kv JOIN l ON l.root = id WHERE key != 'merged_from' UNION ALL SELECT root, key, value FROM g WHERE key != 'merged_from' AND (root, key) NOT IN (SELECT (id, key) FROM kv) UNION ALL SELECT root, 'merged_from', '"'||last||'"' FROM l)
            SELECT a.id, label, deleted, TIMESTAMP '2026-01-01' AS changed_at, key, value FROM a JOIN mv USING (id) UNION ALL SELECT id, label, true, TIMESTAMP '2026-01-01', key, value FROM kv JOIN p ON v = id JOIN mv USING (id)""",
        "agtype_edges": """SELECT 'edge' AS kind, o_orderkey::VARCHAR AS id, 'PLACED' AS label, o_custkey::VARCHAR AS start_id, o_orderkey::VARCHAR AS end_id, 'note=a::edge {x};priority='||o_orderpriority AS properties FROM orders""",
        "agtype_scalars": """SELECT s_suppkey, place, 'scalar' AS kind, value FROM (SELECT s_suppkey, unnest([0, 1, 2, 3]) AS place, unnest([s_nationkey::VARCHAR, s_name, 'null', 'true']) AS value FROM supplier)""",
        "schema_guardrails": f"""WITH {_SIM}, n AS (SELECT name_a AS name, arg_max(name_b, (similarity, -ord)) AS nearest, max(similarity) AS s, bool_or(name_a = name_b) AS known FROM s WHERE name_a IS NOT NULL GROUP BY 1)
            SELECT name, CASE WHEN NOT regexp_matches(name, '^[A-Za-z][A-Za-z0-9_]{{1,30}}$') THEN 'invalid' WHEN known THEN 'exists' WHEN s >= 0.7 THEN 'similar' ELSE 'ok' END AS verdict, nearest, floor(s * 100 + 0.5)::INTEGER AS percent FROM n""",
        "bulk_counters": f"""SELECT 'entity' AS kind, CASE WHEN created THEN 'created' ELSE 'updated' END AS outcome, count(*) AS n FROM ({changes["upsert_entities"]}) GROUP BY ALL
            UNION ALL SELECT 'relationship', CASE WHEN created THEN 'created' ELSE 'updated' END, count(*) FROM ({changes["upsert_edges_dedupe"]}) GROUP BY ALL""",
        "graph_sql": f"WITH {_MV} SELECT label, count(*) AS n FROM mv WHERE NOT deleted AND length(name) > 12 GROUP BY 1",
        "deleted_vertices": f"WITH {_MV} SELECT id, label FROM mv WHERE deleted",
    }
