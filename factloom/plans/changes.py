"""Queries of mutations, functions and text forms, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import agtype, bags, similarity
from factloom.functions.text import match_score
from factloom.model import is_identifier, live
from factloom.operators import mermaid, mutate
from factloom.operators.hierarchy import Hierarchy
from factloom.plans.graph import _E, _ID, _ME, _MV, _V, MEMORY_LINKS, MEMORY_TYPES, TYPES
from factloom.schema.markdown import reconcile
from factloom.sources.graph import current_edges, memory_graph, star_graph
from factloom.sources.tables import table

def _at():
    return F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")


def _new(*columns):
    """Made ids that SQL can make as well."""
    return F.md5(F.concat_ws("|", *columns))


def _inputs(spark, d):
    """Entity inputs as an upsert batch: repeated inputs once, in the order in which they were received."""
    rows = table(spark, d, "entity_inputs").select("input_id", "name", "entity_type", "properties", "confidence").distinct()
    return rows.select(F.col("input_id").alias("ord"), F.col("entity_type").alias("label"), "name", bags.from_json_text(F.col("properties")).alias("properties"), "confidence")


def _upserted(spark, d):
    v = memory_graph(spark, d).vertices.withColumn("seq", F.lit(0))
    good = mutate.vertex_errors(_inputs(spark, d), MEMORY_TYPES).filter("error is null").drop("error")
    return mutate.upsert_vertices(v, good, _at(), _new("label", "name"))


def _upsert_values(spark, d):
    up = _upserted(spark, d)
    return up.select("id", F.explode("properties").alias("key", "value"))


def _edges_upserted(spark, d):
    g = current_edges(table(spark, d, "relationships"))
    rows = table(spark, d, "relationship_inputs")
    ids = rows.select(F.col("input_id").alias("ord"), F.col("rel_type").alias("label"), F.lower("from_name").alias("start_id"), F.lower("to_name").alias("end_id"), bags.from_json_text(F.col("properties")).alias("properties"))
    return mutate.upsert_edges(g, ids, _at(), _new("label", "start_id", "end_id")).select("id", "label", "start_id", "end_id", "created")


def _pairs(spark, d):
    """(surviving_id, merged_id) with the vertex that chains of merges end in."""
    m = table(spark, d, "merges")
    chain = m.select(F.col("merged_id").alias("id"), F.col("surviving_id").alias("parent")).unionByName(m.select(F.col("surviving_id").alias("id"), F.lit(None).cast("string").alias("parent")))
    return Hierarchy(chain, "id", "parent").nodes().filter("depth > 0").select(F.col("root_id").alias("surviving_id"), F.col("fact_id").alias("merged_id"))


def _bulk(spark, d):
    """Ends of relationship inputs resolved: the batch are entity inputs tied to a vertex, the store the current vertices."""
    rows = table(spark, d, "relationship_inputs").select("input_id", "from_name", "to_name", "from_type", "to_type").dropDuplicates(["input_id"])
    ends = rows.select(F.col("input_id").alias("index"), F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"{f}_name").alias("ref"), F.col(f"{f}_type").alias("hint")) for f in ("from", "to")))))
    batch = table(spark, d, "entity_inputs").filter("entity_id is not null").select("name", F.col("entity_type").alias("label"), F.col("entity_id").alias("id"))
    return mutate.resolve_references(ends, batch, memory_graph(spark, d).vertices).select("index", "field", "id", F.col("error").isNotNull().alias("failed"))


def _agtype(spark, d):
    n = table(spark, d, "nation")
    props = F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("region")))
    text = F.concat(F.lit('{"id": '), F.col("n_nationkey").cast("string"), F.lit(', "label": "Nation", "properties": '), props, F.lit("}::vertex"))
    rows = n.select(text.alias("t"))
    i, label, p = agtype.vertex_columns(F.col("t"))
    return rows.select(agtype.kind_column(F.col("t")).alias("kind"), i, label, p["name"].alias("name"), p["region"].alias("region"))


def queries() -> dict:
    return {
        "upsert_entities": lambda s, d: _upserted(s, d).select("id", "label", "name", "confidence", "created"),
        "upsert_entities_merge": _upsert_values,
        "upsert_edges_dedupe": _edges_upserted,
        "soft_delete_filter": lambda s, d: mutate.soft_delete(memory_graph(s, d).vertices, table(s, d, "merges").select(F.col("surviving_id").alias("id")), _at()).select("id", "label", "deleted", "deleted_at"),
        "merge_entities_transfer": lambda s, d: mutate.transferred_edges(memory_graph(s, d), _pairs(s, d), _at(), _new("start_id", "label", "end_id")).select("id", "label", "start_id", "end_id"),
        "bulk_resolve_references": _bulk,
        "fact_versions": star_fact_versions,
        "supersession_chain": lambda s, d: star_fact_versions(s, d).groupBy("user_id", "event_type").agg(F.max("version").alias("n_versions"), F.max_by("event_id", "version").alias("current_id")),
        "trigram_similarity": lambda s, d: _type_pairs(s, d).select("name_a", "name_b", F.round(similarity.similarity_column(F.col("name_a"), F.col("name_b")), 9).alias("similarity")),
        "most_similar_type": lambda s, d: _type_pairs(s, d).withColumn("s", F.round(similarity.similarity_column(F.col("name_a"), F.col("name_b")), 9)).groupBy("name_a").agg(F.max(F.struct(F.col("s"), -F.col("ord"), F.col("name_b"))).alias("m")).select("name_a", F.col("m.name_b").alias("match"), F.col("m.s").alias("score")),
        "match_scores": lambda s, d: table(s, d, "entity_inputs").select("input_id", match_score(F.col("name"), F.col("graph_name")).alias("score"), match_score(F.col("name"), F.lit(" an")).alias("score_an")).distinct(),
        "schema_reconcile": lambda s, d: reconcile(live(memory_graph(s, d).vertices).select(F.col("label").alias("name")), s.createDataFrame([(t,) for t in TYPES], "name string")),
        "identifier_validation": lambda s, d: table(s, d, "entity_inputs").select("name").filter("name is not null").distinct().select("name", is_identifier(F.col("name")).alias("valid")),
        "property_bag_merge": _merged_bags,
        "json_property_extract": lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k")),
        "mermaid_lines": lambda s, d: mermaid.node_lines(star_graph(s, d).vertices),
        "mermaid_links": lambda s, d: mermaid.link_lines(star_graph(s, d).edges),
        "agtype_parse": _agtype,
    }


def star_fact_versions(spark, d):
    """(event_id, user_id, event_type, version, is_current): every fact's place in the chain of facts on one subject."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", "event_type", F.row_number().over(w).alias("version"), F.lead("event_id").over(w).isNull().alias("is_current"))


def _type_pairs(spark, d):
    """Types in use against the types of the schema: two small sets of stated names."""
    used = table(spark, d, "bulk_inputs").select(F.col("entity_type").alias("name_a")).distinct()
    return used.select("name_a", F.posexplode(F.array(*map(F.lit, MEMORY_TYPES))).alias("ord", "name_b"))


def _merged_bags(spark, d):
    once = table(spark, d, "entity_inputs").select("input_id", "properties").distinct()
    given = F.create_map(F.lit("team"), F.lit("x"), F.lit("checked"), F.lit("1"))
    return once.select("input_id", F.explode(bags.merged(bags.from_json_text(F.col("properties")), given)).alias("key", "value"))


_BATCH = "SELECT DISTINCT input_id, name, entity_type, properties, confidence FROM entity_inputs"
_STORED = f"{_MV}, pv AS (SELECT id, bag AS properties FROM mv)"
_UPSERT = f"""WITH {_STORED}, b AS ({_BATCH}), g AS (SELECT input_id, trim(name, ' '||chr(9)||chr(10)||chr(13)||chr(160)) AS name, entity_type AS label, properties, confidence FROM b WHERE name IS NOT NULL AND trim(name, ' '||chr(9)||chr(10)||chr(13)||chr(160)) != '' AND (confidence IS NULL OR confidence BETWEEN 0 AND 1)),
 f AS (SELECT label, name, arg_max(confidence, input_id) FILTER (confidence IS NOT NULL) AS conf FROM g GROUP BY ALL),
 old AS (SELECT label, name, min(id) AS id, arg_min(confidence, id) AS confidence FROM mv WHERE NOT deleted GROUP BY ALL),
 up AS (SELECT coalesce(old.id, md5(f.label||'|'||f.name)) AS id, old.id AS old_id, f.label, f.name, coalesce(f.conf, mv.confidence) AS confidence, old.id IS NULL AS created FROM f LEFT JOIN old USING (label, name) LEFT JOIN mv ON mv.id = old.id)"""


def _trigram(a: str, b: str) -> str:
    trimmed = lambda x: f"trim({x}, chr(9)||chr(10)||chr(13)||' '||chr(160)||chr(8195))"
    grams = lambda y: (lambda x: f"list_distinct(list_transform(range(1, length({x}) + 1), lambda i: substring(' '||lower({x})||' ', i, 3)))")(trimmed(y))
    return f"CASE WHEN {a} = {b} THEN 1.0 ELSE round(len(list_intersect({grams(a)}, {grams(b)})) / len(list_distinct(list_concat({grams(a)}, {grams(b)}))), 9) END"


_TYPES = ", ".join(f"'{t}'" for t in MEMORY_TYPES)
_SIM = f"t AS (SELECT DISTINCT entity_type AS name_a FROM bulk_inputs), s AS (SELECT name_a, name_b, ord, {_trigram('name_a', 'name_b')}::DOUBLE AS similarity FROM t, (SELECT unnest([{_TYPES}]) AS name_b, unnest(range({len(MEMORY_TYPES)})) AS ord))"


def oracle_sql() -> dict[str, str]:
    return {
        "upsert_entities": f"{_UPSERT} SELECT id, label, name, confidence, created FROM up",
        "upsert_entities_merge": f"""{_UPSERT}, e AS (SELECT label, name, input_id, properties, unnest(json_keys(properties)) AS key FROM g WHERE properties IS NOT NULL),
            nv AS (SELECT label, name, key, arg_max(coalesce(json_extract_string(properties, '$."'||key||'"'), '~null'), input_id) AS value FROM e GROUP BY ALL),
            ov AS (SELECT up.id, unnest(json_keys(properties)) AS key, properties FROM up JOIN pv ON pv.id = up.old_id WHERE properties IS NOT NULL),
            ov2 AS (SELECT id, key, json_extract_string(properties, '$."'||key||'"') AS value FROM ov),
            n2 AS (SELECT up.id, key, value FROM nv JOIN up USING (label, name) WHERE key NOT IN ('id', 'name'))
            SELECT id, key, nullif(value, '~null') AS value FROM n2 UNION ALL SELECT id, key, value FROM ov2 ANTI JOIN n2 USING (id, key)""",
        "upsert_edges_dedupe": f"""WITH {_ME}, b AS (SELECT DISTINCT rel_type AS label, lower(from_name) AS start_id, lower(to_name) AS end_id FROM relationship_inputs), o AS (SELECT label, start_id, end_id, min(id) AS oid FROM me GROUP BY ALL)
            SELECT coalesce(oid, md5(label||'|'||start_id||'|'||end_id)) AS id, label, start_id, end_id, oid IS NULL AS created FROM b LEFT JOIN o USING (label, start_id, end_id)""",
        "soft_delete_filter": f"WITH {_STORED} SELECT id, label, true AS deleted, TIMESTAMP '2026-01-01' AS deleted_at FROM mv WHERE NOT deleted AND id IN (SELECT surviving_id FROM merges)",
        "merge_entities_transfer": f"""WITH RECURSIVE {_ME}, m AS (SELECT DISTINCT surviving_id AS s, merged_id AS m FROM merges), up AS (SELECT m AS v, s AS root FROM m UNION ALL SELECT up.v, m.s FROM up JOIN m ON m.m = up.root),
            p AS (SELECT v, root FROM up WHERE root NOT IN (SELECT m FROM m)),
            mv AS (SELECT p.root AS start_id, label, end_id FROM me JOIN p ON p.v = start_id WHERE start_id != end_id UNION SELECT start_id, label, p.root FROM me JOIN p ON p.v = end_id WHERE start_id != end_id)
            SELECT md5(start_id||'|'||label||'|'||end_id) AS id, label, start_id, end_id FROM mv ANTI JOIN me USING (start_id, label, end_id) WHERE start_id != end_id""",
        "bulk_resolve_references": f"""WITH {_STORED}, r0 AS (SELECT DISTINCT ON (input_id) * FROM relationship_inputs ORDER BY input_id), r AS (SELECT input_id AS index, 'from' AS field, from_name AS ref, from_type AS hint FROM r0 UNION ALL SELECT input_id, 'to', to_name, to_type FROM r0),
            b AS (SELECT lower(name) AS n, entity_type AS label, max(entity_id) AS id FROM entity_inputs WHERE entity_id IS NOT NULL GROUP BY ALL), b1 AS (SELECT n, max(id) AS id FROM b GROUP BY 1 HAVING count(*) = 1),
            a AS (SELECT id, lower(name) AS n, label FROM mv WHERE NOT deleted), k AS (SELECT *, lower(trim(ref, chr(9)||chr(10)||chr(13)||' '||chr(160))) AS key FROM r),
            x AS (SELECT k.*, coalesce(t.id, CASE WHEN hint IS NULL THEN b1.id END) AS done, (SELECT max(id) FROM a WHERE a.id = key) AS by_id, (SELECT count(*) FROM a WHERE a.n = key) AS n_exact, (SELECT min(id) FROM a WHERE a.n = key) AS exact_id,
              (SELECT CASE WHEN count(*) = 1 THEN min(id) END FROM a WHERE a.n = key AND a.label = hint) AS hinted, (SELECT count(*) FROM a WHERE contains(a.n, key) OR contains(key, a.n)) AS n_near, (SELECT min(id) FROM a WHERE contains(a.n, key) OR contains(key, a.n)) AS near_id
              FROM k LEFT JOIN b t ON t.n = lower(ref) AND t.label = hint LEFT JOIN b1 ON b1.n = lower(ref)),
            y AS (SELECT index, field, CASE WHEN done IS NOT NULL THEN done WHEN regexp_full_match(key, '[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}') THEN by_id WHEN n_exact = 1 THEN exact_id WHEN n_exact > 1 THEN hinted WHEN n_near = 1 AND key != '' THEN near_id END AS id FROM x)
            SELECT index, field, id, id IS NULL AS failed FROM y""",
        "fact_versions": "SELECT event_id, user_id, event_type, row_number() OVER w AS version, lead(event_id) OVER w IS NULL AS is_current FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)",
        "supersession_chain": "SELECT user_id, event_type, count(*) AS n_versions, arg_max(event_id, (ts, event_id)) AS current_id FROM events GROUP BY ALL",
        "trigram_similarity": f"WITH {_SIM} SELECT name_a, name_b, similarity FROM s",
        "most_similar_type": f"WITH {_SIM} SELECT name_a, arg_max(name_b, (similarity, -ord)) AS match, max(similarity) AS score FROM s GROUP BY 1",
        "match_scores": "SELECT DISTINCT input_id, " + ", ".join(f"CASE WHEN lower(name) = {q} THEN 1.0 WHEN starts_with(lower(name), {q}) THEN 0.8 WHEN contains(lower(name), {q}) THEN 0.6 WHEN contains({q}, lower(name)) THEN 0.4 ELSE 0.0 END::DOUBLE AS {n}" for q, n in (("lower(graph_name)", "score"), ("'an'", "score_an"))) + " FROM entity_inputs",
        "schema_reconcile": f"""WITH {_STORED}, a AS (SELECT DISTINCT label AS name FROM mv WHERE NOT deleted), b AS (SELECT unnest([{", ".join(f"'{t}'" for t in TYPES)}]) AS name)
            SELECT name, CASE WHEN name IN (FROM a) AND name IN (FROM b) THEN 'common' WHEN name IN (FROM a) THEN 'only_in_file' ELSE 'only_in_store' END AS side FROM (FROM a UNION FROM b)""",
        "identifier_validation": "SELECT DISTINCT name, regexp_matches(name, '^[A-Za-z][A-Za-z0-9_]{1,30}$') AS valid FROM entity_inputs WHERE name IS NOT NULL",
        "property_bag_merge": """WITH o AS (SELECT DISTINCT input_id, properties FROM entity_inputs), k AS (SELECT input_id, properties, unnest(json_keys(properties)) AS key FROM o WHERE properties IS NOT NULL)
            SELECT input_id, key, json_extract_string(properties, '$."'||key||'"') AS value FROM k WHERE key NOT IN ('team', 'checked') UNION ALL SELECT input_id, 'team', 'x' FROM o UNION ALL SELECT input_id, 'checked', '1' FROM o""",
        "json_property_extract": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
        "mermaid_lines": f"""WITH {_V}, s AS (SELECT id, label, CASE WHEN length(name) > 40 THEN left(name, 37)||'...' ELSE name END AS n FROM v)
            SELECT id, '  n_'||replace(id, '-', '_')||CASE WHEN label = 'Fact' THEN '>' ELSE '[' END||CASE WHEN regexp_matches(n, '["\\[\\](){{}}|<>/\\\\#&;]') THEN '"'||replace(n, '"', '#quot;')||'"' ELSE n END||']' AS line FROM s""",
        "mermaid_links": f"WITH {_E} SELECT id, '  n_'||replace(start_id, '-', '_')||' -->|'||label||'| n_'||replace(end_id, '-', '_') AS line FROM e",
        "agtype_parse": "SELECT 'vertex' AS kind, n_nationkey::VARCHAR AS id, 'Nation' AS label, n_name AS name, n_regionkey::VARCHAR AS region FROM nation",
    }
