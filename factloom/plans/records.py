"""Queries over the record tables: hierarchies, orphans, heavy keys; each with equivalent SQL where SQL can express it."""

from __future__ import annotations

from factloom.operators.hierarchy import Hierarchy, find_roots
from factloom.operators.orphans import OrphanTracker, parent_rows, reference_rows, track
from factloom.operators.skew import degrees, heavy_keys
from factloom.sources.tables import table


def _tracked(spark, d) -> OrphanTracker:
    refs = [reference_rows(table(spark, d, "relationships"), "relationships", ["from_id", "to_id"]), reference_rows(table(spark, d, "facts"), "facts", ["entity_id"])]
    return track(refs, [parent_rows(table(spark, d, t)) for t in ("entities", "core_entities")])


def queries() -> dict:
    return {
        "p1_found": lambda spark, d: find_roots(table(spark, d, "facts")),
        "p1_hierarchy": lambda spark, d: Hierarchy(table(spark, d, "facts")).nodes().select("fact_id", "root_id", "depth", "n_descendants", "in_cycle"),
        "p1_paths": lambda spark, d: Hierarchy(table(spark, d, "facts")).paths().selectExpr("fact_id", "array_join(path, '>') as path"),
        "p1_descendants": lambda spark, d: Hierarchy(table(spark, d, "facts")).descendants(),
        "p2_found": lambda spark, d: _tracked(spark, d).found(),
        "p2_monthly": lambda spark, d: _tracked(spark, d).monthly(),
        "p3_found": lambda spark, d: heavy_keys(table(spark, d, "relationships"), ["from_id", "to_id"]),
        "p3_degrees": lambda spark, d: degrees(table(spark, d, "relationships")),
    }


#: Canonical id in DuckDB's SQL.
def _c(x: str) -> str:
    return f"nullif(lower(trim({x}, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(160))), '')"


_LINKS = f"""n AS (SELECT {_c("id")} AS id, max({_c("superseded_by")}) AS p FROM facts GROUP BY 1),
e AS (SELECT a.id AS c, a.p AS p FROM n a JOIN n b ON a.p = b.id),
w AS (SELECT c AS id, [c] AS path, p AS nxt FROM e
      UNION ALL SELECT w.id, list_append(w.path, w.nxt), e.p FROM w LEFT JOIN e ON e.c = w.nxt WHERE w.nxt IS NOT NULL AND NOT list_contains(w.path, w.nxt)),
f AS (SELECT id, path, nxt, CASE WHEN nxt IS NULL THEN path[-1] ELSE list_min(path[list_position(path, nxt):]) END AS root FROM w
      WHERE nxt IS NULL OR list_contains(path, nxt))"""

_REFS = f"""refs AS (SELECT 'relationships' AS ref_table, {_c("id")} AS ref_id, 'from_id' AS ref_field, {_c("from_id")} AS k, min(ingested_at) AS t FROM relationships GROUP BY ALL
  UNION ALL SELECT 'relationships', {_c("id")}, 'to_id', {_c("to_id")}, min(ingested_at) FROM relationships GROUP BY ALL
  UNION ALL SELECT 'facts', {_c("id")}, 'entity_id', {_c("entity_id")}, min(ingested_at) FROM facts GROUP BY ALL),
v AS (SELECT {_c("id")} AS k, min(ingested_at) AS seen, min(deleted_at) AS gone FROM (SELECT id, ingested_at, deleted_at FROM entities UNION ALL SELECT id, ingested_at, deleted_at FROM core_entities) GROUP BY 1),
r AS (SELECT refs.*, seen, gone, coalesce(seen <= t AND (gone IS NULL OR t < gone), false) AS live FROM refs LEFT JOIN v USING (k) WHERE refs.k IS NOT NULL)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH RECURSIVE {_LINKS} SELECT id AS fact_id, root AS root_id FROM f",
        "p1_hierarchy": f"""WITH RECURSIVE {_LINKS},
            full_path AS (SELECT id, root, CASE WHEN list_contains(path, root) THEN path[:list_position(path, root)] ELSE path END AS path, nxt IS NOT NULL AND list_contains(path[list_position(path, nxt):], id) AS ring FROM f),
            anc AS (SELECT unnest(path[2:]) AS a FROM full_path), cnt AS (SELECT a, count(*) AS k FROM anc GROUP BY 1)
            SELECT n.id AS fact_id, coalesce(root, n.id) AS root_id, depth, n_descendants, in_cycle FROM (SELECT n.id, root, coalesce(len(path) - 1, 0) AS depth, coalesce(ring, false) AS in_cycle, coalesce(k, 0) AS n_descendants
            FROM n LEFT JOIN full_path USING (id) LEFT JOIN cnt ON cnt.a = n.id) n""",
        "p1_paths": f"""WITH RECURSIVE {_LINKS} SELECT n.id AS fact_id, coalesce(array_to_string(CASE WHEN list_contains(path, root) THEN path[:list_position(path, root)] ELSE path END, '>'), n.id) AS path FROM n LEFT JOIN f USING (id)""",
        "p1_descendants": f"""WITH RECURSIVE {_LINKS} SELECT unnest((CASE WHEN list_contains(path, root) THEN path[:list_position(path, root)] ELSE path END)[2:]) AS fact_id, id AS descendant_id FROM f""",
        "p2_found": f"WITH {_REFS} SELECT ref_table, ref_id, ref_field FROM r WHERE NOT live",
        "p2_monthly": f"""WITH {_REFS}, ch AS (
            SELECT ref_table, t AS moved, 1 AS c FROM r WHERE NOT live
            UNION ALL SELECT ref_table, seen, -1 FROM r WHERE NOT live AND seen > t
            UNION ALL SELECT ref_table, gone, 1 FROM r WHERE NOT live AND seen > t AND gone IS NOT NULL
            UNION ALL SELECT ref_table, gone, 1 FROM r WHERE live AND gone IS NOT NULL),
            m AS (SELECT ref_table, date_trunc('month', moved) AS month, sum(c) AS c FROM ch GROUP BY ALL),
            a AS (SELECT ref_table, date_trunc('month', t) AS month, count(*) AS n FROM r WHERE NOT live GROUP BY ALL)
            SELECT ref_table, strftime(month, '%Y-%m') AS month, coalesce(n, 0)::BIGINT AS n_arrived, (sum(c) OVER (PARTITION BY ref_table ORDER BY month))::BIGINT AS n_open FROM m LEFT JOIN a USING (ref_table, month)""",
        "p3_found": f"""SELECT field, key_id FROM (SELECT 'from_id' AS field, {_c("from_id")} AS key_id FROM relationships UNION ALL SELECT 'to_id', {_c("to_id")} FROM relationships)
            WHERE key_id IS NOT NULL GROUP BY ALL HAVING count(*) >= 0.02 * (SELECT count(*) FROM relationships)""",
        "p3_degrees": f"""WITH o AS (SELECT {_c("id")} AS id, min({_c("from_id")}) AS f, min({_c("to_id")}) AS t, min(rel_type) AS rel_type FROM relationships GROUP BY 1),
            b AS (SELECT f AS v, t AS n, 'out' AS direction, rel_type FROM o UNION ALL SELECT t, f, 'in', rel_type FROM o)
            SELECT v AS vertex_id, direction, rel_type, count(*) AS n_links, count(DISTINCT n) AS n_neighbours FROM b WHERE v IS NOT NULL GROUP BY ALL""",
    }
