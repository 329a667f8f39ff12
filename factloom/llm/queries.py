"""Queries of the operators for training data, with equivalent SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.llm.copies import Copies
from factloom.llm.encode import encode
from factloom.llm.leaks import leaks
from factloom.llm.names import link, resolve, typed_names
from factloom.llm.split import split
from factloom.llm.survivor import MISSING, best_values, survivors
from factloom.sources.tables import table


def _leaks(spark, d):
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def _resolved(spark, d):
    return resolve(typed_names(table(spark, d, "entity_inputs"), table(spark, d, "relationship_inputs")), table(spark, d, "nicknames"))


def queries() -> dict:
    return {
        "p4_found": lambda spark, d: link(_resolved(spark, d)),
        "p4_entities": lambda spark, d: _resolved(spark, d).groupBy("graph_name", "entity").agg(F.count(F.lit(1)).alias("n_spellings"), F.min("name").alias("name")),
        "p5_found": lambda spark, d: best_values(table(spark, d, "entity_inputs"), table(spark, d, "merges")).select("surviving_id", "prop_name", "prop_value"),
        "p5_records": lambda spark, d: survivors(table(spark, d, "entity_inputs"), table(spark, d, "merges")).select("surviving_id", "n_props", "last_at"),
        # its SQL asks for the layers of the records that add something, so only these are layered
        "p5_layers": lambda spark, d: best_values(table(spark, d, "entity_inputs"), table(spark, d, "merges"), "layer", superfluous=False).select("surviving_id", "prop_name", "prop_value", "layer", "n_layers"),
        "p6_found": lambda spark, d: Copies(table(spark, d, "bulk_inputs")).pairs(),
        "p6_records": lambda spark, d: Copies(table(spark, d, "bulk_inputs")).records().select("record_id", "name", "n_copies"),
        "p7_ids": lambda spark, d: encode(table(spark, d, "documents")),
        "p8_found": lambda spark, d: _leaks(spark, d).select("doc_id", "item_id"),
        "p8_items": lambda spark, d: _leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs")).join(table(spark, d, "eval_items"), "item_id").select("item_id", "suite", "split", "n_docs"),
        "p8_spans": lambda spark, d: _leaks(spark, d),
        "p9_found": lambda spark, d: split(table(spark, d, "documents"), with_text=False).filter("piece = 0").select("doc_id"),
        "p9_pieces": lambda spark, d: split(table(spark, d, "documents")),
    }


_GRAMS = """w AS (SELECT 'd' AS k, doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM documents UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') FROM eval_items),
p AS (SELECT k, id, ws, unnest(range(1, len(ws) - 10)) AS pos FROM w WHERE len(ws) >= 12),
g AS (SELECT DISTINCT k, id, array_to_string(list_slice(ws, pos, pos + 11), ' ') AS gram FROM p),
found AS (SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM g d JOIN g i ON d.gram = i.gram WHERE d.k = 'd' AND i.k = 'i')"""


_MISSING = ", ".join("'" + m + "'" for m in MISSING)

_BEST = f"""m AS (SELECT DISTINCT surviving_id AS s, merged_id AS m FROM merges),
up AS (SELECT m AS v, s AS root FROM m UNION ALL SELECT up.v, m.s FROM up JOIN m ON m.m = up.root),
r AS (SELECT v, root FROM up WHERE root NOT IN (SELECT m FROM m) UNION SELECT s, s FROM m WHERE s NOT IN (SELECT m FROM m)),
i AS (SELECT DISTINCT root, input_id, received_at, properties FROM entity_inputs JOIN r ON entity_id = v WHERE properties IS NOT NULL),
e AS (SELECT root, input_id, received_at, properties, unnest(json_keys(properties)) AS k FROM i),
x AS (SELECT root, input_id, received_at, k, json_extract_string(properties, '$."' || k || '"') AS val FROM e),
best AS (SELECT root, k, arg_max(val, (received_at, -input_id)) AS val, max(received_at) AS at_ FROM x WHERE val IS NOT NULL AND lower(trim(val)) NOT IN ({_MISSING}) GROUP BY ALL)"""

#: Records that add something, and their layers as the longest chain of records that beat each other.
_LAYERS = f"""{_BEST.split("best AS")[0].rstrip().rstrip(",")},
st AS (SELECT root, input_id, k, val, coalesce(received_at, TIMESTAMP '0001-01-01') AS at_ FROM x WHERE val IS NOT NULL AND lower(trim(val)) NOT IN ({_MISSING})),
rec AS (SELECT root, st.input_id, at_, array_to_string(list_sort(list(DISTINCT k)), '|') AS props, count(DISTINCT k) AS n, coalesce(any_value(confidence), -1.0) AS trust
  FROM st JOIN (SELECT DISTINCT input_id, confidence FROM entity_inputs) c ON c.input_id = st.input_id GROUP BY ALL),
kept AS (SELECT * FROM rec a WHERE NOT EXISTS (SELECT 1 FROM rec b WHERE b.root = a.root AND b.props = a.props
  AND (b.at_ > a.at_ AND b.trust >= a.trust OR b.at_ = a.at_ AND (b.trust > a.trust OR b.trust = a.trust AND b.input_id < a.input_id)))),
beats AS (SELECT b.root, b.input_id AS over_id, a.input_id AS under_id FROM kept a JOIN kept b ON a.root = b.root AND b.at_ >= a.at_ AND b.trust >= a.trust AND b.n >= a.n AND (b.at_ > a.at_ OR b.trust > a.trust OR b.n > a.n)),
chain AS (SELECT root, input_id, 1 AS layer FROM kept UNION SELECT chain.root, under_id, layer + 1 FROM chain JOIN beats ON beats.root = chain.root AND over_id = chain.input_id),
lay AS (SELECT root, input_id, max(layer) AS layer FROM chain GROUP BY ALL)"""

_FORM = """k AS (SELECT record_id, unnest(json_keys(properties)) AS key, properties FROM bulk_inputs),
p AS (SELECT record_id, string_agg(regexp_replace(lower(key), '[^\\p{L}\\p{N}]', '', 'g') || '=' || regexp_replace(lower(json_extract_string(properties, '$."' || key || '"')), '[^\\p{L}\\p{N}]', '', 'g'), ',' ORDER BY key) AS props FROM k GROUP BY 1),
f AS (SELECT record_id, b.name AS raw, graph_name, confidence, regexp_replace(lower(b.name), '[^\\p{L}\\p{N}]', '', 'g') AS name, regexp_replace(lower(entity_type), '[^\\p{L}\\p{N}]', '', 'g') AS kind, coalesce(props, CASE WHEN properties IS NULL THEN NULL ELSE '' END) AS props
  FROM bulk_inputs b LEFT JOIN p USING (record_id)),
g AS (SELECT record_id, raw, min(record_id) OVER w AS first_id, count(*) OVER w AS n FROM f WINDOW w AS (PARTITION BY graph_name, confidence, name, kind, props))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": f"WITH RECURSIVE {_BEST} SELECT root AS surviving_id, k AS prop_name, val AS prop_value FROM best",
        "p5_records": f"WITH RECURSIVE {_BEST} SELECT root AS surviving_id, count(*) AS n_props, max(at_) AS last_at FROM best GROUP BY 1",
        "p5_layers": f"""WITH RECURSIVE {_LAYERS} SELECT root AS surviving_id, k AS prop_name, arg_max(val, (-layer, at_, trust, n, -input_id)) AS prop_value, min(layer)::INTEGER AS layer, count(DISTINCT layer)::INTEGER AS n_layers
            FROM st JOIN kept USING (root, input_id, at_) JOIN lay USING (root, input_id) GROUP BY root, k""",
        "p6_found": f"WITH {_FORM} SELECT first_id, record_id AS copy_id FROM g WHERE record_id != first_id",
        "p6_records": f"WITH {_FORM} SELECT record_id, raw AS name, n AS n_copies FROM g WHERE record_id = first_id",
        "p8_found": f"WITH {_GRAMS} SELECT doc_id, item_id FROM found",
        "p8_spans": f"""WITH {_GRAMS}, q AS (SELECT k, id, pos, array_to_string(list_slice(ws, pos, pos + 11), ' ') AS gram FROM p), m AS (SELECT d.id AS doc_id, i.id AS item_id, d.pos AS dp, i.pos AS ip FROM q d JOIN q i ON d.gram = i.gram WHERE d.k = 'd' AND i.k = 'i'),
            o AS (SELECT *, dp - ip AS diagonal, dp - row_number() OVER (PARTITION BY doc_id, item_id, dp - ip ORDER BY dp) AS run FROM m),
            r AS (SELECT doc_id, item_id, min(dp) - 1 AS doc_word, min(ip) - 1 AS item_word, count(*) + 11 AS n_words FROM o GROUP BY doc_id, item_id, diagonal, run)
            SELECT DISTINCT ON (doc_id, item_id) doc_id, item_id, doc_word, item_word, n_words FROM r ORDER BY doc_id, item_id, n_words DESC, doc_word, item_word""",
        "p8_items": f"WITH {_GRAMS} SELECT item_id, suite, split, count(*) AS n_docs FROM found JOIN eval_items USING (item_id) GROUP BY ALL",
    }
