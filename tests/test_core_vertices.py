from datetime import datetime

from factloom.plans import changes, graph

T = datetime(2025, 1, 1)
VERTEX = "id string, graph_name string, name string, entity_type string, properties string, confidence double, created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz, ingested_at timestamp_ntz"
TABLES = {
    "entities": ([("e1", "g", "Own", "Person", None, None, T, None, None, T)], VERTEX),
    "core_entities": ([(" C1 ", None, "Gabriel Core", "Team", None, None, T, None, None, T)], VERTEX),
    "relationships": ([("r1", "e1", "c1", "WORKS_AT", None, T, T), ("r2", "C1", "x", "OWNS", None, T, T)], "id string, from_id string, to_id string, rel_type string, properties string, created_at timestamp_ntz, ingested_at timestamp_ntz"),
    "entity_inputs": ([], "input_id long, graph_name string, name string, entity_type string, properties string, confidence double, source string, entity_id string, received_at timestamp_ntz, ingested_at timestamp_ntz"),
    "relationship_inputs": ([(1, "g", "Own", "gabriel core", None, None, "OWNS", None, T)], "input_id long, graph_name string, from_name string, to_name string, from_type string, to_type string, rel_type string, properties string, received_at timestamp_ntz"),
}


def test_core_vertices_are_seen(spark, tmp_path):
    for name, (rows, schema) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    q, d = graph.queries() | changes.queries(), str(tmp_path)
    assert {(r["id"], r["from_name"], r["to_name"]) for r in q["relationships_flat"](spark, d).collect()} == {("r1", "Own", "Gabriel Core"), ("r2", "Gabriel Core", "x")}
    assert [(r["id"], r["score"]) for r in q["search_memory"](spark, d).collect()] == [("c1", 0.8)]
    assert {(r["field"], r["id"], r["failed"]) for r in q["bulk_resolve_references"](spark, d).collect()} == {("from", "e1", False), ("to", "c1", False)}
