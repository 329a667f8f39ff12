import json

import pytest

from factloom.api import TOOLS, GraphMemory
from factloom.config import Config
from factloom.sources.store import GraphStore


@pytest.fixture(scope="module")
def memory(spark, tmp_path_factory):
    m = GraphMemory(GraphStore(spark, f"file://{tmp_path_factory.mktemp('store')}/g"), Config(query_limits=Config().query_limits.__class__(query_timeout_ms=60000)))
    out = m.remember_knowledge(
        entities=[
            {"name": "Alice", "type": "Person", "properties": {"role": "CTO"}}, {"name": " Bob ", "type": "Person", "properties": {"role": "Engineer"}},
            {"name": "Project Atlas", "type": "Project"}, {"name": "Project Zenith", "type": "Project"}, {"name": "Atlas", "type": "Team"}, {"name": "", "type": "Team"}, {"name": "X", "type": "Nope"},
        ],
        relationships=[
            {"from": "alice", "to": "Bob", "type": "REPORTS_TO", "properties": {"since": 2024}}, {"from": "Alice", "to": "Project Atlas", "type": "OWNS"},
            {"from": "Bob", "to": "Nobody at all", "type": "OWNS"}, {"from": "Bob", "to": "Alice", "type": "OWNS", "properties": {"from": "x"}}, {"from": "Bob", "to": "Atlas", "type": "WORKS_AT", "to_type": "Team"},
        ],
    )
    d = out.data
    assert (d["entities_created"], d["relationships_created"], [f["index"] for f in d["relationships_failed"]], [f["index"] for f in d["entities_failed"]]) == (5, 3, [2, 3], [5, 6])
    return m


def test_definitions(memory):
    assert [t["name"] for t in memory.definitions()] == list(TOOLS) and len(TOOLS) == 17
    assert memory.call("nothing").is_error and memory.recall_entity().is_error


def test_upsert_keeps_id_and_merges(memory):
    a = memory.remember_entity(name="Alice", type="Person", properties={"email": "a@x"}, confidence=0.9).data
    assert a["status"] == "updated"
    got = memory.recall_entity(identifier="alice", include_relationships=True).data
    assert got["id"] == a["id"] and got["properties"]["role"] == "CTO" and got["properties"]["email"] == "a@x" and got["properties"]["confidence"] == 0.9
    assert {(r["type"], r["to"]) for r in got["relationships"]} == {("REPORTS_TO", "Bob"), ("OWNS", "Project Atlas")}
    assert memory.remember_entity(name="Q", type="Person", confidence=0.2).text == "Confidence 0.2 is below minimum threshold 0.6."
    assert memory.remember_entity(name="Q", type="Person", confidence=2).text == "Confidence must be 0.0-1.0."
    assert "Invalid entity type" in memory.remember_entity(name="Q", type="Planet").text
    injected = "'; DROP TABLE x; -- $$}) RETURN 1; \"q\""
    assert memory.remember_entity(name=injected, type="Topic").data["status"] == "created"
    assert memory.search_entities(query=injected, exact=True).data["count"] == 1
    memory.forget_entity(identifier=injected)


def test_search_and_listing(memory):
    hits = memory.search_entities(query="atlas").data["results"]
    assert [(h["name"], h["score"]) for h in hits] == [("Atlas", 1.0), ("Project Atlas", 0.6)]
    assert memory.search_entities(query="  ").data["count"] == 0
    assert [e["name"] for e in memory.list_entities(type_filter="Project").data["entities"]] == ["Project Atlas", "Project Zenith"]
    assert memory.list_entities(type_filter="Planet").is_error
    two = memory.remember_relationship(**{"from": "Project", "to": "Bob", "type": "OWNS"}).data
    assert two["needs_disambiguation"] and two["field"] == "from" and len(two["candidates"]) == 2


def test_connections_and_context(memory):
    c = memory.recall_connections(identifier="Alice", depth=2, include_mermaid=True).data
    assert {e["name"] for e in c["entities"]} == {"Bob", "Project Atlas", "Atlas"} and not c["truncated"]
    assert c["mermaid"].startswith("graph LR\n") and "-->|OWNS|" in c["mermaid"]
    one = memory.recall_connections(identifier="Alice", depth=1, limit=1, relationship_types=["OWNS"]).data
    assert (one["total_count"], len(one["entities"]), one["truncated"]) == (1, 1, False)
    assert "Invalid depth: 11" in memory.recall_connections(identifier="Alice", depth=11).text
    assert "Limit must be between 1 and 200" in memory.recall_connections(identifier="Alice", limit=0).text
    assert memory.recall_context(identifier="Alice", sections=[]).text == "At least one section required"
    assert set(memory.recall_context(identifier="Alice", depth=1, sections=["entity"]).data) == {"entity"}


def test_facts(memory):
    a = memory.supersede_fact(entity="Bob", new_fact="Bob is a junior", source="chat", confidence=0.8).data
    assert a["old_fact_id"] is None
    b = memory.supersede_fact(entity="Bob", new_fact="Bob is a senior", old_fact="Bob is a junior").data
    assert b["old_fact_id"] == a["new_fact_id"]
    c = memory.supersede_fact(entity="Bob", new_fact="Bob likes tea", old_fact="Bob likes \"coffee\"").data
    active = memory.find_contradictions(identifier="Bob").data["facts"]
    assert {f["content"] for f in active} == {"Bob is a senior", "Bob likes tea"} and c["old_fact_id"]
    every = memory.recall_context(identifier="Bob", depth=1, sections=["facts"]).data["facts"]
    assert {f["content"]: f["superseded"] for f in every} == {"Bob is a junior": True, "Bob is a senior": False, "Bob likes tea": False, 'Bob likes "coffee"': True}
    t = memory.recall_timeline(identifier="Bob", last_n=2).data
    assert t["showing"] == 2 and t["total_events"] >= 4 and t["events"][0]["timestamp"] >= t["events"][1]["timestamp"]


def test_merge_transfers_edges(memory):
    memory.remember_knowledge(entities=[{"name": "Bobby T", "type": "Person", "properties": {"role": "Lead", "phone": "1"}}], relationships=[{"from": "Bobby T", "to": "Project Zenith", "type": "OWNS", "properties": {"since": 1}}, {"from": "Bobby T", "to": "Atlas", "type": "WORKS_AT", "to_type": "Team"}])
    m = memory.merge_entities(surviving="Bob", merged="Bobby T").data
    assert m["status"] == "merged"
    got = memory.recall_entity(identifier=m["surviving_id"], include_relationships=True).data
    assert got["properties"]["role"] == "Engineer" and got["properties"]["phone"] == "1" and got["properties"]["merged_from"] == m["merged_id"]
    assert sorted((r["type"], r["to"]) for r in got["relationships"] if r["from"] == "Bob") == [("OWNS", "Project Zenith"), ("WORKS_AT", "Atlas")]
    assert memory.recall_entity(identifier=m["merged_id"]).data["found"] is False
    assert "different types" in memory.merge_entities(surviving="Bob", merged="Project Zenith").text
    assert "with itself" in memory.merge_entities(surviving="Bob", merged=m["surviving_id"]).text


def test_stats_export_and_compaction(memory):
    before = memory.graph_stats().data
    assert before["healthy"] and before["entity_counts"]["Project"] == 2 and before["entity_counts"]["Meeting"] == 0
    lines = [json.loads(x) for x in memory.export_graph().text.split("\n")]
    assert {x["section"] for x in lines} == {"entities", "relationships", "facts"}
    assert memory.export_graph(sections=[]).text == "" and 'Invalid section: "x"' in memory.export_graph(sections=["x"]).text
    memory.store.compact()
    assert memory.graph_stats().data == before


def test_schema_additions_persist(memory, spark):
    args = dict(action="add", name="Vendor", properties=["name"], extraction_hint="who sells us hardware or services", examples=["a", "b", "c"])
    assert memory.update_memory_schema(**args).data == {"added": "Vendor", "total_types": 12}
    assert "already exists" in memory.update_memory_schema(**args).text
    again = GraphMemory(GraphStore(spark, memory.store.root))
    assert "Vendor" in again.registry.types and again.get_memory_schema(compact=True).data["guardrails"] == {"max_entity_types": 15}
