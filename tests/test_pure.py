import pytest

from factloom import model
from factloom.config import Guardrails, jdbc_url, load_config
from factloom.functions.agtype import parse, parse_rows
from factloom.functions.similarity import most_similar, similarity, trigrams
from factloom.model import GraphError
from factloom.operators import mermaid
from factloom.schema import markdown
from factloom.schema.presets import PRESETS, EntityType, from_json, preset
from factloom.schema.registry import Registry


def test_trigrams():
    assert trigrams("abc") == {" ab", "abc", "bc "} and trigrams("") == set() and len(trigrams("a")) == 1 and len(trigrams("ab")) == 2
    assert similarity("Person", "Person") == similarity("Person", "person") == 1 and similarity("", "test") == 0
    assert similarity("Person", "Persons") == 0.625 and similarity("Person", "Project") < 0.5
    assert most_similar("b", ["x", "b", "B"]) == ("b", 1.0) and most_similar("b", []) is None and most_similar("zz", ["p", "q"]) == ("p", 0.0)


@pytest.mark.parametrize("name", ["Person", "WORKS_AT", "Ab", "A" * 31])
def test_identifiers(name):
    assert model.check_identifier(name, "x") == name


@pytest.mark.parametrize("name", ["A", "1Person", "_deleted", "My Person", "A" * 32, "", "Ab\n", None])
def test_bad_identifiers(name):
    with pytest.raises(GraphError):
        model.check_identifier(name, "x")


def test_keys_and_depth():
    assert [model.check_property_key(k) for k in ("name", "_deleted", "_deleted_at")]
    for k in ("", "bad key", "key;DROP", "__"):
        with pytest.raises(GraphError):
            model.check_property_key(k)
    with pytest.raises(GraphError, match="'from' is a reserved relationship field"):
        model.check_edge_properties({"from": 1})
    assert [model.check_depth(d) for d in (1, 3, 10, 2.0)] == [1, 3, 10, 2]
    for d in (0, -1, 11, 1.5, float("nan"), float("inf"), "3", True, None):
        with pytest.raises(GraphError, match="Must be an integer between 1 and 10"):
            model.check_depth(d)


def test_guardrails():
    new = lambda name, hint="something else entirely", n=3: EntityType(name, ["name"], hint, ["x"] * n)
    r = Registry(preset("dev-team"))
    assert r.add(new("Vendor")) == 12
    for bad, message in ((new("Person"), "already exists"), (new("Bad Type!"), "Invalid entity type name"), (new("Planet", "a body that circles a star", n=2), "At least 3 examples required. Got 2."), (new("Planet", r.get("Person").extraction_hint), "100% similar to existing type \"Person\"")):
        with pytest.raises(GraphError, match=message):
            r.add(bad)
    with pytest.raises(GraphError, match="63% similar"):
        Registry(preset("dev-team"), Guardrails(similarity_threshold=0.6)).add(new("Persons"))
    with pytest.raises(GraphError, match="Maximum 11 entity types reached"):
        Registry(preset("dev-team"), Guardrails(max_entity_types=11)).add(new("Vendor"))
    assert preset("dev-team").entity_types != r.preset.entity_types


def test_presets():
    assert {n: (len(p.entity_types), len(p.relationship_types)) for n, p in PRESETS.items()} == {"dev-team": (11, 13), "coding-agent": (9, 10), "executive-assistant": (9, 10)}
    with pytest.raises(GraphError):
        preset("nope")
    assert from_json('{"name": "x", "entity_types": [{"name": "A1"}], "relationship_types": ["R1"]}').relationship_types == ["R1"]


def test_markdown_round_trip(tmp_path, spark):
    p = preset("coding-agent")
    assert markdown.parse(markdown.render(p)) == ([t.name for t in p.entity_types], p.relationship_types)
    assert markdown.parse("") == ([], []) and markdown.parse("## Other\n### X\n- `Y`") == ([], [])
    markdown.write_file(str(tmp_path / "s.md"), p)
    assert markdown.read_file(str(tmp_path / "s.md"))[1] == p.relationship_types and markdown.read_file(str(tmp_path / "no.md")) is None
    frame = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert {tuple(r) for r in markdown.reconcile(frame("Person", "Project", "Custom"), frame("Person", "Project")).collect()} == {("Person", "common"), ("Project", "common"), ("Custom", "only_in_file")}


def test_config():
    assert load_config({}, {}).query_limits.max_depth == 3
    c = load_config({"query_limits": {"max_depth": 4}, "preset": "coding-agent"}, {"FACTLOOM_MAX_DEPTH": "5", "FACTLOOM_SIMILARITY_THRESHOLD": "0.5", "FACTLOOM_JDBC_PASSWORD": "p@ss/word"})
    assert (c.query_limits.max_depth, c.guardrails.similarity_threshold, c.preset) == (5, 0.5, "coding-agent")
    assert jdbc_url(c.jdbc | {"user": "me", "host": "db"}) == "jdbc:postgresql://db:5432/postgres?user=me&password=p%40ss%2Fword"
    for base in ({"query_limits": {"max_depth": 11}}, {"guardrails": {"max_entity_types": "x"}}, {"graph_name": "1bad"}, {"query_limits": {"max_limit": 1.5}}):
        with pytest.raises(GraphError):
            load_config(base, {})


def test_graph_values():
    assert [parse(x) for x in ('"hello"', "42", "42::numeric", "3.14::float8", "not-json", "null", None, "[1, 2]", "true")] == ["hello", 42, 42, 3.14, "not-json", None, None, [1, 2], True]
    v = parse('{"id": 844424930131969, "label": "Person", "properties": {"name": "A", "n": "5::numeric", "l": [{"x": "std::vector"}]}}::vertex')
    assert v == {"type": "vertex", "id": "844424930131969", "label": "Person", "properties": {"name": "A", "n": 5, "l": [{"x": "std"}]}}
    e = '{"id": 1, "label": "K", "start_id": 2, "end_id": 3, "properties": {"t": "a}::vertex, {"}}::edge'
    assert parse(e)["start_id"] == "2" and parse(e)["end_id"] == "3"
    p = parse('[{"id": 2, "label": "P", "properties": {}}::vertex, ' + e + ', {"id": 3, "label": "P", "properties": {}}::vertex]::path')
    assert [x["id"] for x in p["vertices"]] == ["2", "3"] and [x["id"] for x in p["edges"]] == ["1"]
    assert parse_rows([{"a": "1", "b": "x::y z"}]) == [{"a": 1, "b": "x::y z"}]


def test_diagrams(spark):
    assert mermaid.render([], []) == ("graph LR\n  empty[No entities found]", False)
    ents = [{"id": f"a-{k}", "name": n, "type": t} for k, (n, t) in enumerate([("Ann", "Person"), ('Say "hi"', "Decision"), ("M" * 50, "Meeting"), ("F", "Fact"), ("S", "Skill"), ("R", "Repository"), ("?", "Odd")])]
    text, cut = mermaid.render(ents, [{"from_id": "a-0", "type": "KNOWS", "to_id": "a-1"}, {"from_id": "a-0", "type": "KNOWS", "to_id": "zz"}])
    assert text.split("\n") == ["graph LR", "  n_a_0(Ann)", '  n_a_1{"Say #quot;hi#quot;"}', f"  n_a_2[[{'M' * 37}...]]", "  n_a_3>F]", "  n_a_4{{S}}", "  n_a_5[R]", "  n_a_6[?]", "  n_a_0 -->|KNOWS| n_a_1"] and not cut
    text, cut = mermaid.render(ents * 5, [], 5)
    assert cut and text.endswith("%% Truncated: showing 5 of 35 nodes") and len(text.split("\n")) == 7
    df = spark.createDataFrame([(e["id"], e["name"], e["type"]) for e in ents], "id string, name string, label string")
    assert [r["line"] for r in mermaid.node_lines(df).orderBy("id").collect()] == mermaid.render(ents, [])[0].split("\n")[1:]
    # only characters that mean something in a diagram are quoted
    assert [mermaid.label(x) for x in ("v1.2", "Dr. Chen", "José", "a/b", "x[1]", "R&D", "#1", "a;b", "p|q")] == ["v1.2", "Dr. Chen", "José", '"a/b"', '"x[1]"', '"R&D"', '"#1"', '"a;b"', '"p|q"']
    edges = spark.createDataFrame([("e", "a-0", "b-1", "KNOWS"), ("f", "a-0", "b-1", "A/B")], "id string, start_id string, end_id string, label string")
    assert [x["line"] for x in mermaid.link_lines(edges).orderBy("id").collect()] == ["  n_a_0 -->|KNOWS| n_b_1", '  n_a_0 -->|"A/B"| n_b_1']
