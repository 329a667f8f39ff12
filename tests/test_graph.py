import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from factloom.model import EDGE, VERTEX, GraphError
from factloom.operators import export, facts, neighbours, search, stats, traverse
from factloom.operators.contain import containment
from factloom.sources.graph import Graph, current_edges, current_vertices


def graph(spark, n, edges, deleted=()):
    t = datetime(2025, 1, 1)
    v = [("T", f"v{k}", f"name {k}", {}, t + timedelta(days=k), None, None, k in deleted, None, k) for k in range(n)]
    e = [("L" if k % 2 else "M", f"e{k}", f"v{a}", f"v{b}", {}, t, None, k) for k, (a, b) in enumerate(edges)]
    return Graph(spark.createDataFrame(v, VERTEX).cache(), spark.createDataFrame(e, EDGE).cache())


def trails(n, edges, start, depth):
    """Vertices and edges on undirected trails of at most `depth` edges; whether one comes back to the start."""
    nodes, used, back = {start}, set(), False

    def walk(v, seen):
        nonlocal back
        if len(seen) == depth:
            return
        for k, (a, b) in enumerate(edges):
            if k not in seen and v in (a, b):
                w = b if v == a else a
                nodes.add(w)
                used.update(seen | {k})
                back = back or w == start
                walk(w, seen | {k})

    walk(start, frozenset())
    return nodes, used, back


@pytest.mark.parametrize("seed", range(4))
def test_traversal_equals_trails(spark, seed):
    r = random.Random(seed)
    n = r.randrange(4, 8)
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(r.randrange(3, 9))]
    deleted = {k for k in range(1, n) if r.random() < 0.25}
    g = graph(spark, n, edges, deleted)
    depth = r.randrange(1, 5)
    nodes, used, back = trails(n, edges, 0, depth)
    assert {r["id"] for r in traverse.hops(g, ["v0"], depth).collect()} == {f"v{k}" for k in nodes}
    assert {r["id"] for r in traverse.path_edges(g, ["v0"], depth).collect()} == {f"e{k}" for k in used}
    assert traverse.returns(g, "v0", depth) == back
    alive = [edges[k] for k in used if not {*edges[k]} & deleted]
    reach = {0}
    while more := {x for a, b in alive if {a, b} & reach for x in (a, b)} - reach:
        reach |= more
    c = traverse.Connections(g, "v0", depth)
    assert {r["id"] for r in c.entities.collect()} == {f"v{k}" for k in reach - {0}}
    assert {r["id"] for r in c.relationships.collect()} == {f"e{k}" for k in used if {*edges[k]} <= reach and not {*edges[k]} & deleted}
    want = sorted(((nodes - {0}) | ({0} if back else set())) - deleted, reverse=True)
    assert [r["id"] for r in traverse.timeline(g, "v0", depth, None).collect()] == [f"v{k}" for k in want]


def test_types_deletion_and_bounds(spark):
    g = graph(spark, 5, [(0, 1), (1, 2), (0, 3), (3, 4)], {3})
    assert {r["id"] for r in traverse.hops(g, ["v0"], 3, ["M"]).collect()} == {"v0", "v1", "v3"}
    assert {r["id"] for r in traverse.Connections(g, "v0", 3).entities.collect()} == {"v1", "v2"}
    with pytest.raises(GraphError):
        traverse.hops(g, ["v0"], 11)


def test_neighbours(spark):
    g = graph(spark, 4, [(0, 1), (0, 2), (3, 0), (0, 0)], {2})
    got = neighbours.relationships(g, "v0").collect()
    assert [(r["direction"], r["id"]) for r in got] == [("out", "e3"), ("out", "e0"), ("in", "e3"), ("in", "e2")]
    assert neighbours.relationships(g, "v0", "out", limit=1).count() == 1 and neighbours.relationships(g, "v0", "both", "L").count() == 2
    flat = neighbours.with_names(g.edges.withColumn("properties", F.create_map(F.lit("from"), F.lit("x"), F.lit("id"), F.lit("y"))), g.vertices.filter("id != 'v1'")).filter("id = 'e0'").first()
    assert (flat["from_name"], flat["to_name"], flat["properties"]) == ("name 0", "v1", {"prop_from": "x"})


def test_search(spark):
    rows = [("A", "1", "Ann"), ("A", "2", "Annabel"), ("B", "3", "Joann"), ("B", "4", "ann"), ("A", "5", "x"), ("A", "6", None)]
    v = spark.createDataFrame([(a, b, c, {}, None, None, None, b == "9", None, 0) for a, b, c in rows], VERTEX)
    assert [(r["id"], r["score"]) for r in search.search(v, " ANN ", ["A", "B"]).collect()] == [("1", 1.0), ("4", 1.0), ("2", 0.8), ("3", 0.6)]
    assert [r["id"] for r in search.search(v, "ann", ["A", "B"], "B", exact=True).collect()] == ["4"] and search.search(v, " ").count() == 0
    assert [r["id"] for r in search.search(v, "xylophone", ["A"]).collect()] == ["5"]
    with pytest.raises(GraphError, match='Invalid entity type: "C". Valid types: A, B'):
        search.search(v, "a", ["A", "B"], "C")
    got = {r["query"]: (r["status"], r["id"]) for r in search.resolve_many(v, ["annab", "ann", "zz", " "], ["A", "B"]).collect()}
    assert got == {"annab": ("ambiguous", None), "ann": ("ambiguous", None), "zz": ("not_found", None), " ": ("not_found", None)}
    assert [r["name"] for r in search.listing(v.filter("name is not null"), limit=3).collect()] == ["ann", "Ann", "Annabel"]
    assert [r["id"] for r in search.by_name(v, "ANN", ["A", "B"]).collect()] == ["1"]


def test_facts_stats_and_export(spark):
    t = datetime(2025, 1, 1)
    v = [("Person", "p", "P", {}, t, None, None, False, None, 0), ("Person", "d", "D", {}, t, None, None, True, None, 0)] + [("Fact", f"f{k}", f"fact {k}", {}, t + timedelta(days=k), None, None, k == 3, None, k) for k in range(4)]
    e = [("RELATES_TO", f"r{k}", f"f{k}", "p", {}, t, None, 0) for k in range(4)] + [("SUPERSEDED_BY", "s", "f0", "f1", {}, t, None, 0), ("KNOWS", "k", "p", "d", {}, t, None, 0)]
    g = Graph(spark.createDataFrame(v, VERTEX), spark.createDataFrame(e, EDGE))
    assert [(r["id"], r["superseded"]) for r in facts.facts_of(g, "p").collect()] == [("f0", True), ("f1", False), ("f2", False)]
    assert {r["id"] for r in facts.active_facts(g).collect()} == {"f1", "f2"} and [tuple(r) for r in facts.active_counts(g).collect()] == [("p", 2)]
    assert {tuple(r) for r in stats.vertex_counts(g, ["Person", "Fact", "Team"]).collect()} == {("Person", 1), ("Fact", 3), ("Team", 0)}
    assert {tuple(r) for r in stats.edge_counts(g, ["KNOWS", "NONE"]).collect()} == {("KNOWS", 1), ("NONE", 0)}
    assert {r["id"]: (r["entity_id"], r["superseded_by"]) for r in export.facts(g).collect()}["f0"] == ("p", "f1") and export.facts(g).count() == 4
    assert export.relationships(g).count() == 6 and export.entities(g).count() == 1
    first, cursor = export.page(export.facts(g), None, 3)
    rest, end = export.page(export.facts(g), cursor, 3)
    assert [r["id"] for r in first.collect()] == ["f0", "f1", "f2"] and cursor == "f2" and [r["id"] for r in rest.collect()] == ["f3"] and end is None
    with pytest.raises(GraphError):
        export.lines(g, ["bad"])


def test_written_export(spark, tmp_path):
    g = graph(spark, 3, [(0, 1)])
    export.write_lines(g, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).groupBy("section").count().count() == 2


def test_current_state(spark):
    schema = "id string, graph_name string, name string, entity_type string, properties string, confidence double, created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz, ingested_at timestamp_ntz"
    t = [datetime(2025, 1, k) for k in range(1, 4)]
    rows = [(" A ", "g", "old", "T", '{"a": "1"}', None, t[0], None, None, t[0]), ("a", "g", "new", "T", None, 0.5, t[0], None, t[1], t[1]), (None, "g", "x", "T", None, None, t[0], None, None, t[0]), ("b", "g", None, None, "bad", None, None, None, None, None)]
    got = {r["id"]: r for r in current_vertices(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {"a", "b"} and got["a"]["name"] == "new" and got["a"]["deleted"] and not got["b"]["deleted"]
    rel = spark.createDataFrame([("r", "a", " B ", "L", None, t[0], t[0]), ("r", "a", "c", "L", None, t[0], t[1]), ("q", None, "c", "L", None, t[0], t[1])], "id string, from_id string, to_id string, rel_type string, properties string, created_at timestamp_ntz, ingested_at timestamp_ntz")
    assert [(r["id"], r["end_id"]) for r in current_edges(rel).collect()] == [("r", "c")]


def test_containment(spark):
    r = random.Random(8)
    texts = ["".join(r.choice("ab c") for _ in range(r.randrange(0, 7))) for _ in range(60)] + [None, ""]
    other = ["".join(r.choice("ab c") for _ in range(r.randrange(0, 12))) for _ in range(60)] + [None]
    frame = lambda x: spark.createDataFrame([(t,) for t in x], "t string")
    got = {tuple(x) for x in containment(frame(texts), frame(other)).collect()}
    assert got == {(a, b) for a in texts if a for b in other if b and a in b}


def test_ad_hoc_queries(spark):
    g = graph(spark, 3, [(0, 1), (1, 2)])
    got = g.sql("SELECT v.name, count(*) AS n FROM {edges} e JOIN {vertices} v ON v.id = e.end_id WHERE v.name = :name GROUP BY 1", {"name": "name 2"})
    assert [tuple(r) for r in got.collect()] == [("name 2", 1)] and g.sql("SELECT * FROM {vertices} WHERE name = :n", {"n": "' OR '1'='1"}).count() == 0


def test_resolving_many_and_few_queries_is_the_same(spark, monkeypatch):
    names = ["Ann", "Anna", "Ann Lee", "", None, "lee", "Bo", "boann", "é", " x "]
    v = spark.createDataFrame([("P", f"i{k}", n, False) for k, n in enumerate(names)], "label string, id string, name string, deleted boolean")
    asked = ["ann", " ANN lee ", "o", "", " ", "zz", "é", "Ann", "a long text with lee inside"]
    few = sorted(map(tuple, search.resolve_many(v, asked, ["P"]).collect()))
    monkeypatch.setattr(search, "FEW_QUERIES", 0)
    assert few == sorted(map(tuple, search.resolve_many(v, asked, ["P"]).collect())) and len(few) == len(asked)


def test_large_frontiers_give_the_same(spark, monkeypatch):
    r = random.Random(8)
    edges = spark.createDataFrame([("K", f"e{k}", f"v{r.randrange(30)}", f"v{r.randrange(30)}", {}, None) for k in range(40)], "label string, id string, start_id string, end_id string, properties map<string,string>, created_at timestamp_ntz")
    vertices = spark.createDataFrame([("P", f"v{k}", f"n{k}", {}, None, k % 7 == 3) for k in range(30)], "label string, id string, name string, properties map<string,string>, created_at timestamp_ntz, deleted boolean")

    def results():
        g = Graph(vertices, edges)
        c = traverse.Connections(g, "v1", 3)
        return [sorted(map(tuple, df.collect())) for df in (traverse.hops(g, ["v1"], 3), traverse.path_edges(g, ["v1"], 3).select("id"), c.entities.select("id", "dist"), c.envelope(5))], traverse.returns(g, "v1", 4)

    one = results()
    monkeypatch.setattr(traverse, "LITERALS", 0)
    assert one == results() and len(one[0][0]) > 3
