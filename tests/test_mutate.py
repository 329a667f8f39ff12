import random
from datetime import datetime

from factloom.model import EDGE, VERTEX
from factloom.operators import mutate
from factloom.sources.graph import Graph

T = datetime(2025, 1, 1)
AT = None
BATCH = "ord int, label string, name string, properties map<string,string>, confidence double"


def vertices(spark, rows):
    return spark.createDataFrame([(lab, i, n, p, T, None, c, d, None, k) for k, (lab, i, n, p, c, d) in enumerate(rows)], VERTEX)


def test_upserts_follow_a_model(spark):
    r = random.Random(6)
    stored = [("P", f"i{k}", f"n{k % 6}", {"role": '"old"'}, r.choice([None, 0.5]), r.random() < 0.3) for k in range(10)]
    batch = [(k, r.choice(["P", "Q"]), f"n{r.randrange(8)}", r.choice([None, {}, {"role": f'"{k}"'}, {"team": f'"{k}"', "id": '"x"'}]), r.choice([None, 0.1, 1.0])) for k in range(40)]
    model = {}
    for lab, i, n, p, c, d in stored:
        if not d:
            model.setdefault((lab, n), [i, dict(p), c])
    made = set()
    for _, lab, n, p, c in batch:
        if (lab, n) not in model:
            made.add((lab, n))
        m = model.setdefault((lab, n), ["new", {}, None])
        m[1].update({k: v for k, v in (p or {}).items() if k != "id"})
        m[2] = m[2] if c is None else c
    got = mutate.upsert_vertices(vertices(spark, stored), spark.createDataFrame(batch, BATCH), AT).collect()
    touched = {(b[1], b[2]) for b in batch}
    assert {(g["label"], g["name"]) for g in got} == touched and len(got) == len(touched)
    for g in got:
        want = model[g["label"], g["name"]]
        assert (g["properties"], g["confidence"], g["created"]) == (want[1], want[2], (g["label"], g["name"]) in made)
        assert g["created"] or g["id"] == want[0]


def test_refused_rows_and_renaming(spark):
    rows = [(0, "P", "  ", None, None), (1, "Z", "a", None, None), (2, "P", "a", None, 1.5), (3, "P", "a", {"bad key": "1"}, None), (4, "P", " a ", None, 1.0), (5, None, None, None, None)]
    got = {r["ord"]: r["error"] for r in mutate.vertex_errors(spark.createDataFrame(rows, BATCH), ["P"]).collect()}
    assert got == {0: "Entity name cannot be empty", 1: 'Invalid entity type: "Z". Valid types: P', 2: "Confidence must be between 0.0 and 1.0", 3: "Invalid property key", 4: None, 5: "Entity name cannot be empty"}
    v = vertices(spark, [("P", "i", "a", {}, None, False)])
    assert mutate.upsert_vertices(v, spark.createDataFrame([(0, "P", "a", {"name": '"b"'}, None)], BATCH), AT).first()["name"] == "b"
    assert mutate.upsert_vertices(v, spark.createDataFrame([], BATCH), AT).count() == 0


def test_edges_and_transfer(spark):
    r = random.Random(7)
    ends = [(r.choice("KL"), f"v{r.randrange(6)}", f"v{r.randrange(6)}") for _ in range(25)]
    edges = spark.createDataFrame([(lab, f"e{k:02d}", a, b, {"x": str(k), "id": "q"}, T, None, k) for k, (lab, a, b) in enumerate(ends)], EDGE)
    batch = spark.createDataFrame([(k, *e, {"y": str(k)}) for k, e in enumerate(ends[:3] + [("K", "v0", "new")] * 2)], "ord int, label string, start_id string, end_id string, properties map<string,string>")
    got = mutate.upsert_edges(edges, batch, AT).collect()
    assert len(got) == len({*ends[:3], ("K", "v0", "new")}) and {(g["label"], g["start_id"], g["end_id"]) for g in got if g["created"]} == {("K", "v0", "new")}
    assert next(g for g in got if g["created"])["properties"] == {"y": "4"}
    pairs = spark.createDataFrame([("v0", "v1"), ("v0", "v2")], "surviving_id string, merged_id string")
    want = set()
    for lab, a, b in ends:
        if a != b:
            want |= {(lab, "v0", b)} if a in ("v1", "v2") else set()
            want |= {(lab, a, "v0")} if b in ("v1", "v2") else set()
    want = {w for w in want if w[1] != w[2]} - set(ends)
    moved = mutate.transferred_edges(Graph(edges, edges), pairs, AT).collect()
    assert {(m["label"], m["start_id"], m["end_id"]) for m in moved} == want and len(moved) == len(want) and all("id" not in m["properties"] for m in moved)


def test_references(spark):
    uuid = "0a0b0c0d-0000-4000-8000-0000000000ff"
    v = vertices(spark, [("P", uuid, "Ann", {}, None, False), ("P", "2", "Bob", {}, None, False), ("T", "3", "Bob", {}, None, False), ("P", "4", "Annabel Lee", {}, None, False), ("P", "5", "gone", {}, None, True)])
    batch = spark.createDataFrame([("Cy", "P", "b1"), ("Dee", "P", "b2"), ("Dee", "T", "b3")], "name string, label string, id string")
    refs = [(k, "from", ref, hint) for k, (ref, hint) in enumerate([("cy", None), ("dee", None), ("dee", "T"), (uuid.upper(), None), ("bob", None), ("bob", "T"), ("bel lee", None), ("gone", None), ("", None), (None, None), ("xx annabel lee xx", None)])]
    got = {r["index"]: r["id"] for r in mutate.resolve_references(spark.createDataFrame(refs, "index int, field string, ref string, hint string"), batch, v).collect()}
    assert got == {0: "b1", 1: None, 2: "b3", 3: uuid, 4: None, 5: "3", 6: "4", 7: None, 8: None, 9: None, 10: None}
    deleted = mutate.soft_delete(v, spark.createDataFrame([("2",), ("2",), ("5",), (None,)], "id string"), AT).collect()
    assert [(d["id"], d["deleted"]) for d in deleted] == [("2", True)]
