import json
import random
import unicodedata

from factloom.llm import copies
from factloom.llm.copies import Copies, Trie

SCHEMA = "record_id long, graph_name string, name string, entity_type string, properties string, confidence double, first long, n int"


def form(r):
    bare = lambda x: None if x is None else "".join(c for c in x.lower() if unicodedata.category(c)[0] == "L" or unicodedata.category(c)[0] == "N")
    props = None if r[4] is None else tuple(sorted((bare(k), bare(v)) for k, v in json.loads(r[4]).items()))
    return r[1], bare(r[2]), bare(r[3]), props, r[5]


def brute(rows):
    groups = {}
    for r in rows:
        if r[0] is not None:
            groups.setdefault(form(r), []).append(r[0])
    return {(min(g), x) for g in groups.values() for x in g if x != min(g)}, {min(g): len(g) for g in groups.values()}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(copies, "BUCKET", 5)
    monkeypatch.setattr(copies, "TABLE", 7)
    r = random.Random(2)
    rows = []
    for k in range(500):
        name = r.choice(["Edge Gateway", "edge-GATEWAY!", " Edge gateway ", f"Name {r.randrange(40)}", f"name{r.randrange(40)}", "TEÁM", "team", None, "", "n" * 3000])
        props = r.choice([None, "{}", '{"a":"X 1","b":"y"}', '{"b" : "Y.",\n"A" : "x1"}', '{"a":"x","b":"1y"}', '{"a": null}'.replace("null", '""')])
        rows.append((k, r.choice(["g", "h"]), name, r.choice(["Team", "tEAM", None]), props, r.choice([0.5, None]), 1, 2))
    rows.append((None, "g", "x", "Team", None, 0.5, 1, 2))
    r.shuffle(rows)
    pairs, sizes = brute(rows)
    c = Copies(spark.createDataFrame(rows, SCHEMA))
    assert {tuple(x) for x in c.pairs().collect()} == pairs
    got = c.records().collect()
    assert {x["record_id"]: x["n_copies"] for x in got} == sizes and got[0]["first"] == 1


def test_one_form_holds_most(spark, monkeypatch):
    monkeypatch.setattr(copies, "BUCKET", 3)
    rows = [(k, "g", "Same  name" if k % 3 else f"other {k}", "T", None, None, 0, 0) for k in range(3000)]
    assert {tuple(x) for x in Copies(spark.createDataFrame(rows, SCHEMA).repartition(7)).pairs().collect()} == brute(rows)[0]


def test_empty_and_trie(spark):
    empty = Copies(spark.createDataFrame([], SCHEMA))
    assert empty.pairs().count() == 0 and empty.records().count() == 0
    t = Trie()
    places = [t.add(f, n, k) for k, (f, n) in enumerate([(b"", 1), (b"abc", 1), (b"abcdefgh", 1), (b"abcdefghi", 1), (b"abc", 3)])]
    assert places == [0, 1, 2, 3, 1] and t.n == [1, 4, 1, 1] and t.least == [0, 1, 2, 3]
