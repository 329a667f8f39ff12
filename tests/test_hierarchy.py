import random

import pytest

from factloom.operators import hierarchy
from factloom.operators.hierarchy import Hierarchy, find_roots


def brute(rows):
    """Roots by following the links one at a time."""
    clean = lambda x: (x.strip().lower() or None) if x is not None else None
    ids, up = set(), {}
    for i, p in rows:
        if clean(i):
            ids.add(clean(i))
            if clean(p):
                up[clean(i)] = max(clean(p), up.get(clean(i), ""))
    up = {c: p for c, p in up.items() if p in ids}
    root, path, ring = {}, {}, set()
    for c in ids:
        walk, x = [c], c
        while x in up and up[x] not in walk:
            x = up[x]
            walk.append(x)
        if x in up:
            circle = walk[walk.index(up[x]):]
            root[c] = min(circle)
            ring |= set(circle)
            if root[c] in walk:
                walk = walk[: walk.index(root[c]) + 1]
            else:
                raise AssertionError
        else:
            root[c] = x
        path[c] = walk
    return up, root, path, ring


def forest(n, seed, hot=False):
    r = random.Random(seed)
    names = [f"n{k:05d}" for k in range(n)]
    rows = []
    for k, name in enumerate(names):
        x = r.random()
        if hot and x < 0.4:
            parent = names[0] if k else None
        elif x < 0.3:
            parent = names[k - 1] if k else None  # chains
        elif x < 0.7:
            parent = r.choice(names)  # may close circles
        elif x < 0.75:
            parent = "missing"
        elif x < 0.8:
            parent = r.choice([" ", "", name])  # blank, itself
        else:
            parent = None
        rows.append((name, parent))
        if r.random() < 0.2:
            rows.append((f" {name.upper()} ", None))
        if r.random() < 0.1:
            rows.append((name, parent and f"{parent.upper()}\t"))
    return rows + [(None, names[0]), ("", None)]


@pytest.mark.parametrize("seed,hot,local", [(1, False, 1 << 15), (2, True, 4), (3, False, 4)])
def test_against_walks(spark, monkeypatch, seed, hot, local):
    monkeypatch.setattr(hierarchy, "LOCAL_ELEMENTS", local)
    monkeypatch.setattr(hierarchy, "HOT_LEAST", 20)
    monkeypatch.setattr(hierarchy, "HOT_SHARE", 0.05)
    rows = forest(300, seed, hot)
    up, root, path, ring = brute(rows)
    df = spark.createDataFrame(rows, "id string, superseded_by string")
    assert sorted(map(tuple, find_roots(df).collect())) == sorted((c, root[c]) for c in up)
    h = Hierarchy(df)
    got = {r["fact_id"]: r for r in h.nodes().collect()}
    assert set(got) == set(root)
    assert {c: r["root_id"] for c, r in got.items()} == root
    assert {c for c, r in got.items() if r["in_cycle"]} == ring
    assert {c: r["depth"] for c, r in got.items()} == {c: len(p) - 1 for c, p in path.items()}
    below = {c: {d for d, p in path.items() if c in p[1:]} for c in root}
    assert {c: r["n_descendants"] for c, r in got.items()} == {c: len(b) for c, b in below.items()}
    for c, r in got.items():  # the interval holds exactly the descendants
        assert {d for d, x in got.items() if x["root_id"] == r["root_id"] and r["entry"] < x["entry"] <= r["exit"]} == below[c]
    assert {r["fact_id"]: r["path"] for r in h.paths().collect()} == path


def test_long_chain(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "LOCAL_ELEMENTS", 50)
    rows = [(f"c{k:05d}", f"c{k + 1:05d}") for k in range(3000)] + [("c03000", None)]
    got = find_roots(spark.createDataFrame(rows, "id string, superseded_by string")).collect()
    assert len(got) == 3000 and {r["root_id"] for r in got} == {"c03000"}


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], "id string, superseded_by string, num long, child string")
    assert find_roots(empty).count() == 0 and Hierarchy(empty).nodes().count() == 0 and Hierarchy(empty).paths().count() == 0
    rows = [("a", "b", 7, "x"), ("b", None, 7, "x")]
    got = find_roots(spark.createDataFrame(rows, "id string, superseded_by string, num long, child string"))
    assert got.columns == ["fact_id", "root_id"] and [tuple(r) for r in got.collect()] == [("a", "b")]


def test_uuid_ids_keep_their_text(spark):
    a, b = "0a0b0c0d-0000-4000-8000-0000000000ff", "ffffffff-0000-4000-8000-000000000001"
    rows = [(f" {a.upper()} ", b), (b, None)]
    assert [tuple(r) for r in find_roots(spark.createDataFrame(rows, "id string, superseded_by string")).collect()] == [(a, b)]


def test_descendants_are_those_counted(spark, tmp_path):
    from factloom.plans import records

    rows = [("a", None), ("b", "A "), ("c", "b"), ("d", "a"), ("x", "y"), ("y", "x"), ("z", "y"), ("lone", "nowhere")]
    spark.createDataFrame(rows, "id string, superseded_by string").write.parquet(str(tmp_path / "facts.parquet"))
    got = [tuple(r) for r in records.queries()["p1_descendants"](spark, str(tmp_path)).select("fact_id", "descendant_id").collect()]
    assert sorted(got) == [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("x", "y"), ("x", "z"), ("y", "z")]
    counts = {r["fact_id"]: r["n_descendants"] for r in records.queries()["p1_hierarchy"](spark, str(tmp_path)).collect()}
    assert counts == {i: sum(a == i for a, _ in got) for i, _ in rows}
