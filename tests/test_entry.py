import importlib

import __spark_entry__ as entry


def test_contract(spark):
    assert entry.entry(spark).columns == ["fact_id", "root_id"]
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and {f"p{k}_found" for k in (1, 2, 3)} <= set(queries)


def test_core_stands_alone():
    import ast
    from pathlib import Path

    root = Path(entry.__file__).parent / "factloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            tree = ast.parse(p.read_text())
            named = [getattr(n, "module", None) or "" for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)] + [a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names]
            assert not [m for m in named if "llm" in m], p
    assert importlib.import_module("factloom.plans.records").queries()
