import ast
from pathlib import Path

import __spark_entry__ as entry

HERE = Path(__file__).resolve().parent.parent


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["c_name", "order_name", "others"] and df.count() > 0


def test_every_workload_query_has_sql():
    assert set(entry.QUERIES) == set(entry.SQL) and set(entry.SQL) <= set(entry.oracle_sql())


def test_the_library_imports_nothing_of_llm():
    for path in (HERE / "skeinql").rglob("*.py"):
        if "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n for n in names), path
