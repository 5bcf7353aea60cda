"""The entry module: names, SQL keys, and that the core stands without its subpackage."""

import ast
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_never_imports_the_subpackage():
    for p in (ROOT / "spanweave").rglob("*.py"):
        if "llm" in p.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or "", *(a.name for a in node.names)] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), p
