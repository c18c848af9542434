import ast
import pathlib
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_core_runs_without_text_subpackage():
    code = "import sys; sys.modules['ravelin.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and not any(k.startswith(('p6', 'p7', 'p8')) for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_imports_the_text_subpackage():
    for f in (ROOT / "ravelin").rglob("*.py"):
        if f.parent.name == "llm":
            continue
        for node in ast.walk(ast.parse(f.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), f


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert not e.entry.__doc__ is None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["node_id", "direction"]
