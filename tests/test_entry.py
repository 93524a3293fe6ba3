"""The driver's contract."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_registry():
    import __spark_entry__ as e

    assert len(e.queries()) > 120 and set(e.oracle_sql()) <= set(e.queries()) and "p1_found" in e.oracle_sql()


def test_imports_without_the_optional_package():
    code = "import sys; sys.modules['netloom.llm'] = None; import __spark_entry__ as e; assert 'p1_found' in e.queries() and 'p3_found' not in e.queries() and 'p3_found' not in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_the_optional_package():
    for p in (ROOT / "netloom").rglob("*.py"):
        assert "llm" in p.parts or "netloom.llm" not in p.read_text(), p
