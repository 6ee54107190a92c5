import re
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).resolve().parent


def test_nothing_imports_the_llm_subpackage():
    for path in (ROOT / "folioscan").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import) folioscan\.llm", path.read_text(), re.M), path


def test_queries_and_sql_go_together():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 40


def test_entry(spark):
    assert entry.entry(spark).columns == ["key_field", "key_id"]
