"""The driver's contract, with the training-data subpackage and without it."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(n.startswith('op') for n in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"


def shown(folder):
    return subprocess.run([sys.executable, "-B", "-c", SHOW], cwd=folder, capture_output=True, text=True, check=True).stdout.split()


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "ragloom", tmp_path / "ragloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    n, sql, ops, known = shown(tmp_path)
    assert int(n) >= 85 and int(n) - int(sql) <= 3 and int(ops) == 0 and known == "True"


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "ragloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"(from|import) [.\w]*llm", path.read_text()), path
