"""The core stands without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_the_entry_imports_without_the_subpackage():
    code = """
import sys
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name == "weftgraph.llm" or name.startswith("weftgraph.llm."):
            raise ModuleNotFoundError(f"No module named {name!r}", name="weftgraph.llm")
sys.meta_path.insert(0, Hide())
import __spark_entry__ as e
names = e.queries()
assert "p1_found" in names and not any(n[:2] in ("p5", "p6", "p7", "p8") for n in names), sorted(names)
assert set(e.oracle_sql()) <= set(names)
"""
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


def test_nothing_outside_imports_the_subpackage():
    for f in (REPO / "weftgraph").rglob("*.py"):
        if "llm" not in f.relative_to(REPO).parts:
            assert "weftgraph.llm" not in f.read_text(), f
