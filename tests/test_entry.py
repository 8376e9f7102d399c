import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def names(at):
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    return subprocess.run([sys.executable, "-c", code], cwd=at, capture_output=True, text=True, check=True).stdout.split()


def test_every_operator_has_one_query():
    found = names(ROOT)
    if (ROOT / "marginalia/llm").exists():
        assert [n.split("_")[0] for n in found if n.startswith("op")].count("op1") == 1
        assert {n.split("_")[0] for n in found if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in found


def test_the_rest_works_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "marginalia", tmp_path / "marginalia", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    found = names(tmp_path)
    assert "hybrid_search" in found and not [n for n in found if n.startswith("op") or n == "pipeline"]
    assert not [p for p in (tmp_path / "marginalia").rglob("*.py") if "llm" in p.read_text()]
