import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
LIST = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(n.startswith('op') for n in q))"


def _counts(folder: Path) -> list[int]:
    out = subprocess.run([sys.executable, "-c", LIST], cwd=folder, capture_output=True, text=True, check=True)
    return list(map(int, out.stdout.split()))


def test_the_corpus_part_can_be_deleted(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    shutil.copytree(ROOT / "halocline", tmp_path / "halocline", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    assert _counts(tmp_path)[1] == 0
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    assert _counts(tmp_path)[0] > 90


def test_other_import_errors_are_not_swallowed(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "halocline", tmp_path / "halocline", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    (tmp_path / "halocline/llm").mkdir()
    (tmp_path / "halocline/llm/__init__.py").write_text("")
    (tmp_path / "halocline/llm/queries.py").write_text("import no_such_package\n")
    out = subprocess.run([sys.executable, "-c", LIST], cwd=tmp_path, capture_output=True, text=True, check=False)
    assert out.returncode and "no_such_package" in out.stderr
