"""The entry points, with and without the parts that may be taken away."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
PROBE = "import __spark_entry__ as e; print(sorted(e.queries())); print(sorted(e.oracle_sql()))"


def names(folder):
    said = subprocess.run([sys.executable, "-B", "-c", PROBE], cwd=folder, capture_output=True, text=True, check=True).stdout.splitlines()
    return [set(eval(line)) for line in said[-2:]]


def test_entry_without_optional_parts(tmp_path):
    for part in ("__spark_entry__.py", "cadentia"):
        copy = shutil.copytree if (ROOT / part).is_dir() else shutil.copy
        copy(ROOT / part, tmp_path / part)
    (tmp_path / "corpus_pipeline.py").write_text("from cadentia.llm import nothing_of_the_kind\n")
    shutil.rmtree(tmp_path / "cadentia" / "llm", ignore_errors=True)
    queries, sql = names(tmp_path)
    assert "score_final" in queries and sql <= queries and not any(q.startswith("op") for q in queries) and "pipeline" not in queries
    (tmp_path / "corpus_pipeline.py").unlink()
    assert names(tmp_path) == [queries, sql]
