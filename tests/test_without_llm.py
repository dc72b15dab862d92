"""The library without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') for n in e.queries()))"


def listed(folder, keep_pipeline):
    folder.mkdir(parents=True)
    shutil.copytree(ROOT / "tradeq", folder / "tradeq", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", folder)
    if keep_pipeline:
        shutil.copy(ROOT / "corpus_pipeline.py", folder)
    done = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def test_other_queries_work_without_the_subpackage(tmp_path):
    for keep in (True, False):
        n, checks, training = listed(tmp_path / str(keep), keep)
        assert int(n) > 100 and int(checks) > 100 and training == "False"
