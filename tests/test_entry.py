"""The entry module: its three functions, and that it works without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).resolve().parent


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["doc_id", "score"] and found.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_subpackage(tmp_path):
    for name in ("lorekeep", "__spark_entry__.py"):
        src = ROOT / name
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if src.is_dir() else shutil.copy(src, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(k.startswith('op') for k in q) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1", "PYTHONPATH": ":".join(p for p in sys.path if "site-packages" in p)})
