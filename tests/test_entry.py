"""The entry points, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__

ROOT = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
ASK = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), set(e.oracle_sql()) <= set(e.queries()), 'pipeline' in e.queries())"


def ask(folder):
    out = subprocess.run([sys.executable, "-B", "-c", ASK], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr
    n, sql, within, pipeline = out.stdout.split()
    return int(n), int(sql), within == "True", pipeline == "True"


@pytest.mark.parametrize("gone", [("loomwright/llm",), ("loomwright/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_library_stands_without_the_subpackage(tmp_path, gone):
    from loomwright.plans import catalogue  # noqa: F401
    from loomwright.registry import QUERIES, SQL

    shutil.copytree(f"{ROOT}/loomwright", tmp_path / "loomwright", ignore=shutil.ignore_patterns("__pycache__"))
    for f in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{f}"):
            shutil.copy(f"{ROOT}/{f}", tmp_path / f)
    for f in gone:
        path = tmp_path / f
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)
    n, sql, within, pipeline = ask(tmp_path)
    assert within and not pipeline
    if "loomwright/llm" in gone:
        assert (n, sql) == (len(QUERIES), len(SQL))


def test_entry(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert __spark_entry__.entry(spark).count() > 0
