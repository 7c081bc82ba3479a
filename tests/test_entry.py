"""The engine without the corpus operators: folders and pipeline removed."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_the_corpus_operators(tmp_path):
    shutil.copytree(f"{ROOT}/presswire", tmp_path / "presswire", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bias_spread_by_story' in q and 'pipeline' not in q and not any(k.startswith('op1') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path), "PYTHONPATH": ""}, timeout=120)


def test_nothing_else_imports_them():
    found = subprocess.run(["grep", "-rlE", "(from|import) presswire.llm|corpus_pipeline", f"{ROOT}/presswire", "--include=*.py"], capture_output=True, text=True).stdout.split()
    assert all(f.startswith(f"{ROOT}/presswire/llm/") for f in found)
