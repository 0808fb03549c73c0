import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [["ashlar/llm", "tests/llm"], ["ashlar/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_without_the_subpackage(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        p = copy / name
        if p.is_dir():
            shutil.rmtree(p)
        elif p.exists():
            p.unlink()
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'latest_price_per_unit' in q and 'pipeline' not in q and set(s) <= set(q)"
    for path in (None, str(ROOT)):  # nothing may come from elsewhere, even if it could be found there
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | ({"PYTHONPATH": f"{copy}:{path}"} if path and "ashlar/llm" not in gone else {})
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=env)


def test_nothing_else_imports_it():
    files = [p for p in (ROOT / "ashlar").rglob("*.py") if "llm" not in p.relative_to(ROOT / "ashlar").parts]
    assert files and not [p for p in files if re.search(r"^\s*(from|import)\b.*\b(llm|corpus_pipeline)\b", p.read_text(), re.M)]
