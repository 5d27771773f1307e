"""The library without the training-data operators: the entry module still imports and keeps all other queries."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def test_entry_without_llm(tmp_path):
    from tarmac.oracle.queries import all_oracles
    from tarmac.registry import all_queries

    shutil.copytree(os.path.join(ROOT, "tarmac"), tmp_path / "tarmac",
                    ignore=lambda folder, names: {"llm", "__pycache__"} & set(names))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    out = subprocess.run([sys.executable, "-c", LIST], cwd=tmp_path, capture_output=True, text=True, timeout=120, check=True,
                         env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    queries, oracles = (set(line.split()) for line in out.stdout.splitlines())
    assert queries == set(all_queries()) and oracles == set(all_oracles())
