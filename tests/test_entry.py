"""The driver's entry points, also without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "rank", "score"] and df.count() > 0


def test_every_statement_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_alone(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "lectern", tmp_path / "lectern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), any(k.startswith('op') for k in q))"], cwd=tmp_path, env={"PATH": "/usr/bin"}, capture_output=True, text=True, check=True)
    n, with_sql, optional = said.stdout.split()
    assert int(n) > 50 and int(with_sql) > 50 and optional == "False"
