import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_every_sql_belongs_to_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_graph_queries_all_have_sql():
    from larkspur.plans import catalog

    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_without_the_corpus_part(tmp_path):
    shutil.copytree(ROOT / "larkspur", tmp_path / "larkspur", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pagerank_trade_10' in q and not any(n.startswith('op') or n == 'pipeline' for n in q) and set(e.oracle_sql()) <= set(q)"
    for extra in (None, ROOT / "corpus_pipeline.py"):
        if extra and extra.exists():
            shutil.copy(extra, tmp_path)
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["vertex", "rank"]
