"""The driver contract, with and without the optional parts."""

import subprocess
import sys

import __spark_entry__


def test_names_match():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_without_optional_parts():
    code = "import sys\nfor m in ('factloom.llm', 'corpus_pipeline'): sys.modules[m] = None\nimport __spark_entry__ as e\nq = e.queries()\nassert 'heatmap' in q and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
