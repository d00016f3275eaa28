"""The driver's contract, with and without the subpackage for training data."""

import os
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_subpackage():
    code = "import sys; sys.modules['lattica.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 80 and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
