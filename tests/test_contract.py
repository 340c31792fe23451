"""The driver's contract, and the core without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert len(q) > 100 and set(o) <= set(q)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() >= 0


def test_core_does_not_import_llm():
    code = "import sys; import codonloom.plans.catalog as c; c.queries(); import codonloom.streaming.enrich, codonloom.sources.writers, codonloom.operators.models; sys.exit(any(m.startswith('codonloom.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0
