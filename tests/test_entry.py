"""The driver contract without the corpus operators' libraries."""

import os
import subprocess
import sys

import pytest

from aislelens.plans import catalog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("hidden", ["zstandard", "xxhash", "tokenizers", "corpus_pipeline", "aislelens.llm"])
def test_retail_queries_stay_where_a_corpus_library_is_missing(hidden):
    code = f"import sys; sys.modules[{hidden!r}] = None; import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    names, sql = (set(line.split()) for line in done.stdout.splitlines())
    assert names == sql == set(catalog.JOBS)
