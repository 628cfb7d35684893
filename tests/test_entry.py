import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_registry_is_consistent():
    every, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(every)
    assert len(every) > 25


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_flagship_returns_rows(spark):
    got = entry.entry(spark).collect()
    assert got and [r["rank"] for r in got] == list(range(1, len(got) + 1))


def test_library_works_without_the_optional_part():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(('lodestone.llm', 'corpus_pipeline')):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import importlib.util
real = importlib.util.find_spec
importlib.util.find_spec = lambda name, *a: None if name.startswith('lodestone.llm') else real(name, *a)
import __spark_entry__ as e
assert 'search_topk' in e.queries() and not any(n.startswith('op') and n[2:3].isdigit() for n in e.queries()) and 'pipeline' not in e.queries()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
