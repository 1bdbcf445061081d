"""Every query against its SQL on the smallest tables; the library without the optional subpackage."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry_module

DATA = "/root/testdata/sf0.001"
HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def cells(rows):
    return sorted(str([None if x is None or x != x else (round(x, 9) + 0.0 if isinstance(x, float) else x) for x in r]) for r in rows)


def core(names):
    llm = set(getattr(sys.modules.get("quillstone.llm.queries"), "QUERIES", {}))
    return [n for n in names if n not in llm]


@pytest.mark.parametrize("name", core(entry_module.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    mine = entry_module.queries()[name](spark, DATA)
    cols = sorted(mine.columns)
    theirs = c.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in theirs.description]
    assert sorted(names) == cols
    want = [[r[names.index(k)] for k in cols] for r in theirs.fetchall()]
    assert cells(want) == cells([[r[k] for k in cols] for r in mine.collect()])


@pytest.mark.parametrize("name", [n for n in core(entry_module.queries()) if n not in entry_module.oracle_sql()])
def test_query_runs(spark, name):
    assert entry_module.queries()[name](spark, DATA).count() >= 0


def test_flagship(spark):
    assert entry_module.entry(spark).count() > 0


def test_imports_without_the_optional_subpackage():
    code = "import sys; sys.modules['quillstone.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p3_found' in q and 'p6_ids' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=HERE, check=True)
