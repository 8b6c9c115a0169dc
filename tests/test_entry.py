import importlib
import re
import sys

import __spark_entry__ as entry


def test_queries_and_sql_agree():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100


def test_rest_stands_without_llm(monkeypatch):
    for m in [m for m in sys.modules if m.startswith("corpusloom.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "corpusloom.llm.queries", None)
    names = importlib.reload(entry).queries()
    assert "p4_found" in names and not any(re.match(r"p[1235678]_", n) for n in names)
    monkeypatch.undo()
    importlib.reload(entry)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "snippet" in df.columns
