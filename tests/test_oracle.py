"""Every query with SQL equals its SQL over the smallest tables; the library works without its optional part."""

import os
import subprocess
import sys
from collections import Counter

import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def cell(x):
    if isinstance(x, float):
        return float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(cell, x))
    return x.replace(tzinfo=None) if getattr(x, "tzinfo", None) else x


@pytest.mark.skipif(not os.path.isdir(D), reason="no tables")
def test_queries_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in os.listdir(D):
        con.execute(f"CREATE VIEW {p[:-8]} AS SELECT * FROM '{D}/{p}'")
    queries, sql, bad = entry.queries(), entry.oracle_sql(), []
    assert set(sql) <= set(queries)
    for name, text in sql.items():
        df = queries[name](spark, D)
        cols = sorted(df.columns)
        got = Counter(tuple(cell(r[c]) for c in cols) for r in df.collect())
        r = con.execute(text)
        names = [c[0] for c in r.description]
        order = [names.index(c) for c in sorted(names)]
        want = Counter(tuple(cell(row[i]) for i in order) for row in r.fetchall())
        if sorted(names) != cols or got != want:
            bad.append((name, list((got - want).items())[:2], list((want - got).items())[:2]))
    assert not bad


def test_names_need_no_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 150 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_works_without_the_optional_part():
    code = "import sys; sys.modules['corpusmill.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p4_found' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
