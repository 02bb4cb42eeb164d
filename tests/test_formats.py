"""Queries that write and read every text format, against DuckDB."""

import os

import duckdb
import pytest

from leafmill.plans import formats
from leafmill.sinks.registry import WRITERS
from leafmill.sources.registry import READERS


@pytest.mark.parametrize("name", sorted(formats.queries()))
def test_formats_match_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{os.path.join(sf, 'documents.parquet')}'")
    got = formats.queries()[name](spark, sf).collect()
    want = con.execute(formats.oracle_sql()[name])
    order = [d[0] for d in want.description]
    key = lambda r: tuple(str(x) for x in r)
    rows = sorted(key([r[c] for c in order]) for r in got)
    assert rows and rows == sorted(key(r) for r in want.fetchall())


def test_spellings_name_formats():
    assert {k for f in formats.WRITTEN.values() for k in f} <= set(WRITERS)
    assert {k for f in formats.READ.values() for k in f} | set(formats.ROUND) <= set(READERS)
