"""Queries over pages with references that no semicolon closes, against DuckDB."""

import duckdb
import pytest

from leafmill import engine
from leafmill.plans import queries as plans

HEADINGS = ["cut&amp", "&amp;&amp; a&amp;b &lt;c&gt", "d &quot;e&quot; &lt", "&amp;amp f & g&amp;lt;", "cut&amp;"]


@pytest.mark.parametrize("name", ["page_headings", "heading_identifiers", "heading_identifiers_gfm", "unique_heading_identifiers", "page_chunk_paths", "page_toc"])
def test_open_references_match_sql(spark, tmp_path, name):
    rows = [(k, f"http://example.com/{k}", f'<html lang="en"><head><title>t</title></head><body><article><h1>{h}</h1><p>text</p></article></body></html>') for k, h in enumerate(HEADINGS)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(plans.oracle_sql()[name])
    order = [d[0] for d in want.description]
    key = lambda r: tuple(str(x) for x in r)
    got = sorted(key([r[c] for c in order]) for r in plans.queries()[name](spark, str(tmp_path)).collect())
    assert got and got == sorted(key(r) for r in want.fetchall())


def test_open_references_only_where_asked():
    page = '<p title="a&amp">b&amp c&lt;d &#65; &#66</p><script type="math/tex">x & y</script>'
    told = lambda name: [x["c"] if x["t"] == "Str" else x["c"][1] for x in engine.reader(name)(page)["blocks"][0]["c"] if x["t"] in ("Str", "Math")]
    assert told("html") == ["b&", "c<d", "A", "B"]
    assert told("html-open_references") == ["b&amp", "c<d", "A", "&#66"]
