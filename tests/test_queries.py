"""Every query of the change-tracking part against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tidemark.plans import field_queries, queries as Q, store_queries  # noqa: F401

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return repr(round(float(value), 6))
    return str(value).removesuffix(" 00:00:00")


def lines(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(row[k]) for k in order) for row in rows)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_equals_its_sql(spark, connection, name):
    got = Q.QUERIES[name](spark, str(DATA))
    wanted = connection.execute(Q.ORACLE_SQL[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(columns) == sorted(got.columns)
    assert lines(got.columns, got.collect()) == lines(columns, wanted.fetchall())


def test_text_of_entities_without_semicolon_equals_its_sql(spark, tmp_path):
    pages = [(1, "<p>a&&amp{b}&ampp</p>"), (2, "&eacute;&lt &amp;lt;&nbsp;&#39;"), (3, "<li>&amp;amp;</li>\u00a0"), (4, "&nbsp;"), (5, None)]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
        wanted = con.execute(Q.ORACLE_SQL["html_to_text"]).fetchall()
    assert sorted(tuple(r) for r in Q.QUERIES["html_to_text"](spark, str(tmp_path)).collect()) == sorted(wanted)
