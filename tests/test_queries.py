"""Every registered query of the library against its SQL in DuckDB."""

import os
import re
from html import unescape

import duckdb
import pytest

from lorewell.plans import registry, wiki, wiki_sql

QUERIES = registry.QUERIES | wiki.QUERIES
ORACLE_SQL = registry.ORACLE_SQL | wiki_sql.ORACLE_SQL
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, frame.astype(object).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.execute(ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got)
    assert rows(got) == rows(want)


def test_page_articles_hold_the_words_of_their_article(spark, duck):
    """Brute force: the article element cut from the markup, tags and code removed, references decoded."""
    html = {i: h for i, h in duck.execute("SELECT page_id, html FROM pages").fetchall()}
    got = QUERIES["page_articles"](spark, SF).collect()
    assert len(got) == len(html)
    for r in got:
        inside = re.search(r"(?s)<article[^>]*>(.*?)</article>", html[r.page_id]).group(1)
        inside = re.sub(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1>", "", inside)
        assert r.main_content.split() == unescape(re.sub("<[^>]*>", " ", inside)).split()
